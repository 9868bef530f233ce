"""Grid components and survivorship."""

import random
from datetime import datetime

import numpy as np
import pytest

from lumatrace.llm import components, survivorship

EDGES = "path1 string, channel1 string, path2 string, channel2 string, method string, distance double, node string, root string, key string"


def groups_by_hand(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    key = lambda p, c: p.replace("\\", "/") + ("" if c in (None, "", "RGB", "Composite") else "|" + c)
    for r in rows:
        if r[0] is not None and r[2] is not None:
            a, b = find(key(r[0], r[1])), find(key(r[2], r[3]))
            if a != b:
                up[max(a, b)] = min(a, b)
    size = {}
    for x in up:
        size[find(x)] = size.get(find(x), 0) + 1
    return {(find(x), x) for x in up if size[find(x)] > 1}


def edges(seed, n=300, nodes=200):
    r = random.Random(seed)
    node = lambda: (f"C:\\a\\{r.randint(0, nodes)}" if r.random() < 0.5 else f"C:/a/{r.randint(0, nodes)}", r.choice([None, "", "RGB", "Composite", "R", "Luminance"]))
    rows = [(*node(), *node()) for _ in range(n)]
    rows += [(f"p{i:04d}", None, f"p{i + 1:04d}", None) for i in range(150)]  # a long path
    rows += [("hub", "A", f"leaf{i}", None) for i in range(120)]
    rows += [("self", None, "self", ""), (None, None, "x", None), ("y", None, None, None), ("Case", None, "case", None)]
    r.shuffle(rows)
    return [(*x, "AI", 0.1, "n", "r", "k") for x in rows + rows[:20]]


@pytest.mark.parametrize("cell", [40, 1_000_000])
def test_groups_match_union_find(spark, monkeypatch, cell):
    monkeypatch.setattr(components, "CELL", cell)
    rows = edges(3)
    got = components.match_groups(spark.createDataFrame(rows, EDGES)).collect()
    assert len(got) == len({r.member_key for r in got})
    assert {(r.group_key, r.member_key) for r in got} == groups_by_hand(rows)


def test_keys_are_written_as_stated(spark):
    rows = [("a\\b.png", None, "a/c.png", "R"), ("a/c.png", "R", "d.png", "RGB"), ("d.png", "", "e.png", "Composite"), ("a/b.png", "Luminance", "e.png", "G")]
    got = components.match_groups(spark.createDataFrame([(*r, "AI", 0.1, "n", "r", "k") for r in rows], EDGES)).collect()
    assert {tuple(r) for r in got} == {("a/b.png", k) for k in ("a/b.png", "a/c.png|R", "d.png", "e.png")} | {("a/b.png|Luminance", k) for k in ("a/b.png|Luminance", "e.png|G")}


def test_hubs_and_giants_are_looked_up_in_place(spark, monkeypatch):
    monkeypatch.setattr(components, "CELL", 30)
    monkeypatch.setattr(components, "HOT", 5)
    rows = edges(8) + [("hub", "A", f"far{i}", "B", "AI", 0.1, "n", "r", "k") for i in range(300)]
    got = components.match_groups(spark.createDataFrame(rows, EDGES)).collect()
    assert {(r.group_key, r.member_key) for r in got} == groups_by_hand(rows)


def test_groups_of_nothing(spark):
    assert components.match_groups(spark.createDataFrame([], EDGES)).count() == 0
    assert components.match_groups(spark.createDataFrame([(None,) * 9], EDGES)).count() == 0


def test_local_union_find():
    v, r = components.local_roots(np.array([5, 1, 9, 9]), np.array([1, 7, 9, 8]))
    assert dict(zip(v.tolist(), r.tolist())) == {5: 1, 7: 1, 9: 8}


ROWS = "group_id bigint, path string, resolution_w int, resolution_h int, file_size bigint, bit_depth int, observed_at timestamp_ntz, is_best boolean, present string, best string"


def t(day):
    return datetime(2025, 1, day)


def test_each_field_survives_by_itself(spark):
    rows = [
        (1, "b", 100, 100, None, 8, t(1), True, "x", "y"),
        (1, "b", 200, None, 10, 0, t(2), None, "x", "y"),  # half a resolution and no depth: these stay as before
        (1, "b", 50, 50, -1, 16, t(3), None, "x", "y"),
        (1, "b", 50, 50, -1, 16, t(3), None, "x", "y"),
        (1, "a", None, None, None, None, None, None, None, None),
        (2, "z", 10, 10, 5, 8, t(1), None, None, None),
        (2, "y", 10, 10, 5, 8, t(1), None, None, None),
        (2, "w", 10, 10, 4, 8, t(1), None, None, None),
        (3, "big", 100_000, 100_000, 1, 8, t(1), None, None, None),
        (3, "c", 100_000, 99_999, 9, 32, t(1), None, None, None),
        (None, "q", 1, 1, 1, 1, t(1), None, None, None),
        (4, None, 1, 1, 1, 1, t(1), None, None, None),
    ]
    df = spark.createDataFrame(rows, ROWS)
    files = {(r.group_id, r.path): tuple(r)[2:] for r in survivorship.surviving_files(df).collect()}
    assert files[(1, "b")] == (50, 50, 10, 16)
    assert files[(1, "a")] == (None, None, None, None)
    best = {r.group_id: r.path for r in survivorship.best_files(df).collect()}
    assert best == {1: "b", 2: "y", 3: "big"}
    assert survivorship.best_files(spark.createDataFrame([], ROWS)).count() == 0


def test_priority_comes_before_time(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("k", 1, 1, "old trusted"), ("k", 0, 9, "new"), ("k", 2, 9, None)], "k string, p int, at int, v string")
    out = survivorship.surviving_records(df, ["k"], {"v": F.col("v")}, {"v": F.col("v").isNotNull()}, F.col("at"), F.col("p")).first()
    assert out.v == "old trusted"
