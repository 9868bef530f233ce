"""Hot keys, bounds and stored settings."""

import random

import pytest
from pyspark.sql import functions as F

from lumatrace.operators import bands, graph, results, similar
from lumatrace.plans import config, pipeline, scratch, skew
from lumatrace.sources import tables


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def near_hashes(n, seed):
    r = random.Random(seed)
    base = r.getrandbits(64)
    rows = []
    for i in range(n):
        h = base
        for b in r.sample(range(64), r.randint(0, 3)):
            h ^= 1 << b
        rows.append((i, h if i % 3 else r.getrandbits(64)))
    return rows


@pytest.mark.parametrize("hot", [3, 10_000])
def test_pairs_of_hot_buckets(spark, monkeypatch, hot):
    monkeypatch.setattr(bands, "HOT", hot)
    rows = near_hashes(150, 3)
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    want = {(min(a, b), max(a, b)) for g, a in first.items() for h, b in first.items() if a < b and (g ^ h).bit_count() <= 3}
    df = spark.createDataFrame([(i, signed(h)) for i, h in rows], "id bigint, h bigint")
    got = bands.banded_pairs(df, "id", "h", 3, "all_pairs").collect()
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want)


def test_lookup_is_the_same_for_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hub" if i % 2 else f"k{i}") for i in range(300)], "i int, k string")
    table = spark.createDataFrame([("hub", 1), ("k4", 2), ("other", 3)], "k string, v int")
    plain = {tuple(r) for r in skew.lookup(rows, "k", table, "v", 300).select("i", "k", "v").collect()}
    assert {tuple(r) for r in skew.lookup(rows, "k", table, "v", 300, hot=5).select("i", "k", "v").collect()} == plain
    assert len(plain) == 300 and (4, "k4", 2) in plain and (2, "k2", None) in plain


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    monkeypatch.setattr(graph, "HOT", 10)
    edges = [("hub", f"leaf{i:03d}") for i in range(200)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("loop", "loop"), (None, "x")]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert {got[f"leaf{i:03d}"] for i in range(200)} == {"hub"} and {got[f"c{i:03d}"] for i in range(61)} == {"c000"} and got["loop"] == "loop" and None not in got


def test_components_far_across_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 20)
    tables, write = [], graph.materialize

    def counted(df, label):
        tables.append(label)
        assert len(tables) <= 40  # a label for each step of the way would be hundreds
        return write(df, label)

    monkeypatch.setattr(graph, "materialize", counted)
    names = [f"n{i:03d}" for i in range(300)]
    random.Random(4).shuffle(names)
    edges = [*zip(names, names[1:], strict=False), ("x1", "x0"), ("only", "only"), ("x1", None)]
    got = {(r.node, r.component) for r in graph.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {(n, "n000") for n in names} | {("x0", "x0"), ("x1", "x0"), ("only", "only")}


def test_components_whose_hashes_meet(spark, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 1)
    whole = F.xxhash64
    monkeypatch.setattr(graph.F, "xxhash64", lambda salt, c: whole(salt, c) if "1" in str(salt) else whole(salt))
    edges = [("a", "b"), ("c", "d"), ("d", "e")]
    got = {(r.node, r.component) for r in graph.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")}


def test_comparing_all_has_a_bound(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id bigint, embedding array<float>")
    exact = {tuple(r) for r in similar.neighbours(v, 3).select("id", "other").collect()}
    monkeypatch.setattr(similar, "INDEX_THRESHOLD", 30)
    with pytest.raises(ValueError, match="too many"):
        similar.knn_exact(v)
    found = {tuple(r) for r in similar.neighbours(v, 3, "exhaustive").select("id", "other").collect()}
    assert found == exact


def test_results_are_stored_by_group(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 9).alias("group_id"), F.col("id").cast("string").alias("path"), (F.col("id") < 9).alias("is_best"), F.lit(0).alias("distance"), F.lit(5).alias("file_size"), F.lit(None).cast("string").alias("channel"))
    tables.write_results(rows, str(tmp_path / "r"), buckets=4)
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.count() == 200 and results.fetch_group(back, 3).first().is_best
    assert results.report_pages(back, max_visuals=2).select("group_id").distinct().count() == 2


def test_settings_are_kept(tmp_path):
    c = config.ScanConfig("/lib", channels=("R",), similarity=80.0)
    config.save(c, str(tmp_path / "s.json"))
    assert config.load(str(tmp_path / "s.json")) == c
    (tmp_path / "old.json").write_text('{"folder": "/x", "threshold": 70.0, "gone": 1}')
    assert config.load(str(tmp_path / "old.json")).similarity == 70.0


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(Session())


def test_a_scan_of_nothing(spark):
    schema = "path string, channel string, file_size bigint, resolution_w int, resolution_h int, capture_date double, format_str string, hash string"
    assert pipeline.duplicate_scan(config.ScanConfig("/"), spark.createDataFrame([], schema)).count() == 0


def test_stores_of_other_models_are_cleared(spark, tmp_path):
    for name in ("a_old", "a_new"):
        (tmp_path / name).mkdir()
    assert tables.clear_store(spark, str(tmp_path), keep="a_new") == ["a_old"]
    assert [p.name for p in tmp_path.iterdir()] == ["a_new"] and tables.clear_store(spark, str(tmp_path / "none")) == []
