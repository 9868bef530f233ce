"""Batch dedup and near-duplicate pairs against brute force."""

import random
import re

import pytest

from lumatrace.llm import batch_dedup, buckets, near_duplicates

SCHEMA = "item_id bigint, path string, analysis_type string, phash bigint, dhash bigint, whash bigint, xxhash string, batch_no int, kind string, rep string, links string"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def flip(r, x, n):
    for b in r.sample(range(64), n):
        x ^= 1 << b
    return x


def make(n, seed, spread=12, hot=0):
    """Rows around a few prototypes, with nulls, redeliveries, spellings and copies; the last columns clash with inner names."""
    r = random.Random(seed)
    protos = [tuple(r.getrandbits(64) for _ in range(4)) for _ in range(max(2, n // 6))]
    rows = []
    for i in range(n):
        p, d, w, x = protos[0] if i < hot else r.choice(protos)
        p, d, w = flip(r, p, r.randint(0, spread)), flip(r, d, r.randint(0, spread)), flip(r, w, r.randint(0, 6))
        text = r.choice([f"{x:016x}", f"0x{x:016X}", f" {x:016x} ", f"{r.getrandbits(64):016x}", None, None])
        if r.random() < 0.1:
            p = None
        if r.random() < 0.05:
            d = None
        if r.random() < 0.05:
            w = None
        row = (100 + i * 7, f"/p{i}", r.choice(["R", "Composite", "Composite", None]) if r.random() < 0.5 else "Composite", p, d, w, text, r.randint(0, 3))
        rows.append(row)
        if r.random() < 0.2:
            rows.append((*row[:7], row[7] + 1))
        if r.random() < 0.2:
            rows.append((row[0] + 3, *row[1:]))
    return [(*[signed(v) if isinstance(v, int) and k in (3, 4, 5) else v for k, v in enumerate(row)], "k", "r", "l") for row in rows]


def firsts(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[7], r[0])):
        out.setdefault(r[0], r)
    return list(out.values())


def number(x):
    return None if x is None else int(x.strip().lower().removeprefix("0x"), 16)


def ham(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def refused_by_hand(rows):
    kept, out = [], set()
    for r in firsts(rows):
        hit = any(
            a[2] is not None and a[2] == r[2]
            and ((number(a[6]) is not None and number(a[6]) == number(r[6])) or (None not in (a[3], a[4], r[3], r[4]) and ham(a[3], r[3]) <= 8 and ham(a[4], r[4]) <= 8))
            for a in kept
        )
        if r[7] > 0 and hit:
            out.add(r[0])
        else:
            kept.append(r)
    return out


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 0), (3, 60)])
def test_refused_items_match_brute_force(spark, seed, hot):
    rows = make(150, seed, hot=hot)
    got = [r.item_id for r in batch_dedup.refuse_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == refused_by_hand(rows)


def test_hot_buckets_are_split_without_loss(spark, monkeypatch):
    rows = make(120, 5, hot=80)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(buckets, "PER_GROUP", 12)
    monkeypatch.setattr(batch_dedup, "PER_GROUP", 12)
    monkeypatch.setattr(buckets, "LIMIT", 2)
    one = batch_dedup.classes(batch_dedup.items(df))
    layout = buckets.plan(batch_dedup._entries(one), batch_dedup._file, one.count() * batch_dedup.KEYS, per_group=12)
    assert len(layout.hot) and layout.parts
    assert {r.item_id for r in batch_dedup.refuse_duplicates(df).collect()} == refused_by_hand(rows)
    cls = near_duplicates.classes(near_duplicates.items(df)).select("kind", "rep", "phash", "dhash", "whash")
    layout = buckets.plan(cls, near_duplicates._file, cls.count() * near_duplicates.SHUFFLE_BANDS, near_duplicates.SHUFFLE_BANDS)
    assert len(layout.hot) and layout.parts
    want = near_by_hand(rows)
    got = near_duplicates.near_duplicate_pairs(df).collect()
    have = {(r.item_id_a, r.item_id_b) for r in got}
    assert len(have) == len(got) and have <= {(a, b) for a, b, _ in want}
    assert {(a, b) for a, b, d in want if d <= 9} <= have


def test_finer_keys_meet_the_same_near_pairs(spark, monkeypatch):
    df = spark.createDataFrame(make(300, 9, spread=7), SCHEMA)
    plain = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()}
    monkeypatch.setattr(buckets, "PER_GROUP", 20)
    monkeypatch.setattr(buckets, "LIMIT", 1)
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()} == plain


def near_by_hand(rows):
    full = [r for r in firsts(rows) if None not in (r[2], r[3], r[4], r[5])]
    out = set()
    for i, a in enumerate(full):
        for b in full[i + 1 :]:
            if a[2] == b[2]:
                d = sum(ham(a[k], b[k]) for k in (3, 4, 5))
                if d <= 19:
                    lo, hi = sorted((a[0], b[0]))
                    out.add((lo, hi, d))
    return out


def test_near_pairs_match_brute_force(spark):
    rows = make(300, 9, spread=7)
    want = near_by_hand(rows)
    got = near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    have = {(r.item_id_a, r.item_id_b) for r in got}
    assert len(have) == len(got)
    assert have <= {(a, b) for a, b, _ in want}
    assert len(have) >= 0.98 * len(want)
    assert {(a, b) for a, b, d in want if d <= 9} <= have


def test_copies_form_one_class(spark):
    rows = [(i, "/p", "R", 5, 6, 7, None, 0, "k", "r", "l") for i in range(40)] + [(50, "/q", "R", 5, 6, 15, None, 0, "k", "r", "l"), (51, "/q", "G", 5, 6, 7, None, 0, "k", "r", "l")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert near_duplicates.near_duplicate_pairs(df).count() == 41 * 40 // 2
    one = {r.item_id: r for r in near_duplicates.near_duplicate_classes(df).collect()}
    assert len(one) == 42
    assert one[7].class_id == 0 and one[7].members == 40 and one[7].links == 1
    assert one[50].links == 1 and one[51].links == 0


def test_empty_and_null_tables(spark):
    for rows in ([], [(None, None, None, None, None, None, None, None, None, None, None), (1, None, None, 1, 1, 1, "zz", 2, None, None, None)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert batch_dedup.refuse_duplicates(df).count() == 0
        assert near_duplicates.near_duplicate_pairs(df).count() == 0


def taken(spark, rows, path, reopen=False):
    one = batch_dedup.items(spark.createDataFrame(rows, SCHEMA)).cache()
    index = batch_dedup.SegmentIndex.create(one.where("batch_no = 0"), path)
    out = []
    for b in sorted({r.batch_no for r in one.select("batch_no").distinct().collect()} - {0}):
        if reopen:
            spark.sql(f"DROP TABLE {index.table}")
            index = batch_dedup.SegmentIndex.open(spark, path)
        out += [r.item_id for r in index.take(one.where(one.batch_no == b)).collect()]
    assert len(out) == len(set(out))
    return set(out), index


def test_index_takes_batch_after_batch(spark, tmp_path):
    rows = make(120, 21)
    out, index = taken(spark, rows, str(tmp_path / "index"), reopen=True)
    assert out == refused_by_hand(rows)
    index.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        batch_dedup.SegmentIndex.open(spark, str(tmp_path / "index"))


def test_index_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batch_dedup, "PER_GROUP", 40)
    monkeypatch.setattr(buckets, "LIMIT", 2)
    rows = [(*r[:7], 0 if i < 12 else 1 + i % 5, *r[8:]) for i, r in enumerate(make(160, 33, hot=50))]
    out, index = taken(spark, rows, str(tmp_path / "index"))
    assert index.version > 0 and out == refused_by_hand(rows)
    again = batch_dedup.SegmentIndex.open(spark, str(tmp_path / "index"))
    assert (again.layout.groups, again.layout.parts) == (index.layout.groups, index.layout.parts)
    assert 0 < again.entries <= index.entries  # the writer counts each item with all its keys
    index.drop()


def test_large_deliveries_are_taken_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batch_dedup, "SLICE", 30)
    rows = make(130, 4, hot=40)
    assert {r.item_id for r in batch_dedup.refuse_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == refused_by_hand(rows)


def test_more_partners_than_are_named_at_once(spark):
    r = random.Random(2)
    p, d = r.getrandbits(64), r.getrandbits(64)
    rows = [(i, "/p", "R", None, None, None, f"{i:x}", 0, "k", "r", "l") for i in range(1, 31)]  # accepted contents
    rows += [(100 + i, "/p", "R", signed(flip(r, p, 1)), signed(d), None, f"{i:x}", 1, "k", "r", "l") for i in range(1, 31)]  # refused by content
    rows += [(200 + i, "/p", "R", signed(flip(r, p, 2)), signed(d), None, None, 1, "k", "r", "l") for i in range(5)]  # near these, and to each other
    out = {r.item_id for r in batch_dedup.refuse_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == refused_by_hand(rows) and 200 not in out and {201, 202, 203, 204} <= out


def test_a_small_batch_reads_as_much_of_a_longer_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batch_dedup, "PER_GROUP", 50)
    monkeypatch.setattr(buckets, "LIMIT", 100)
    read = []
    for n in (600, 2400):
        r = random.Random(n)
        history = [(i, "/p", "R", signed(r.getrandbits(64)), signed(r.getrandbits(64)), 0, f"{r.getrandbits(64):x}", 0, "k", "r", "l") for i in range(n)]
        index = batch_dedup.SegmentIndex.create(batch_dedup.items(spark.createDataFrame(history, SCHEMA)), str(tmp_path / f"index{n}"))
        batch = batch_dedup.classes(batch_dedup.items(spark.createDataFrame([(9_000_000, "/q", "R", 77, 78, 79, "abc", 1, "k", "r", "l")], SCHEMA)))
        batch = spark.createDataFrame(batch.collect(), batch.schema)
        held = index.held(batch, 1)
        plan = held._jdf.queryExecution().executedPlan().toString()
        chosen, whole = (int(x) for x in re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan).groups())
        assert chosen <= batch_dedup.KEYS and whole == index.layout.groups
        assert plan.count("Exchange hashpartitioning") == 1  # of the probes; the history is not shuffled
        probed = index.probed(1, buckets.pack_probes(batch_dedup._entries(batch), batch_dedup._file, batch_dedup.PROBE, index.layout))
        read.append(probed.selectExpr("sum(length(block)) AS n").first().n)
        index.drop()
    assert read[1] < 1.5 * read[0]


def test_sketch_agrees_as_often_as_sets_overlap():
    import numpy as np

    sk = near_duplicates.SKETCH
    r = random.Random(4)
    a = np.array([[r.getrandbits(64) for _ in range(3)] for _ in range(300)], dtype=np.uint64)
    b = a.copy()
    for i in range(300):
        for k in r.sample(range(192), 16):
            b[i, k // 64] ^= np.uint64(1 << (k % 64))
    x, y = sk.columns(*a.T), sk.columns(*b.T)
    same = np.mean([np.mean(sk.coordinate(j, x) == sk.coordinate(j, y)) for j in range(60)])
    assert abs(same - (192 - 16) / (192 + 16)) < 0.02
