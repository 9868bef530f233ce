"""Operators on hand-made rows: the rules that are easy to get wrong."""

import random

import numpy as np
from pyspark.sql import functions as F

from lumatrace.operators import bands, clusters, exact, graph, incremental, items, similar
from lumatrace.operators import results as res
from lumatrace.plans.config import ScanConfig
from lumatrace.plans.pipeline import duplicate_scan
from lumatrace.plans.skew import join_counted

FILES = "path string, channel string, resolution_w int, resolution_h int, file_size bigint, format_str string, capture_date double, hash string"
EVIDENCE = "path1 string, channel1 string, path2 string, channel2 string, method string, distance double"


def file(path, w=10, size=100, fmt="PNG", taken=None, hash=None, channel=None):
    return (path, channel, w, 10, size, fmt, taken, hash)


def scan(spark, files, edges=(), **kw):
    kw.setdefault("use_ai", True)
    config = ScanConfig("/", find_dhash=False, find_phash=False, similarity=50, **kw)
    e = spark.createDataFrame([(a, None, b, None, m, d) for a, b, m, d in edges], EVIDENCE)
    return {(r.group_id, r.path): r for r in duplicate_scan(config, spark.createDataFrame(files, FILES), links=e).collect()}


def test_members_without_a_tie_to_the_leader_leave(spark):
    out = scan(spark, [file("a", w=30, hash="1"), file("b", hash="2"), file("c", hash="3")], [("a", "b", "AI", 0.02), ("b", "c", "AI", 0.02)])
    assert {p: (r.is_best, r.distance, r.found_by) for (_, p), r in out.items()} == {"a": (True, 0, "Best"), "b": (False, 98, "AI")}


def test_exact_twins_stay_with_any_leader(spark):
    files = [file("a_long.png", hash="h"), file("b.png", hash="h"), file("cc.png", hash="h")]
    out = scan(spark, files)
    assert {p for (_, p) in out} == {"a_long.png", "b.png", "cc.png"} and out[(1, "b.png")].is_best


def test_strict_stars_lose_twins_of_another_representative(spark):
    files = spark.createDataFrame([file("a_long.png", hash="h"), file("b.png", hash="h"), file("cc.png", hash="h")], FILES)
    e = exact.exact_edges(files).select("path1", F.lit(None).cast("string").alias("channel1"), "path2", F.lit(None).cast("string").alias("channel2"), F.lit("xxHash").alias("method"), F.lit(0.0).alias("distance"))
    stars = clusters.star_groups(files, clusters.merge_evidence(e), strict=True).collect()
    assert {r.node for r in stars} == {"b.png|", "a_long.png|"}


def test_evidence_priority(spark):
    rows = [("x", None, "y", "", "AI", 0.1), ("y", "Composite", "x", "RGB", "pHash", 0.0), ("x", None, "y", None, "dHash", 0.0), ("p", None, "q", None, "AI", 0.3), ("q", None, "p", None, "AI", 0.2), ("x", None, "x", None, "AI", 0.0), (None, None, "x", None, "AI", 0.0)]
    got = {(r.node_a, r.node_b): (r.method, r.distance) for r in clusters.merge_evidence(spark.createDataFrame(rows, EVIDENCE)).collect()}
    assert got == {("x|", "y|"): ("dHash", 0.0), ("p|", "q|"): ("AI", 0.2)}


def test_leader_rules(spark):
    def best(*files):
        df = spark.createDataFrame(files, FILES).withColumn("component", F.lit(1)).withColumn("node", F.col("path"))
        return clusters.leaders(df).first().leader

    assert best(file("a", fmt="JPEG", size=900), file("b", fmt="png")) == "b"
    assert best(file("a", taken=1e9), file("b", taken=None)) == "b"
    assert best(file("a", taken=2e9), file("b", taken=1e9)) == "b"
    assert best(file("long_name"), file("zz")) == "zz"
    assert best(file("b"), file("a")) == "a"
    assert best(file("a", w=None, size=None, fmt=None), file("b", w=1)) == "b"


def test_thresholds(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id bigint, embedding array<float>")
    assert [(r.id_a, r.id_b) for r in similar.link_pairs(similar.knn_exact(v, 5), 1.0).collect()] == [(1, 2)]
    assert [r.vec_id for r in similar.vector_search(v, [1.0, 0.0], 1.0).collect()] == [1]


def test_blocks_give_the_same_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    one = {tuple(r) for r in similar.knn_exact(v, 4).collect()}
    assert one == {tuple(r) for r in similar.knn_exact(v, 4, per_block=17).collect()} and len(one) == 480
    near = {(r.id, r.other) for r in similar.probe(v, similar.fit_cells(v, 10), k=4, probes=6).collect()}
    assert len(near & {(r[0], r[1]) for r in one}) >= 0.9 * 480


def test_band_recall(spark):
    r = random.Random(3)
    rows, want = [], set()
    for i in range(200):
        h = r.getrandbits(64)
        g = h
        for b in r.sample(range(64), r.randint(1, 3)):
            g ^= 1 << b
        rows += [(2 * i, h - (1 << 63)), (2 * i + 1, g - (1 << 63))]
        want.add((2 * i, 2 * i + 1))
    rows += [(9000, None), (None, 5)]
    df = spark.createDataFrame(rows, "id bigint, h bigint")
    for mode in ("pivot", "all_pairs"):
        assert want == {(x.id_a, x.id_b) for x in bands.banded_pairs(df, "id", "h", 3, mode).collect()}
    miss = spark.createDataFrame([(1, 0), (2, 1 | 1 << 16 | 1 << 32 | 1 << 48)], "id bigint, h bigint")
    assert bands.banded_pairs(miss, "id", "h", 8).count() == 0


def test_components_match_union_find(spark, monkeypatch):
    r = random.Random(8)
    rows = [(f"n{r.randint(0, 150)}", f"n{r.randint(0, 150)}") for _ in range(110)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [(None, "x")]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in rows:
        if a and b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {(x.node, x.component) for x in graph.connected_components(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got == {(x, find(x)) for x in up}
    monkeypatch.setattr(graph, "ONE_TASK", 10)
    assert got == {(x.node, x.component) for x in graph.connected_components(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert graph.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_items(spark):
    files = spark.createDataFrame([("/a/x_ORM.png",), ("/a/y.png",)], "path string")
    got = {tuple(r) for r in items.analysis_items(files, True, True, ["R", "G"], ["orm"]).collect()}
    assert got == {("/a/x_ORM.png", "R"), ("/a/x_ORM.png", "G"), ("/a/y.png", "Luminance")}
    assert {r[1] for r in items.analysis_items(files, True, channels=["B"]).collect()} == {"B"}


RES = "group_id bigint, path string, channel string, is_best boolean, distance int, found_by string, checked boolean, file_size bigint"


def test_slider_and_removal(spark):
    rows = [(1, "a", None, True, 0, "Best", False, 1), (1, "b", None, False, 100, "pHash", False, 1), (1, "c", None, False, 85, "AI", True, 1), (1, "d", None, False, 90, "AI", False, 1), (2, "E", None, True, 0, "Best", False, 1), (2, "f", None, False, 70, "AI", False, 1)]
    df = spark.createDataFrame(rows, RES)
    assert {r.path for r in res.min_similarity(df, 90).collect()} == {"a", "b", "d", "E"}
    assert res.min_similarity(df, 0).count() == 6
    gone = spark.createDataFrame([("A",), ("e",)], "path string")
    left = {r.path: r.is_best for r in res.remove_paths(df, gone).collect()}
    assert left == {"b": True, "d": False, "c": False}
    assert {r.group_id: r.state for r in res.check_rollup(df).collect()} == {1: "partial", 2: "none"}
    assert [tuple(r) for r in res.link_plan(df).collect()] == [("c", "a", "hardlink")]


def test_cache(spark):
    disk = spark.createDataFrame([("a", 1.0, 10), ("b", 1.0, 10), ("c", 2.0, 10), ("d", 1.0, 10)], "path string, mtime double, file_size bigint")
    cache = spark.createDataFrame([("a", None, 1.0, 10, [1.0]), ("b", None, 1.0, 11, [1.0]), ("c", None, 1.0, 10, [1.0]), ("d", None, 1.0, 10, None)], "path string, channel string, mtime double, file_size bigint, vector array<float>")
    assert {r.path for r in incremental.to_process(disk, cache).collect()} == {"b", "c"}
    assert {r.path for r in incremental.cache_hits(disk, cache).collect()} == {"a"}
    new = spark.createDataFrame([("a", None, 9.0, 1, None), ("a", None, 8.0, 2, None), ("a", "R", 7.0, 3, None)], cache.schema)
    out = {(r.path, r.channel): r.mtime for r in incremental.upsert(cache, new).collect()}
    assert out[("a", None)] == 9.0 and out[("a", "R")] == 7.0 and len(out) == 5


def test_hot_key_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i int, key string")
    keyed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("i").alias("m"))
    got = {tuple(r) for r in join_counted(rows, keyed, "key", "n", 300, floor=10).select("i", "m").collect()}
    assert got == {tuple(r) for r in rows.join(keyed, "key").select("i", "m").collect()} and len(got) == 300


def test_group_numbers_are_dense(spark):
    keys = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("k")).repartition(7)
    got = sorted((r.k, r.group_id) for r in clusters.number_groups(keys, "k").collect())
    assert [g for _, g in got] == list(range(1, 1001))


def test_empty_scan(spark):
    assert scan(spark, []) == {}


def test_copies_seen_by_channel_only_are_found(spark):
    files = [file("a.png", hash="h", channel="R"), file("a.png", hash="h", channel="G"), file("bb.png", hash="h", channel="R"), file("ccc.png", hash="h"), file("ccc.png", channel="A"), file("d.png", hash="x", channel="R"), file("e.png", channel="R")]
    for some in (files, files[:3] + files[5:]):
        out = [(r.path, r.channel, r.is_best, r.found_by) for r in duplicate_scan(ScanConfig("/", find_dhash=False, find_phash=False), spark.createDataFrame(some, FILES)).collect()]
        assert {p for p, c, _, _ in out if c is None} == {p for p, *_, h in some if h == "h"}
        assert [(p, c) for p, c, best, _ in out if best] == [("a.png", None)]


def test_a_composite_without_hash_is_tied_by_its_channels(spark):
    files = [file("aa.png", hash="h", channel="R"), file("b.png", channel=None), file("b.png", hash="h", channel="R"), file("ccc.png", hash="h", channel="R")]
    out = duplicate_scan(ScanConfig("/", find_dhash=False, find_phash=False), spark.createDataFrame(files, FILES)).where("channel IS NULL").collect()
    assert {r.path for r in out} == {"aa.png", "b.png", "ccc.png"}


def test_channel_nodes_stay_in_their_own_component(spark):
    files = [file(p, hash="h", channel=c) for p in ("a.png", "bb.png") for c in (None, "R")]
    links = spark.createDataFrame([("a.png", "R", "bb.png", "R", "AI", 0.02)], EVIDENCE)
    out = duplicate_scan(ScanConfig("/", find_dhash=False, find_phash=False, use_ai=True), spark.createDataFrame(files, FILES), links=links).collect()
    assert sorted((r.group_id, r.path, r.channel) for r in out) == [(1, "a.png", None), (1, "bb.png", None), (2, "a.png", "R"), (2, "bb.png", "R")]
