"""Registered queries on small tables of their own."""

import random
from collections import Counter

import numpy as np

from lumatrace.operators import graph, similar
from lumatrace.plans import pipeline, queries
from lumatrace.plans.config import ScanConfig

HASHES = "item_id bigint, path string, analysis_type string, dhash bigint, phash bigint, whash bigint, xxhash string"
PRINTS = "item_id bigint, path string, channel string, vector array<float>, resolution_w int, resolution_h int, file_size bigint, capture_date double, format_str string"


def table(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{d}/{name}.parquet")
    return str(d)


def test_full_scan_takes_content_hashes_as_numbers(spark, tmp_path):
    texts = ["0xAB12", "ab12", "\tAB12 ", "00ab12", "0x", None, "ab13"]
    rows = [(i, f"/a/f{i}.png", "Composite", None, None, None, x) for i, x in enumerate(texts)]
    table(spark, tmp_path, "fingerprints", [], PRINTS)
    d = table(spark, tmp_path, "hashes", rows, HASHES)
    out = queries.duplicate_scan_full(spark, d).collect()
    assert {r.path for r in out} == {f"/a/f{i}.png" for i in range(4)} and {r.group_id for r in out} == {1}


def test_full_scan_groups_by_vectors_and_leads_by_metadata(spark, tmp_path):
    axis = lambda i, more=0.0: [float(j == i) + more * (j == 50) for j in range(96)]
    vectors = [axis(0), axis(0, 0.2), axis(1), axis(0)[:48], [0.0] * 96, [float("nan")] * 96, None, axis(2), axis(2)]
    channels = [None, None, None, None, None, None, None, "R", "R"]
    rows = [(i, f"/a/f{i}.png", c or "Composite", None, None, None, None) for i, c in enumerate(channels)]
    prints = [(i, f"/a/f{i}.png", c, v, 10 * (i % 2 + 1), 10, 100, None, "PNG") for i, (c, v) in enumerate(zip(channels, vectors))]
    prints.append((1, "/a/f1.png", None, vectors[1], None, 0, None, None, None))
    table(spark, tmp_path, "hashes", rows, HASHES)
    d = table(spark, tmp_path, "fingerprints", prints, PRINTS)
    got = {(r.path, r.channel): (r.is_best, r.found_by, r.distance) for r in queries.duplicate_scan_full(spark, d).collect()}
    assert got == {("/a/f1.png", None): (True, "Best", 0), ("/a/f0.png", None): (False, "AI", 98), ("/a/f7.png", "R"): (True, "Best", 0), ("/a/f8.png", "R"): (False, "AI", 100)}


def test_precision_sets_the_cells_searched(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(600, 8))
    df = spark.createDataFrame([(i, f"/f{i}", None, [float(z) for z in v]) for i, v in enumerate(x)], "item_id bigint, path string, channel string, vector array<float>")

    def links(precision):
        return {(r.path1, r.path2): r.distance for r in pipeline.vector_links(ScanConfig("/", similarity=70, precision=precision), df, 8).collect()}

    exact = links("fast")
    monkeypatch.setattr(similar, "INDEX_THRESHOLD", 0)
    monkeypatch.setattr(similar.probe, "__defaults__", (*similar.probe.__defaults__[:-1], 100))
    few, all_cells = links("fast"), links("exhaustive")
    assert len(exact) > 500 and all_cells == exact
    assert set(few) < set(exact)


def test_search_returns_all_below_the_threshold(spark, tmp_path):
    rows = [(i, [1.0, 0.004 * i]) for i in range(250)] + [(999, [-1.0, 0.0])]
    d = table(spark, tmp_path, "embeddings", rows, "vec_id bigint, embedding array<float>")
    assert {r.vec_id for r in queries.vector_search_whole(spark, d).collect()} == set(range(250))
    assert queries.sample_search_whole(spark, d).count() == 251
    assert "LIMIT 10000)" in queries.SQL["vector_search_whole"]


def test_hamming_classes_hold_every_item_and_all_near_hashes(spark, tmp_path):
    rng = random.Random(4)
    hashes = [rng.getrandbits(63) for _ in range(40)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), n)) for h in hashes for n in (2, 5, 8, 9)]
    hashes = [h - (h >> 63 << 64) for h in hashes]
    hashes += hashes[::3]
    rows = [(i, f"/f{i}", "Composite", None, h, None, None) for i, h in enumerate(hashes)] + [(0, "/f0", "Composite", None, hashes[0], None, None), (900, "/n", "R", None, None, None, None)]
    d = table(spark, tmp_path, "hashes", rows, HASHES)
    rep = {}
    for i, h in enumerate(hashes):
        rep.setdefault(h, i)
    near = {(i, j): ((h ^ g) & (1 << 64) - 1).bit_count() for h, i in rep.items() for g, j in rep.items() if i < j and ((h ^ g) & (1 << 64) - 1).bit_count() <= 8}
    assert {(r.id_a, r.id_b): r.bits for r in queries.hamming_pairs_whole(spark, d).collect()} == near and max(near.values()) == 8
    links = Counter(i for p in near for i in p)
    got = [tuple(r) for r in queries.hamming_classes(spark, d).collect()]
    assert sorted(got) == sorted((i, rep[h], links[rep[h]]) for i, h in enumerate(hashes))


def test_star_groups_of_a_long_chain_merge_the_evidence_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 5)
    names = [f"/c/n{i:02d}.png" for i in range(40)]
    random.Random(4).shuffle(names)
    rows = [(a, None, b, "RGB", "AI", 0.1) for a, b in zip(names, names[1:])] + [(names[1], None, names[0], None, "dHash", 0.0), ("/c/x.png", "R", "/c/y.png", None, "xxHash", 0.0), (None, None, "/c/x.png", None, "AI", 0.2)]
    out = queries.star_groups(spark, table(spark, tmp_path, "edges", rows, "path1 string, channel1 string, path2 string, channel2 string, method string, distance double"))
    assert not [f for f in out.inputFiles() if "/edges.parquet/" in f]  # all that is left to do reads merged pairs
    at = names.index("/c/n00.png")
    near = {names[i]: ("dHash", 0.0) if {i, at} == {0, 1} else ("AI", 0.1) for i in (at - 1, at + 1) if 0 <= i < 40}
    want = {("/c/n00.png|", f"{n}|", *e, False) for n, e in near.items()} | {("/c/n00.png|", "/c/n00.png|", "Best", 0.0, True), ("/c/x.png|R", "/c/x.png|R", "Best", 0.0, True), ("/c/x.png|R", "/c/y.png|", "xxHash", 0.0, False)}
    assert {(r.leader, r.node, r.method, r.distance, r.is_best) for r in out.collect()} == want
