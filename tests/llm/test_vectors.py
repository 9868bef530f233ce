"""Most similar vectors against brute force."""

import numpy as np

from lumatrace.llm import vector_index

SCHEMA = "item_id bigint, vector array<float>, rep string, other string, distance string, shard string"


def by_hand(ids, v, k):
    v = v.astype(np.float64)
    d = np.round(1 - v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)), 6)
    out = {}
    for i, a in enumerate(ids):
        order = [j for j in np.lexsort((ids, d[i])) if j != i][:k]
        out[int(a)] = [(int(ids[j]), d[i, j]) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "r", "o", "d", "s") for i, v in rows], SCHEMA)


def test_recall_on_the_test_table(spark, data, monkeypatch):
    monkeypatch.setattr(vector_index, "PER_SHARD", 300)  # several shards
    df = spark.read.parquet(f"{data}/sf0.01/fingerprints.parquet")
    rows = [(r.item_id, r.vector) for r in df.select("item_id", "vector").collect()]
    ok = {i: v for i, v in rows if v is not None and len(v) == 96 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    want = by_hand(ids, np.array([ok[i] for i in ids]), 10)
    got = vector_index.nearest_items(df).collect()
    pairs = {(r.item_id, r.neighbour) for r in got}
    truth = {(i, j) for i, n in want.items() for j, _ in n}
    assert len(pairs) == len(got) == len(truth)
    assert len(pairs & truth) >= 0.9 * len(truth)
    near = {(i, j) for i, n in want.items() for j, d in n if d <= 0.2}
    assert len(pairs & near) >= 0.98 * len(near)


def test_fine_cells_and_dealt_out_cells_lose_little(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=96)
    near = centre + 0.3 * rng.normal(size=(900, 96))  # a third of all and more lie close together
    v = np.concatenate([near, rng.normal(size=(1200, 96))]).astype(np.float32)
    ids = np.arange(1, len(v) + 1) * 3
    want = by_hand(ids, v, 10)
    df = frame(spark, [(int(i), x.tolist()) for i, x in zip(ids, v)])
    q = vector_index.Quantiser.fit(v, len(v), 20)
    assert q.parts.max() > 1
    got = vector_index.nearest_items(df, per_shard=20, split=40, scan=400, probes=len(q.centroids)).collect()
    pairs = {(r.item_id, r.neighbour) for r in got}
    truth = {(i, j) for i, n in want.items() for j, _ in n}
    assert len(pairs) == len(got) == len(truth)
    assert len(pairs & truth) >= 0.9 * len(truth)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 96)).astype(np.float32)
    hot = base[0]
    rows = [(100 + i, base[i].tolist()) for i in range(40)] + [(1000 - i, hot.tolist()) for i in range(30)] + [(i, hot.tolist()) for i in (971, 972)]
    rows += [(5000, (hot * 3).tolist())]  # not normalised: distance 0 as well
    bad = [(9001, None), (9002, [0.0] * 96), (9003, [1.0] * 95), (9004, [float("nan")] + [1.0] * 95), (9005, [None] + [1.0] * 95), (9006, [float("inf")] + [1.0] * 95), (None, hot.tolist())]
    got = vector_index.nearest_items(frame(spark, rows + bad)).collect()
    use = dict(rows)
    ids = np.array(sorted(use))
    want = by_hand(ids, np.array([use[i] for i in ids], dtype=np.float32), 10)
    have = {}
    for r in got:
        have.setdefault(r.item_id, set()).add(r.neighbour)
    assert set(have) == set(want)
    for i in (100, 985, 971, 5000):
        assert have[i] == {j for j, _ in want[i]}
    pairs = {(r.item_id_a, r.item_id_b) for r in vector_index.near_pairs(frame(spark, rows + bad)).collect()}
    assert pairs >= {tuple(sorted((i, j))) for i in (100, 985) for j, d in want[i] if d <= 0.2}


def test_no_usable_vector(spark):
    assert vector_index.nearest_items(frame(spark, [])).count() == 0
    assert vector_index.near_pairs(frame(spark, [(1, None), (2, [0.0] * 96)])).count() == 0
    assert vector_index.nearest_items(frame(spark, [(1, [1.0] * 96)])).count() == 0
