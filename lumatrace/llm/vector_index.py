"""Problem 5: the most similar vectors of every vector.

Method: an inverted file of coarse centroids with product-quantised residuals,
asymmetric distance tables and exact reranking. Centroids and code books are fitted on a bounded
sample; every vector is then filed under its nearest centroid. A query
probes the cells of its PROBES nearest centroids: its dot products with the code
words make one table, a candidate's score is the dot product with the centroid plus a
sum of table entries, and the REFINE best by score are compared exactly.

Centroids are clustered into shards of near cells. A vector is shipped
once to the shard of its own cell, where it is a candidate and a query at once, and once more to each other
shard that holds a cell it probes, so what is shuffled is a small multiple of
the vectors. The number of shards follows the number of vectors. A cell that would fill a shard
more than twice is dealt out to several shards, each of which its queries visit.

There are about as many cells as the root of the number of vectors, CELLS at most, and the
probes grow with them. A cell of over SPLIT vectors, as all are from some millions of
vectors on, is cut again into cells of about SUBCELL vectors by means fitted in its shard; a query then
compares those nearest to it, SCAN vectors in all for each probe, so its work does not grow with the cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..plans.skew import grouped

SAMPLE = 32_768
SUBSPACES = 24
WORDS = 128
#: probes are at least PROBES and PROBE_SHARE times the root of the number of cells
PROBES, PROBE_SHARE = 10, 0.55
REFINE = 64
CELLS = 4096
SPLIT, SUBCELL, SCAN = 4096, 256, 2048
PER_SHARD = 24_000
QUERIES = 4096
RERANK = 512
ROUNDS = 8


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _fit_means(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool, rounds: int = ROUNDS) -> np.ndarray:
    means = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(part @ means.T - (0 if spherical else (means**2).sum(1) / 2), axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(n) - n, len(x) - 1), axis=0)
        full = n > 0
        means[full] = sums[full] / n[full, None]
        means[~full] = x[rng.choice(len(x), size=int((~full).sum()))]
        if spherical:
            means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    return means.astype(np.float32)


@dataclass
class Quantiser:
    """Coarse centroids, their shards and the residual code books; fitted from at most SAMPLE vectors."""

    centroids: np.ndarray
    shard_of: np.ndarray  # its first shard for each cell
    parts: np.ndarray  # shards of each cell; one with several has them for itself
    words: np.ndarray  # subspace, word, dimension

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, per_shard: int, seed: int = 7) -> Quantiser:
        rng = np.random.Generator(np.random.PCG64(seed))
        x = unit(sample)
        cells = int(np.clip(int(np.sqrt(total)), 16, CELLS))
        centroids = _fit_means(x, cells, rng, spherical=True)
        load = (np.bincount(np.argmax(x @ centroids.T, axis=1), minlength=cells) + 1.0) / (len(x) + cells)  # share of all vectors
        parts = np.maximum(1, np.ceil(load * total / per_shard).astype(np.int64))
        parts[parts <= 2] = 1
        rest = np.flatnonzero(parts == 1)
        shards = int(np.clip(np.ceil(load[rest].sum() * total / per_shard), 1, max(1, len(rest))))
        shard_of = np.zeros(cells, dtype=np.int64)
        if len(rest):
            shard_of[rest] = _even_shards(centroids[rest], load[rest], shards)
        wide = np.flatnonzero(parts > 1)
        shard_of[wide] = shards + np.cumsum(parts[wide]) - parts[wide]
        res = x - centroids[np.argmax(x @ centroids.T, axis=1)]
        spaces = max(p for p in range(1, SUBSPACES + 1) if x.shape[1] % p == 0)
        width = x.shape[1] // spaces
        words = np.stack([_fit_means(np.ascontiguousarray(res[:, i * width : (i + 1) * width]), WORDS, rng, spherical=False, rounds=6) for i in range(spaces)])
        return cls(centroids, shard_of, parts, words)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        score = x @ self.centroids.T
        probes = min(probes, score.shape[1])
        part = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(score, part, axis=1), axis=1), axis=1)

    def encode(self, residual: np.ndarray) -> np.ndarray:
        width = self.words.shape[2]
        out = np.empty((len(residual), len(self.words)), dtype=np.uint8)
        for i, w in enumerate(self.words):
            out[:, i] = np.argmax(residual[:, i * width : (i + 1) * width] @ w.T - (w**2).sum(1) / 2, axis=1)
        return out


def _even_shards(centroids: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """Near cells into one shard, each shard with about the same load: cut in two along the main direction, again and again."""
    out = np.zeros(len(centroids), dtype=np.int64)
    todo = [(np.arange(len(centroids)), shards, 0)]
    while todo:
        at, parts, base = todo.pop()
        if parts == 1 or len(at) < 2:
            out[at] = base
            continue
        x = centroids[at] - centroids[at].mean(axis=0)
        axis = np.linalg.svd(x, full_matrices=False)[2][0]
        order = at[np.argsort(x @ axis, kind="stable")]
        left = parts // 2
        cut = int(np.clip(np.searchsorted(np.cumsum(load[order]), load[order].sum() * left / parts), 1, len(at) - 1))
        todo += [(order[:cut], left, base), (order[cut:], parts - left, base + left)]
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """``item_id, vector`` where the vector has ``dim`` finite numbers that are not all zero."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("item_id").isNotNull() & (F.size(v) == dim)).where(finite & F.exists(v, lambda x: x != 0)).select("item_id", v.cast("array<float>").alias("vector"))


def _subcells(x: np.ndarray, cell: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Finer cells of the candidates, which are sorted by cell: centre and coarse cell of each finer one, and the finer one of each candidate.

    A cell of at most ``split`` candidates stays whole.
    """
    rng = np.random.Generator(np.random.PCG64(3))
    centres, owner, of, n = [], [], np.empty(len(x), dtype=np.int64), 0
    for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(cell)) + 1) if len(x) else []:
        k = 1 if len(part) <= split else -(-len(part) // SUBCELL)
        if k == 1:
            centres.append(x[part].mean(axis=0, keepdims=True))
            of[part] = n
        else:
            means = _fit_means(x[part[rng.permutation(len(part))[: 32 * k]]], k, rng, spherical=True, rounds=4)
            centres.append(means)
            of[part] = n + np.concatenate([np.argmax(x[p] @ means.T, axis=1) for p in np.array_split(part, max(1, len(part) * k // 4_000_000))])
        owner += [cell[part[0]]] * k
        n += k
    return np.concatenate(centres) if centres else np.zeros((0, x.shape[1]), dtype=np.float32), np.array(owner, dtype=np.int64), of


def _visits(x: np.ndarray, near: np.ndarray, centres: np.ndarray, owner: np.ndarray, size: np.ndarray, scan: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, finer cell) pairs to compare: all finer cells of the probed cells, nearest first, until ``scan`` candidates a probe are met."""
    held = np.zeros(int(max(owner.max(initial=0), near.max(initial=0))) + 1, dtype=bool)
    held[owner] = True
    place = np.searchsorted(owner, np.arange(len(held)))
    count = np.bincount(owner, minlength=len(held))
    row, col = np.nonzero(held[near])
    n = count[near[row, col]]
    q = np.repeat(row, n)
    c = np.repeat(place[near[row, col]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    several = np.flatnonzero(np.bincount(q, weights=size[c], minlength=len(x)) > scan * np.bincount(row, minlength=len(x)))
    if not len(several):
        return q, c
    cut = np.isin(q, several)
    keep = ~cut
    a, b = q[cut], c[cut]
    score = np.concatenate([np.einsum("ij,ij->i", x[i], centres[j]) for i, j in zip(np.array_split(a, max(1, len(a) // 65_536)), np.array_split(b, max(1, len(a) // 65_536)))])
    order = np.lexsort((-score, a))
    a, b = a[order], b[order]
    before = np.cumsum(size[b]) - size[b]
    before -= before[np.searchsorted(a, a)]
    ok = before < scan * np.bincount(row, minlength=len(x))[a]
    return np.concatenate([q[keep], a[ok]]), np.concatenate([c[keep], b[ok]])


def _search(q: Quantiser, ids: np.ndarray, x: np.ndarray, raw: np.ndarray, own: np.ndarray, home: np.ndarray, k: int, most: float, probes: int, refine: int, split: int = SPLIT, scan: int = SCAN):
    """Best k of this shard for each of its queries: query row numbers, candidate row numbers, distances."""
    base = np.flatnonzero(home)
    base = base[np.argsort(own[base], kind="stable")]
    centres, owner, fine = _subcells(x[base], own[base], split)
    turn = np.argsort(fine, kind="stable")
    base, fine = base[turn], fine[turn]
    codes = np.ascontiguousarray(q.encode(x[base] - q.centroids[own[base]]).T)
    starts, ends = np.searchsorted(fine, np.arange(len(centres))), np.searchsorted(fine, np.arange(len(centres)), side="right")
    norm = np.linalg.norm(raw, axis=1)
    width = q.words.shape[2]
    most_held = refine + 1  # the row itself takes one of the places
    for rows in np.array_split(np.arange(len(x)), max(1, -(-len(x) // QUERIES))):
        qs_all, cell_all = _visits(x[rows], q.nearest(x[rows], probes), centres, owner, ends - starts, scan)
        if not len(qs_all):
            continue
        order = np.argsort(cell_all, kind="stable")
        qs_all, cell_all = qs_all[order], cell_all[order]
        score_of = np.full((len(rows), most_held), -np.inf, dtype=np.float32)
        cand_of = np.zeros((len(rows), most_held), dtype=np.int64)
        for part in np.split(np.arange(len(qs_all)), np.flatnonzero(np.diff(cell_all)) + 1):
            c, qs = int(cell_all[part[0]]), qs_all[part]
            xq = x[rows[qs]]
            tables = np.matmul(q.words, np.ascontiguousarray(xq.reshape(len(qs), -1, width).transpose(1, 2, 0)))  # subspace, word, query
            dots = xq @ q.centroids[owner[c]]
            for s in range(starts[c], ends[c], SPLIT):  # a block of candidates, so that scores stay small
                e = min(ends[c], s + SPLIT)
                score = np.repeat(dots[None, :], e - s, axis=0)
                for i in range(len(tables)):
                    score += tables[i][codes[i, s:e]]
                all_of = np.concatenate([score_of[qs], score.T], axis=1)
                best = np.argpartition(all_of, all_of.shape[1] - most_held, axis=1)[:, -most_held:]
                place = np.concatenate([cand_of[qs], np.broadcast_to(np.arange(s, e), (len(qs), e - s))], axis=1)
                score_of[qs], cand_of[qs] = np.take_along_axis(all_of, best, axis=1), np.take_along_axis(place, best, axis=1)
        filled = score_of > -np.inf
        cand = base[cand_of]
        for at in np.array_split(np.arange(len(rows)), max(1, -(-len(rows) // RERANK))):
            yield _rerank(ids, x, raw, norm, rows[at], cand[at], filled[at], k, most)


def _rerank(ids: np.ndarray, x: np.ndarray, raw: np.ndarray, norm: np.ndarray, rows: np.ndarray, cand: np.ndarray, filled: np.ndarray, k: int, most: float):
    """The k best candidates of each row by exact distance, ties by id; single precision settles all but a few places behind the last."""
    close = np.einsum("qd,qrd->qr", x[rows], x[cand])
    close[~filled | (cand == rows[:, None])] = -np.inf
    last = min(k + 8, close.shape[1])
    best = np.argpartition(close, close.shape[1] - last, axis=1)[:, close.shape[1] - last :]
    qi, ri = np.nonzero(np.take_along_axis(close, best, axis=1) > max(-2.0, 1 - most - 1e-4))
    a, b = rows[qi], cand[qi, best[qi, ri]]
    d = np.round(1 - np.einsum("ij,ij->i", raw[a], raw[b]) / (norm[a] * norm[b]), 6) + 0.0
    ok = (ids[a] != ids[b]) & (d <= most)
    a, b, d = a[ok], b[ok], d[ok]
    order = np.lexsort((ids[b], d, a))
    a, b, d = a[order], b[order], d[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], d[keep]


def class_neighbours(cls: DataFrame, total: int, sample: np.ndarray, dim: int, k: int, max_distance: float, probes: int | None = None, refine: int = REFINE, per_shard: int | None = None, split: int = SPLIT, scan: int = SCAN) -> DataFrame:
    """``rep, other, distance``: up to k nearest other classes by shard of each class within ``max_distance``."""
    q = Quantiser.fit(sample, total, per_shard or PER_SHARD)
    probes = probes or max(PROBES, math.ceil(PROBE_SHARE * math.sqrt(len(q.centroids))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vec = b.column("vector")
            x = unit(_matrix(vec, dim))
            near = q.nearest(x, probes)
            own = near[:, 0]
            at = b.column("rep").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            home = q.shard_of[own] + (at % q.parts[own].astype(np.uint64)).astype(np.int64)
            by = np.argsort(q.shard_of[near], axis=1, kind="stable")
            shards, parts = np.take_along_axis(q.shard_of[near], by, axis=1), np.take_along_axis(q.parts[near], by, axis=1)
            first = np.ones(shards.shape, dtype=bool)
            first[:, 1:] = shards[:, 1:] != shards[:, :-1]
            row, col = np.nonzero(first)
            n = parts[row, col]
            to = np.repeat(shards[row, col], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(row, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.astype(np.int32)), b.column("rep").take(pa.array(row)), vec.take(pa.array(row)), pa.array(own[row].astype(np.int32)), pa.array(home[row] == to)],
                names=["shard", "rep", "vector", "cell", "home"],
            )

    def search(key: tuple, table: pa.Table) -> pa.Table:
        raw = _matrix(table.column("vector"), dim).astype(np.float64)
        ids = table.column("rep").to_numpy()
        out = list(
            _search(q, ids, unit(raw), raw, table.column("cell").to_numpy(), table.column("home").to_numpy(), k, max_distance, probes, refine, split, scan)
        )
        a, b, d = (np.concatenate([o[i] for o in out]) if out else np.array([], dtype=np.int64 if i < 2 else float) for i in range(3))
        return pa.table({"rep": ids[a], "other": ids[b], "distance": d})

    routed = cls.select("rep", "vector").mapInArrow(route, "shard int, rep bigint, vector array<float>, cell int, home boolean")
    shards = int((q.shard_of + q.parts).max())
    return grouped(routed, ["shard"], shards, 2).applyInArrow(search, "rep bigint, other bigint, distance double")


def nearest_items(vectors: DataFrame, k: int = 10, max_distance: float = 2.0, dim: int = 96, probes: int | None = None, refine: int = REFINE, **sizes: int) -> DataFrame:
    """``item_id, neighbour, distance``: the k most similar items of every item, within ``max_distance``.

    Distance is 1 minus the cosine in double precision, rounded to six decimals; ties go
    by the smaller id. An item counts once. Vectors that are null, of another
    length, all zero or with a null, NaN or infinite number take no part. Items
    with equal vectors are one class of which k + 1 members at most are candidates, as no item
    needs more of them; each item still gets its own result.
    """
    good = usable(vectors, dim)
    total = vectors.count()
    share = min(1.0, SAMPLE / max(1, total))
    picked = good.where(F.pmod(F.xxhash64("item_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("vector").limit(2 * SAMPLE).toArrow()
    if picked.num_rows == 0:
        return vectors.sparkSession.createDataFrame([], "item_id bigint, neighbour bigint, distance double")
    sample = _matrix(picked.column("vector"), dim)
    grouped = good.groupBy("vector").agg(F.min("item_id").alias("rep"), F.max("item_id").alias("last"))
    near = materialize(class_neighbours(grouped, total, sample, dim, k, max_distance, probes, refine, **sizes), "neighbours")
    rank = Window.partitionBy("rep").orderBy("distance", "other")
    near = near.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).select("rep", "other", "distance")
    # members of classes with several items; a narrow table of ids
    ident = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(5), "vector").alias("h2")]
    several = good.groupBy(*ident).agg(F.min("item_id").alias("rep"), F.max("item_id").alias("last")).where("rep <> last").select("h1", "h2", "rep")
    members = materialize(good.select("item_id", *ident).distinct().join(several, ["h1", "h2"]).select("rep", "item_id"), "members")
    head = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("item_id"))).where(F.col("r") <= k + 1).select("rep", "item_id")
    to = head.select(F.col("rep").alias("other"), F.col("item_id").alias("neighbour"))
    own = members.join(head.select("rep", F.col("item_id").alias("neighbour")), "rep").where("item_id <> neighbour").select("item_id", "neighbour", F.lit(0.0).alias("distance"))
    # candidates of a class are cut to k items before they meet its members
    wide = near.join(to, "other", "left").select("rep", F.coalesce("neighbour", "other").alias("neighbour"), "distance")
    wide = wide.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("distance", "neighbour"))).where(F.col("r") <= k).drop("r")
    across = wide.join(members, "rep", "left").select(F.coalesce("item_id", "rep").alias("item_id"), "neighbour", "distance")
    final = Window.partitionBy("item_id").orderBy("distance", "neighbour")
    return across.unionByName(own).withColumn("r", F.row_number().over(final)).where(F.col("r") <= k).select("item_id", "neighbour", "distance")


def near_pairs(vectors: DataFrame, max_distance: float = 0.2, k: int = 10, dim: int = 96) -> DataFrame:
    """``item_id_a, item_id_b``: pairs of which one is among the k nearest of the other, within ``max_distance``."""
    near = nearest_items(vectors, k, max_distance, dim)
    return near.select(F.least("item_id", "neighbour").alias("item_id_a"), F.greatest("item_id", "neighbour").alias("item_id_b")).distinct()
