"""Vector search: one query against all, all against all, and a cell-probe index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance

#: Probes and refine factor of the search precision presets.
PRESETS = {"fast": (8, 1), "balanced": (20, 3), "high": (80, 8), "exhaustive": (256, 20)}
INDEX_THRESHOLD = 50_000
LINK_NEIGHBOURS = 50
SEARCH_TOP = 10_000
FIT_ROWS = 20_000
PER_SHARD = 16_000


def vector_search(vectors: DataFrame, query: Sequence[float], max_distance: float, top: int = SEARCH_TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, distance``: the ``top`` nearest first, of these the ones below ``max_distance``. Ties go by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    ok = vectors.where(F.size(vec_col) == len(query))
    ranked = ok.select(F.col(id_col), cosine_distance(F.col(vec_col), q).alias("distance")).where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return ranked.orderBy("distance", id_col).limit(top).where(F.col("distance") < max_distance)


def _block_neighbours(block: int, most: float = np.inf):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "other": [], "distance": []}).astype({"id": "int64", "other": "int64"})
        a, b = np.stack(left["v"].to_numpy()).astype(np.float64), np.stack(right["v"].to_numpy()).astype(np.float64)
        a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
        ids, others, dist = [], [], []
        for s in range(0, len(a), 512):
            d = np.round(1 - a[s : s + 512] @ b.T, 6) + 0.0
            k = min(block, d.shape[1])
            edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            i, j = np.nonzero((d <= edge) & (d <= most))
            ids.append(left["id"].to_numpy()[s + i])
            others.append(right["id"].to_numpy()[j])
            dist.append(d[i, j])
        return pd.DataFrame({"id": np.concatenate(ids), "other": np.concatenate(others), "distance": np.concatenate(dist)})

    return run


def knn_exact(vectors: DataFrame, k: int = LINK_NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding", per_block: int = 4_000, max_distance: float = np.inf) -> DataFrame:
    """``id, other, distance, rank``: the k nearest of each row, itself included, by matrix products of blocks; of these the ones up to ``max_distance``.

    Rows are hashed into blocks and every pair of blocks is one task, so this is
    the exact path for tables up to ``INDEX_THRESHOLD`` and refuses larger ones; :func:`neighbours`
    goes over to :func:`probe` there. Zero and null vectors take no part.
    """
    usable = vectors.where(F.col(vec_col).isNotNull() & F.exists(vec_col, lambda x: x != 0)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    n = usable.count()
    if n > INDEX_THRESHOLD:
        raise ValueError(f"{n} vectors are too many to compare all with each other; use neighbours() or probe()")
    blocks = max(1, -(-n // per_block))
    at = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = usable.withColumn("x", at).withColumn("y", other)
    right = usable.withColumn("y", at).withColumn("x", other)
    near = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(_block_neighbours(k, max_distance), "id bigint, other bigint, distance double")
    w = Window.partitionBy("id").orderBy("distance", "other")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, k: int = LINK_NEIGHBOURS, precision: str = "balanced", id_col: str = "vec_id", vec_col: str = "embedding", max_distance: float = np.inf) -> DataFrame:
    """``id, other, distance, rank``: exact below ``INDEX_THRESHOLD`` rows, by cells above, as many of them searched as the precision says."""
    n = vectors.count()
    if n < INDEX_THRESHOLD:
        return knn_exact(vectors, k, id_col, vec_col, max_distance=max_distance)
    return probe(vectors, fit_cells(vectors, partitions_for(n), vec_col), k, PRESETS[precision][0], id_col, vec_col, max_distance)


def link_pairs(near: DataFrame, max_distance: float) -> DataFrame:
    """``id_a, id_b, distance``: neighbours at most ``max_distance`` apart, each unordered pair once."""
    kept = near.where((F.col("distance") <= max_distance) & (F.col("id") != F.col("other")))
    return kept.groupBy(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).agg(F.min("distance").alias("distance"))


def partitions_for(rows: int) -> int:
    return int(np.clip(int(np.sqrt(rows)), 128, 2048))


def fit_cells(vectors: DataFrame, cells: int, vec_col: str = "embedding", fit_rows: int = FIT_ROWS, seed: int = 5) -> np.ndarray:
    """Unit centroids fitted on at most ``fit_rows`` vectors, a bound on what reaches the driver."""
    share = min(1.0, fit_rows / max(1, vectors.count()))
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).alias("v"))
    rows = rows.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) <= int(share * 1_000_000)).limit(fit_rows).toPandas()
    x = np.stack(rows["v"].to_numpy()).astype(np.float64)
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(cells, len(x)), replace=False)]
    for _ in range(10):
        near = np.argmax(x @ c.T, axis=1)
        for i in range(len(c)):
            if (near == i).any():
                m = x[near == i].mean(axis=0)
                c[i] = m / max(np.linalg.norm(m), 1e-12)
    return c


def _shards(centroids: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each cell; cells that lie alike along the widest direction share one."""
    along = centroids @ np.linalg.svd(centroids - centroids.mean(axis=0), full_matrices=False)[2][0]
    out = np.empty(len(centroids), dtype=np.int32)
    out[np.argsort(along, kind="stable")] = np.arange(len(centroids)) * shards // len(centroids)
    return out


def _cell_neighbours(k: int, most: float):
    one = _block_neighbours(k, most)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [one(key, left[:0], right[:0])]
        if len(left) and len(right):
            cells = np.concatenate(left["cells"].to_numpy())
            row = np.repeat(np.arange(len(left)), left["cells"].map(len))
            order = np.argsort(cells, kind="stable")
            for c, base in right.groupby("cell"):
                a, b = np.searchsorted(cells[order], [c, c + 1])
                found.append(one(key, left.iloc[row[order[a:b]]], base))
        return pd.concat(found, ignore_index=True)

    return run


def probe(vectors: DataFrame, centroids: np.ndarray, k: int = LINK_NEIGHBOURS, probes: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", max_distance: float = np.inf, per_shard: int = PER_SHARD) -> DataFrame:
    """``id, other, distance, rank`` by searching the ``probes`` nearest cells of each row and comparing exactly there.

    Cells are held in shards of about ``per_shard`` rows, so that a row travels once
    to each shard it probes. Only neighbours up to ``max_distance`` are kept.
    """
    probes = min(probes, len(centroids))
    usable = vectors.where(F.col(vec_col).isNotNull() & F.exists(vec_col, lambda x: x != 0)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    shard_of = _shards(centroids, min(len(centroids), max(1, -(-usable.count() // per_shard))))

    def nearest(f: pd.DataFrame) -> np.ndarray:
        x = np.stack(f["v"].to_numpy()).astype(np.float64)
        return np.argsort(-(x @ centroids.T), axis=1)[:, :probes].astype(np.int32)

    def base(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                cell = nearest(f)[:, 0]
                yield pd.DataFrame({"id": f["id"], "v": f["v"], "x": shard_of[cell], "cell": cell})

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                near = nearest(f)
                at = shard_of[near]
                for x in np.unique(at):
                    rows = np.flatnonzero((at == x).any(axis=1))
                    yield pd.DataFrame({"id": f["id"].to_numpy()[rows], "v": f["v"].to_numpy()[rows], "x": x, "cells": [near[r][at[r] == x] for r in rows]})

    row = f"id bigint, v {vectors.schema[vec_col].dataType.simpleString()}, x int"
    left, right = usable.mapInPandas(asked, f"{row}, cells array<int>"), usable.mapInPandas(base, f"{row}, cell int")
    near = left.groupBy("x").cogroup(right.groupBy("x")).applyInPandas(_cell_neighbours(k, max_distance), "id bigint, other bigint, distance double")
    w = Window.partitionBy("id").orderBy("distance", "other")
    return near.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
