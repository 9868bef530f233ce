"""Cached fingerprints against the files on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(disk: DataFrame, cache: DataFrame) -> DataFrame:
    old = cache.groupBy("path").agg(F.max_by(F.struct("mtime", "file_size", "vector"), "mtime").alias("c")).select("path", F.col("c.mtime").alias("c_mtime"), F.col("c.file_size").alias("c_size"), F.col("c.vector").alias("c_vector"))
    return disk.join(old, "path", "left")


def to_process(disk: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that are new or whose time or size changed."""
    new = F.col("c_mtime").isNull() | (F.col("mtime") != F.col("c_mtime")) | (F.col("file_size") != F.col("c_size"))
    return _joined(disk, cache).where(F.coalesce(new, F.lit(True))).select("path", "mtime", "file_size")


def cache_hits(disk: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose time and size are as cached and whose vector is there."""
    same = (F.col("mtime") == F.col("c_mtime")) & (F.col("file_size") == F.col("c_size")) & F.col("c_vector").isNotNull()
    return _joined(disk, cache).where(same).select("path", "mtime", "file_size")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("path", "channel")) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``; keys compare null-safely. One row a key of ``new`` is kept, the latest by mtime."""
    rows = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), F.struct("mtime", *[c for c in new.columns if c not in (*keys, "mtime", "vector")])).alias("r")).select("r.*")
    mine = rows.select(*(F.col(k).alias(f"_{k}") for k in keys))
    cond = None
    for k in keys:
        c = old[k].eqNullSafe(mine[f"_{k}"])
        cond = c if cond is None else cond & c
    return old.join(mine, cond, "left_anti").unionByName(rows)


def delete_paths(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("path").distinct(), "path", "left_anti")


def select_paths(table: DataFrame, wanted: DataFrame) -> DataFrame:
    return table.join(wanted.select("path").distinct(), "path", "left_semi")
