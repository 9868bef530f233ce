"""Exact duplicates by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_counted


def hash_groups(files: DataFrame, key: str = "hash") -> DataFrame:
    """``key, members, rep`` for each content hash; the smallest path stands for all. Null hashes form no group."""
    return files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("members"), F.min("path").alias("rep"))


def exact_edges(files: DataFrame, key: str = "hash") -> DataFrame:
    """``path1, path2``: the representative with each other member of its group, n - 1 edges a group."""
    groups = hash_groups(files, key).where("members > 1")
    rows = files.where(F.col(key).isNotNull()).select(key, "path")
    total = groups.agg(F.coalesce(F.max("members"), F.lit(0)).alias("m")).first().m
    joined = rows.join(groups.drop("members"), key) if total <= 100_000 else join_counted(rows, groups, key, "members", rows.count())
    return joined.where("path <> rep").select(F.col("rep").alias("path1"), F.col("path").alias("path2"))


def representatives(files: DataFrame, key: str = "hash") -> DataFrame:
    """Files that later stages look at: one for each content hash. Files without a hash failed to load and leave here."""
    return files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*files.columns), "path").alias("f")).select("f.*")


def skipped(files: DataFrame, key: str = "hash") -> DataFrame:
    return files.where(F.col(key).isNull()).select("path")
