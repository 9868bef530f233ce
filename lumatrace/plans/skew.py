"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, floor: int = 100_000) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and the number of ``rows`` it meets.

    Keys that meet more than ``max(floor, total / 1000)`` rows number fewer than
    1000 whatever the input, so these alone are broadcast and their rows stay where they are; all other rows
    are shuffled by key, and no partition of that shuffle has a hot key in it.
    """
    limit = max(floor, total // 1000)
    if total <= limit:
        return rows.join(keyed.drop(count), key)
    hot = F.broadcast(keyed.where(F.col(count) > limit))
    few = rows.join(hot.drop(count), key)
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col(count) <= limit).drop(count), key)
    return few.unionByName(rest)


def lookup(rows: DataFrame, key: str, table: DataFrame, value: str, total: int, hot: int = 1_000_000) -> DataFrame:
    """``rows`` with ``value``: that of ``table``, which has one row a ``key``, or null where it has none.

    A key met by over ``hot`` rows is not shuffled; ``total`` bounds the number of rows.
    """
    if total <= hot:
        return rows.join(table, key, "left")
    of = rows.groupBy(key).agg(F.count("*").alias("_n")).join(table, key, "left").select(key, value, "_n")
    return join_counted(rows, of, key, "_n", total, hot)


def grouped(rows: DataFrame, keys: list[str], groups: int, per_task: int = 8) -> GroupedData:
    """``rows`` grouped by ``keys`` for functions over groups of a bounded size, with as many tasks as ``groups`` groups of them need.

    The session's number of shuffle partitions does not grow with the data, so a task of it would; here a task has about
    ``per_task`` groups at most. Few groups are spread over more tasks than there are groups, so that hardly any two share one.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(min(4 * groups, 8 * cores), -(-groups // per_task), 1), *keys).groupBy(*keys)
