"""Problem 3: one group identifier for all nodes tied directly or through others.

Method: a two-dimensional grid. Vertices are hashed into blocks and an edge goes to
the cell of its two blocks. Each cell runs a union-find of its own and reports a
star of each local component. The representatives of a vertex in its row and
column of cells are then exchanged: the smallest becomes its parent, parents
jump once, and the ties between representatives are the edges of the next,
smaller round. The rounds end when no edge is left, which is when all parents
are stable; the maps of the rounds are then composed backwards. The grid has as many
blocks as make a cell about CELL edges; all edges meet first in a grid of at least
BLOCKS blocks, and only what rounds have shrunk to CELL edges is one cell. Vertex ids are
hashes, so the smallest id is a random priority and paths shrink geometrically. A
representative of a giant component is a hot key of the exchange; such keys are
looked up by :func:`_lookup`, which leaves their rows where they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..plans.skew import grouped, join_counted

CELL = 500_000
BLOCKS = 4
HOT = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over one cell: the vertices that are no root, and their roots (smallest id of the local component)."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(ids))
    while len(u):
        hi, lo = np.maximum(u, v), np.minimum(u, v)
        np.minimum.at(parent, hi, lo)
        while True:  # compress all paths
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        u, v = parent[u], parent[v]
        apart = u != v
        u, v = u[apart], v[apart]
    below = parent != np.arange(len(ids))
    return ids[below], ids[parent[below]]


def _cells(edges: DataFrame, blocks: int) -> DataFrame:
    """``a, b, cell, part``: a cell that holds over four times CELL edges, as hubs make it, is cut into parts by its edges.

    The broadcast table has one row for each such cell, so at most one for two million edges.
    """
    side = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(17)), F.lit(blocks))
    x, y = side("a"), side("b")
    celled = edges.withColumn("cell", F.least(x, y) * F.lit(blocks) + F.greatest(x, y))
    if blocks == 1:
        return celled.withColumn("part", F.lit(0).cast("bigint"))
    hot = celled.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 4 * CELL).select("cell", F.ceil(F.col("n") / CELL).alias("parts"))
    return celled.join(F.broadcast(hot), "cell", "left").select("a", "b", "cell", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).alias("part"))


def _lookup(rows: DataFrame, key: str, table: DataFrame, value: str, total: int) -> DataFrame:
    """``rows`` with ``value``: that of ``table``, which has one row a ``key``, or the key itself where it has none.

    A key met by over HOT rows of two numbers is not shuffled; it may weigh some 16 MB up to there.
    """
    if total <= HOT:
        return rows.join(table, key, "left").withColumn(value, F.coalesce(value, key))
    of = rows.groupBy(key).agg(F.count("*").alias("_n")).join(table, key, "left").select(key, F.coalesce(value, key).alias(value), "_n")
    return join_counted(rows, of, key, "_n", total, HOT)


def _unite(table: pa.Table) -> pa.Table:
    v, r = local_roots(table.column("a").to_numpy(), table.column("b").to_numpy())
    return pa.table({"v": pa.array(v, pa.int64()), "r": pa.array(r, pa.int64())})


def grid_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with an edge to another node; ``root`` is a node of its component.

    Edges are undirected; repeats, loops and rows with a null end tie nothing more.
    """
    tie = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    left = materialize(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(tie(F.col(a), F.col(b)).alias("e")).select("e.a", "e.b").distinct(), "edges"
    )
    levels: list[tuple[DataFrame, int]] = []
    while n := left.count():
        blocks = max(1 if levels else BLOCKS, math.ceil(math.sqrt(2 * n / CELL)) if n > CELL else 1)
        forest = materialize(grouped(_cells(left, blocks), ["cell", "part"], blocks * (blocks + 1) // 2, 2).applyInArrow(_unite, "v bigint, r bigint"), "forest")
        if blocks == 1:
            levels.append((forest.select("v", F.col("r").alias("p")), n))
            break
        first = forest.groupBy("v").agg(F.min("r").alias("p"))
        up = first.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = materialize(_lookup(first, "p", up, "pp", n).select("v", F.col("pp").alias("p")), "parents")
        levels.append((parent, n))
        of_v = parent.select("v", F.col("p").alias("x"))
        of_r = parent.select(F.col("v").alias("r"), F.col("p").alias("y"))
        moved = _lookup(forest.join(of_v, "v"), "r", of_r, "y", n).select("x", "y").where("x <> y")
        left = materialize(moved.select(tie(F.col("x"), F.col("y")).alias("e")).select("e.a", "e.b").distinct(), "edges")
    if not levels:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = levels[-1][0]
    for parent, n in reversed(levels[:-1]):
        above = labels.select(F.col("v").alias("p"), F.col("p").alias("top"))
        here = _lookup(parent, "p", above, "top", n).select("v", F.col("top").alias("p"))
        labels = materialize(here.unionByName(labels.join(parent.select("v"), "v", "left_anti")), "labels")
    roots = labels.select(F.col("p").alias("v")).distinct().select("v", F.col("v").alias("p"))
    return labels.unionByName(roots).select(F.col("v").alias("node"), F.col("p").alias("root"))


def node_key(path: Column, channel: Column) -> Column:
    """Text key of a node: the path with forward slashes, then a bar and the channel, or nothing for the composite."""
    plain = channel.isNull() | channel.isin("", "RGB", "Composite")
    return F.concat(F.translate(path, "\\", "/"), F.when(plain, "").otherwise(F.concat(F.lit("|"), channel)))


def match_groups(edges: DataFrame) -> DataFrame:
    """``group_key, member_key`` for each node that is tied to another one.

    ``group_key`` is the smallest key of the group by code point. Rows with a
    null path and ties of a node with itself tie nothing; an empty table has no groups.
    """
    ends = edges.where(F.col("path1").isNotNull() & F.col("path2").isNotNull()).select(
        node_key(F.col("path1"), F.col("channel1")).alias("k1"), node_key(F.col("path2"), F.col("channel2")).alias("k2")
    ).where("k1 <> k2")
    keys = ends.select(F.explode(F.array("k1", "k2")).alias("key")).distinct()
    salt = 0
    while True:  # ids are 64-bit hashes of the keys; another salt if two keys meet
        nodes = materialize(keys.select(F.xxhash64(F.lit(salt), "key").alias("node"), "key"), "nodes")
        seen = nodes.agg(F.count("*").alias("n"), F.count_distinct("node").alias("d")).first()
        if seen.n == seen.d:
            break
        salt += 1
    of = grid_components(ends.select(F.xxhash64(F.lit(salt), "k1").alias("a"), F.xxhash64(F.lit(salt), "k2").alias("b")))
    members = materialize(nodes.join(of, "node").select("root", F.col("key").alias("member_key")), "members")
    groups = members.groupBy("root").agg(F.min("member_key").alias("group_key"), F.count("*").alias("n"))
    return join_counted(members, groups, "root", "n", seen.n).select("group_key", "member_key")
