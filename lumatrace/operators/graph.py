"""Connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialize
from ..plans.skew import join_counted, lookup

#: edges up to which one task runs a union-find; a bound of some tens of megabytes
ONE_TASK = 500_000
HOT = 1_000_000


def union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest number of the component of each of 0..n-1: all edges hook at once, then all paths are compressed."""
    parent = np.arange(n)
    while len(u):
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        u, v = parent[u], parent[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return parent


def _in_one_task(pairs: DataFrame) -> DataFrame:
    kind = pairs.schema["x"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        n = table.num_rows
        both = np.concatenate([table.column(c).to_numpy() for c in ("x", "y")])
        ids, flat = np.unique(both, return_inverse=True)
        parent = union_find(flat[:n], flat[n:], len(ids))
        for at in np.array_split(np.arange(len(ids)), max(1, len(ids) // 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], table.schema.field("x").type), pa.array(ids[parent[at]], table.schema.field("x").type)], names=["node", "component"])

    return pairs.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _bound(most: DataFrame, total: int) -> int:
    """What bounds the rows of a key in a join: the number in ``most`` if no key is hot by it, else all rows."""
    found = most.first()[0] or 0
    return found if found <= HOT else total


def _contract(edges: DataFrame, n: int) -> DataFrame:
    """``node, component`` for both ends of ``n`` distinct edges ``x < y`` of numbers in random order; the component is one of its nodes.

    In a round all nodes hook to their smallest neighbour, parents jump once and the edges between parents are the
    next round's, which are a third or fewer, chains and hubs alike; what a task can hold ends the rounds. The parents
    of the rounds are then composed backwards.
    """
    rounds: list[tuple[DataFrame, int]] = []
    while n > ONE_TASK:
        both = edges.union(edges.select("y", "x"))
        near = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("p"), F.count("*").alias("n")), "near")
        most = _bound(near.agg(F.max("n") + 1), 2 * n)  # only its neighbours and itself have a node as parent
        jump = near.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        parents = materialize(lookup(near.select("x", "p"), "p", jump, "pp", most, HOT).select("x", F.col("pp").alias("p")), "parents")
        rounds.append((parents, 2 * n))
        from_x = lookup(edges, "x", parents.select("x", F.col("p").alias("px")), "px", most, HOT)
        ends = lookup(from_x, "y", parents.select(F.col("x").alias("y"), F.col("p").alias("py")), "py", most, HOT).where("px <> py")
        left = materialize(ends.select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct(), "edges")
        discard(near)
        discard(edges)
        edges, n = left, left.count()
    labels = materialize(_in_one_task(edges), "labels")
    for parents, total in reversed(rounds):
        most = _bound(parents.groupBy("p").count().agg(F.max("count")), total)
        above = labels.select(F.col("node").alias("p"), F.col("component").alias("top"))
        below = materialize(lookup(parents, "p", above, "top", most, HOT).select(F.col("x").alias("node"), F.coalesce("top", "p").alias("component")), "labels")
        discard(parents)
        discard(labels)
        labels = below
    return labels


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``node, component`` for all nodes of ``edges``; the component is its smallest node.

    Up to ``ONE_TASK`` distinct edges one task suffices. Beyond, nodes are numbered by hashes and
    the numbers' graph is contracted, so the rounds grow with the logarithm of the edges however far across a
    component is; a round's table cuts the lineage. Hubs and the parents of giant
    components are hot keys of these joins and are looked up where their rows are. Null ends tie
    nothing; a loop keeps its node as a component of its own.
    """
    ok = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    once = materialize(ok.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    n = once.count()
    if n <= ONE_TASK:
        return materialize(_in_one_task(once), "labels")
    keys = once.select(F.explode(F.array("x", "y")).alias("node"))
    salt = 0
    while True:  # another salt if two nodes meet
        nodes = materialize(keys.groupBy(F.xxhash64(F.lit(salt), "node").alias("id")).agg(F.min("node").alias("node"), F.max("node").alias("last")), "nodes")
        if not nodes.where("node <> last").limit(1).count():
            break
        discard(nodes)
        salt += 1
    number = [F.xxhash64(F.lit(salt), c) for c in ("x", "y")]
    ties = materialize(once.where("x <> y").select(F.least(*number).alias("x"), F.greatest(*number).alias("y")), "edges")
    discard(once)
    of = _contract(ties, n).select(F.col("node").alias("id"), "component")
    labels = materialize(nodes.join(of, "id", "left").select(F.coalesce("component", "id").alias("root"), "node"), "labels")
    discard(nodes)
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    return join_counted(labels, smallest, "root", "n", _bound(smallest.agg(F.max("n")), 2 * n), HOT).select("node", "component")
