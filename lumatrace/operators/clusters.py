"""Evidence, leaders, star groups and result rows.

A node is (path, channel); its key joins them null-safely as text. Evidence
rows are (path1, channel1, path2, channel2, method, distance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import method_rank, score
from ..functions.paths import file_name, format_score, group_name
from ..plans.scratch import materialize
from .graph import connected_components

EVIDENCE = ["path1", "channel1", "path2", "channel2", "method", "distance"]


def node_key(path: Column, channel: Column) -> Column:
    """Text key of a node; the composite has no channel."""
    plain = channel.isNull() | channel.isin("", "RGB", "Composite", "Luminance")
    return F.concat(path, F.lit("|"), F.when(plain, "").otherwise(channel))


def union_evidence(*producers: DataFrame) -> DataFrame:
    out = producers[0].select(*EVIDENCE)
    for p in producers[1:]:
        out = out.unionByName(p.select(*EVIDENCE))
    return out


def merge_evidence(evidence: DataFrame) -> DataFrame:
    """``node_a, node_b, method, distance``: the first evidence of each unordered pair in the order of methods, then of distance.

    Rows with a missing path and a node with itself are no evidence.
    """
    ok = evidence.where(F.col("path1").isNotNull() & F.col("path2").isNotNull())
    ends = ok.select(node_key(F.col("path1"), F.col("channel1")).alias("a"), node_key(F.col("path2"), F.col("channel2")).alias("b"), "method", "distance").where("a <> b")
    best = F.min(F.struct(method_rank(F.col("method")).alias("rank"), "distance", "method"))
    return ends.groupBy(F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b")).agg(best.alias("e")).select("node_a", "node_b", "e.method", "e.distance")


def leader_order() -> Column:
    """Struct whose greatest value is the best file: pixels, format, size, short name, early or absent capture date.

    Ties go to the smallest path and channel, so the leader is the least by the negated struct.
    """
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0))
    return F.struct(
        (-zero(c("resolution_w")).cast("bigint") * zero(c("resolution_h"))).alias("pixels"),
        (-format_score(F.coalesce(c("format_str"), F.lit("")))).alias("format"),
        (-zero(c("file_size"))).alias("size"),
        F.length(file_name(c("path"))).alias("name"),
        F.coalesce(c("capture_date"), F.lit(0.0)).alias("taken"),
        c("path"),
        F.coalesce(c("channel"), F.lit("")).alias("channel"),
    )


def leaders(members: DataFrame, group: str = "component") -> DataFrame:
    """``group, leader`` (node key) of each group of files."""
    best = members.groupBy(group).agg(F.min(F.struct(leader_order().alias("o"), "node")).alias("b"))
    return best.select(group, F.col("b.node").alias("leader"))


def star_groups(files: DataFrame, pairs: DataFrame, exact: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """``component, node, leader, is_best, method, distance``: each component's leader and the members tied directly to it.

    ``files``: nodes with the columns of :func:`leader_order`. ``exact``: node and
    content hash; unless ``strict``, members (nodes of the same component) with the
    leader's hash count as tied to it by xxHash even when the evidence names another representative.
    Components of which fewer than two nodes are known, and leaders without a tie, have no group.
    """
    of = connected_components(pairs, "node_a", "node_b")
    known = materialize(of.join(files.withColumn("node", node_key(F.col("path"), F.col("channel"))), "node"), "known")
    lead = leaders(known)
    size = known.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    lead = lead.join(size, "component")
    ties = pairs.select(F.col("node_a").alias("leader"), F.col("node_b").alias("node"), "method", "distance").unionByName(
        pairs.select(F.col("node_b").alias("leader"), F.col("node_a").alias("node"), "method", "distance")
    )
    tied = ties.join(lead, "leader").select("component", "node", "leader", "method", "distance")
    if exact is not None and not strict:
        exact = materialize(exact.join(known.select("node"), "node", "left_semi"), "twins")  # a twin counts in its own component only
        by_hash = lead.join(exact.select(F.col("node").alias("leader"), F.col("hash")), "leader").join(exact, "hash").where("node <> leader")
        twins = by_hash.select("component", "node", "leader", F.lit("xxHash").alias("method"), F.lit(0.0).alias("distance"))
        tied = tied.unionByName(twins).groupBy("component", "node", "leader").agg(F.min(F.struct(method_rank(F.col("method")).alias("r"), "distance", "method")).alias("e"))
        tied = tied.select("component", "node", "leader", "e.method", "e.distance")
    tied = materialize(tied.join(known.select("component", "node"), ["component", "node"], "left_semi"), "tied")
    heads = tied.select("component", "leader").distinct()
    best = heads.select("component", F.col("leader").alias("node"), "leader", F.lit("Best").alias("method"), F.lit(0.0).alias("distance"))
    return best.unionByName(tied).withColumn("is_best", F.col("node") == F.col("leader"))


def result_rows(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Result rows: the file's columns with ``group_id`` (1, 2, ... in the order of the leaders' keys), ``is_best``, ``distance`` (score) and ``found_by``."""
    keyed = files.withColumn("node", node_key(F.col("path"), F.col("channel")))
    number = number_groups(groups.select("leader").distinct(), "leader")
    shown = F.when(F.col("is_best"), 0).otherwise(score(F.col("method"), F.col("distance")))
    return (
        groups.join(number, "leader")
        .withColumn("score", shown.cast("int"))
        .select("node", "group_id", "is_best", F.col("score").alias("distance"), F.col("method").alias("found_by"))
        .join(keyed, "node")
        .drop("node")
    )


def number_groups(keys: DataFrame, key: str) -> DataFrame:
    """``key, group_id`` with ids from 1 in key order: a range sort, then offsets of its partitions."""
    placed = keys.orderBy(key).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    placed = materialize(placed, "ordered")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))  # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("part", "first", before.alias("base"))
    return placed.join(F.broadcast(base), "part").select(key, (F.col("row") - F.col("first") + F.col("base") + 1).alias("group_id"))


def group_summary(results: DataFrame) -> DataFrame:
    """``group_id, name, dup_count, member_count, total_size`` for each group."""
    best = F.max_by(F.struct("path", "channel"), F.struct(F.coalesce("is_best", F.lit(False)).cast("int").alias("b"), F.col("path")))
    out = results.groupBy("group_id").agg(best.alias("b"), F.count("*").alias("member_count"), F.sum(F.coalesce("file_size", F.lit(0))).alias("total_size"))
    return out.select("group_id", group_name(F.col("b.path"), F.col("b.channel")).alias("name"), (F.col("member_count") - 1).alias("dup_count"), "member_count", "total_size")


def search_group(query_row: DataFrame, hits: DataFrame) -> DataFrame:
    """One group: the query (a sample file or a pseudo row) as best, then the hits with their scores."""
    best = query_row.select("path", F.lit(1).cast("bigint").alias("group_id"), F.lit(True).alias("is_best"), F.lit(0).alias("distance"), F.lit("Query").alias("found_by"))
    found = hits.select("path", F.lit(1).cast("bigint").alias("group_id"), F.lit(False).alias("is_best"), score(F.lit("AI"), F.col("distance")).alias("distance"), F.lit("AI").alias("found_by"))
    return best.unionByName(found)
