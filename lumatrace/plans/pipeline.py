"""The duplicate scan and the search, from tables to result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..operators import bands, clusters, exact, similar
from .config import ScanConfig
from .scratch import materialize


def perceptual_evidence(hashes: DataFrame, methods: list[tuple[str, str, int]], mode: str = "pivot") -> DataFrame:
    """Evidence rows of hash methods (name, column, bits) from rows (path, channel, hashes).

    Nodes are numbered in the order of their keys, so that the bands move numbers and still have the smallest key as pivot.
    """
    columns = [c for _, c, _ in methods]
    keyed = hashes.select(clusters.node_key(F.col("path"), F.col("channel")).alias("node"), *columns)
    numbered = materialize(clusters.number_groups(keyed.select("node").distinct(), "node"), "numbers")
    rows = materialize(keyed.join(numbered, "node").select(F.col("group_id").alias("id"), *columns), "hashes")
    near = [bands.banded_pairs(rows, "id", column, bits, mode).select("id_a", "id_b", F.lit(method).alias("method")) for method, column, bits in methods]
    pairs = near[0]
    for more in near[1:]:
        pairs = pairs.union(more)
    pairs = materialize(pairs, "near")
    last = F.substring_index("node", "|", -1)
    # a path may hold a bar; the channel is what follows the last one
    path, channel = F.substring(F.col("node"), F.lit(1), F.length("node") - F.length(last) - 1), F.nullif(last, F.lit(""))
    end = lambda side, i: numbered.select(F.col("group_id").alias(f"id_{side}"), path.alias(f"path{i}"), channel.alias(f"channel{i}"))
    both = pairs.join(end("a", 1), "id_a").join(end("b", 2), "id_b")
    return both.select("path1", "channel1", "path2", "channel2", "method", F.lit(0.0).alias("distance"))


def with_composites(files: DataFrame) -> DataFrame:
    """``files`` with one composite node for each path that has a content hash and only channel nodes; its metadata is that of its first channel."""
    whole = clusters.node_key(F.col("path"), F.col("channel")) == clusters.node_key(F.col("path"), F.lit(None).cast("string"))
    first = F.min_by(F.struct(*files.columns), F.struct(F.col("hash").isNull(), F.col("channel"))).alias("f")
    lacking = files.groupBy("path").agg(F.max(whole).alias("whole"), first).where("NOT whole AND f.hash IS NOT NULL").select("f.*")
    return files.unionByName(lacking.withColumn("channel", F.lit(None).cast("string")))


def duplicate_scan(config: ScanConfig, files: DataFrame, hashes: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Result rows of a duplicate scan.

    ``files``: one row a node with metadata and ``hash`` (content). ``hashes``: path, channel, dhash, phash,
    whash. ``links``: evidence rows of vector neighbours. Stages are left out as
    the configuration says; files without a content hash take no part. Exact
    copies are tied as composites, which files seen by channel only get here.
    """
    c = config.validate()
    producers = []
    files = materialize(with_composites(files) if c.find_exact else files, "files")
    if c.find_exact:
        e = exact.exact_edges(files.select("path", "hash").distinct())
        null = F.lit(None).cast("string")
        producers.append(e.select("path1", null.alias("channel1"), "path2", null.alias("channel2"), F.lit("xxHash").alias("method"), F.lit(0.0).alias("distance")))
    if hashes is not None:
        every = ((c.find_dhash, "dHash", "dhash", c.dhash_bits), (c.find_phash, "pHash", "phash", c.phash_bits), (c.find_whash, "wHash", "whash", c.whash_bits))
        if methods := [m for on, *m in every if on]:
            producers.append(perceptual_evidence(hashes, methods))
    if links is not None and c.use_ai:
        producers.append(links.where(F.col("distance") <= vec.threshold_distance(c.similarity)))
    pairs = materialize(clusters.merge_evidence(clusters.union_evidence(*producers)), "pairs")
    keys = F.array(*(clusters.node_key(F.col("path"), x) for x in (F.col("channel"), F.lit(None).cast("string"))))  # the hash is the file's, so the composite has it too
    twins = files.where(F.col("hash").isNotNull()).select(F.explode(keys).alias("node"), "hash").distinct()
    groups = materialize(clusters.star_groups(files, pairs, twins if c.find_exact else None), "groups")
    return clusters.result_rows(groups, files)


def vector_links(config: ScanConfig, vectors: DataFrame, dim: int) -> DataFrame:
    """Evidence rows of neighbours within the threshold of similarity, from rows (item_id, path, channel, vector).

    An item counts once. Below ``INDEX_THRESHOLD`` items all are compared; above,
    each searches as many cells as the precision says, and distances there are exact.
    """
    c = config.validate()
    most = vec.threshold_distance(c.similarity)
    rows = vectors.where(F.col("item_id").isNotNull() & F.col("path").isNotNull() & vec.usable(F.col("vector"), dim))
    one = materialize(rows.groupBy("item_id").agg(F.min(F.struct("path", "channel", "vector")).alias("r")).select("item_id", "r.*"), "vectors")
    near = similar.neighbours(one, similar.LINK_NEIGHBOURS, c.precision, "item_id", "vector", most)
    end = lambda i, x: one.select(F.col("item_id").alias(x), F.col("path").alias(f"path{i}"), F.col("channel").alias(f"channel{i}"))
    pairs = similar.link_pairs(near, most).join(end(1, "id_a"), "id_a").join(end(2, "id_b"), "id_b")
    return pairs.select("path1", "channel1", "path2", "channel2", F.lit("AI").alias("method"), "distance")


def search(config: ScanConfig, vectors: DataFrame, query: list[float], query_row: DataFrame, id_col: str = "path", vec_col: str = "vector") -> DataFrame:
    """Result rows of a text or sample search: the query and what lies below the distance threshold among its nearest."""
    c = config.validate()
    hits = similar.vector_search(vectors, query, vec.threshold_distance(c.similarity), similar.SEARCH_TOP, id_col, vec_col)
    return clusters.search_group(query_row, hits.select(F.col(id_col).alias("path"), "distance"))
