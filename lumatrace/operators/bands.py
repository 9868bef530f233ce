"""Banded matching of 64-bit perceptual hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import BAND_BITS, bands, hamming
from ..plans.skew import join_counted

#: classes of a bucket from which it is filed finer; at most 262 144 buckets can have any
HOT = 4096


def banded_pairs(hashes: DataFrame, id_col: str, hash_col: str, max_bits: int, mode: str = "pivot") -> DataFrame:
    """``id_a, id_b, bits`` for rows that share one of four 16-bit bands and differ in at most ``max_bits`` bits.

    Mode ``pivot`` compares the smallest id of a bucket with the others, which is
    linear in a bucket however hot it is. Mode ``all_pairs`` compares all within a
    bucket; rows of equal hash are one class there, its smallest id being compared for all.
    Distances up to three always share a band; beyond, banding may miss a pair.
    """
    rows = hashes.where(F.col(hash_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    if mode == "all_pairs":
        rows = rows.groupBy("h").agg(F.min("id").alias("id"))
    elif mode != "pivot":
        raise ValueError(f"unknown mode {mode!r}")
    filed = rows.select("id", "h", F.explode(bands(F.col("h"))).alias("b")).select("id", "h", (F.col("b.band") * (1 << BAND_BITS) + F.col("b.key")).alias("key"))
    if mode == "pivot":
        pivot = filed.groupBy("key").agg(F.min(F.struct("id", "h")).alias("p"), F.count("*").alias("n")).where("n > 1")
        met = join_counted(filed, pivot, "key", "n", 4 * rows.count())
        met = met.select(F.col("p.id").alias("id_a"), F.col("p.h").alias("h_a"), F.col("id").alias("id_b"), F.col("h").alias("h_b"))
    else:
        filed = _finer(filed, max_bits)
        left = filed.select("key", "part", F.col("id").alias("id_a"), F.col("h").alias("h_a"))
        right = filed.select("key", "part", F.col("id").alias("id_b"), F.col("h").alias("h_b"))
        met = left.join(right, ["key", "part"])
    near = met.where("id_a < id_b").withColumn("bits", hamming(F.col("h_a"), F.col("h_b"))).where(F.col("bits") <= max_bits)
    return near.select("id_a", "id_b", "bits").distinct()


def _finer(filed: DataFrame, max_bits: int) -> DataFrame:
    """``id, h, key, part``: rows of a hot bucket are filed under each of ``max_bits`` + 1 parts of their other 48 bits, one of which any near pair shares."""
    hot = filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot"))
    marked = filed.join(F.broadcast(hot), "key", "left")
    band = F.shiftright("key", BAND_BITS).cast("int")
    low = F.col("h").bitwiseAND(F.expr("shiftleft(1L, cast(16 * shiftright(key, 16) as int)) - 1"))
    rest = F.when(band == 3, F.col("h").bitwiseAND((1 << 48) - 1)).otherwise(
        F.expr("shiftleft(shiftrightunsigned(h, cast(16 * (shiftright(key, 16) + 1) as int)), cast(16 * shiftright(key, 16) as int))").bitwiseOR(low)
    )
    parts = min(48, max_bits + 1)
    cuts = [48 * i // parts for i in range(parts + 1)]
    keys = [F.shiftrightunsigned(rest, a).bitwiseAND((1 << (b - a)) - 1) * parts + i for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return marked.withColumn("part", F.explode(F.when(F.col("hot"), F.array(*keys)).otherwise(F.array(F.lit(-1).cast("bigint"))))).drop("hot")


def whole_pairs(hashes: DataFrame, id_col: str, hash_col: str, max_bits: int) -> DataFrame:
    """``id_a, id_b, bits`` of all distinct hashes, each under its smallest id, that differ in at most ``max_bits`` bits; none is missed.

    Of ``max_bits // 2 + 1`` parts, the last few equal or one of the others differing
    in one bit at most is what any such pair has. Parts that differ in a bit meet
    where the one that has it set is filed without it.
    """
    rows = hashes.where(F.col(hash_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"))
    parts = max_bits // 2 + 1
    loose = max_bits - parts + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    filed, asked = [], []
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        key = F.shiftrightunsigned("h", low).bitwiseAND((1 << min(63, high - low)) - 1 if high - low < 64 else -1)
        at = lambda k, i=i: F.struct(F.lit(i).alias("part"), k.alias("key"))
        filed.append(at(key))
        asked.append(at(key))
        if i < loose:
            asked += [F.when(key.bitwiseAND(1 << b) != 0, at(key.bitwiseXOR(F.lit(1 << b).cast("bigint")))) for b in range(high - low)]
    base = rows.select("id", "h", F.explode(F.array(*filed)).alias("at")).select("at.part", "at.key", F.col("id").alias("x"), F.col("h").alias("g"))
    probes = rows.select("id", "h", F.explode(F.array(*asked)).alias("at")).where("at IS NOT NULL").select("at.part", "at.key", "id", "h")
    near = probes.join(base, ["part", "key"]).withColumn("bits", hamming(F.col("h"), F.col("g"))).where((F.col("id") != F.col("x")) & (F.col("bits") <= max_bits))
    return near.select(F.least("id", "x").alias("id_a"), F.greatest("id", "x").alias("id_b"), "bits").distinct()


def no_pairs(hashes: DataFrame, id_col: str) -> DataFrame:
    """An empty table of pairs, for classes without their links."""
    kind = hashes.schema[id_col].dataType.simpleString()
    return hashes.sparkSession.createDataFrame([], f"id_a {kind}, id_b {kind}, bits int")


def class_members(hashes: DataFrame, pairs: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """``item_id, rep, links``: each item with the one compared for all of its hash, and the number of near hashes in ``pairs`` of such representatives."""
    rows = hashes.where(F.col(hash_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(hash_col).alias("h")).distinct()
    reps = rows.groupBy("h").agg(F.min("item_id").alias("rep"))
    ends = pairs.select(F.col("id_a").alias("rep")).unionAll(pairs.select("id_b")).groupBy("rep").agg(F.count("*").alias("links"))
    linked = reps.join(ends, "rep", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return rows.join(linked, "h").select("item_id", "rep", "links")
