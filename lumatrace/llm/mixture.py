"""Problem 7: combine sources so that each has its target share of the tokens.

Method: texts of a source are laid end to end and cut into blocks of BLOCK
tokens. The output is as long as all listed texts together; it is made of shards
of SHARD_SLOTS block slots. The number of slots a source has in a shard is a
multinomial draw, conditioned on the exact total of each source: the root of a
binary tree over the shards holds the totals and each node divides its counts
between its halves by a hypergeometric draw seeded by the node, so any
shard finds its counts and where they start by itself. Slot s of a source is
block permutation(s mod n) of pass s div n; each pass has another
pseudorandom permutation. Slots beyond the last allowed pass stay empty, which
is what the report shows as missing. Blocks are then joined by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .tokens import token_count

BLOCK = 512
SHARD_SLOTS = 4096
PER_RUN = 2_000_000
MAX_SOURCES = 10_000


def source_name(source: Column) -> Column:
    """Letters only, in lower case."""
    return F.regexp_replace(F.lower(source), r"[^\p{L}]", "")


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 at the given places: a four-round Feistel network that walks its cycles back into range."""
    if n <= 1:
        return np.zeros_like(at)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for r in range(4):
                f = (right + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
            out[todo] = (left << np.uint64(half)) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_counts(shard: int, shards: int, totals: np.ndarray, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in this shard and in all shards before it."""
    lo, hi, counts, before = 0, shards, totals.astype(np.int64), np.zeros(len(totals), dtype=np.int64)
    size = int(totals.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left_size = min(size, (mid - lo) * slots)
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(counts, left_size, method="marginals") if size < 1_000_000_000 else _big_split(rng, counts, left_size)
        if shard < mid:
            hi, counts, size = mid, left, left_size
        else:
            lo, counts, size, before = mid, counts - left, size - left_size, before + left
    return counts, before


def _big_split(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """The hypergeometric division at sizes where its normal limit is exact to well under one part in a thousand."""
    total = int(counts.sum())
    share = take / total
    draw = counts * share + rng.normal(size=len(counts)) * np.sqrt(counts * share * (1 - share))
    left = np.clip(np.rint(draw).astype(np.int64), 0, counts)
    for i in np.argsort(-counts):
        gap = take - int(left.sum())
        left[i] = np.clip(left[i] + gap, 0, counts[i])
    return left


def _sized(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    wanted = targets.where(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("name")).agg(
        F.min("source").alias("source"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats")
    )
    docs = documents.where(F.col("doc_id").isNotNull()).select("doc_id", source_name(F.col("source")).alias("name"), token_count(F.col("text")).alias("tokens"))
    if wanted.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} listed sources; this list is a small table")
    return docs.join(F.broadcast(wanted.select("name", "source")), "name").select("doc_id", "source", "tokens"), wanted


def mix(documents: DataFrame, targets: DataFrame, seed: int = 11, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frames: ``plan`` (shard, slot, source, block, pass), ``pieces`` (source, block, doc_id, start, tokens)
    and ``report`` (one row for each listed source).

    Source names match by their letters alone, whatever the case. Null texts
    have no tokens; documents without a listed source take no part; targets that
    match by name add their shares. With no tokens at all the plan is empty. A source is ``short`` if
    the mixture used up all its passes and these have too few tokens. More than MAX_SOURCES listed
    sources are an error.
    """
    docs, wanted = _sized(documents, targets)
    docs = materialize(docs.where("tokens > 0"), "sized")
    tokens_of = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    sizes = wanted.join(tokens_of, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))
    listed = sorted(sizes.collect(), key=lambda r: r.source)  # one row a listed source
    total = sum(r.tokens for r in listed)
    runs = {r.source: max(1, -(-r.tokens // PER_RUN)) for r in listed}

    spark = documents.sparkSession
    run_rows = spark.createDataFrame([(s, n) for s, n in runs.items()] or [("", 1)], "source string, runs bigint")
    # a source is laid out in runs of about PER_RUN tokens, so that no task holds a whole source
    laid = docs.join(F.broadcast(run_rows), "source").withColumn("turn", F.xxhash64("doc_id")).withColumn("run", F.pmod("turn", F.col("runs")))
    before = Window.partitionBy("source", "run").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = materialize(laid.withColumn("at", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("source", "run", "doc_id", "tokens", "at"), "laid")
    run_blocks = laid.groupBy("source", "run").agg(F.ceil(F.max(F.col("at") + F.col("tokens")) / block).alias("blocks"))
    by_run = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = run_blocks.withColumn("base", F.coalesce(F.sum("blocks").over(by_run), F.lit(0)))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("tokens") - 1) / block)
    spread = laid.join(base, ["source", "run"]).withColumn("b", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("b") * block)
    stop = F.least(F.col("at") + F.col("tokens"), (F.col("b") + 1) * block)
    pieces = materialize(
        spread.select("source", (F.col("base") + F.col("b")).alias("block"), "doc_id", (begin - F.col("at")).alias("start"), (stop - begin).alias("tokens")), "pieces"
    )
    n_blocks = {r.source: r.n for r in base.groupBy("source").agg(F.sum("blocks").alias("n")).collect()}

    # slots of each source, as many as its share of the tokens fills with blocks of this source's mean length
    names = [r.source for r in listed]
    have = np.array([n_blocks.get(r.source, 0) for r in listed], dtype=np.int64)
    mean = np.array([r.tokens / n_blocks[r.source] if n_blocks.get(r.source) else float(block) for r in listed])
    totals = np.rint(np.array([r.target_share * total for r in listed]) / mean).astype(np.int64) if total else np.zeros(len(listed), dtype=np.int64)
    repeats = np.array([r.max_repeats for r in listed], dtype=np.int64)
    shards = max(1, -(-int(totals.sum()) // SHARD_SLOTS)) if len(listed) else 1

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                counts, start = shard_counts(int(shard), shards, totals, SHARD_SLOTS, seed)
                which = np.repeat(np.arange(len(names)), counts)
                if not len(which):
                    continue
                s = np.concatenate([np.arange(a, a + c) for a, c in zip(start, counts)])
                slot = np.random.Generator(np.random.PCG64([seed, 1, int(shard)])).permutation(len(which))
                turn = s // np.maximum(have[which], 1)
                ok = (have[which] > 0) & (turn < repeats[which])
                blk = np.zeros(len(s), dtype=np.int64)
                for i in np.unique(which):
                    for t in np.unique(turn[(which == i) & ok]):
                        at = (which == i) & (turn == t)
                        blk[at] = permuted(s[at] % have[i], int(have[i]), seed * 1_000_003 + int(i) * 8191 + int(t))
                yield pd.DataFrame({"shard": int(shard), "slot": slot[ok], "source": pd.Series([names[i] for i in which[ok]], dtype=object), "block": blk[ok], "pass": turn[ok]})

    plan = spark.range(0, shards, 1, min(shards, 4096)).mapInPandas(draw, "shard bigint, slot bigint, source string, block bigint, pass bigint")
    plan = materialize(plan, "plan")

    size = pieces.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
    used = plan.groupBy("source", "block").agg(F.count("*").alias("uses"))
    got = used.join(size, ["source", "block"]).groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("mixed_tokens"), F.max("uses").alias("most_uses"))
    asked = spark.createDataFrame([(n, int(t), int(r)) for n, t, r in zip(names, totals, have * repeats)] or [("", 0, 0)], "source string, slots bigint, room bigint")
    filled = plan.groupBy("source").agg(F.count("*").alias("filled"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # over the listed sources only
    report = (
        sizes.join(asked, "source").join(got, "source", "left").join(filled, "source", "left")
        .select("source", "target_share", "max_repeats", "documents", "tokens", (F.col("target_share") * F.lit(float(total))).alias("wanted_tokens"),
                F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
                (F.col("slots") - F.coalesce("filled", F.lit(0))).alias("empty_slots"), (F.coalesce("filled", F.lit(0)) >= F.col("room")).alias("used_up"))
        .withColumn("actual_share", F.round(F.col("mixed_tokens") / F.when(whole > 0, whole), 6))
        .withColumn("short", F.col("used_up") & (F.col("max_repeats") * F.col("tokens") < F.col("wanted_tokens")))
        .drop("used_up")
    )
    return plan, pieces, report


def mixed_documents(documents: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """``shard, slot, source, block, pass, doc_id, start, tokens``: the mixture, blocks joined by index."""
    plan, pieces, _ = mix(documents, targets, seed)
    return plan.join(pieces, ["source", "block"])
