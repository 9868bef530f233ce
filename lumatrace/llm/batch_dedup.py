"""Problem 1: hold each new batch against everything accepted before it.

Method: a segment index for edit distance. Hashes are strings of fixed length
compared position by position, so the edit distance is the number of differing
bits. A 64-bit pHash is cut into nine segments; two hashes with at most eight
differing bits agree in one of them at least, so the index files every accepted
hash under (analysis type, segment number, segment) and a batch probes its own
nine segments. Inside a bucket the dHash segments are probed in the same way
and both distances are verified. A bucket that has become hot is filed under the
dHash segments too, so it falls apart where these differ. Content hashes are one more key.

The index (:class:`SegmentIndex`) is a table bucketed by group of keys. It is
appended to; a batch shuffles its own probes to it, reads the groups it probes, and neither
files nor moves what was accepted before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_number
from ..plans.scratch import materialize, new_path, remove
from . import buckets as B

SEGMENTS = 9
MAX_BITS = 8
#: bit offset of each segment; one is 8 bits wide, the others 7
CUTS = [0, 7, 14, 21, 28, 35, 42, 49, 56, 64]
STORED = [("phash", "u8"), ("dhash", "u8")]
PROBE = [*STORED, ("item_id", "i8"), ("batch_no", "i4")]
#: stored entries of a group, some six megabytes
PER_GROUP = 240_000
#: entries of an item: its segments and its content
KEYS = SEGMENTS + 1
#: earlier partners named for each item and bucket at once; an item of which more are needed is probed again
PARTNERS = 8
#: rounds of settling before undecided items are probed again
ROUNDS = 6
#: items that are taken at once; a larger delivery is taken in slices
SLICE = 4_000_000
#: lowest bits of a key: a segment of the pHash, a content number, segments of both hashes
PLAIN, CONTENT, FINE, TAGS = (np.uint64(i) for i in range(4))


def segment_values(h: np.ndarray, s: int) -> np.ndarray:
    width = CUTS[s + 1] - CUTS[s]
    return (h >> np.uint64(CUTS[s])) & np.uint64((1 << width) - 1)


def _finer(key: np.ndarray, dhash: np.ndarray, j: int) -> np.ndarray:
    return B.combine(key, segment_values(dhash, j) * np.uint64(SEGMENTS) + np.uint64(j)) & ~TAGS | FINE


def _file(cols: dict[str, np.ndarray], layout: B.Layout) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """Entries of items: image hashes by segment, then content numbers, which travel in the place of the hashes."""
    kind, ph, dh = (cols[c].view(np.uint64) for c in ("kind", "phash", "dhash"))
    near = np.flatnonzero(cols["near"])
    for s in range(SEGMENTS):
        key = B.combine(kind[near], segment_values(ph[near], s) * np.uint64(SEGMENTS) + np.uint64(s)) & ~TAGS
        hot = layout.is_hot(key)
        yield 0, key[~hot], near[~hot], ["phash", "dhash", "item_id", "batch_no"]
        for j in range(SEGMENTS if hot.any() else 0):
            yield 0, _finer(key[hot], dh[near[hot]], j), near[hot], ["phash", "dhash", "item_id", "batch_no"]
    known = np.flatnonzero(cols["known"])
    yield 0, B.combine(kind[known], cols["xx"].view(np.uint64)[known]) & ~TAGS | CONTENT, known, ["xx", "kind", "item_id", "batch_no"]


def items(hashes: DataFrame) -> DataFrame:
    """One row an item: its smallest batch and its hashes.

    Rows without an id are no items. Where deliveries of one item differ, a hash
    present in one of them is used, the greatest if there are several.
    """
    return (
        hashes.where(F.col("item_id").isNotNull() & F.col("batch_no").isNotNull())
        .select(
            "item_id",
            "batch_no",
            F.when(F.col("analysis_type").isNotNull(), F.xxhash64("analysis_type")).alias("kind"),
            content_number(F.col("xxhash")).alias("xx"),
            "phash",
            "dhash",
        )
        .groupBy("item_id")
        .agg(F.min("batch_no").alias("batch_no"), *(F.max(c).alias(c) for c in ("kind", "xx", "phash", "dhash")))
    )


def matchable() -> Column:
    """Whether anything can match an item at all; null matches nothing, a null type included."""
    return F.col("kind").isNotNull() & (F.col("xx").isNotNull() | (F.col("phash").isNotNull() & F.col("dhash").isNotNull()))


def classes(one_each: DataFrame, *within: str) -> DataFrame:
    """Items of equal type and hashes (and of equal ``within``) as one row with the first of them.

    All later copies share the first one's fate or are refused because of it, so
    only the first has to be compared. Items that nothing can match are left out.
    """
    return (
        one_each.where(matchable())
        .groupBy("kind", "xx", "phash", "dhash", *(F.col(c).alias(f"by_{c}") for c in within))
        .agg(F.min(F.struct("batch_no", "item_id")).alias("first"))
        .select("kind", "xx", "phash", "dhash", "first.batch_no", "first.item_id")
    )


def _entries(cls: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    near = F.col("phash").isNotNull() & F.col("dhash").isNotNull()
    return cls.select("kind", zero("phash"), zero("dhash"), zero("xx"), near.alias("near"), F.col("xx").isNotNull().alias("known"), "item_id", F.col("batch_no").cast("int").alias("batch_no"))


def _buckets(keys: np.ndarray, dense: np.ndarray, dhash: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """The comparisons of a group: rows, the number of the bucket of each, buckets a key has, and whether bits are to be counted."""
    tag = keys & TAGS
    at = np.flatnonzero(tag == CONTENT)
    yield at, dense[at], 1, False
    at = np.flatnonzero(tag == FINE)
    yield at, dense[at], 1, True
    at = np.flatnonzero(tag == PLAIN)
    key, dh = dense[at], dhash[at]
    for s in range(SEGMENTS):
        width = CUTS[s + 1] - CUTS[s]
        bucket = key << width
        bucket |= (dh >> np.uint64(CUTS[s])).astype(bucket.dtype) & bucket.dtype.type((1 << width) - 1)
        yield at, bucket, 1 << width, True


def _hold(stored: pa.Table, probes: pa.Table) -> pa.Table:
    """``later, earlier, more`` for the probes of one group: refused by the index (``earlier`` null), or partners in the batch itself.

    Of the partners that come before an item the first PARTNERS in a bucket are named; ``more`` marks an item that may have others.
    """
    keys, p = B.unpack(probes.column("block"), PROBE)
    by = np.lexsort((p["item_id"], p["batch_no"], keys))
    keys, ph, dh, ids = keys[by], p["phash"][by], p["dhash"][by], p["item_id"][by]
    each, dense = np.unique(keys, return_inverse=True)
    dense = dense.astype(np.int32 if len(each) < 1 << 23 else np.int64)
    # of what is stored only the probed buckets matter
    kept = []
    for block in stored.column("block"):
        k, c = B.unpack([block], STORED)  # sorted by key
        if len(k) < 2 * len(each):
            place = np.minimum(np.searchsorted(each, k), len(each) - 1)
            at = np.flatnonzero(each[place] == k)
            kept.append((k[at], place[at].astype(dense.dtype), c["phash"][at], c["dhash"][at]))
            continue
        lo = np.searchsorted(k, each)
        n = np.searchsorted(k, each, side="right") - lo
        at = slice(None) if n.sum() == len(k) else np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
        kept.append((np.repeat(each, n), np.repeat(np.arange(len(each), dtype=dense.dtype), n), c["phash"][at], c["dhash"][at]))
    s_keys, s_dense, s_ph, s_dh = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, dtype=t) for t in ("u8", "i8", "u8", "u8"))

    def close(a_ph: np.ndarray, a_dh: np.ndarray, b_ph: np.ndarray, b_dh: np.ndarray, bits: bool):
        def passes(q: np.ndarray, c: np.ndarray) -> np.ndarray:
            if not bits:
                return (a_ph[q] == b_ph[c]) & (a_dh[q] == b_dh[c])
            ok = np.bitwise_count(a_ph[q] ^ b_ph[c]) <= MAX_BITS
            ok[ok] = np.bitwise_count(a_dh[q[ok]] ^ b_dh[c[ok]]) <= MAX_BITS
            return ok

        return passes

    gone = np.zeros(len(keys), dtype=bool)
    for (at, bucket, width, bits), (s_at, s_bucket, _, _) in zip(_buckets(keys, dense, dh), _buckets(s_keys, s_dense, s_dh)):
        todo = np.flatnonzero(~gone[at])
        if not len(todo) or not len(s_at):
            continue
        todo = todo[np.argsort(bucket[todo])]  # neighbours are then looked up next to each other
        at, bucket = at[todo], bucket[todo]
        probed = np.zeros(len(each) * width, dtype=bool)
        probed[bucket] = True
        met = np.flatnonzero(probed[s_bucket])
        met = met[np.argsort(s_bucket[met])]
        s_at, s_bucket = s_at[met], s_bucket[met]
        lo, hi = np.searchsorted(s_bucket, bucket), np.searchsorted(s_bucket, bucket, side="right")
        q, _ = B.first_passing(lo, hi, close(ph[at], dh[at], s_ph[s_at], s_dh[s_at], bits), 1)
        gone[at[q]] = True
    refused = np.unique(ids[gone])
    live = np.flatnonzero(~np.isin(ids, refused))
    pairs, full = [np.zeros((2, 0), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at, bucket, _, bits in _buckets(keys[live], dense[live], dh[live]):
        if not len(at):
            continue
        turn = np.argsort(bucket, kind="stable")  # the entries of a key stand in the order of batch and id
        at, bucket = live[at[turn]], bucket[turn]
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(np.append(True, bucket[1:] != bucket[:-1]), place, 0))
        q, c = B.first_passing(start, place, close(ph[at], dh[at], ph[at], dh[at], bits), PARTNERS)
        pairs.append(np.stack([ids[at[q]], ids[at[c]]]))
        full.append(ids[at[np.flatnonzero(np.bincount(q, minlength=len(at)) == PARTNERS)]])
    pair = np.unique(np.concatenate(pairs, axis=1), axis=1)
    more = np.unique(np.concatenate(full))
    n = [len(refused), pair.shape[1], len(more)]
    none = pa.nulls(1, pa.int64())
    return pa.table(
        {
            "later": np.concatenate([refused, pair[0], more]),
            "earlier": pa.concat_arrays([pa.nulls(n[0], pa.int64()), pa.array(pair[1], pa.int64()), pa.nulls(n[2], none.type)]),
            "more": np.repeat([False, False, True], n),
        }
    )


def _without(df: DataFrame, gone: DataFrame, *ends: str) -> DataFrame:
    for end in ends:
        df = df.join(gone.withColumnRenamed("item_id", end), end, "left_anti")
    return df


def _settle(links: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Ids of the class firsts that are refused, in several tables, and of those that are not decided yet (None: all are).

    A round accepts what has no earlier partner left and refuses the later partners of
    what it accepted. An item with ``more`` partners than were named is never accepted here.
    """
    one = lambda df, c: df.select(F.col(c).alias("item_id"))
    seen = links.agg(F.count("earlier").alias("pairs"), F.count_if("more").alias("more")).first()
    old = one(links.where("earlier IS NULL AND NOT more"), "later")  # ids may repeat; they are only asked for
    refused = [old]
    if not seen.pairs:  # an item with more partners than were named has some that were
        return refused, None
    pair = materialize(_without(links.where("earlier IS NOT NULL"), old, "later", "earlier").select("later", "earlier"), "links")
    more = materialize(one(_without(links.where("more"), old, "later"), "later"), "more") if seen.more else None
    undecided = one(pair, "later").union(one(pair, "earlier"))
    for _ in range(ROUNDS):
        free = undecided.join(one(pair, "later"), "item_id", "left_anti")
        if more is not None:
            free = free.join(more, "item_id", "left_anti")
        beaten = one(pair.join(free.withColumnRenamed("item_id", "earlier"), "earlier", "left_semi"), "later")
        done = materialize(free.withColumn("ok", F.lit(True)).union(beaten.withColumn("ok", F.lit(False))), "settled")
        refused.append(done.where("NOT ok").select("item_id"))
        ids = done.select("item_id")
        undecided = undecided.join(ids, "item_id", "left_anti")
        pair = _without(pair, ids, "later", "earlier")
        if not pair.take(1):
            if more is None:  # what only lost its partners in the last round is free
                return refused, None
            break
        pair = materialize(pair, "links")
    rest = materialize(undecided, "undecided")
    return refused, rest if rest.take(1) else None


class SegmentIndex:
    """The accepted history as an appendable table of packed segment and content entries, bucketed by group.

    ``create`` makes an index of accepted items, ``open`` finds one again (a missing one is an error),
    ``append`` adds accepted items and ``take`` holds a delivery against it and appends what is accepted.
    All take rows with the columns of :func:`items`. Only a delivery is filed into segments and shuffled; of the table the probed
    buckets are read as they are. An index that has grown past twice its size is laid out
    anew with more groups, which costs a constant share of what was appended since.
    """

    def __init__(self, spark: SparkSession, path: str, layout: B.Layout, entries: int, version: int) -> None:
        self.spark, self.path, self.layout, self.entries, self.version = spark, path.rstrip("/"), layout, entries, version
        self.table = f"segments_{abs(hash(self.path)):x}_{version}"

    @classmethod
    def create(cls, history: DataFrame, path: str) -> SegmentIndex:
        rows = materialize(classes(history), "history")
        entries = rows.count() * KEYS
        index = cls(history.sparkSession, path, B.plan(_entries(rows), _file, entries, per_group=PER_GROUP), 0, 0)
        index._save_layout()
        index._write(B.pack_stored(_entries(rows), _file, STORED, index.layout), entries)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SegmentIndex:
        at = spark.read.parquet(f"{path.rstrip('/')}/layout").orderBy(F.col("version").desc()).first()
        hot = np.array(sorted(np.array(at.hot, dtype=np.int64).view(np.uint64)), dtype=np.uint64)
        index = cls(spark, path, B.Layout(at.groups, 1, hot, {r.grp: r.n for r in at.parts}), 0, at.version)
        files = f"{index.path}/v{index.version}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {index.table} (grp INT, n INT, block BINARY) USING parquet CLUSTERED BY (grp) INTO {index.layout.groups} BUCKETS LOCATION '{files}'")
        index.entries = spark.table(index.table).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        return index

    def _save_layout(self) -> None:
        hot = self.layout.hot.view(np.int64).tolist()
        row = (self.version, self.layout.groups, hot, list(self.layout.parts.items()))
        schema = "version int, groups int, hot array<bigint>, parts array<struct<grp: int, n: int>>"
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/layout")

    def _write(self, blocks: DataFrame, entries: int) -> None:
        n = self.layout.groups
        blocks.repartition(n, "grp").write.mode("append").bucketBy(n, "grp").option("path", f"{self.path}/v{self.version}").saveAsTable(self.table)
        self.entries += entries

    def append(self, accepted: DataFrame) -> None:
        """Add accepted items."""
        rows = materialize(classes(accepted), "accepted")
        self._append(rows, rows.count())

    def _append(self, rows: DataFrame, most: int) -> None:
        self._write(B.pack_stored(_entries(rows), _file, STORED, self.layout), most * KEYS)
        if self.entries > 2 * PER_GROUP * self.layout.groups:
            self._grow()

    def _grow(self) -> None:
        """Lay the entries out anew; a key that has become hot is filed finer from its entries alone."""
        old, before = self.spark.table(self.table), self.table
        layout = B.plan(_opened(old), _refile, self.entries, per_group=PER_GROUP)
        last = f"{self.path}/v{self.version}"
        self.version, self.layout = self.version + 1, replace(layout, hot=np.union1d(layout.hot, self.layout.hot))
        self.table = f"segments_{abs(hash(self.path)):x}_{self.version}"
        entries, self.entries = self.entries, 0
        self._write(B.pack_stored(_opened(old), _refile, STORED, self.layout), entries)
        self._save_layout()
        self.spark.sql(f"DROP TABLE {before}")
        remove(self.spark, last)

    def probed(self, n: int, probes: DataFrame) -> DataFrame:
        """The stored blocks that ``n`` items can meet; if they cannot touch every bucket, only the buckets they touch are read."""
        stored = self.spark.table(self.table).select("grp", "block")
        if n * KEYS * SEGMENTS >= self.layout.groups:
            return stored
        return stored.where(F.col("grp").isin([r.grp for r in probes.select("grp").distinct().collect()]))

    def held(self, cls: DataFrame, n: int) -> DataFrame:
        """Matches of ``n`` class firsts; only their probes are shuffled, to the buckets of the table."""
        probes = B.pack_probes(_entries(cls), _file, PROBE, self.layout).select("grp", "block")
        return self.probed(n, probes).groupBy("grp").cogroup(probes.groupBy("grp")).applyInArrow(_hold, "later bigint, earlier bigint, more boolean")

    def take(self, delivery: DataFrame) -> DataFrame:
        """``item_id`` of the delivered items that are refused; the others are appended to the index.

        Items are taken in the order of batch and id. A delivery of over SLICE items is taken in slices of that order.
        """
        rows = materialize(classes(delivery), "classes")
        return _refused(delivery, rows, self.take_classes(rows, rows.count()))

    def take_classes(self, rows: DataFrame, n: int) -> list[DataFrame]:
        """Ids of the refused ones of ``n`` class firsts (a written table), in several tables."""
        slices = [rows]
        if n > SLICE:  # the bounded sample only places the cuts
            parts = -(-n // SLICE)
            some = sorted((r.batch_no, r.item_id) for r in rows.select("batch_no", "item_id").sample(min(1.0, 50_000 / n), 1).limit(100_000).collect())
            turn = F.struct(F.col("batch_no").cast("int").alias("b"), F.col("item_id").alias("i"))
            cuts = sorted({some[i * len(some) // parts] for i in range(1, parts)}) if some else []
            place = sum(((turn >= F.struct(F.lit(b).cast("int").alias("b"), F.lit(i).cast("bigint").alias("i"))).cast("int") for b, i in cuts), F.lit(0))
            slices = [rows.where(place == k) for k in range(len(cuts) + 1)]
        out: list[DataFrame] = []
        for todo in slices:
            while todo is not None:
                refused, rest = _settle(materialize(self.held(todo, min(n, SLICE)), "matches"))
                gone = _union(refused if rest is None else [*refused, rest])
                self._append(todo.join(gone, "item_id", "left_anti"), min(n, SLICE))
                out += refused
                todo = None if rest is None else materialize(todo.join(rest, "item_id", "left_semi"), "undecided")
        return out

    def drop(self) -> None:
        """Remove the index and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)


def _union(ids: list[DataFrame]) -> DataFrame:
    out = ids[0]
    for more in ids[1:]:
        out = out.union(more)
    return out


def _refused(delivered: DataFrame, firsts: DataFrame, refused: list[DataFrame]) -> DataFrame:
    """Refused items: the refused firsts of classes, and all later copies."""
    kept = firsts.select("item_id").join(_union(refused), "item_id", "left_anti") if refused else firsts.select("item_id")
    return delivered.where(matchable()).select("item_id").join(kept, "item_id", "left_anti")


def _opened(table: DataFrame) -> DataFrame:
    """Stored blocks as entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column("block"):
                k, c = B.unpack([block], STORED)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (k, c["phash"], c["dhash"])], names=["key", "phash", "dhash"])

    return table.select("block").mapInArrow(run, "key bigint, phash bigint, dhash bigint")


def _refile(cols: dict[str, np.ndarray], layout: B.Layout) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    key, dh = cols["key"].view(np.uint64), cols["dhash"].view(np.uint64)
    hot = layout.is_hot(key) & (key & TAGS == PLAIN)
    rows = np.flatnonzero(~hot)
    yield 0, key[rows], rows, ["phash", "dhash"]
    rows = np.flatnonzero(hot)
    for j in range(SEGMENTS if len(rows) else 0):
        yield 0, _finer(key[rows], dh[rows], j), rows, ["phash", "dhash"]


def refuse_duplicates(hashes: DataFrame, history: int = 0) -> DataFrame:
    """``item_id`` of every refused item of all batches after ``history``.

    Batches up to ``history`` are accepted and make the index; each later batch is then taken by it in turn.
    A later item is refused if one accepted before
    it has the same analysis type and the same content number or both image
    hashes within eight bits. Nulls match nothing; equal items are compared once;
    an empty table gives an empty result; further columns are ignored.
    """
    spark = hashes.sparkSession
    one_each = materialize(items(hashes), "items")
    index = SegmentIndex.create(one_each.where(F.col("batch_no") <= history), new_path(spark, "index"))
    late = one_each.where(F.col("batch_no") > history)
    firsts = materialize(classes(late, "batch_no"), "classes")  # of each batch by itself
    refused: list[DataFrame] = []
    for batch in sorted(firsts.groupBy("batch_no").count().collect(), key=lambda r: r.batch_no):
        refused += index.take_classes(firsts.where(F.col("batch_no") == batch.batch_no), batch["count"])
    index.drop()
    return _refused(late, firsts, refused)
