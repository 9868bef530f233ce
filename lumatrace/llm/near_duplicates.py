"""Problem 2: pairs of items that differ in few bits, without comparing all pairs.

Method: fast similarity sketching, then banding and exact verification. Items
of the same type whose three hashes are equal form one class first. Each class is filed
under SHUFFLE_BANDS bands of SHUFFLE_ROWS sketch coordinates; these move the data.
Inside such a bucket LOCAL_BANDS further bands of LOCAL_ROWS coordinates pick the pairs whose
bits are counted, other coordinates in every shuffled band, so a pair has 7 x 9
chances of being met while a row is shuffled seven times only. A pair that differs
in the full 19 bits is met with probability 0.995, one that differs in 12 with 0.9998.
A shuffled bucket that is hot is filed under its local bands at once, which meet the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..plans.skew import grouped, join_counted
from . import buckets as B
from .sketch import BitSketch

MAX_BITS = 19
SHUFFLE_BANDS, SHUFFLE_ROWS = 7, 3
LOCAL_BANDS, LOCAL_ROWS = 9, 6
PAYLOAD = [("rep", "i8"), ("phash", "u8"), ("dhash", "u8"), ("whash", "u8")]
ONE = np.uint64(1)
SKETCH = BitSketch(SHUFFLE_BANDS * (SHUFFLE_ROWS + LOCAL_BANDS * LOCAL_ROWS))


def _band(bits: np.ndarray, base: np.ndarray, first: int, rows: int) -> np.ndarray:
    key = base
    for j in range(first, first + rows):
        key = B.combine(key, SKETCH.coordinate(j, bits))
    return key


def _local(band: int, j: int) -> int:
    """First coordinate of the local band ``j`` of a shuffled band."""
    return SHUFFLE_BANDS * SHUFFLE_ROWS + (band * LOCAL_BANDS + j) * LOCAL_ROWS


def _file(cols: dict[str, np.ndarray], layout: B.Layout) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """Entries of each band; the lowest bit of a key tells whether it is of a local band."""
    names = [c for c, _ in PAYLOAD]
    bits = SKETCH.columns(*(cols[c].view(np.uint64) for c in ("phash", "dhash", "whash")))
    kind = cols["kind"].view(np.uint64)
    for b in range(SHUFFLE_BANDS):
        key = _band(bits, B.combine(kind, b), b * SHUFFLE_ROWS, SHUFFLE_ROWS) & ~ONE
        hot = layout.is_hot(key)
        rows = np.flatnonzero(~hot)
        yield b, key[rows], rows, names
        rows = np.flatnonzero(hot)
        for j in range(LOCAL_BANDS if len(rows) else 0):
            yield b, _band(bits[:, rows], B.combine(key[rows], j), _local(b, j), LOCAL_ROWS) | ONE, rows, names


def items(hashes: DataFrame) -> DataFrame:
    """One row for each item that has a type and all three hashes."""
    needed = ["item_id", "analysis_type", "phash", "dhash", "whash"]
    full = F.lit(True)
    for c in needed:
        full = full & F.col(c).isNotNull()
    return (
        hashes.where(full)
        .select("item_id", F.xxhash64("analysis_type").alias("kind"), "phash", "dhash", "whash")
        .groupBy("item_id")
        .agg(*(F.max(c).alias(c) for c in ("kind", "phash", "dhash", "whash")))
    )


def classes(one_each: DataFrame) -> DataFrame:
    """Distinct hash triples by type: the smallest item as ``rep`` and the number of members."""
    return one_each.groupBy("kind", "phash", "dhash", "whash").agg(F.min("item_id").alias("rep"), F.count("*").alias("members"))


def class_pairs(cls: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``rep_a, rep_b, bits`` for classes of one type within ``max_bits``; each pair once, rep_a < rep_b."""
    n = cls.agg(F.count("*").alias("n")).first().n
    rows = cls.select("kind", *(c for c, _ in PAYLOAD))
    layout = B.plan(rows, _file, n * SHUFFLE_BANDS, SHUFFLE_BANDS)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        band = int(key[0].as_py()) % SHUFFLE_BANDS
        blocks = table.column("block")
        keys, c = B.unpack(blocks, PAYLOAD)
        sizes, marks = table.column("n").to_numpy(), table.column("chunk").to_numpy()
        chunk = np.repeat(marks, sizes)
        cross = len(np.unique(marks)) > 1
        by_key = np.argsort(keys)
        keys, chunk, c = keys[by_key], chunk[by_key], {k: v[by_key] for k, v in c.items()}
        alone = np.ones(len(keys), dtype=bool)
        alone[1:] &= keys[1:] != keys[:-1]
        alone[:-1] &= keys[1:] != keys[:-1]
        keys, chunk, c = keys[~alone], chunk[~alone], {k: v[~alone] for k, v in c.items()}
        ph, dh, wh, rep = c["phash"], c["dhash"], c["whash"], c["rep"]
        found = [np.zeros((3, 0), dtype=np.int64)]

        def verify(at: np.ndarray, k: np.ndarray) -> None:
            by = np.argsort(k)
            order = at[by]
            ph_s, dh_s, wh_s = ph[order], dh[order], wh[order]
            for i, j in B.same_key_pairs(k[by]):
                d = np.bitwise_count(ph_s[i] ^ ph_s[j])
                near = d <= max_bits
                i, j, d = i[near], j[near], d[near]
                d = d + np.bitwise_count(dh_s[i] ^ dh_s[j])
                near = d <= max_bits
                i, j, d = i[near], j[near], d[near]
                d = d + np.bitwise_count(wh_s[i] ^ wh_s[j])
                near = d <= max_bits
                i, j, d = order[i[near]], order[j[near]], d[near]
                if cross:
                    apart = chunk[i] != chunk[j]
                    i, j, d = i[apart], j[apart], d[apart]
                found.append(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j]), d.astype(np.int64)]))

        fine = (keys & ONE) == ONE
        at = np.flatnonzero(fine)
        verify(at, keys[at])
        at = np.flatnonzero(~fine)
        bits = SKETCH.columns(ph[at], dh[at], wh[at])
        for j in range(LOCAL_BANDS if len(at) else 0):
            verify(at, _band(bits, keys[at], _local(band, j), LOCAL_ROWS))
        every = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"rep_a": every[0], "rep_b": every[1], "bits": every[2].astype(np.int32)})

    blocks = B.pack_pairs(rows, _file, PAYLOAD, layout)
    return grouped(blocks, ["grp", "pair"], layout.groups).applyInArrow(compare, "rep_a bigint, rep_b bigint, bits int").distinct()


def _with_class(one_each: DataFrame, cls: DataFrame, columns: list[str]) -> DataFrame:
    """``item_id`` of the members of the given classes with ``columns`` of these; a class is known by 128 bits, and a hot one is not shuffled."""
    hashes = ["kind", "phash", "dhash", "whash"]
    both = lambda a, b: [F.xxhash64(*hashes).alias(a), F.xxhash64(F.lit(1), *hashes).alias(b)]
    rows = one_each.select("item_id", *both("h1", "h2"))
    keyed = cls.select(*both("h1", "h3"), *columns, F.col("members").alias("n"))
    total = cls.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).first().n
    return join_counted(rows, keyed, "h1", "n", total).where("h2 = h3").select("item_id", *columns)


def near_duplicate_pairs(hashes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``item_id_a, item_id_b``: all pairs of items within ``max_bits``, equal ones included.

    Items without a type or with a null hash take no part. A redelivered item
    counts once. Classes with one member, which are nearly all, need no lookup of members.
    """
    one_each = materialize(items(hashes), "items")
    cls = materialize(classes(one_each), "classes")
    pairs = class_pairs(cls, max_bits).select("rep_a", "rep_b")
    members = materialize(_with_class(one_each, cls.where(F.col("members") > 1), ["rep"]).select("rep", "item_id"), "members")
    a = members.select(F.col("rep").alias("rep_a"), F.col("item_id").alias("item_a"))
    b = members.select(F.col("rep").alias("rep_b"), F.col("item_id").alias("item_b"))
    across = (
        pairs.join(a, "rep_a", "left")
        .join(b, "rep_b", "left")
        .select(F.coalesce("item_a", "rep_a").alias("x"), F.coalesce("item_b", "rep_b").alias("y"))
    )
    inside = a.join(b, (F.col("rep_a") == F.col("rep_b")) & (F.col("item_a") < F.col("item_b"))).select(
        F.col("item_a").alias("x"), F.col("item_b").alias("y")
    )
    return across.union(inside).select(F.least("x", "y").alias("item_id_a"), F.greatest("x", "y").alias("item_id_b"))


def near_duplicate_classes(hashes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``item_id, class_id, members, links``: one row an item with its class and the class's number of near classes."""
    one_each = materialize(items(hashes), "items")
    cls = materialize(classes(one_each), "classes")
    pairs = class_pairs(cls, max_bits)
    ends = pairs.select(F.col("rep_a").alias("rep")).union(pairs.select("rep_b")).groupBy("rep").agg(F.count("*").alias("links"))
    linked = cls.join(ends, "rep", "left").withColumns({"class_id": F.col("rep"), "links": F.coalesce("links", F.lit(0))})
    return _with_class(one_each, linked, ["class_id", "members", "links"])
