"""Rows filed under several bucket keys, in groups of bounded size.

Both similarity joins over 64-bit hashes work in the same way. Every row is
filed under several bucket keys. Rows travel as packed binary blocks, one per
group of buckets and map batch, so a shuffled entry costs its payload and no
row overhead. A group is the unit of one Python call; it has about
``PER_GROUP`` entries whatever the size of the input, as the number of groups
follows the number of rows. :func:`plan` finds groups over four times that. The hot keys
in them are filed under finer keys that miss no pair, so only a bucket in which the finer
keys are equal too stays large; a group that still is over the limit is cut into chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_GROUP = 120_000
LIMIT = 4
FLUSH_ROWS = 131_072


@dataclass(frozen=True)
class Layout:
    """Number of groups (a group holds keys of one lane only), keys that are filed finer, and chunks of the groups that have several."""

    groups: int
    lanes: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # sorted
    parts: dict[int, int] = field(default_factory=dict)

    @classmethod
    def sized(cls, entries: int, per_group: int, lanes: int = 1) -> Layout:
        return cls(max(1, -(-entries // (per_group * lanes))) * lanes, lanes)

    def group(self, keys: np.ndarray, lane: int) -> np.ndarray:
        """Group of each key; the lowest bits of keys are left out, as they may be tags."""
        return (keys >> np.uint64(8)).astype(np.int64) % (self.groups // self.lanes) * self.lanes + lane

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(keys), dtype=bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)] == keys


#: columns of a map batch, layout -> (lane, keys, row numbers, payload columns) for each band or segment
FileFn = Callable[[dict[str, np.ndarray], Layout], Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: spreads the bits of unsigned 64-bit keys."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """One key from two; order matters."""
    with np.errstate(over="ignore"):
        return mix64(a * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, dtype=np.uint64) + np.uint64(1))


def gathered(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of at least ``rows`` rows, so that packed blocks are not tiny."""
    held: list[dict[str, np.ndarray]] = []
    n, enough = 0, rows or FLUSH_ROWS
    for b in batches:
        if b.num_rows:
            held.append({c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(b.schema.names)})
            n += b.num_rows
        if n >= enough:
            yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            held, n = [], 0
    if held:
        yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}


def _full_groups(df: DataFrame, file: FileFn, layout: Layout, limit: int) -> dict[int, int]:
    """Entries of each group over ``limit``; one number for each ``limit`` entries at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(layout.groups, dtype=np.int64)
        for cols in gathered(batches):
            for lane, keys, _, _ in file(cols, layout):
                total += np.bincount(layout.group(keys, lane), minlength=layout.groups)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["grp", "n"])

    found = df.mapInArrow(count, "grp int, n bigint").groupBy("grp").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return {r.grp: r.n for r in found.collect()}


def _hot_keys(df: DataFrame, file: FileFn, layout: Layout, within: dict[int, int], limit: int) -> np.ndarray:
    """Keys of these groups with over ``limit`` entries; one for each ``limit`` entries at most."""
    full = np.array(sorted(within), dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in gathered(batches):
            met = [keys[np.isin(layout.group(keys, lane), full)] for lane, keys, _, _ in file(cols, layout)]
            each, n = np.unique(np.concatenate(met), return_counts=True)
            yield pa.record_batch([pa.array(each.view(np.int64)), pa.array(n)], names=["key", "n"])

    found = df.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return np.sort(np.array([r.key for r in found.select("key").collect()], dtype=np.int64).view(np.uint64))


def plan(df: DataFrame, file: FileFn, entries: int, lanes: int = 1, per_group: int | None = None) -> Layout:
    """Layout for about ``entries`` entries of ``df``, hot keys and groups found by counting all of them."""
    per_group = per_group or PER_GROUP
    layout, limit = Layout.sized(entries, per_group, lanes), LIMIT * per_group
    full = _full_groups(df, file, layout, limit) if entries > limit else {}
    if not full:
        return layout
    layout = replace(layout, hot=_hot_keys(df, file, layout, full, per_group))
    return replace(layout, parts={g: -(-n // per_group) for g, n in _full_groups(df, file, layout, limit).items()})


def _packed(df: DataFrame, file: FileFn, types: list[str], layout: Layout, spread: Callable, schema: str, by_key: bool = False) -> DataFrame:
    """Blocks by group. A block is the concatenation of its entries' keys (u8) and payload columns, each as one array; ``by_key`` sorts its entries."""
    kinds = [np.dtype(t) for t in types]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in gathered(batches):
            out: list[tuple] = []
            for lane, keys, rows, names in file(cols, layout):
                if not len(keys):
                    continue
                g = layout.group(keys, lane)
                order = np.lexsort((keys, g)) if by_key else np.argsort(g, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
                    grp = int(g[at[0]])
                    arrays = [cols[c][rows[at]].astype(t, copy=False) for c, t in zip(names, kinds)]
                    for place, some in spread(grp, layout, arrays):
                        out.append((*place, len(keys[at][some]), b"".join([keys[at][some].tobytes(), *(a[some].tobytes() for a in arrays)])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], schema=arrow)

    fields = [f.split() for f in schema.split(", ")]
    arrow = pa.schema([(n, {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in fields])

    return df.mapInArrow(emit, schema)


EVERY = slice(None)


def pack_pairs(df: DataFrame, file: FileFn, payload: list[tuple[str, str]], layout: Layout) -> DataFrame:
    """``grp, pair, chunk, n, block`` for comparing all entries of a group with each other; each pair of chunks is met in one ``pair``."""

    def spread(grp: int, layout: Layout, arrays: list[np.ndarray]):
        parts = layout.parts.get(grp, 1)
        if parts == 1:
            yield (grp, "0-0", 0), EVERY
            return
        chunk = (mix64(arrays[0].view(np.uint64)) % np.uint64(parts)).astype(int)
        for c in np.unique(chunk).tolist():
            for other in range(parts):
                yield (grp, f"{min(c, other)}-{max(c, other)}", c), chunk == c

    return _packed(df, file, [t for _, t in payload], layout, spread, "grp int, pair string, chunk int, n int, block binary")


def pack_stored(df: DataFrame, file: FileFn, payload: list[tuple[str, str]], layout: Layout) -> DataFrame:
    """``grp, n, block`` of entries that stay, sorted by key in a block; a chunk of a large group is a group of its own."""

    def spread(grp: int, layout: Layout, arrays: list[np.ndarray]):
        parts = layout.parts.get(grp, 1)
        if parts == 1:
            yield (grp,), EVERY
            return
        chunk = (mix64(arrays[0].view(np.uint64)) % np.uint64(parts)).astype(int)
        for c in np.unique(chunk).tolist():
            yield (grp + layout.groups * c,), chunk == c

    return _packed(df, file, [t for _, t in payload], layout, spread, "grp int, n int, block binary", by_key=True)


def pack_probes(df: DataFrame, file: FileFn, payload: list[tuple[str, str]], layout: Layout) -> DataFrame:
    """``grp, n, block`` of entries that are held against :func:`pack_stored`, once for each chunk of their group."""

    def spread(grp: int, layout: Layout, arrays: list[np.ndarray]):
        for c in range(layout.parts.get(grp, 1)):
            yield (grp + layout.groups * c,), EVERY

    return _packed(df, file, [t for _, t in payload], layout, spread, "grp int, n int, block binary")


def unpack(blocks: pa.ChunkedArray, payload: list[tuple[str, str]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Keys and payload columns of all blocks, in their order."""
    types = [np.dtype("u8"), *(np.dtype(t) for _, t in payload)]
    width = sum(t.itemsize for t in types)
    parts: list[list[np.ndarray]] = [[np.zeros(0, dtype=t)] for t in types]
    for block in blocks:
        buf = block.as_buffer()
        n, at = buf.size // width, 0
        for i, t in enumerate(types):
            parts[i].append(np.frombuffer(buf, dtype=t, count=n, offset=at))
            at += n * t.itemsize
    keys, *cols = (np.concatenate(p) for p in parts)
    return keys, {c: v for (c, _), v in zip(payload, cols)}


def same_key_pairs(keys: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of equal entries of the sorted ``keys``.

    Work and memory follow the number of pairs; at most about ``most`` come at once.
    """
    n = len(keys)
    if n < 2:
        return
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, n)
    rest = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n) - 1  # entries after i with its key
    at = np.flatnonzero(rest)
    at = at[np.argsort(-rest[at], kind="stable")]
    many = rest[at]
    held_i: list[np.ndarray] = []
    held_j: list[np.ndarray] = []
    size, d = 0, 1
    live = len(at)
    while live:
        live = int(np.searchsorted(-many[:live], -d, side="right"))
        i = at[:live]
        held_i.append(i)
        held_j.append(i + d)
        size += live
        d += 1
        if size >= most:
            yield np.concatenate(held_i), np.concatenate(held_j)
            held_i, held_j, size = [], [], 0
    if size:
        yield np.concatenate(held_i), np.concatenate(held_j)


def first_passing(lo: np.ndarray, hi: np.ndarray, passes: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int, budget: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate): of the candidates lo..hi-1 of each query, in their order, the first ``most`` that pass.

    A query that has them is not compared further, so a bucket full of near copies costs no work by pairs.
    """
    pos, got = lo.astype(np.int64), np.zeros(len(lo), dtype=np.int64)
    active, step = np.flatnonzero(hi > lo), 16
    queries, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while len(active):
        n = np.minimum(hi[active] - pos[active], max(1, min(step, budget // len(active))))
        q = np.repeat(active, n)
        c = np.arange(len(q)) - np.repeat(np.cumsum(n) - n - pos[active], n)
        ok = passes(q, c)
        q, c = q[ok], c[ok]
        keep = np.arange(len(q)) - np.searchsorted(q, q) + got[q] < most
        queries.append(q[keep])
        found.append(c[keep])
        got += np.bincount(q[keep], minlength=len(got))
        pos[active] += n
        active = active[(pos[active] < hi[active]) & (got[active] < most)]
        step *= 2
    return np.concatenate(queries), np.concatenate(found)
