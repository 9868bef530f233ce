"""Problem 6: lay texts into containers of fixed capacity.

Method: sum-of-squares online packing. An item goes to the fill level that makes
the sum over levels of (number of containers partly filled to that level) squared smallest,
a new container being level 0; the counts are an array over levels. Only a text above the capacity is
divided: into full pieces and one remainder. Documents are spread by hash over
bins of about PER_BIN texts that are packed independently; what a bin leaves
open is at most a few containers, against tens of thousands filled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import grouped
from .tokens import token_count

CAPACITY = 512
PER_BIN = 50_000
SCHEMA = "doc_id bigint, piece int, pieces int, container bigint, start int, tokens int"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number and start of each item (1 <= size <= capacity), taken in order."""
    count = np.zeros(2 * capacity + 1, dtype=np.int64)  # levels from the capacity on stay 0
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    box, start = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    made = 0
    for n, s in enumerate(sizes.tolist()):
        if s == capacity:
            box[n], start[n] = made, 0
            made += 1
            continue
        top = capacity - s
        # change of the sum of squares: leaving level h is 1 - 2 N(h), reaching h + s is 1 + 2 N(h + s), or nothing if that is full
        cost = count[s : capacity + 1] * 2 + 1
        cost[top] = 0
        cost[1:] += 1 - 2 * count[1 : top + 1]
        cost[1:][count[1 : top + 1] == 0] = 1 << 60
        h = top - int(np.argmin(cost[::-1]))  # of equal choices the fullest container
        if h:
            b = open_at[h].pop()
            count[h] -= 1
        else:
            b, made = made, made + 1
        box[n], start[n] = b, h
        if h + s < capacity:
            open_at[h + s].append(b)
            count[h + s] += 1
    return box, start


def _pack_bin(key: tuple, docs: pd.DataFrame, capacity: int) -> pd.DataFrame:
    docs = docs.sort_values(["turn", "doc_id"], kind="stable")
    size, ids = docs["tokens"].to_numpy(), docs["doc_id"].to_numpy()
    whole, rest = size // capacity, size % capacity
    pieces = whole + (rest > 0)
    row = np.repeat(np.arange(len(docs)), whole)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
    part = np.flatnonzero(rest)
    box, start = sum_of_squares(rest[part], capacity)
    made = int(box.max()) + 1 if len(box) else 0
    base = int(key[0]) << 36
    out = {
        "doc_id": np.concatenate([ids[row], ids[part]]),
        "piece": np.concatenate([nth, whole[part]]).astype(np.int32),
        "pieces": np.concatenate([pieces[row], pieces[part]]).astype(np.int32),
        "container": base + np.concatenate([made + np.arange(len(row)), box]),
        "start": np.concatenate([np.zeros(len(row), dtype=np.int64), start]).astype(np.int32),
        "tokens": np.concatenate([np.full(len(row), capacity), rest[part]]).astype(np.int32),
    }
    return pd.DataFrame(out)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, per_bin: int = PER_BIN) -> DataFrame:
    """``doc_id, piece, pieces, container, start, tokens``: where each piece of each text lies.

    Texts without tokens (null, blank) need no room and have no row; rows without an id are left out;
    a repeated id counts as often as it stands there.
    """
    bins = max(1, -(-documents.count() // per_bin))
    sized = (
        documents.where(F.col("doc_id").isNotNull())
        .select("doc_id", token_count(F.col("text")).alias("tokens"))
        .where("tokens > 0")
        .withColumn("turn", F.xxhash64("doc_id"))
        .withColumn("bin", F.pmod("turn", F.lit(bins)))
    )
    return grouped(sized, ["bin"], bins).applyInPandas(lambda key, pdf: _pack_bin(key, pdf, capacity), SCHEMA)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``containers, tokens, fill``: how full the containers are, 1 being no space left over."""
    return packed.agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn(
        "fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 6)
    )
