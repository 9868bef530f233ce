"""Fast similarity sketching of bit strings.

A 64-bit hash triple is the set of its 192 (position, bit) elements; two triples
that differ in h bits have Jaccard similarity (192 - h) / (192 + h). A sketch
has t coordinates. In rounds 0..t-1 every element is thrown by a fresh hash
function into one of the t bins with a fresh value; in rounds t..2t-1 every
element goes into bin (round - t). A coordinate is the element that is first by
(round, value) in its bin, so the last t rounds guarantee that each coordinate
fills, while for sets of about t elements and more nearly all fill in the first
rounds. Each coordinate of two sketches agrees with probability equal to the
Jaccard similarity, and the agreements concentrate as for independent samples.

As there are only 2 * 192 possible elements, a coordinate is a fixed priority
list over them, and its value is the place of the first listed element that the
set holds.
"""

from __future__ import annotations

import numpy as np

POSITIONS = 192


class BitSketch:
    """Coordinates of the fast similarity sketch for sets over (position, bit)."""

    def __init__(self, t: int, seed: int = 20250101) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        elements = 2 * POSITIONS
        bins = rng.integers(0, t, size=(t, elements))
        values = rng.random(size=(t, elements))
        self.t = t
        self.lists: list[np.ndarray] = []
        last = rng.random(size=(t, elements))
        rounds = np.broadcast_to(np.arange(t)[:, None], bins.shape)
        names = np.broadcast_to(np.arange(elements)[None, :], bins.shape)
        for b in range(t):
            here = bins == b
            order = np.lexsort((values[here], rounds[here]))
            listed = np.concatenate([names[here][order], np.argsort(last[b])])
            self.lists.append(listed[np.sort(np.unique(listed, return_index=True)[1])])

    @staticmethod
    def columns(phash: np.ndarray, dhash: np.ndarray, whash: np.ndarray) -> np.ndarray:
        """Bits of each row as 192 contiguous byte columns."""
        raw = np.stack([phash, dhash, whash], axis=1).astype("<u8").view(np.uint8)
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        return np.ascontiguousarray(bits.T)

    def coordinate(self, j: int, bits: np.ndarray, first: int = 16) -> np.ndarray:
        """Coordinate j of each row, as the place in the priority list (up to 383)."""
        listed = self.lists[j]
        out = np.full(bits.shape[1], 255, dtype=np.uint8)
        for d in range(first - 1, -1, -1):
            p, b = divmod(int(listed[d]), 2)
            np.copyto(out, np.uint8(d), where=bits[p] == b)
        open_rows = np.flatnonzero(out == 255)
        out = out.astype(np.uint64)
        d = first
        while len(open_rows):
            p, b = divmod(int(listed[d]), 2)
            hit = bits[p, open_rows] == b
            out[open_rows[hit]] = d
            open_rows = open_rows[~hit]
            d += 1
        return out
