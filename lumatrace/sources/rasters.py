"""Pixels of files as RGBA rasters, and the perceptual hashes of their planes.

Formats that the JVM decodes come from Spark's image source; textures and other formats
are decoded from their bytes. Every raster has four channels of one byte. A file that no reader
decodes has no raster, as a truncated one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.paths import load_shrink, suffix
from . import dds
from .files import not_excluded, supported

#: Suffixes that Spark's image source decodes.
JVM_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".bmp"]
RASTER = "path string, width int, height int, data binary"
HASHES = "path string, analysis_type string, dhash bigint, phash bigint, whash bigint"
LARGEST = 128


def as_rgba(a: np.ndarray, tonemap: bool = True) -> np.ndarray:
    """Any decoded raster with one to four channels as RGBA bytes; what has no alpha is opaque."""
    a = a[..., None] if a.ndim == 2 else a
    if a.dtype.kind == "f" and tonemap:
        a = np.concatenate([pixels.tonemap(a[..., :3].astype(np.float64)), dds.to_bytes(a[..., 3:])], axis=-1)
    a = dds.to_bytes(a)
    h, w, c = a.shape
    if c == 4:
        return a
    colour = {1: [a, a, a], 2: [a[..., :1], a[..., 1:], np.zeros((h, w, 1), np.uint8)], 3: [a]}[c]  # two channels are red and green
    return np.concatenate([*colour, np.full((h, w, 1), 255, np.uint8)], axis=-1)


def read_tga(b: bytes) -> np.ndarray | None:
    """Uncompressed and run-length true colour and grey rasters."""
    if len(b) < 18:
        return None
    skip, mapped, kind = b[0], b[1], b[2]
    w, h, bits, flags = struct.unpack_from("<HHBB", b, 12)
    c = bits // 8
    if mapped or kind not in (2, 3, 10, 11) or bits not in (8, 24, 32) or not w or not h:
        return None
    body, at = b[18 + skip :], 0
    if kind >= 10:
        parts, n = [], 0
        while n < w * h and at < len(body):
            run = (body[at] & 127) + 1
            if body[at] & 128:
                parts.append(body[at + 1 : at + 1 + c] * run)
                at += 1 + c
            else:
                parts.append(body[at + 1 : at + 1 + c * run])
                at += 1 + c * run
            n += run
        body = b"".join(parts)
    if len(body) < w * h * c:
        return None
    a = np.frombuffer(body, dtype=np.uint8, count=w * h * c).reshape(h, w, c)
    a = a if flags & 0x20 else a[::-1]
    return a[..., [2, 1, 0, 3][:c]].copy() if c > 1 else a.copy()


def read_hdr(b: bytes) -> np.ndarray | None:
    """Radiance picture, flat or with run lengths by row, as floats."""
    if not b.startswith((b"#?RADIANCE", b"#?RGBE")):
        return None
    head, _, rest = b.partition(b"\n\n")
    line, _, body = rest.partition(b"\n")
    size = line.split()
    if len(size) != 4 or size[0] != b"-Y" or size[2] != b"+X":
        return None
    h, w = int(size[1]), int(size[3])
    out, at = np.empty((h, w, 4), dtype=np.uint8), 0
    for y in range(h):
        if body[at : at + 2] != b"\x02\x02" or not 8 <= w < 32768:
            row = body[at : at + 4 * w]
            if len(row) < 4 * w:
                return None
            out[y] = np.frombuffer(row, dtype=np.uint8).reshape(w, 4)
            at += 4 * w
            continue
        at += 4
        for c in range(4):
            row, n = [], 0
            while n < w:
                if at >= len(body):
                    return None
                k = body[at]
                row.append(body[at + 1 : at + 2] * (k - 128) if k > 128 else body[at + 1 : at + 1 + k])
                at += 2 if k > 128 else 1 + k
                n += k - 128 if k > 128 else k
            got = b"".join(row)
            if len(got) != w:
                return None
            out[y, :, c] = np.frombuffer(got, dtype=np.uint8)
    scale = np.ldexp(1.0, out[..., 3].astype(int) - 136)
    return (out[..., :3] * scale[..., None]).astype(np.float32)


DECODERS: dict[str, Callable[[bytes], np.ndarray | None]] = {".dds": dds.decode, ".tga": read_tga, ".hdr": read_hdr}


def decode(content: bytes, kind: str, shrink: int = 1, tonemap: bool = True) -> np.ndarray | None:
    """RGBA raster of a file that Spark does not decode; a texture with mip levels is read at the smallest level at least a ``shrink``-th as wide."""
    try:
        level = 0
        content = dds.standard(content) if kind == ".dds" else content
        if kind == ".dds" and (head := dds.read_header(content)):
            while level + 1 < head["mips"] and head["width"] >> (level + 1) >= max(1, head["width"] // shrink):
                level += 1
            a = dds.decode(content, level)
            a = dds.decode_blocks(content, level) if a is None else a
        else:
            a = DECODERS[kind](content)
        if a is None:
            return None
        a = as_rgba(a, tonemap)
        if kind == ".dds":
            a = as_rgba(pixels.resolve_alpha(a))
        return shrunk(a, max(1, shrink >> level))
    except (struct.error, IndexError, ValueError, KeyError):
        return None


def shrunk(a: np.ndarray, by: int) -> np.ndarray:
    """Every ``by``-th pixel, one of each side at least."""
    return pixels.resize_nearest(a, max(1, a.shape[1] // by), max(1, a.shape[0] // by)) if by > 1 else a


def thumbnail(a: np.ndarray, largest: int = LARGEST) -> np.ndarray:
    """The nearest pixels of a picture no side of which is longer than ``largest``."""
    h, w = a.shape[:2]
    if max(h, w) <= largest:
        return a
    return pixels.resize_nearest(a, max(1, round(w * largest / max(h, w))), max(1, round(h * largest / max(h, w))))


def _any_case(ends: Sequence[str]) -> str:
    return "*{" + ",".join("." + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in ends) + "}"


def rasters(spark: SparkSession, root: str, excluded: Sequence[str] = (), shrink: int | None = None) -> DataFrame:
    """``path, width, height, data`` of all supported pictures below ``root`` that a reader decodes, excluded folders left out.

    Without ``shrink`` a file is reduced by its size on disk.
    """
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    tree = {"recursiveFileLookup": "true", "ignoreMissingFiles": "true"}
    jvm = spark.read.format("image").options(**tree, pathGlobFilter=_any_case(JVM_SUFFIXES), dropInvalid="true").load(root)
    plain = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))  # this source names files as URIs
    jvm = jvm.select(bare(plain).alias("path"), "image.width", "image.height", "image.nChannels", "image.data").where(not_excluded(F.col("path"), root, excluded))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, w, h, c, data in zip(*(b.column(i) for i in range(5))):
                a = np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(h.as_py(), w.as_py(), c.as_py())
                a = as_rgba(a[..., [2, 1, 0, 3][: a.shape[2]]] if a.shape[2] > 2 else a)
                yield _row(path.as_py(), shrunk(a, shrink or max(1, max(a.shape[:2]) // 2048)))

    raw = spark.read.format("binaryFile").options(**tree, pathGlobFilter=_any_case(list(DECODERS))).load(root)
    by = F.lit(shrink) if shrink else load_shrink(F.col("length"))
    raw = raw.select(bare("path").alias("path"), suffix(F.col("path")).alias("kind"), by.cast("int").alias("by"), "content").where(not_excluded(F.col("path"), root, excluded))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, kind, n, content in zip(*(b.column(i) for i in range(4))):
                a = decode(content.as_py(), kind.as_py(), n.as_py())
                if a is not None:
                    yield _row(path.as_py(), a)

    return jvm.mapInArrow(turn, RASTER).unionByName(raw.where(supported(F.col("path"))).mapInArrow(parse, RASTER))


def _row(path: str, a: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path]), pa.array([a.shape[1]], pa.int32()), pa.array([a.shape[0]], pa.int32()), pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())], names=["path", "width", "height", "data"]
    )


def perceptual_hashes(pictures: DataFrame, items: DataFrame, ignore_solid: bool = True) -> DataFrame:
    """``path, analysis_type, dhash, phash, whash`` of the wanted planes of rasters.

    ``items`` has ``path, analysis_type``. A single channel that is nearly black or white throughout has no
    hashes if ``ignore_solid``; a path without a raster has none either.
    """
    wanted = items.where(F.col("path").isNotNull() & F.col("analysis_type").isNotNull()).groupBy("path").agg(F.collect_set("analysis_type").alias("types"))  # six types at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, w, h, data, types in zip(*(b.column(c) for c in ("path", "width", "height", "data", "types"))):
                a = thumbnail(np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(h.as_py(), w.as_py(), 4))
                for kind in sorted(types.as_py()):
                    plane = pixels.channel_view(a, kind)
                    if not (ignore_solid and len(kind) == 1 and pixels.is_solid(plane)):
                        out.append((path.as_py(), kind, pixels.dhash(plane), pixels.phash(plane), pixels.whash(plane)))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(cols)], names=["path", "analysis_type", "dhash", "phash", "whash"])

    return pictures.join(wanted, "path").mapInArrow(run, HASHES)
