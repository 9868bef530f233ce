"""Content and perceptual hash expressions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BANDS, BAND_BITS = 4, 16


@F.pandas_udf(T.StringType())
def xxh64_hex(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """XXH64 with seed 0 of binary content, as 16 hex digits; null stays null.

    The built-in ``xxhash64`` has another fixed seed, so the printed value needs Python.
    """
    import xxhash

    for s in parts:
        yield s.map(lambda b: None if b is None else xxhash.xxh64_hexdigest(bytes(b)))


def content_number(x: Column) -> Column:
    """The 64-bit number that an xxHash text stands for; null where it is none."""
    bare = F.regexp_replace(F.lower(F.trim(x)), r"^\s*(0x)?|\s+$", "")
    return F.when(bare.rlike("^[0-9a-f]{1,16}$"), F.conv(bare, 16, -10).cast("bigint"))


def pack_bits(bits: Column) -> Column:
    """64 booleans as a signed long, the first one being the highest bit."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("bigint")))


def band_key(h: Column, band: int) -> Column:
    return F.shiftrightunsigned(h, BAND_BITS * band).bitwiseAND((1 << BAND_BITS) - 1)


def bands(h: Column) -> Column:
    """Array of (band, key) of the four 16-bit parts."""
    return F.array(*(F.struct(F.lit(i).alias("band"), band_key(h, i).alias("key")) for i in range(BANDS)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def uuid5_url(name: Column) -> Column:
    """UUID version 5 in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def vector_id(path: Column, channel: Column) -> Column:
    return uuid5_url(F.concat(path, F.coalesce(channel, F.lit(""))))


def thumbnail_key(path: Column, mtime: Column, size: Column, mode: Column, channel: Column) -> Column:
    """Cache key; ``mtime`` is a text, so that its form is the caller's choice."""
    return F.sha1(F.concat_ws("|", path, mtime, size.cast("string"), mode, F.coalesce(channel, F.lit("full"))))


def store_name(folder: Column, model: Column) -> Column:
    return F.concat(F.md5(folder), F.lit("_"), F.translate(model, "/-", "__"))
