"""Expressions over paths, formats and file sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats by how much quality they keep.
LOSSLESS = ["PNG", "BMP", "TIFF", "TIF", "EXR"]
LOSSY = ["JPEG", "JPG", "WEBP", "AVIF", "TGA"]
#: File name extensions of supported images.
EXTENSIONS = (
    ".avif .bmp .cin .cur .dds .dpx .exr .gif .hdr .heic .heif .ico .j2k .jp2 .jpeg .jpg .jxl .png .psd .tga .tif .tiff .webp"
).split()


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, empty where there is none; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def format_score(fmt: Column) -> Column:
    up = F.upper(fmt)
    return F.when(up.isin(LOSSLESS), 2).when(up.isin(LOSSY), 1).otherwise(0)


def group_name(path: Column, channel: Column) -> Column:
    return F.concat(stem(path), F.when(F.coalesce(channel, F.lit("")) != "", F.concat(F.lit(" ("), channel, F.lit(")"))).otherwise(""))


def load_shrink(file_size: Column) -> Column:
    mib = 1024 * 1024
    return F.when(file_size > 50 * mib, 8).when(file_size > 10 * mib, 4).when(file_size > 2 * mib, 2).otherwise(1)


def thumbnail_shrink(width: Column, height: Column, target: int) -> Column:
    """Power of two not below the integer ratio to one and a half times the target; 1 for images up to that."""
    room = target * 1.5
    ratio = F.greatest(F.lit(1), F.floor(F.least(width / room, height / room)))
    grown = F.pow(F.lit(2.0), F.ceil(F.log2(ratio.cast("double")))).cast("int")
    return F.when((width > room) | (height > room), F.when(ratio > 1, grown).otherwise(1)).otherwise(1)


def parse_list(text: Column) -> Column:
    """Comma list: trimmed, lower case, without empty entries."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def common_base_name(stems: Column) -> Column:
    """Longest common prefix of an array of stems, cut back to the last of ``_``, ``-`` or blank where they differ."""
    short = F.array_min(F.transform(stems, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    n = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(short), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & F.forall(stems, lambda s: F.substr(s, F.lit(1), i) == F.substr(short, F.lit(1), i)), i).otherwise(acc),
    )
    prefix = F.substr(short, F.lit(1), n)
    cut = F.regexp_extract(prefix, r"^(.*)[_\- ][^_\- ]*$", 1)
    return F.when(n >= F.length(short), short).when(prefix.rlike(r"[_\- ]"), cut).otherwise(prefix)
