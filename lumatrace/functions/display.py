"""Scores, labels and display strings of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Display names of match methods.
METHOD_LABELS = {"xxHash": "Exact Match", "dHash": "Simple Match", "pHash": "Near-Identical", "wHash": "Structural Match"}
#: Order in which evidence of several methods counts.
METHOD_ORDER = ["xxHash", "dHash", "pHash", "wHash", "AI"]


def score(method: Column, distance: Column) -> Column:
    """Whole percent for AI matches, 100 for every hash method."""
    return F.when(method == "AI", F.floor(F.round(F.greatest(F.lit(0.0), 1 - distance) * 100, 6))).otherwise(100).cast("int")


def method_rank(method: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, METHOD_ORDER)), method).cast("int"), F.lit(len(METHOD_ORDER) + 1))


def method_label(method: Column, distance: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in METHOD_LABELS.items():
        out = out.when(method == k, v)
    return out.otherwise(F.concat(distance.cast("string"), F.lit("%")))


def sort_priority(is_best: Column, found_by: Column, distance: Column) -> Column:
    return F.when(is_best, 102).when(found_by == "xxHash", 101).when(found_by == "dHash", 100).when(found_by == "pHash", 99).otherwise(distance).cast("int")


def metadata_string() -> Column:
    """Display line from the columns of a result row; empty and absent parts are left out."""
    c = F.col
    num = lambda x: F.coalesce(x, F.lit(0)).cast("string")
    text = lambda x: F.nullif(x, F.lit(""))
    return F.concat_ws(
        " | ",
        F.concat(num(c("resolution_w")), F.lit("x"), num(c("resolution_h"))),
        F.format_string("%.2f MB", F.coalesce(c("file_size"), F.lit(0)) / F.lit(1048576.0)),
        text(c("format_str")),
        text(c("compression_format")),
        text(c("color_space")),
        F.concat(num(c("bit_depth")), F.lit("-bit")),
        text(c("format_details")),
        text(c("texture_type")),
        F.concat(F.lit("Mips: "), num(c("mipmap_count"))),
    )


def progress(base: Column, done: Column, total: Column, weight: Column) -> Column:
    """Overall percent: what was done before plus the fraction of this phase times its weight."""
    return base + F.when(total > 0, done / total).otherwise(0.0) * weight
