"""Analysis items: which planes of a file are compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name


def analysis_items(files: DataFrame, by_channel: bool = False, by_luminance: bool = False, channels: Sequence[str] = ("R", "G", "B", "A"), tags: Sequence[str] = ()) -> DataFrame:
    """``path, analysis_type``. With ``by_channel`` files whose lower-case name holds one of the tags (all files
    without tags) give an item a channel; the rest give one for luminance or the composite."""
    plain = F.array(F.lit("Luminance" if by_luminance else "Composite"))
    name = F.lower(file_name(F.col("path")))
    types = plain
    if by_channel:
        split = F.lit(True)
        if tags:
            split = F.exists(F.array(*map(F.lit, tags)), lambda t: F.contains(name, t))
        chosen = F.array(*map(F.lit, channels)) if channels else F.array().cast("array<string>")
        types = F.when(split, chosen).otherwise(plain)
    return files.select("path", F.explode(types).alias("analysis_type"))


def channel_of(analysis_type: str = "analysis_type") -> Column:
    """The channel of a result row: null for the composite and for luminance, which look at the whole image."""
    return F.when(F.col(analysis_type).isin("Composite", "Luminance", "RGB"), None).otherwise(F.col(analysis_type))
