"""Files of an asset library as a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import EXTENSIONS, suffix

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def supported(path: Column, extensions: Sequence[str] = EXTENSIONS) -> Column:
    return suffix(path).isin([e.lower() for e in extensions])


def not_excluded(path: Column, root: str, excluded: Sequence[str]) -> Column:
    """Outside each excluded folder and all below it."""
    ok = F.lit(True)
    for p in excluded:
        ok = ok & ~F.startswith(path, F.lit(f"{root.rstrip('/')}/{p.strip('/')}/"))
    return ok


def discover(spark: SparkSession, root: str, excluded: Sequence[str] = (), extensions: Sequence[str] = EXTENSIONS, content: bool = False) -> DataFrame:
    """``path, mtime, file_size`` (and ``content``) of the supported files below ``root``; missing files are skipped.

    Without ``content`` only the listing is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    bare = F.regexp_replace("path", "^file:/+", "/")
    rows = files.select(bare.alias("path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("file_size"), *(["content"] if content else []))
    return rows.where(supported(F.col("path"), extensions) & not_excluded(F.col("path"), root, excluded))


def listed(files: DataFrame) -> DataFrame:
    return files.orderBy("path")
