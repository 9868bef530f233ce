"""Problem 4: one surviving record a file and the best file of each group.

Method: field-by-field survivorship. One aggregation takes, for each attribute,
the maximum of (present, source priority, time, value); it combines on the map
side, so a group with a third of all rows moves one row a map task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surviving_records(
    rows: DataFrame, keys: list[str], fields: Mapping[str, Column], present: Mapping[str, Column], observed: Column, priority: Column | None = None
) -> DataFrame:
    """One row for each distinct ``keys`` with the surviving value of every field, null where none is present.

    A value that is present beats an absent one, then the higher ``priority``,
    then the later ``observed`` (null is earliest), then the greater value. Exact repeats change nothing.
    """
    trust = F.lit(0) if priority is None else priority
    best = [
        F.max(F.struct(F.coalesce(present[f], F.lit(False)).alias("present"), trust.alias("priority"), observed.alias("observed"), v.alias("value"))).alias(f)
        for f, v in fields.items()
    ]
    return rows.groupBy(*keys).agg(*best).select(*keys, *(F.when(F.col(f"{f}.present"), F.col(f"{f}.value")).alias(f) for f in fields))


def surviving_files(scan_results: DataFrame) -> DataFrame:
    """``group_id, path, resolution_w, resolution_h, file_size, bit_depth`` for each file of each group.

    Sizes, resolution and depth count as present above 0, resolution only with
    both sides. Rows without group or path belong to no file.
    """
    c = F.col
    known = scan_results.where(c("group_id").isNotNull() & c("path").isNotNull())
    pixels = c("resolution_w").cast("bigint") * c("resolution_h")
    one = surviving_records(
        known,
        ["group_id", "path"],
        {
            "resolution": F.struct(pixels.alias("pixels"), c("resolution_w").alias("w"), c("resolution_h").alias("h")),
            "file_size": c("file_size"),
            "bit_depth": c("bit_depth"),
        },
        {"resolution": (c("resolution_w") > 0) & (c("resolution_h") > 0), "file_size": c("file_size") > 0, "bit_depth": c("bit_depth") > 0},
        c("observed_at"),
    )
    return one.select("group_id", "path", c("resolution.w").alias("resolution_w"), c("resolution.h").alias("resolution_h"), "file_size", "bit_depth")


def best_files(scan_results: DataFrame) -> DataFrame:
    """``group_id`` and the fields of its best file: most pixels, then depth, then size, then the smallest path; absent counts as 0."""
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    files = surviving_files(scan_results)
    pixels = F.col("resolution_w").cast("bigint") * F.col("resolution_h")
    order = F.struct((-zero(pixels)).alias("p"), (-zero(F.col("bit_depth"))).alias("d"), (-zero(F.col("file_size"))).alias("s"), F.col("path"), "resolution_w", "resolution_h", "file_size", "bit_depth")
    return files.groupBy("group_id").agg(F.min(order).alias("best")).select("group_id", "best.path", "best.resolution_w", "best.resolution_h", "best.file_size", "best.bit_depth")
