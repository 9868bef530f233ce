"""Files and events as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import EXTENSIONS
from ..operators.incremental import upsert
from ..plans.scratch import remove
from ..sources.files import FILE_SCHEMA, not_excluded, supported


def stream_files(spark: SparkSession, root: str, excluded: Sequence[str] = (), extensions: Sequence[str] = EXTENSIONS, per_batch: int = 5_000) -> DataFrame:
    """Supported files below ``root`` as a stream, ``per_batch`` new ones in a micro-batch."""
    rows = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
        .select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("file_size"), "content")
    )
    return rows.where(supported(F.col("path"), extensions) & not_excluded(F.col("path"), root, excluded))


def upsert_stream(rows: DataFrame, table: str, checkpoint: str, keys: tuple[str, ...] = ("path", "channel")) -> StreamingQuery:
    """Merge each micro-batch into a Parquet table that has versions in numbered folders, and stop when all input is read.

    A batch that is retried writes the same version again, so results stay exact. The version it starts from
    is kept for that; older ones are removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{table}/v{number - 1}"
        old = spark.read.schema(batch.schema).parquet(before) if number else spark.createDataFrame([], batch.schema)
        upsert(old, batch, keys).write.mode("overwrite").parquet(f"{table}/v{number}")
        remove(spark, f"{table}/v{number - 2}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Arrivals by time window and type; rows later than ``late`` behind the newest are left out by the watermark when streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
