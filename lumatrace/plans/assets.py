"""From a folder of pictures to duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_number, xxh64_hex
from ..operators.exact import representatives
from ..operators.items import analysis_items, channel_of
from ..sources.files import discover
from ..sources.metadata import image_metadata
from ..sources.rasters import perceptual_hashes, rasters
from ..sources.tables import write_results
from .config import ScanConfig
from .pipeline import duplicate_scan
from .scratch import materialize


def catalogue(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """One row a supported file: metadata, ``xxhash`` text and ``hash`` number of its content."""
    files = discover(spark, config.folder, config.excluded, content=True)
    hashes = files.select("path", xxh64_hex(F.col("content")).alias("xxhash"))
    return materialize(image_metadata(files).join(hashes, "path").withColumn("hash", content_number(F.col("xxhash"))), "catalogue")


def picture_hashes(spark: SparkSession, config: ScanConfig, files: DataFrame, shrink: int = 4) -> DataFrame:
    """Perceptual hashes of the analysis items of one file of each content."""
    c = config.validate()
    wanted = analysis_items(representatives(files), c.compare_by_channel, c.compare_by_luminance, c.channels, c.tags)
    return materialize(perceptual_hashes(rasters(spark, c.folder, c.excluded, shrink), wanted), "hashes")


def scan_folder(spark: SparkSession, config: ScanConfig, links: DataFrame | None = None, into: str | None = None) -> DataFrame:
    """Result rows of a duplicate scan of the pictures below the configured folder; ``into`` names a table that they replace.

    Files whose pixels no reader decodes are compared by content only.
    """
    c = config.validate()
    files = catalogue(spark, c).withColumn("channel", F.lit(None).cast("string"))
    hashes = picture_hashes(spark, c, files).withColumn("channel", channel_of()).drop("analysis_type") if c.find_dhash or c.find_phash or c.find_whash else None
    nodes = files
    if hashes is not None:
        planes = hashes.where(F.col("channel").isNotNull()).select("path", "channel")
        nodes = files.unionByName(files.drop("channel").join(planes, "path"))
    results = duplicate_scan(c, nodes, hashes, links)
    if into is None:
        return results
    write_results(results, into)
    return spark.read.schema(results.schema).parquet(into)
