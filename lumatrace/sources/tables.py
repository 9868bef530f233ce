"""Declared schemas and table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_META = [
    ("path", T.StringType()), ("resolution_w", T.IntegerType()), ("resolution_h", T.IntegerType()), ("file_size", T.LongType()), ("mtime", T.DoubleType()),
    ("capture_date", T.DoubleType()), ("format_str", T.StringType()), ("compression_format", T.StringType()), ("format_details", T.StringType()), ("has_alpha", T.BooleanType()),
    ("bit_depth", T.IntegerType()), ("mipmap_count", T.IntegerType()), ("texture_type", T.StringType()), ("color_space", T.StringType()), ("channel", T.StringType()),
]
FINGERPRINTS = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), *(T.StructField(n, t) for n, t in _META)])
HASHES = T.StructType([T.StructField("path", T.StringType()), T.StructField("analysis_type", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("dhash", "phash", "whash"))])
RESULTS = T.StructType(
    [*(T.StructField(n, t) for n, t in _META), T.StructField("group_id", T.LongType()), T.StructField("is_best", T.BooleanType()), T.StructField("distance", T.IntegerType()), T.StructField("found_by", T.StringType())]
)
#: What readers expect where metadata is absent.
DEFAULTS = {"resolution_w": 0, "resolution_h": 0, "file_size": 0, "mtime": 0.0, "format_str": "Unknown", "format_details": "", "has_alpha": False, "bit_depth": 8, "mipmap_count": 1, "texture_type": "2D", "color_space": "sRGB"}


def with_defaults(rows: DataFrame) -> DataFrame:
    """Absent metadata as the defaults that readers expect; the compression defaults to the format."""
    have = [c for c in DEFAULTS if c in rows.columns]
    out = rows.withColumns({c: F.coalesce(F.col(c), F.lit(DEFAULTS[c])) for c in have})
    if "compression_format" in rows.columns:
        out = out.withColumn("compression_format", F.coalesce("compression_format", "format_str"))
    return out


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def create_table(df: DataFrame, path: str) -> None:
    """Drop and create."""
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_results(results: DataFrame, path: str, buckets: int = 64) -> None:
    """Result groups, clustered so that the lookup of one group reads few row groups."""
    results.repartitionByRange(buckets, "group_id").sortWithinPartitions("group_id").write.mode("overwrite").parquet(path)


def key_lookup(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("key") == key).limit(1)


def key_put(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.join(rows.select("key").distinct(), "key", "left_anti").unionByName(rows.dropDuplicates(["key"]))


def clear_store(spark: SparkSession, folder: str, keep: str | None = None) -> list[str]:
    """Remove the stores below a folder but the one named ``keep``, as after a change of model; the removed names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    gone = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName() != keep)
    for name in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, name), True)
    return gone
