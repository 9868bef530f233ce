"""Lineage cuts that survive the loss of an executor.

Iterative operators write what a round produced as a Parquet table in the
folder that the session names in ``spark.checkpoint.dir`` and go on from there.
Only where that setting is absent and all runs in one machine (tests, a laptop) a
folder of our own is used; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dir:
            _own_dir[app] = tempfile.mkdtemp(prefix="lumatrace-")
        named = _own_dir[app]
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder, removed when the session ends."""
    root = f"{shared_dir(spark)}/lumatrace-{spark.sparkContext.applicationId}"
    if root not in _used:
        _used.add(root)
        atexit.register(remove, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame from :func:`materialize` that no later stage reads."""
    for name in df.inputFiles()[:1]:
        remove(df.sparkSession, name.rsplit("/", 1)[0])


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the folder is the cluster's to clean then
        pass
