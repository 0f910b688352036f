"""The folder that the cluster shares, and tables cut into it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where the session names none, as on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def located(spark: SparkSession, path: str):
    """(file system, path) in the JVM: whatever scheme the path has, or that of fs.defaultFS."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there when the application ends goes with it."""
    path = f"{shared_dir(spark)}/timberline-{name}-{uuid.uuid4().hex}"
    fs, at = located(spark, path)
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at)
    return path


#: Whether Spark removes the shuffle files of a query when it ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors cost no recomputation. The shuffle
    files that led to it go once it is complete."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes folders that no later step reads."""
    for p in paths:
        fs, at = located(spark, p)
        fs.delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Removes written tables that no later step reads."""
    for t in tables:
        if path := getattr(t, "written_at", None):
            drop(t.sparkSession, path)
