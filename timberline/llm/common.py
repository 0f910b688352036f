"""What the operators share: the folder that the cluster shares, tables cut into it, and text as bytes."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import drop, forget, located, scratch, shared_dir, written  # noqa: F401

#: Before the names of columns that are added to rows with columns of any other name.
OWN = "__timberline_"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors by the shared folder, once per application: their Python workers import it. Batches between Spark
    and Python are kept small, as rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    context = spark.sparkContext
    if getattr(context, "_timberline", None) != context.applicationId:
        root, packed = Path(__file__).parents[1], io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        fs, at = located(spark, f"{scratch(spark, 'code')}/timberline.zip")
        out = fs.create(at)
        out.write(bytearray(packed.getvalue()))
        out.close()
        context.addPyFile(at.toString())
        context._timberline = context.applicationId


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")
