"""Byte accounting and the cutting of a write stream into segments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..model import free_name


def live_bytes(versions: DataFrame) -> DataFrame:
    return versions.agg(F.coalesce(F.sum(F.octet_length("key") + 8 + F.octet_length("value")), F.lit(0)).alias("bytes"))


def freeze_segments(rows: DataFrame, stream: str, order: str, target: int) -> DataFrame:
    """Cuts each stream into segments: a segment is frozen after the row that takes it beyond `target` bytes. Adds
    segment (from 0; a column of that name is replaced). Rows come sorted by Spark's external sort and pass through once;
    a task holds one batch."""
    rows = rows.drop("segment")
    size = free_name("bytes", rows.columns)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seg, used = None, 0, 0
        for b in batches:
            out = []
            for s, n in zip(b[stream], b[size]):
                if s != now:
                    now, seg, used = s, 0, 0
                out.append(seg)
                used += n
                if used > target:
                    seg, used = seg + 1, 0
            yield b.assign(segment=out).drop(columns=size)

    sized = rows.withColumn(size, F.octet_length("key") + 8 + F.octet_length("value"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", segment long"
    return sized.repartition(stream).sortWithinPartitions(stream, order).mapInPandas(cut, schema)
