"""Version garbage collection under a watermark: the oldest timestamp that any reader still needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..model import has_prefix, is_tombstone
from .snapshot import top_one


def collect_versions(versions: DataFrame, low: int, bottom: bool, filters: list = ()) -> DataFrame:
    """Keeps every version above the watermark, and per key the newest at or below it unless a filter drops it (a
    prefix of the key, or a Boolean column) or, at the bottom level, it is a tombstone with nothing above.

    Versions above pass through without a shuffle; only the newest below per key and task moves, so one key with most
    of the history costs no more than any other."""
    rows = versions.select("key", "ts", "value")
    above, below = rows.filter(F.col("ts") > low), top_one(rows.filter(F.col("ts") <= low), ["key"], F.desc("ts"))
    if filters:
        dropped = reduce(Column.__or__, [f if isinstance(f, Column) else has_prefix([f]) for f in filters])
        below = below.filter(~F.coalesce(dropped, F.lit(False)))
    if bottom:
        dead = is_tombstone()
        below = below.filter(~dead).unionByName(below.filter(dead).join(above.select("key").distinct(), "key", "left_semi"))
    return above.unionByName(below)


def watermark(readers: DataFrame, clock: int) -> DataFrame:
    """The least read timestamp of any reader, the clock if there is none."""
    return readers.agg(F.coalesce(F.min("read_ts"), F.lit(clock).cast("long")).alias("watermark"))


def snapshot_count(readers: DataFrame) -> DataFrame:
    return readers.agg(F.countDistinct("read_ts").alias("snapshots"))


def history_prune(history: DataFrame, low: int) -> DataFrame:
    """Committed transactions that a live reader could still conflict with: commit_ts >= watermark."""
    return history.filter(F.col("commit_ts") >= low)
