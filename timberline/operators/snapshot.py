"""Reads of the versions relation as of a timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..model import Bound, as_lit, free_name, in_range, is_tombstone


def top_one(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """First row per key. Catalyst puts a WindowGroupLimit below the exchange, so a hot key sends one row per task."""
    rank = free_name("rank", df.columns)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) == 1).drop(rank)


def snapshot(versions: DataFrame, read_ts: int | None = None, lower: Bound | None = None, upper: Bound | None = None, keep_ts: bool = False) -> DataFrame:
    """Per key the newest version with ts <= read_ts; a tombstone hides the key. The timestamp test is below the
    window and the tombstone test above it; range tests reach the scan."""
    seen = versions.filter(in_range(lower, upper))
    if read_ts is not None:
        seen = seen.filter(F.col("ts") <= F.lit(read_ts))
    newest = top_one(seen.select("key", "ts", "value"), ["key"], F.desc("ts")).filter(~is_tombstone())
    return newest if keep_ts else newest.select("key", "value")


def point_get(versions: DataFrame, key, read_ts: int | None = None) -> DataFrame:
    """At most one row: the value that is visible under the key."""
    seen = versions.filter(F.col("key") == as_lit(key))
    if read_ts is not None:
        seen = seen.filter(F.col("ts") <= F.lit(read_ts))
    return seen.orderBy(F.desc("ts")).limit(1).filter(~is_tombstone()).select("key", "value")


def multi_get(versions: DataFrame, keys: DataFrame, read_ts: int | None = None) -> DataFrame:
    """One row per asked key, value NULL where nothing is visible. Asked keys filter the versions before the window."""
    asked = keys.select("key").distinct()
    return asked.join(snapshot(versions.join(asked, "key", "left_semi"), read_ts), "key", "left")


def raw_versions(versions: DataFrame, lower: Bound | None = None, upper: Bound | None = None) -> DataFrame:
    """All versions with tombstones, keys ascending and newest first."""
    return versions.filter(in_range(lower, upper)).orderBy("key", F.desc("ts"))


def batch_last_wins(rows: DataFrame) -> DataFrame:
    """A batch keeps its last record per key: (key, commit_ts, seq, value) -> (key, ts, value)."""
    return top_one(rows, ["key", "commit_ts"], F.desc("seq")).select("key", F.col("commit_ts").alias("ts"), "value")


def asof_join(probes: DataFrame, versions: DataFrame, slice_width: int) -> DataFrame:
    """Adds to each probe (key, probe_ts) the value that was visible then, NULL if none.

    Time is cut into slices: each slice of a key sorts alone, and what came before it arrives as one carried row.
    So a hot key is spread over as many tasks as it has slices, and no probe meets more than its own slice."""
    cut = lambda c: F.floor(F.col(c) / F.lit(slice_width)).cast("long")
    v = versions.select("key", F.col("ts").alias("at"), cut("ts").alias("slice"), F.struct("ts", "value").alias("ver"))
    p = probes.select("key", cut("probe_ts").alias("slice"), F.col("probe_ts").alias("at"), F.struct(*(c for c in probes.columns if c != "key")).alias("row"))
    ends = v.groupBy("key", "slice").agg(F.max_by("ver", "at").alias("ver"))
    stops = ends.select("key", "slice", "ver").unionByName(p.select("key", "slice").distinct().withColumn("ver", F.lit(None).cast(ends.schema["ver"].dataType))).groupBy("key", "slice").agg(F.first("ver", ignorenulls=True).alias("ver"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = stops.withColumn("ver", F.last("ver", ignorenulls=True).over(before)).filter("ver is not null").select("key", "slice", F.lit(None).cast("long").alias("at"), "ver")
    left = v.unionByName(carried).withColumns({"probe": F.lit(0), "row": F.lit(None).cast(p.schema["row"].dataType)})
    right = p.select("key", "slice", "at", F.lit(None).cast(v.schema["ver"].dataType).alias("ver"), F.lit(1).alias("probe"), "row")
    order = Window.partitionBy("key", "slice").orderBy(F.asc_nulls_first("at"), "probe").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("ver", F.last("ver", ignorenulls=True).over(order)).filter("probe = 1")
    return out.select("key", "row.*", F.when(F.octet_length("ver.value") > 0, F.col("ver.value")).alias("value"))
