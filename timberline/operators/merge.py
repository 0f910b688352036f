"""Prioritised merging of runs and the transaction overlay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..model import Bound, in_range, is_tombstone
from .snapshot import snapshot, top_one


def merge_kway(runs: list[DataFrame] | DataFrame, priority: str = "run_id") -> DataFrame:
    """Union of runs; on an equal key the run of the lowest index wins. One DataFrame may hold all runs, told apart by
    its priority column."""
    if not isinstance(runs, DataFrame):
        runs = reduce(DataFrame.unionByName, [r.withColumn(priority, F.lit(i)) for i, r in enumerate(runs)])
    return top_one(runs, ["key"], priority).drop(priority)


def merge_two(a: DataFrame, b: DataFrame) -> DataFrame:
    """All of a, and the rows of b whose key isn't in a."""
    return a.unionByName(b.join(a.select("key"), "key", "left_anti"))


def runs_disjoint(files: DataFrame) -> DataFrame:
    """Adds ok: whether a file begins after its predecessor of the same level has ended."""
    w = Window.partitionBy("level").orderBy("first_key", "file_id")
    return files.withColumn("ok", F.coalesce(F.lag("last_key").over(w) < F.col("first_key"), F.lit(True)))


def concat_runs(runs: list[DataFrame]) -> DataFrame:
    """Runs of disjoint ranges one after another: a union, without a shuffle."""
    return reduce(DataFrame.unionByName, runs)


def overlay(local: DataFrame, versions: DataFrame, read_ts: int | None, lower: Bound | None = None, upper: Bound | None = None) -> DataFrame:
    """What a transaction sees: its own buffer shadows the snapshot, buffered empty values hide keys."""
    own = local.filter(in_range(lower, upper)).select("key", "value")
    return merge_two(own, snapshot(versions, read_ts, lower, upper)).filter(~is_tombstone())
