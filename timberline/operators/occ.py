"""Optimistic commit validation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..scratch import written
from .graph import components


def occ_conflicts(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Reads (txn_id, read_ts, key) that meet a committed write (commit_ts, key) with commit_ts > read_ts.

    The latest write per key decides, so each read joins one row whatever the history's length."""
    last = writes.groupBy("key").agg(F.max("commit_ts").alias("last_ts"))
    return reads.join(last, "key").filter("last_ts > read_ts").select("txn_id", "read_ts", "key")


def occ_fold(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Validates transactions in commit order: (txn_id, committed). Aborted ones add nothing to the history, and those
    that write nothing always commit. Needs reads (txn_id, read_ts, key) and writes (txn_id, key).

    Only transactions that write and whose reads meet some earlier write can abort. With the writers of the keys they
    read they form a graph; outcomes depend on each other within its connected components alone, so each is folded by
    itself, in commit order, with one timestamp per key as its state. Hashes name the graph's nodes: two that collide
    join their components, which costs nothing but parallelism."""
    w = writes.select("txn_id", "key").distinct()
    writers = w.select("txn_id").distinct()
    first = w.groupBy("key").agg(F.min("txn_id").alias("first_w"), F.max("txn_id").alias("last_w"))
    risky = reads.join(writers, "txn_id", "left_semi").join(first, "key").filter("first_w < txn_id and last_w > read_ts").select("txn_id", "key", "read_ts").distinct()
    shared = risky.select("key").distinct()
    both = w.join(shared, "key", "left_semi").select("txn_id", F.lit(None).cast("long").alias("read_ts"), "key", F.lit(1).alias("kind")).unionByName(risky.select("txn_id", "read_ts", "key", F.lit(0).alias("kind")))
    node = F.xxhash64(F.lit(0), "txn_id")
    events = written(both, "commits")
    label = components(events.select(node.alias("a"), F.xxhash64(F.lit(1), "key").alias("b")).distinct())
    named = events.join(label, node == label["key"], "left").select(F.coalesce("label", node).alias("part"), "txn_id", "read_ts", events["key"], "kind")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict = {}
        now = txn = None
        aborted = False
        for b in batches:
            out = []
            for p, t, r, k, kind in zip(b["part"], b["txn_id"], b["read_ts"], b["key"], b["kind"]):
                if p != now:
                    now, txn, last = p, None, {}
                if t != txn:
                    txn, aborted = t, False
                if kind == 0:
                    if not aborted and last.get(k, -1) > r:
                        aborted = True
                        out.append(t)
                elif not aborted:
                    last[k] = t
            yield pd.DataFrame({"txn_id": pd.Series(out, dtype="int64")})

    lost = named.repartition("part").sortWithinPartitions("part", "txn_id", "kind", "key").mapInPandas(fold, "txn_id long").withColumn("lost", F.lit(True))
    everyone = reads.select("txn_id").unionByName(writes.select("txn_id")).distinct()
    return everyone.join(lost, "txn_id", "left").select("txn_id", F.col("lost").isNull().alias("committed"))
