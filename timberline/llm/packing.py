"""Best-fit packing of documents into sequences by a linear grouping scheme.

Lengths are whole numbers up to the sequence length, so the plan works on their counts and its size depends on the
sequence length alone. Large lengths, those beyond a quarter of it, are sorted and cut into groups of equal cardinality,
each rounded up to its longest; a linear program over configurations of these few sizes is solved by column generation
and rounded down, and what it leaves again; then actual lengths take the places of the sizes, and the small ones go
best-fit into the remaining room. Documents meet the plan by their rank among those of equal length.

Rows: a null text is an empty one and has its end id alone; repeated rows and null doc_ids are packed like others; an
empty table gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import ship, written
from .tokens import END, chunks, default_vocabulary, encoder


@dataclass
class Run:
    """`count` sequences, each holding these lengths one after another; used: of each, the rank where it begins."""

    lengths: list[int]
    ranks: list[int]
    count: int

    def head(self, n: int) -> Run:
        return Run(self.lengths[:], self.ranks[:], n)

    def tail(self, n: int) -> Run:
        return Run(self.lengths[:], [r + n for r in self.ranks], self.count - n)


def best_configuration(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes that fits, by its number of members: each layer adds one to the one before."""
    layers, taken = [np.zeros(room + 1)], []
    while True:
        below = layers[-1]
        reach = np.full((len(sizes), room + 1), -1.0)
        for i, v in enumerate(sizes.tolist()):
            reach[i, v:] = below[: room + 1 - v] + value[i]
        who = reach.argmax(0)
        now = np.maximum(below, reach.max(0))
        if (now <= below + 1e-12).all():
            break
        taken.append(np.where(now > below + 1e-12, who, -1))
        layers.append(now)
    column, c = [], room
    for who in reversed(taken):
        if who[c] >= 0:
            column.append(int(who[c]))
            c -= int(sizes[who[c]])
    return float(layers[-1][room]), column


def configurations(sizes: list[int], demand: list[int], room: int, gap: float = 1e-4) -> list[tuple[list[int], float]]:
    """((index of each member), how often): the linear program of fewest sequences, by column generation until it is
    within `gap` of its bound by duality, or until columns no longer lower it."""
    k, s, need = len(sizes), np.array(sizes), np.array(demand, float)
    basis = np.diag((room // s).astype(float))
    x = need / np.diag(basis)
    still, least = 0, x.sum()
    while still < 4 * k:
        y = np.linalg.solve(basis.T, np.ones(k))
        worth, members = best_configuration(s, y, room)
        if worth <= 1 + 1e-9 or x.sum() * (1 - 1 / worth) <= gap * x.sum():
            break
        column = np.bincount(members, minlength=k).astype(float)
        d = np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * d, 0)
        x[out], basis[:, out] = ratio[out], column
        still, least = (0, x.sum()) if x.sum() < least * (1 - 1e-9) else (still + 1, least)
    return [(np.repeat(np.arange(k), basis[:, i].astype(int)).tolist(), float(x[i])) for i in range(k) if x[i] > 0]


def grouped(lengths: list[int], left: dict[int, int], groups: int) -> tuple[list[int], list[int]]:
    """(sizes, how many of each): lengths, longest first, in groups of equal cardinality, each rounded up to its longest.
    Groups that round up alike are one size."""
    per = -(-sum(left[v] for v in lengths) // groups)
    sizes: dict[int, int] = {}
    now, held = 0, 0
    for v in lengths:
        n = left[v]
        while n:
            if held % per == 0:
                now = v
            m = min(n, per - held % per)
            sizes[now] = sizes.get(now, 0) + m
            held += m
            n -= m
    return list(sizes), list(sizes.values())


def plan(counts: dict[int, int], room: int, groups: int = 128, small: float = 1 / 4) -> list[Run]:
    """Runs that hold every length as often as counts says. Lengths up to `small` of the room are small, so that a
    configuration holds up to three large ones.

    Solutions are rounded down, and what they leave is grouped and solved again while whole configurations come out.
    Actual lengths take the places of sizes: the longest left that the size allows, and in a configuration's last place
    the longest that the room allows, as the lengths before are shorter than their sizes. A longer one that moves up
    leaves its own place to a shorter one, so every configuration can still be filled. The rest goes best-fit."""
    used, left = dict.fromkeys(counts, 0), {v: n for v, n in counts.items() if n}
    waiting = sorted(left)
    gaps: dict[int, list[Run]] = {}
    keys: list[int] = []

    def take(v: int, n: int) -> int:
        """Takes n of a length; the rank of the first."""
        rank = used[v]
        used[v] += n
        left[v] -= n
        if not left[v]:
            waiting.pop(bisect.bisect_left(waiting, v))
        return rank

    def offer(r: Run) -> None:
        g = room - sum(r.lengths)
        if not gaps.get(g):
            bisect.insort(keys, g)
        gaps.setdefault(g, []).append(r)

    def filled(slots: list[int], times: int) -> None:
        """Opens `times` sequences with actual lengths in place of the slots' sizes."""
        while times:
            lengths: list[int] = []
            for j, size in enumerate(slots):
                bound = room - sum(lengths) if j == len(slots) - 1 else size
                i = bisect.bisect_right(waiting, bound) - 1
                while i >= 0 and left[waiting[i]] <= lengths.count(waiting[i]):
                    i -= 1
                if i >= 0:
                    lengths.append(waiting[i])
            if not lengths:
                return
            n = min([times, *(left[v] // lengths.count(v) for v in set(lengths))])
            offer(Run(lengths, [take(v, n) for v in lengths], n))
            times -= n

    filled([room], left.get(room, 0))
    while True:
        big = [v for v in reversed(waiting) if v > small * room]
        total = sum(left[v] for v in big)
        k = min(groups, total)
        if k < 2:
            break
        sizes, demand = grouped(big, left, k)
        whole = [(c, int(x + 1e-6)) for c, x in configurations(sizes, demand, room) if x >= 1 - 1e-6]
        if not whole:
            break
        for column, times in sorted(whole, key=lambda w: -sum(sizes[i] for i in w[0])):
            filled(sorted((sizes[i] for i in column), reverse=True), times)
    for v in waiting[::-1]:
        n = left[v]
        while n:
            i = bisect.bisect_left(keys, v)
            g = keys[i] if i < len(keys) else room
            fit = min(g // v, n)
            m = n // fit
            if i < len(keys):
                r = gaps[g].pop()
                if not gaps[g]:
                    keys.pop(i)
                m = min(m, r.count)
                if m < r.count:
                    offer(r.tail(m))
                r = r.head(m)
            else:
                r = Run([], [], m)
            for _ in range(fit):
                r.lengths.append(v)
                r.ranks.append(used[v])
                used[v] += m
            n -= fit * m
            offer(r)
    return [r for rs in gaps.values() for r in rs if r.count]


def pieces(docs: DataFrame, vocabulary: str, room: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents of more than `room` ids are cut, the first piece shorter."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for doc_ids, texts in chunks(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode(texts)):
                ids += END
                n, a, k = len(ids) // 4, 0, 0
                while a < n:
                    z = min(n, a + ((n - 1) % room + 1 if k == 0 else room))
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * z]))
                    a, k = z, k + 1
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def ranked(parts: DataFrame, rows: int, per_bucket: int = 200_000) -> DataFrame:
    """Adds rank, from 0, among pieces of equal length. Lengths are dealt over buckets by hash, so a length that a third
    of all pieces have is ranked by many tasks; counts of the buckets before give where each begins."""
    buckets = max(1, rows // per_bucket)
    dealt = parts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    inner = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    if buckets == 1:
        return inner.withColumnRenamed("_r", "rank").drop("_b")
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return inner.join(sums, ["length", "_b"]).withColumn("rank", F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")


def pack(docs: DataFrame, vocabulary: str | None = None, room: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    parts = written(pieces(docs, vocabulary or default_vocabulary(), room), "pieces")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `room` rows
    table, at = [], 0
    for r in plan(counts, room):
        offset = 0
        for v, rank in zip(r.lengths, r.ranks):
            table.append((v, rank, at, offset))
            offset += v
        at += r.count
    table.sort()
    length, rank, first, offset = (np.array(c, np.int64) for c in (zip(*table) if table else ([], [], [], [])))
    key = length << 44 | rank
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("rank").to_numpy()
            i = np.searchsorted(key, b.column("length").to_numpy() << 44 | k, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), pa.array(first[i] + k - rank[i]), pa.array(offset[i])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked(parts, sum(counts.values())).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
    return placed.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
