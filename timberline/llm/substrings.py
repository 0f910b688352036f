"""Repeated passages by suffix arrays with their trees of common-prefix intervals.

Removed is each byte covered by a string of `size` bytes that also starts elsewhere. The suffixes of the corpus are
dealt by content: in every window of that size the k-byte piece of least hash is its anchor, so equal windows have
equal anchors at equal places, and suffixes are sorted together with those of the same anchor alone. Occurrences of an
anchor with equal surroundings (as far as a window can reach) are one member with their number; in periodic text such
neighbours are one row with their distance. Within an anchor:

- a single member that occurs twice is a tree of one leaf, repeated as far as its surroundings go; only its hash moves;
- otherwise the members' suffixes from the anchor on are sorted with their common-prefix lengths, and a stack scan gives
  the tree of intervals. In each interval, a second tree over what stands left of its members tests whether their left
  extensions differ: its nodes, if their members lie in more than one child of the interval, are the maximal repeats, and
  those of `size` bytes or more are groups. Reach beyond the surroundings is pieced together by the spans of neighbouring
  anchors.

An anchor with more than `most` members is dealt again before it is sorted: a window begins at most size - k bytes left of
the anchor, and cutting that range into PARTS gives as many longer pieces around the anchor, of which equal windows share
one. Pieces with few members are sorted like anchors; ranges are cut until they are one place, where the piece is the
window, and all its members are a group. Nothing is left out at any `most`, which only bounds what one task sorts.

Rows: texts are known by hash and length, so copies share their result and each row keeps it; null and empty texts and
those shorter than `size` lose nothing; null doc_ids and repeated rows keep a row each; an empty table gives an empty
one; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import forget, ship, text_of, written

K = 16
BLOCK, PARTS = 1 << 20, 4
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def text_key() -> list[Column]:
    return [F.xxhash64(text_of()).alias("h"), F.octet_length(text_of()).alias("n")]


def rolling(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on, by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    have, factor, out, done, power = 1, BASE, None, 0, np.uint64(1)
    while True:
        if k & have:
            if out is None:
                out = h
            else:
                n = len(h) - done
                out = out[:n] + h[done:] * power if n > 0 else out[:0]
            done += have
            power = power * factor
        if done == k:
            return out
        h = h[: len(h) - have] + h[have:] * factor if len(h) > have else h[:0]
        factor, have = factor * factor, have * 2


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from block-wise prefixes and suffixes."""
    n = len(v) - w + 1
    pad = np.full(-len(v) % w, np.iinfo(v.dtype).max, v.dtype)
    x = np.concatenate([v, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, 1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): each place that is the least of some window of `size` bytes; all of equal least ones."""
    w = size - K + 1
    v = mixed(rolling(b, K))
    low = sliding_min(v, w)
    # a place is chosen if one of the windows over it has its hash as the least: the greatest least of those windows
    top = np.iinfo(np.uint64).max - sliding_min(np.iinfo(np.uint64).max - np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w)
    at = np.flatnonzero(top == v)
    return at, v[at].view(np.int64)


def surroundings(n: int, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How far windows that hold the anchor can reach to the left and right of its first byte in a text of n bytes."""
    return np.minimum(at, size - K), np.minimum(n - at, size)


def anchored(b: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, hashes, hashes of the surroundings) of a text's anchors, block by block: whether a place is an anchor, and
    what surrounds it, depends on less than `size` bytes on either side."""
    for a in range(0, len(b), BLOCK):
        z = min(a + BLOCK, len(b))
        before, after = max(0, a - size), min(len(b), z + size)
        part = b[before:after]
        if len(part) < size:
            continue
        at, v = anchors(part, size)
        own = (at + before >= a) & (at + before < z)
        at, v = at[own], v[own]
        left, right = surroundings(len(b), at + before, size)
        yield at + before, v, around(part, at, left, right)


def folded(at: np.ndarray, v: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, step, times): runs of neighbours at equal distance with equal hashes and surroundings, as in periodic text."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    step = np.diff(at)
    same = (v[1:] == v[:-1]) & (whole[1:] == whole[:-1])
    goes_on = np.concatenate([[False], same])
    goes_on[2:] &= ~same[:-1] | (step[1:] == step[:-1])  # a run has one distance
    first = np.flatnonzero(~goes_on)
    times = np.diff(np.append(first, len(at)))
    return first, np.where(times > 1, np.append(step, 0)[first], 0), times


def prefix_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (byte + 1) * B^i, and the powers, modulo 2^64; differences compare substrings after alignment."""
    powers = np.full(len(b) + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[:-1])]), powers


def inverse() -> np.uint64:
    x, m = int(BASE), 1 << 64
    return np.uint64(pow(x, -1, m))


def around(b: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the surroundings of each anchor, with their reach."""
    sums, _ = prefix_hashes(b)
    back = np.full(len(b) + 1, inverse(), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    h = (sums[at + right] - sums[at - left]) * back[at - left]
    return mixed(h + mixed(left.astype(np.uint64) * np.uint64(1000) + right.astype(np.uint64))).view(np.int64)


def all_anchors(docs: DataFrame, size: int) -> DataFrame:
    """(h, n, pos, step, times, anchor, around) of every text of at least `size` bytes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                for at, v, whole in anchored(b, size):
                    first, step, times = folded(at, v, whole)
                    c = len(first)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(c, batch.column(0)[i].as_py(), np.int64)), pa.array(np.full(c, batch.column(1)[i].as_py(), np.int32)), *(pa.array(x.astype(np.int32)) for x in (at[first], step, times)), pa.array(v[first]), pa.array(whole[first])], names=["h", "n", "pos", "step", "times", "anchor", "around"])

    rows = docs.select(*text_key(), F.encode(text_of(), "UTF-8").alias("b")).filter(F.col("n") >= size)
    return rows.mapInArrow(run, "h long, n int, pos int, step int, times int, anchor long, around long")


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """Equal leading values of neighbouring rows (of uint16, filled with 256 and the row's number so that ends differ)."""
    same = rows[1:] == rows[:-1]
    return np.where(same.all(1), rows.shape[1], same.argmin(1))


def common_to(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def interval_tree(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first, end) of each interval of a suffix array with lcp[i] between i and i + 1, inner ones first."""
    stack = [(0, 0)]
    for i, v in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack[-1][0] > v:
            length, first = stack.pop()
            yield length, first, i + 1
        if stack[-1][0] < v:
            stack.append((v, first))


class Members:
    """An anchor's members, different in pairs (bytes around it, how many stand before it), sorted by what stands right
    and left of it. Lengths are common prefixes between neighbours in either order."""

    def __init__(self, contexts: list[bytes], lefts: list[int], size: int):
        self.m, self.size = len(contexts), size
        fill = np.arange(self.m, dtype=np.uint32) + 256
        right, left = np.repeat(fill[:, None], size, 1), np.repeat(fill[:, None], size - K, 1)
        for i, (c, n) in enumerate(zip(contexts, lefts)):
            b = np.frombuffer(c, np.uint8)
            right[i, : len(b) - n] = b[n:]
            left[i, :n] = b[:n][::-1]
        self.by_right = np.array(sorted(range(self.m), key=lambda i: contexts[i][lefts[i] :]))
        flipped = [contexts[i][: lefts[i]][::-1] for i in range(self.m)]
        self.by_left = np.array(sorted(range(self.m), key=flipped.__getitem__))
        self.rank = np.empty(self.m, np.int64)
        self.rank[self.by_left] = np.arange(self.m)
        self.left_lcp, self.right_lcp = common_prefix(left[self.by_left]), common_prefix(right[self.by_right])

    def intervals(self) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(length, first, end, members in left order, what neighbours among them share to the left) of each interval of
        the tree in which some share `size` bytes in all, inner ones first."""
        for length, a, z in interval_tree(self.right_lcp):
            r = np.sort(self.rank[self.by_right[a:z]])
            # the least over the members that are left out between them
            gap = np.minimum.reduceat(self.left_lcp, r[:-1]) if r[-1] == self.m - 1 else np.minimum.reduceat(self.left_lcp, r)[:-1]
            if gap.max(initial=0) + length >= self.size:
                yield length, a, z, self.by_left[r], gap


def shared_by_two(contexts: list[bytes], lefts: list[int]) -> tuple[int, int]:
    (c, d), (x, y) = contexts, lefts
    return common_to(c[:x][::-1], d[:y][::-1]), common_to(c[x:], d[y:])


def maximal_repeats(contexts: list[bytes], lefts: list[int], size: int) -> Iterator[tuple[int, int, list[int]]]:
    """Of an anchor's members the groups that share a repeat of `size` bytes or more: (bytes to the left, bytes from the
    anchor on, members). A repeat can't be extended within the surroundings without losing a member: to the right, as its
    members lie in more than one child of the interval; to the left, as they are a node of the tree over their left sides,
    or begin there at the anchor itself."""
    if len(contexts) == 2:
        left, right = shared_by_two(contexts, lefts)
        if left + right >= size:
            yield left, right, [0, 1]
        return
    of = Members(contexts, lefts, size)
    place = np.empty(of.m, np.int64)
    place[of.by_right] = np.arange(of.m)
    for length, a, z, who, gap in of.intervals():
        child = np.concatenate([[0], np.cumsum(of.right_lcp[a : z - 1] == length)])[place[who] - a]
        for depth, x, y in interval_tree(np.where(gap + length >= size, gap, 0)):
            if child[x:y].min() != child[x:y].max():
                yield depth, length, who[x:y].tolist()
        if length >= size and gap.min() == 0:  # their left bytes differ: the repeat begins at the anchor
            yield 0, length, who.tolist()


def widest_repeats(contexts: list[bytes], lefts: list[int], size: int) -> list[list[tuple[int, int]]]:
    """Of each member the (left, right) of the maximal repeats that it is in, without those inside another one: in an
    interval its deepest group is what it shares with a neighbour in left order, so no group is put together."""
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if len(contexts) == 2:
        left, right = shared_by_two(contexts, lefts)
        return [[(left, right)]] * 2 if left + right >= size else out
    of = Members(contexts, lefts, size)
    best = np.full(of.m, -1)  # of each member, the left reach already given with a longer right one
    for length, _, _, who, gap in of.intervals():
        reach = np.maximum(np.concatenate([[0], gap]), np.concatenate([gap, [0]]))
        new = (reach + length >= size) & (reach > best[who])
        for i, v in zip(who[new].tolist(), reach[new].tolist()):
            out[i].append((v, length))
        best[who[new]] = reach[new]
    return out


CONTEXT = "piece long, anchor long, around long, often long, kinds long, left int, bytes binary"
SCANNED = ["piece", "anchor", "around", "often", "left", "bytes"]
REACH = pa.schema([("anchor", pa.int64()), ("around", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("repeat", pa.int64())])


def contexts_of(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """CONTEXT of members (anchor, around, often, kinds, h, n, pos): the bytes around one occurrence of each. Texts move once, and
    of neighbouring copies of a text one is read."""
    text = docs.select(*text_key(), F.encode(text_of(), "UTF-8").alias("b")).filter(F.col("n") >= size)
    asked = members.groupBy("h", "n").agg(F.collect_list(F.struct("pos", "anchor", "around", "often", "kinds")).alias("at"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for i, text in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if text == last:
                    continue
                last, b, rows = text, batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                for k in range(0, len(rows), 5000):
                    part = rows[k : k + 5000]
                    left = [min(x["pos"], size - K) for x in part]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in part], pa.int64()) for c in ("anchor", "anchor", "around", "often", "kinds")), pa.array(left, pa.int32()), pa.array([b[x["pos"] - v : x["pos"] + size] for x, v in zip(part, left)], pa.binary())], names=["piece", "anchor", "around", "often", "kinds", "left", "bytes"])

    return text.join(asked, ["h", "n"]).select("h", "n", "b", "at").mapInArrow(gather, CONTEXT)


def scanned(contexts: DataFrame, size: int, repeats: bool) -> DataFrame:
    """(anchor, around, l, r, repeat) of the members of each piece that share repeats. With `repeats`, of every group, and
    repeat is its string's hash; else only the widest, and none of members that occur several times."""
    ship(contexts.sparkSession)

    def done(rows: dict) -> Iterator[tuple]:
        if len(rows) < 2 and not repeats:
            return
        names, held = list(rows), list(rows.values())
        texts, lefts = [c for c, _, _ in held], [v for _, v, _ in held]
        if repeats:
            found = maximal_repeats(texts, lefts, size) if len(names) > 1 else ()
            whole = [(v, len(c) - v, [i]) for i, (c, v, often) in enumerate(held) if often > 1 and len(c) >= size]  # a member of several is a group
            for left, right, members in [*found, *whole]:
                one = members[0]
                string = int.from_bytes(hashlib.blake2b(texts[one][lefts[one] - left : lefts[one] + right], digest_size=8).digest(), "big", signed=True)
                yield from ((*names[i], left, right, string) for i in members)
        else:
            for name, (_, _, often), reach in zip(names, held, widest_repeats(texts, lefts, size)):
                if often == 1:
                    yield from ((*name, left, right, 0) for left, right in reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), REACH)], schema=REACH)
        now, rows = None, {}
        for batch in batches:
            out = []
            for piece, anchor, around_, often, left, b in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if piece != now:
                    out += done(rows)
                    now, rows = piece, {}
                rows[anchor, around_] = (b, left, often)
            if out:
                yield batch_of(out)
        out = list(done(rows))
        if out:
            yield batch_of(out)

    return contexts.select(*SCANNED).repartition("piece").sortWithinPartitions("piece", "anchor", "around").mapInArrow(run, "anchor long, around long, l int, r int, repeat long")


def dealt_again(large: DataFrame, size: int, most: int, repeats: bool) -> DataFrame:
    """As scanned, for the contexts of anchors with more than `most` members. A row stands for the windows that begin lo to
    hi bytes left of its anchor; each turn cuts that range into PARTS. Windows of a part share its core, and members are
    counted by the hash of that alone. Members that are equal wherever the part's windows reach, its hull, are repeated
    all over it; one of them goes on, for others to meet (all do where groups are asked for)."""
    context = large.select("anchor", "around", "often", "left", "bytes").dropDuplicates(["anchor", "around"])
    rows, out = context.withColumns({"piece": F.col("anchor"), "lo": F.lit(0), "hi": F.lit(size - K)}), []
    while True:
        cut = lambda i: (F.col("lo") + F.floor((F.col("hi") + 1 - F.col("lo")) * i / PARTS)).cast("int")
        ranges = F.array(*(F.struct(cut(i).alias("lo"), (cut(i + 1) - 1).alias("hi")) for i in range(PARTS)))
        reach = lambda left, right: (F.col("left") >= left) & (F.octet_length("bytes") - F.col("left") >= right)
        digest = lambda left, right: F.unhex(F.md5(F.substring("bytes", F.col("left") - left + 1, left + right)))
        fits = lambda p: (p["lo"] <= p["hi"]) & reach(p["lo"], size - p["hi"])
        hull = lambda p: F.when(reach(p["hi"], size - p["lo"]), digest(p["hi"], size - p["lo"]))
        parts = F.transform(F.filter(ranges, fits), lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"), digest(p["lo"], size - p["hi"]).alias("core"), hull(p).alias("hull")))
        keys = written(rows.select("piece", "anchor", "around", F.explode(parts).alias("p")).select(F.xxhash64("piece", "p.lo", "p.core").alias("piece"), "p.core", "p.hull", "anchor", "around", "p.lo", "p.hi"), "parts")
        met = keys.join(keys.groupBy("piece", "core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), ["piece", "core"])
        alike = keys.filter("hull is not null").groupBy("piece", "hull").agg(F.count(F.lit(1)).alias("equal"), F.min(F.struct("anchor", "around")).alias("one")).filter("equal > 1")
        told = written(met.join(alike, ["piece", "hull"], "left"), "shared")
        forget(keys)
        alone = F.col("lo") == F.col("hi")
        # at one place core and hull are the window
        group = told.filter(alone if repeats else F.col("equal") > 1).select("anchor", "around", F.col("hi").alias("l"), (F.lit(size) - F.col("lo")).cast("int").alias("r"), F.xxhash64("core").alias("repeat"))
        goes_on = ~alone if repeats else ~alone & (F.col("equal").isNull() | (F.struct("anchor", "around") == F.col("one")))
        left = told.filter(goes_on).select("piece", "anchor", "around", "lo", "hi")
        left = left.join(left.groupBy("piece").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "piece")
        few = left.filter(F.col("kinds") <= most).select("piece", "anchor", "around")
        out += [group, scanned(few.join(context, ["anchor", "around"]), size, repeats)]
        many = left.filter(F.col("kinds") > most).drop("kinds")
        if many.isEmpty():
            return reduce(DataFrame.unionByName, out)
        rows = many.join(context, ["anchor", "around"])


def reaches(docs: DataFrame, known: DataFrame, size: int, most: int, repeats: bool) -> DataFrame:
    """(anchor, around, l, r, repeat), written: how far the members of each anchor reach."""
    kinds = written(known.groupBy("anchor", "around").agg(F.sum("times").alias("often"), F.min(F.struct("h", "n", "pos")).alias("one")).select("anchor", "around", "often", "one.*"), "surroundings")
    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    members = kinds.join(groups, "anchor").select("anchor", "around", "often", "h", "n", "pos", "kinds")
    # a member that occurs several times is a leaf with its number; alone in its anchor, it is the whole tree
    leaves = kinds.filter("often > 1")
    if repeats:
        leaves = leaves.join(groups, "anchor", "left_anti")
    left, right = F.least("pos", F.lit(size - K)), F.least(F.col("n") - F.col("pos"), F.lit(size))
    reach = [leaves.filter(left + right >= size).select("anchor", "around", left.alias("l"), right.alias("r"), F.xxhash64("anchor", "around").alias("repeat"))]
    contexts = written(contexts_of(docs, members, size), "contexts")
    reach.append(scanned(contexts.filter(F.col("kinds") <= most), size, repeats))
    large = contexts.filter(F.col("kinds") > most)
    if not large.isEmpty():
        reach.append(dealt_again(large, size, most, repeats))
    out = written(reduce(DataFrame.unionByName, reach), "reach")
    forget(kinds, contexts)
    return out


def repeats(docs: DataFrame, size: int = 200, most: int = 20_000) -> DataFrame:
    """(h, n, spans): of each text with repeated passages, the array of (start, end) to remove, not merged."""
    known = written(all_anchors(docs, size), "anchors")
    reach = reaches(docs, known, size, most, False)
    last = F.col("pos") + (F.col("times") - 1) * F.col("step")
    spans = known.join(reach, ["anchor", "around"]).select("h", "n", (F.col("pos") - F.col("l")).alias("a"), (last + F.col("r")).alias("z"))
    out = written(spans.distinct().groupBy("h", "n").agg(F.collect_list(F.struct("a", "z")).alias("spans")), "spans")
    forget(known, reach)
    return out


def repeat_groups(docs: DataFrame, size: int = 200, most: int = 20_000) -> DataFrame:
    """(repeat, length, h, n, start): every occurrence of every maximal repeat of `size` bytes or more, a row each; repeat
    names its string by hash, h and n the text as in text_key. A repeat that is longer than an anchor's surroundings is
    given in pieces, one for each anchor in it."""
    known = written(all_anchors(docs, size), "anchors")
    reach = reaches(docs, known, size, most, True)
    at = known.join(reach, ["anchor", "around"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return at.select("repeat", (F.col("l") + F.col("r")).alias("length"), "h", "n", (F.col("pos") + F.col("i") * F.col("step") - F.col("l")).alias("start")).distinct()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def deduplicated(docs: DataFrame, size: int = 200, with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row; kept are the remaining bytes."""
    found, width = repeats(docs, size), 5 if with_bytes else 4
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b, spans in zip(batch.column(1), batch.column(2)):
                b, gone = b.as_py(), merged([(x["a"], x["z"]) for x in spans.as_py() or []])
                keep, at = [], 0
                for a, z in gone:
                    keep.append(b[at:a])
                    at = z
                left = b"".join([*keep, b[at:]])
                rows.append((len(b), len(b) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left)[:width])
            cols = list(zip(*rows)) or [()] * width
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: width + 1])

    rows = docs.select("doc_id", *text_key(), F.encode(text_of(), "UTF-8").alias("b")).join(found, ["h", "n"], "left").select("doc_id", "b", "spans")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
