"""Near-duplicate texts: a chosen-path set similarity join over minwise sketches, then components of the links.

Equal shingle sets are one record. In each of several independent trees, a node branches its records by the minwise
tokens at a few positions that the node's own path selects, until the node is small; then its records are compared
exhaustively by sketch. Candidates are confirmed on the full shingle sets.

Only links that join components are needed: each record first keeps its best earlier partner alone, so there is at most
one candidate per record. After these are confirmed, a second comparison marks the records of each node that have a
candidate in another component; their full sets meet in the node, are compared exactly, and links that join components
come out. Pairs never leave a task. Nodes that stay large at the last level are cut into blocks that share a few pivots:
a cluster of any number of near copies is joined by these, with as many rows as records. For the second comparison only
records with different labels need to meet there; where they are few, they are put before each block of the largest
label, and where they are many, the node branches on. Components come from alternating large-star and small-star steps on the cluster.

Of a pair at the similarity bound s, a selected position keeps it together with probability s. A root selects two
positions, any other node 1 / s of them on average (one, and by its hash a second), so that a pair's expected number of
common paths doesn't fall with depth; six trees miss a pair about once in ten thousand at the last level, and far less
often above it. The sketch test lies 4.5 standard deviations below the bound.

Rows: texts without words (null, empty, white space) link with nothing; repeated rows have one set; rows that share a
doc_id are told apart by their sets, and keep_one by their texts; a row without doc_id has a null component, and
keep_one keeps it only where its group has no other row before it; an empty table gives an empty one; only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.graph import components
from .common import OWN, forget, lower_ascii, ship, text_of, written

TREES, BRANCH, DEPTH, LEAF, BLOCK = 6, 2, 4, 1000, 500
PIVOTS, LEVELS, SHINGLES = 16, 32, 4_000_000
BROADCAST_ROWS = 500_000
PERMUTATIONS = 128
SPACE = r"[\x20\x09-\x0D]+"
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def text_key() -> Column:
    return F.unhex(F.md5(text_of()))


def with_sets(docs: DataFrame, size: int, text: str = "text", to: str = "set") -> DataFrame:
    """docs with the distinct hashes of its shingles of `size` words, of all words if they are fewer; sorted, empty
    without words."""
    w = docs.withColumn("_w", F.array_remove(F.split(lower_ascii(text_of(text)), SPACE), ""))
    args = ", ".join(f"_w[i + {j}]" for j in range(size))
    hashes = f"case when size(_w) >= {size} then transform(sequence(0, size(_w) - {size}), i -> xxhash64({args})) when size(_w) > 0 then array(xxhash64(concat_ws(' ', _w))) else cast(array() as array<bigint>) end"
    return w.withColumn(to, F.sort_array(F.array_distinct(F.expr(hashes)))).drop("_w")


def constants(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 1 << 63, n, np.uint64) * 2 + 1, r.integers(0, 1 << 63, n, np.uint64)


def sketch(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minwise values of each set under each permutation. Sets must not be empty."""
    a, b = constants(PERMUTATIONS)
    base = values.view(np.uint64)
    base = (base ^ (base >> np.uint64(32))) * MIX[0]
    out = np.empty((len(first) - 1, PERMUTATIONS), np.uint16)
    for i in range(PERMUTATIONS):
        h = (base * a[i] + b[i]) >> np.uint64(16)
        low = np.minimum.reduceat(h, first[:-1])
        out[:, i] = ((low * MIX[1]) >> np.uint64(40)).astype(np.uint16)
    return out


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n, key, sketch, small) of every row; key identifies the set, null without words."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = part.column(2)
                n = np.asarray(sets.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                values = sets.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
                some = n > 0
                first = np.concatenate([[0], np.cumsum(n[some])])
                keys, sketches, small = (np.full(len(n), None, object) for _ in range(3))
                if some.any():
                    sk = sketch(values, first)
                    keys[some] = [hashlib.blake2b(values[a:z].tobytes(), digest_size=16).digest() for a, z in zip(first[:-1], first[1:])]
                    sketches[some] = [r.tobytes() for r in sk]
                    small[some] = [r.tobytes() for r in (sk & 255).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(small, pa.binary())], names=["doc_id", "text_key", "n", "key", "sketch", "small"])

    rows = with_sets(docs.select("doc_id", "text"), size).select("doc_id", text_key().alias("text_key"), "set")
    return rows.mapInArrow(run, f"doc_id {kind}, text_key binary, n long, key binary, sketch binary, small binary")


def chosen(node: Column, level: int, share: float) -> list[Column]:
    """The positions that a node selects: functions of its path alone, the last of them null in some nodes below roots."""
    at = [F.pmod(F.xxhash64(node, F.lit(level), F.lit(i)), F.lit(PERMUTATIONS)).cast("int") for i in range(BRANCH)]
    extra = F.pmod(F.xxhash64(node, F.lit(-1)), F.lit(1000)) < int(1000 * (1 / share - 1))
    return at if level == 0 else [at[0], F.when(extra, at[1])]


def branched(rows: DataFrame, level: int, share: float) -> DataFrame:
    """(node, key, sketch) -> the children's rows: the path grows by the position and the token there."""
    token = lambda p: F.substring(F.col("sketch"), p * 2 + 1, 2)
    kids = F.array(*[F.when(p.isNotNull(), F.xxhash64(F.col("node"), p, token(p))) for p in chosen(F.col("node"), level, share)])
    return rows.select(F.explode(F.array_distinct(F.array_compact(kids))).alias("node"), "key", "sketch")


def leaves(records: DataFrame, share: float) -> tuple[DataFrame, DataFrame | None]:
    """(node, key), written: each record once per small node that it falls into; nodes of one record are left out. Large
    nodes branch again; at the last level they are cut into blocks, and given as a second table (node, key)."""
    roots = records.select(F.explode(F.array(*[F.lit(t).cast("long") for t in range(TREES)])).alias("node"), "key", "sketch")
    grown, done, made, hot = branched(roots, 0, share).select("node", "key"), None, [], None
    sketches = records.select("key", "sketch")
    for level in range(1, DEPTH + 1):
        here = written(grown, f"level-{level}")
        count = here.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
        small = here.join(count.filter(f"_n between 2 and {LEAF}").select("node"), "node", "left_semi")
        done = small if done is None else done.unionByName(small)
        large = written(count.filter(f"_n > {LEAF}"), "large")
        made += [here, large]
        if large.isEmpty():
            break
        rest = here.join(large, "node").select("node", "key", "_n")
        if level < DEPTH:
            grown = branched(rest.join(sketches, "key"), level, share).select("node", "key")
    else:
        hot = written(rest, "hot")
        done = done.unionByName(with_pivots(hot))
    out = written(done, "nodes")
    forget(*made)
    return out, hot


def with_pivots(rest: DataFrame) -> DataFrame:
    """(node, key) of large nodes (node, key, _n), as blocks of about BLOCK records and the same few PIVOTS in each: records
    of one large cluster meet its pivots, whatever block they are in. As many rows as records, and a few more."""
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    own = rest.select(F.xxhash64("node", F.pmod(F.xxhash64("key"), blocks)).alias("node"), "key")
    first = rest.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("key"), "key"))).filter(F.col("_r") <= PIVOTS)
    spread = first.select("node", "key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b")).select(F.xxhash64("node", F.col("b")).alias("node"), "key")
    return own.unionByName(spread).distinct()


def unjoined(hot: DataFrame, label: DataFrame, sketches: DataFrame, share: float) -> DataFrame:
    """(node, key): of large nodes what the first comparison has left, so that records with different labels meet. A node of
    one label is done. Where all but LEAF records have one label, blocks of these meet all others; where more have others,
    the node branches on, as its records are no longer alike."""
    now, out = hot.select("node", "key"), []
    for level in range(DEPTH, LEVELS):
        told = written(now.join(label, "key", "left").select("node", "key", F.coalesce("label", "key").alias("label")), "told")
        per = told.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("label", "c").alias("main")).filter("most < n")
        rows = told.join(per, "node")
        small, rest = F.col("n") <= LEAF, F.col("n") - F.col("most") <= LEAF
        blocks = F.ceil(F.col("most") / BLOCK).cast("int")
        where = F.when(F.col("label") == F.col("main"), F.array(F.pmod(F.xxhash64("key"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
        meet = rows.filter(~small & rest).select("node", "key", F.explode(where).alias("b")).select(F.xxhash64("node", F.lit(level), F.col("b")).alias("node"), "key")
        out.append(written(rows.filter(small).select(F.xxhash64("node", F.lit(level), F.lit(-1)).alias("node"), "key").unionByName(meet), "meeting"))
        large = written(rows.filter(~small & ~rest).select("node", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("_m")), "large")
        forget(told)
        if large.isEmpty():
            break
        now = branched(large.join(sketches, "key"), level, share).select("node", "key")
    else:  # thousands of equal sketches of different labels: pairs of blocks lose none of them
        out.append(written(in_blocks(large), "meeting"))
    return reduce(DataFrame.unionByName, out)


def in_blocks(rest: DataFrame) -> DataFrame:
    """(node, key) of nodes (node, key, _m), as nodes of two of their _m blocks each."""
    blocks = rest.withColumn("_b", F.pmod(F.xxhash64("key"), F.col("_m")).cast("int"))
    pairs = blocks.select("key", "node", "_b", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_o"))
    split = pairs.select(F.xxhash64("node", F.least("_b", "_o"), F.greatest("_b", "_o")).alias("node"), "key")
    return split.distinct()


def compared(rows: DataFrame, least: int, ratio: float, labelled: bool) -> DataFrame:
    """(node, a, b, same) of each record a with a candidate in its node; rows (node, key, n, small[, label]), small: the
    low bytes of the sketch. b is its best earlier partner, with `same` equal positions, or null if all came later. With
    labels, only candidates of another label count."""
    ship(rows.sparkSession)

    def pairs(keys: np.ndarray, n: np.ndarray, sk: np.ndarray, lab: np.ndarray, starts: np.ndarray) -> tuple:
        """Of whole nodes in order, each row against the rows before it; starts: the first row of its node."""
        best, who = np.zeros(len(keys), np.int16), np.full(len(keys), -1)
        met = np.zeros(len(keys), bool)
        i, lag = np.arange(len(keys)), 0
        while len(i):
            lag += 1
            i = i[i - lag >= starts[i]]
            for c in range(0, len(i), 50_000):
                j = i[c : c + 50_000]
                o = j - lag
                ok = np.minimum(n[j], n[o]) >= ratio * np.maximum(n[j], n[o])
                if labelled:
                    ok &= lab[j] != lab[o]
                j, o = j[ok], o[ok]
                same = (sk[j] == sk[o]).sum(1, dtype=np.int16)
                hit = same >= least
                j, o, same = j[hit], o[hit], same[hit]
                met[j] = met[o] = True
                up = same > best[j]
                best[j[up]], who[j[up]] = same[up], o[up]
        return best, who, met

    def done(nodes: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(nodes):
            new = np.concatenate([[True], nodes[1:] != nodes[:-1]])
            starts = np.maximum.accumulate(np.where(new, np.arange(len(nodes)), 0))
            best, who, met = pairs(*columns, starts)
            j = np.flatnonzero(met)
            if len(j):
                partner = [k if w >= 0 else None for k, w in zip(columns[0][who[j]].tolist(), who[j].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[j]), pa.array(columns[0][j].tolist(), pa.binary()), pa.array(partner, pa.binary()), pa.array(best[j].astype(np.int32))], names=["node", "a", "b", "same"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = lambda c, kind: np.frombuffer(b"".join(c.to_pylist()), kind)
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            lab = fixed(b.column(4), "<u8").reshape(-1, 2)[:, 0] if labelled else np.zeros(b.num_rows, np.uint64)
            part = (b.column(0).to_numpy(), fixed(b.column(1), "V16"), b.column(2).to_numpy(), fixed(b.column(3), np.uint8).reshape(-1, PERMUTATIONS), lab)
            held = part if held is None else tuple(np.concatenate(x) for x in zip(held, part))
            before = np.flatnonzero(held[0] != held[0][-1])  # the last node may go on
            z = int(before[-1]) + 1 if len(before) else 0
            yield from done(*(x[:z] for x in held))
            held = tuple(x[z:] for x in held)
        if held is not None:
            yield from done(*held)

    columns = ["node", "key", "n", "small"] + ["label"] * labelled
    return rows.select(*columns).repartition("node").sortWithinPartitions("node", "key").mapInArrow(run, "node long, a binary, b binary, same int")


def texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, text) for needed (key, text_key). Up to BROADCAST_ROWS keys are broadcast to spare other texts the move."""
    own = docs.select(text_key().alias("text_key"), text_of().alias("text"))
    if needed.count() <= BROADCAST_ROWS:
        own = own.join(F.broadcast(needed.select("text_key")), "text_key", "left_semi")
    return own.join(needed, "text_key").select("key", "text").dropDuplicates(["key"])


def confirmed(pairs: DataFrame, docs: DataFrame, records: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union. Texts of the records in pairs are moved, and
    both sets are made where they meet."""
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    needed = written(records.join(ends, "key", "left_semi").select("key", "text_key"), "needed")
    texts = written(texts_of(docs, needed), "texts")
    one = pairs.select("a", "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    sets = with_sets(with_sets(both, size, "text_a", "set_a"), size, "text_b", "set_b")
    shared = sets.select("a", "b", F.size("set_a").alias("na"), F.size("set_b").alias("nb"), F.size(F.array_intersect("set_a", "set_b")).alias("shared"))
    sizes = written(shared, "compared")  # a filter above would be pushed below and make the sets again
    forget(needed, texts)
    return sizes.filter(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of incidence columns, a few thousand values at a time."""
    values, which = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = np.bincount(which) > 1
    number = np.cumsum(shared) - 1
    ok = shared[which]
    row, col = row[ok], number[which[ok]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for c in range(0, int(shared.sum()), 4096):
        i, z = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[i:z], col[i:z] - c] = 1
        out += m @ m.T
    return out.astype(np.int64)


def joined_in_nodes(marked: DataFrame, docs: DataFrame, records: DataFrame, label: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join different labels; marked (node, a): the records to compare in each node. A node whose sets
    come to more than SHINGLES values is compared as pairs of smaller blocks, so a task holds few long texts."""
    ship(docs.sparkSession)
    sized = written(marked.select("node", F.col("a").alias("key")).join(records.select("key", "n"), "key"), "sized")
    weights = sized.groupBy("node").agg(F.sum("n").alias("all"))
    heavy = sized.join(weights.filter(F.col("all") > SHINGLES), "node").select("node", "key", F.ceil(2 * F.col("all") / SHINGLES).cast("int").alias("_m"))
    meeting = sized.join(weights.filter(F.col("all") <= SHINGLES), "node", "left_semi").select("node", "key").unionByName(in_blocks(heavy))
    needed = written(records.join(sized.select("key").distinct(), "key", "left_semi").select("key", "text_key"), "needed")
    named = texts_of(docs, needed).join(label, "key", "left").select("key", "text", F.coalesce("label", "key").alias("label"))
    rows = meeting.join(named, "key").repartition("node")
    sets = with_sets(rows, size).select("node", "key", "label", "set").sortWithinPartitions("node", "key")

    def links(keys: list, labels: list, found: list[np.ndarray]) -> list[tuple]:
        n = np.array([len(x) for x in found])
        both = intersections(found)
        _, code = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)
        i, j = np.nonzero(np.triu((100 * both >= percent * (n[:, None] + n[None] - both)) & (code[:, None] != code[None]), 1))
        root, out = list(range(int(code.max()) + 1)), []
        _, first = np.unique(code[i] * len(root) + code[j], return_index=True)
        for x, y in zip(i[first].tolist(), j[first].tolist()):
            a, b = code[x], code[y]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((keys[x], keys[y]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, labels, found = None, [], [], []
        for b in batches:
            out = []
            flat, at = b.column(3).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(b.column(3).value_lengths().to_numpy(zero_copy_only=False))])
            for i, (node, key, lab) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
                if node != now:
                    out += links(keys, labels, found) if len(keys) > 1 else []
                    now, keys, labels, found = node, [], [], []
                keys.append(key)
                labels.append(lab)
                found.append(flat[at[i] : at[i + 1]].copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])
        out = links(keys, labels, found) if len(keys) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    return written(sets.mapInArrow(run, "a binary, b binary"), "more-links")


def labelled(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept, chosen) of every row; chosen: the least row of its component by
    doc_id and text, with any that repeat it, or a row without words."""
    rows = written(sketched(docs, size), "sketches")
    named = written(rows.select("doc_id", "text_key", "n", "key"), "rows")
    records = written(rows.filter("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("small").alias("small"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one")).select("key", "n", "sketch", "small", "one", "one.text_key"), "records")
    forget(rows)
    share = percent / 100
    least = int(PERMUTATIONS * share - 4.5 * (PERMUTATIONS * share * (1 - share)) ** 0.5)
    nodes, hot = leaves(records.select("key", "sketch"), share)
    met = written(compared(nodes.join(records.select("key", "n", "small"), "key"), least, share, False), "met")
    forget(nodes)
    best = written(met.filter("b is not null").groupBy("a").agg(F.max_by("b", "same").alias("b")), "best")
    links = confirmed(best, docs, records, size, percent)
    forget(best)
    label = written(components(links), "labels")
    again = met.select("node", F.col("a").alias("key"))
    if hot is not None:
        again = again.unionByName(unjoined(hot, label, records.select("key", "sketch"), share))
    told = again.join(records.select("key", "n", "small"), "key").join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    marked = written(compared(told, least, share, True).select("node", "a"), "marked")
    forget(met, *([hot] if hot is not None else []))
    if not marked.isEmpty():
        more = joined_in_nodes(marked, docs, records, label, size, percent)
        forget(marked, label)
        label = written(components(links.unionByName(more)), "labels")
    roots = records.select("key", "one").join(label, "key", "left").select("key", "one", F.coalesce("label", "key").alias("root"))
    first = roots.groupBy("root").agg(F.min("one").alias("first"))
    of = written(roots.join(first, "root").select("key", "first"), "components")
    forget(records, label)
    named = named.join(of, "key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id")))
    chosen_ = F.col("key").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    return named.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), chosen_.alias("chosen"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: component_id is the least doc_id reachable."""
    return labelled(docs, size, percent).drop("text_key", "chosen")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs per component, with all columns: the least by doc_id and text, so that rows which share a doc_id but
    not their text stay apart. Of rows equal in both, one stays; rows without words stay unless they are so repeated. Up
    to BROADCAST_ROWS removed rows are broadcast; beyond, texts move once."""
    key, own = f"{OWN}key", f"{OWN}id"
    told = labelled(docs.select("doc_id", "text"), size, percent).groupBy(F.col("doc_id").alias(own), F.col("text_key").alias(key)).agg(F.max("chosen").alias("chosen"), F.count(F.lit(1)).alias("often")).filter("not chosen or often > 1")
    told = written(told, "removed")

    def meeting(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        if other.count() <= BROADCAST_ROWS:
            other = F.broadcast(other)
        return rows.join(other, (rows[key] == other[key]) & rows["doc_id"].eqNullSafe(other[own]), how)

    kept = meeting(docs.withColumn(key, text_key()), told.select(own, key), "left_anti").select(*docs.columns)
    again = told.filter("chosen").select(own, key)
    if not again.isEmpty():
        kept = kept.unionByName(meeting(docs.withColumn(key, text_key()), again, "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns))
    return kept
