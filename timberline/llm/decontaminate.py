"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is 13 consecutive words of an item, or a whole shorter item. It is the set of its shingles of three words with
their places. Shingles are ordered by how rare they are in the documents; to be contained, a window must share its
rarest one, so this necessary prefix of one shingle alone joins. Candidates must lie inside the document by their
place and length; then all shingles of the window must stand at their places, and their words are compared, not hashes.

Documents are known by the md5 of their text, so copies are matched once and every row gets its result. Shingles of the
items are broadcast only up to `broadcast_rows`; beyond, the join shuffles.

Rows: null and empty texts have no words and no hits; items without words have no window; repeated items count once per
item_id, a null item_id has no name and isn't counted; repeated rows and null doc_ids keep a row each; empty tables
give no hits or no rows; only doc_id, text and item_id are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import OWN, lower_ascii, text_of, written

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def windows_of(items: DataFrame, size: int, shingle: int) -> DataFrame:
    """(window, item_id, n, words): each distinct window of each item; n is its number of words."""
    w = items.select("item_id", words(text_of()).alias("w")).filter(F.size("w") > 0).filter("item_id is not null")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))
    each = w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("words"))
    return each.select(F.md5(F.concat_ws(" ", "words")).alias("window"), "item_id", F.size("words").alias("n"), "words").distinct()


def shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, n, k, place, shingle): k words from each place of each distinct window."""
    one = windows.dropDuplicates(["window"]).withColumn("k", F.least("n", F.lit(shingle)))
    return one.select("window", "n", "k", F.explode(F.expr("sequence(0, n - k)")).alias("place"), "words").select("window", "n", "k", "place", F.expr("slice(words, place + 1, k)").alias("shingle"))


def matches(docs: DataFrame, known: DataFrame, sizes: list[int], broadcast: bool) -> DataFrame:
    """(text_key, n_words, pos, shingle): where item shingles stand in documents, each place of a text once."""
    w = docs.select(F.md5(text_of()).alias("text_key"), words(text_of()).alias("w"))
    by_size = [F.expr(f"case when size(w) >= {k} then transform(sequence(0, size(w) - {k}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(k))})) else cast(array() as array<bigint>) end") for k in sizes]
    out = None
    for k, hashes in zip(sizes, by_size):
        mine = known.filter(F.col("k") == k).select("h", "shingle")
        rows = w.select("text_key", "w", F.posexplode(hashes).alias("pos", "h"))
        here = F.slice("w", F.col("pos") + 1, k)
        if broadcast:
            met = rows.join(F.broadcast(mine), "h").filter(here == F.col("shingle")).select("text_key", F.size("w").alias("n_words"), "pos", "shingle")
        else:
            met = rows.select("text_key", F.size("w").alias("n_words"), "pos", "h", here.alias("here")).join(mine, "h").filter("here = shingle").select("text_key", "n_words", "pos", "shingle")
        out = met if out is None else out.unionByName(met)
    return out.distinct()


def hits(docs: DataFrame, items: DataFrame, size: int = 13, shingle: int = 3, broadcast_rows: int = 500_000) -> DataFrame:
    """(text_key, n_hit, n_items, items) of the texts that hold a window; items is the sorted array of item_ids."""
    windows = written(windows_of(items, size, shingle), "windows")
    parts = shingles_of(windows, shingle)
    known = parts.select("k", "shingle").distinct().withColumn("h", F.expr("case k " + " ".join(f"when {k} then xxhash64({', '.join(f'shingle[{j}]' for j in range(k))})" for k in range(1, shingle + 1)) + " end"))
    sizes = {r.k: r.n for r in known.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # `shingle` rows at most
    if not sizes:
        sizes = {shingle: 0}
    met = written(matches(docs, known, sorted(sizes), sum(sizes.values()) <= broadcast_rows), "matches")
    rarity = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    ranked = parts.join(rarity, "shingle", "left")
    prefix = ranked.groupBy("window", "n", "k").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shingle", "place")).alias("rarest")).filter("rarest.often > 0").select("window", "n", "k", F.col("rarest.shingle").alias("shingle"), F.col("rarest.place").alias("place"))
    candidates = met.join(prefix, "shingle").withColumn("start", F.col("pos") - F.col("place")).filter("start >= 0 and start + n <= n_words").select("text_key", "start", "window", "n", "k")
    asked = candidates.join(parts.select("window", "place", "shingle"), "window").withColumn("pos", F.col("start") + F.col("place"))
    held = asked.join(met.select("text_key", "pos", "shingle"), ["text_key", "pos", "shingle"]).groupBy("text_key", "start", "window", "n", "k").agg(F.count(F.lit(1)).alias("have")).filter("have = n - k + 1").select("text_key", "start", "window", "n")
    found = written(held, "windows-found")
    covered = found.select("text_key", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos")).distinct().groupBy("text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("text_key", "window").distinct().join(windows.select("window", F.col("item_id").cast("string").alias("item_id")), "window").groupBy("text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return covered.join(named, "text_key").select("text_key", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def decided(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    found = written(hits(docs, items, **options), "hits")
    rows = docs.select("doc_id", F.md5(text_of()).alias("text_key"), F.size(words(text_of())).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(found, "text_key", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), decided(n_hit, F.col("n_words")).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no window of any item, with all their columns: nothing of the benchmark is trained on,
    also where a long text makes its share small. The share in `decided` is a report's mark, not a licence to keep."""
    key = f"{OWN}key"
    found = written(hits(docs, items, **options).select(F.col("text_key").alias(key)), "hits")
    return docs.withColumn(key, F.md5(text_of())).join(found, key, "left_anti").select(*docs.columns)
