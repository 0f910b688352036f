"""The registered queries of the operators, one each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import chat, decontaminate, media, neardup, packing, pii, quality, secrets, spans, sql, substrings, tokens
from .common import documents, text_of, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_crf(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    model = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    return quality.score(docs, model)


def marked() -> Column:
    """A turn as raw text in one of four styles by conversation; the last has no markers, only blank lines."""
    style = F.pmod(F.xxhash64("id"), F.lit(4))
    name = lambda *n: F.when(F.col("role") == "system", n[0]).when(F.col("role") == "user", n[1]).otherwise(n[2])
    mark = F.when(style == 0, name("System: ", "User: ", "Assistant: ")).when(style == 1, name("### Instruction: ", "### Human: ", "### AI: ")).when(style == 2, name("[system]: ", "Q: ", "A: ")).otherwise("\n")
    return F.concat(mark, text_of())


def op2_chat_hmm(spark: SparkSession, d: str) -> DataFrame:
    known = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), "role", "text")
    model = chat.learn(known, marked())
    raw = known.select("id", "seq", marked().alias("text"))
    return chat.format_chats(raw, model).withColumnRenamed("id", "conv_id")


def op3_prefix_join_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.report(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def op4_pii_disclosure(spark: SparkSession, d: str) -> DataFrame:
    found = written(pii.detect(documents(spark, d).select("doc_id", "text")).select("doc_id", "base", "spans"), "pii-spans")
    sha = F.sha2(spans.joined(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *(spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS), sha.alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


def op5_token_arrow(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_files(documents(spark, d))


def op6_chosen_path_dedup(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, d), size=3, percent=85)


def shown_on_pages(shown: DataFrame, pages: DataFrame, most: int = 64) -> DataFrame:
    """(id, html): every row of shown (doc_id, digest) as a figure on some page, in front of the page's own content and
    between lines of text. Pages are dealt by hash and repeat where they would show more than about `most` figures;
    without pages, figures stand on pages of their own."""
    n = max(1, pages.count())
    parts, groups = -(-shown.count() // (n * most)) or 1, max(1, n // 16)
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    known = pages.select("page_id", group("page_id").alias("g")).withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("page_id"), "page_id")) - 1)
    sizes = known.groupBy("g").agg(F.count(F.lit(1)).alias("in_group"))
    dealt = shown.withColumn("at", F.xxhash64("doc_id", "digest")).withColumn("g", group("at")).join(sizes, "g", "left")
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("at", F.lit(1)), F.coalesce("in_group", F.lit(1)))).withColumn("part", F.pmod(F.xxhash64("at", F.lit(2)), F.lit(parts)))
    caption = F.replace(F.replace(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    figure = F.concat(F.lit("<p>figure</p><figure><img src=\"sha256:"), "digest", F.lit("\"><figcaption>"), caption, F.lit("</figcaption></figure>"))
    figures = dealt.groupBy("g", "k", "part").agg(F.array_join(F.collect_list(figure), "").alias("figures")).join(known, ["g", "k"], "left")
    return figures.join(pages.select("page_id", "html"), "page_id", "left").select(F.xxhash64("g", "k", "part").alias("id"), F.concat("figures", F.coalesce("html", F.lit(""))).alias("html"))


def op7_media_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Each document is a figure with its text as payload and its doc_id as caption, on one of the pages."""
    docs = documents(spark, d).select("doc_id", F.encode(text_of(), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    pages = shown_on_pages(docs.select("doc_id", "digest"), spark.read.parquet(f"{d}/pages.parquet"))
    found = media.resolve(pages, docs.select("digest", "payload")).filter("kind = 'media' and payload_bytes is not null")
    return found.select(F.col("caption").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_suffix_repeats(spark: SparkSession, d: str) -> DataFrame:
    return substrings.deduplicated(documents(spark, d), with_bytes=False)


def op9_secret_trigrams(spark: SparkSession, d: str) -> DataFrame:
    found = written(secrets.scan(documents(spark, d).select("doc_id", "text")).select("doc_id", "spans"), "secret-spans")
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counted = found.select("doc_id", base.alias("base"), "spans")
    sha = F.sha2(spans.joined(F.col("base")).cast("binary"), 256)
    return counted.select("doc_id", *(spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in kinds), sha.alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


def op10_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(documents(spark, d))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_crf, op2_chat_hmm, op3_prefix_join_decontamination, op4_pii_disclosure, op5_token_arrow, op6_chosen_path_dedup, op7_media_sequence, op8_suffix_repeats, op9_secret_trigrams, op10_best_fit_packing)}
#: op1 and op2 are trained models, op5 and op10 a tokenizer's ids.
SQL: dict[str, str] = {
    "op3_prefix_join_decontamination": sql.DECONTAMINATION,
    "op4_pii_disclosure": sql.PII,
    "op6_chosen_path_dedup": sql.NEAR_DUPLICATES,
    "op7_media_sequence": sql.MEDIA,
    "op8_suffix_repeats": sql.REPEATS,
    "op9_secret_trigrams": sql.SECRETS,
}
