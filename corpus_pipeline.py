"""The corpus pipeline: from documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Rows, in every stage: extra columns of any name pass through; a null doc_id is a value like others; rows of one doc_id
are told apart by their texts; an empty table, or one that a stage leaves empty, gives an empty one with its columns.
Empty labels give every document one score, an empty benchmark drops nothing. What a stage makes of null and empty texts,
of ties and of repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import decontaminate, neardup, packing, pii, quality
from timberline.llm.common import documents, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more. A null text is scored as an empty one; equal texts have equal
    scores, so repeated rows stay or go together; a score of exactly 0.7 stays."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, 0.7)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more (exactly 0.8 is a
    link). The least doc_id stays, of equal ones the least text by hash, of equal rows one; rows without a doc_id come
    last. Texts without words are like no other: they stay, but for rows that repeat one."""
    return neardup.keep_one(docs, size=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of 13 words of a benchmark item, or no whole shorter item. Null and empty texts have
    no words and stay; repeated rows stay or go together; an item without item_id or words has no window."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal them are replaced in the text; every row stays, and n_chars follows the
    text. A null text stays null; copies count once in the statistics and are all replaced alike."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 2048 ids. A null or empty text is its end id alone;
    repeated rows are packed each; no documents make no sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicate removal", distinct_enough),
    ("benchmark decontamination", uncontaminated),
    ("personal data", sanitised),
    ("best-fit packing", packed),
]

#: The first stage is a trained model and the last a packing plan, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
