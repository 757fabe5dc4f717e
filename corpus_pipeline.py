"""From raw documents to packed sequences in five stages, each on all that the one before kept.

A row is known by its id and the digest of its text, so rows with a null id or a repeated one keep verdicts of their own. Rows that
repeat both are copies, of which the near-copy stage leaves one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablero.llm import jaccard_join, packing, quality_rules, substring_dedup, toxicity
from tablero.llm.common import shipped, table, written
from tablero.llm.registry import WORDS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def named(docs: DataFrame) -> DataFrame:
    """The documents with what identifies a row."""
    return docs.withColumn("_row", F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")))


def chosen(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The named documents whose row is listed."""
    listed = rows.select(F.col("_row").alias("_listed")).distinct()
    return docs.join(listed, docs["_row"] == F.col("_listed"), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    shipped(spark)
    rows = named(docs)
    return chosen(rows, quality_rules.judged(rows, key="_row").where("kept")).drop("_row")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by a model trained on those that are left and labelled."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_of(model)("text") < toxicity.THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of at least 0.8 connect: the one with the smallest id."""
    shipped(spark)
    rows = named(docs)
    first = jaccard_join.joined(rows, key="_row").where("_row = class_id")
    return chosen(rows, first).dropDuplicates(["_row"]).drop("_row")


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur anywhere else."""
    shipped(spark)
    return substring_dedup.cleaned_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    shipped(spark)
    return packing.pack(docs, public_tokenizers.path(WORDS))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("substring dedup", unrepeated),
    ("best-fit packing", packed),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what one leaves is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs
