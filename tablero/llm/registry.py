"""The queries of this package by key, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablero.llm import (
    alignment, bpe, chat_format, html_text, jaccard_join, line_dedup, packing, pivot_search, quality_rules, spelling, substring_dedup, toxicity,
    training_order,
)
from tablero.llm.common import shared_dir, table

#: The vocabulary of the packed and ordered sequences.
WORDS = "word_bpe_49k.json"
SEED = 20_240_125

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.collapsed(table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.RANKS))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extracted(pages, html_text.model(pages))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(table(spark, sf_dir, "documents"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return training_order.shards(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), SEED, folder)


def op10_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in (alignment.BYTE_BPE, alignment.PIECES)]
    return alignment.aligned(table(spark, sf_dir, "documents"), *paths, spell=False)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_toxicity, op2_chat_format, op3_packing, op4_jaccard_join, op5_bpe, op6_html_text, op7_quality_rules, op8_substring_dedup, op9_training_order,
    op10_pivot_search, op11_token_alignment, op12_spelling_variants, op13_line_dedup)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.SQL, "op10_pivot_search": pivot_search.SQL, "op13_line_dedup": line_dedup.SQL}
