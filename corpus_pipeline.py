"""From raw documents to packed sequences: language ID, quality, near duplicates, packing.

Each stage is written to the shared folder and read again as the next one's documents.

Defined results: a row is judged by itself, so rows with one id or none are kept or go each for itself.  A null or empty text
has no language and goes in the first stage; a null lang is a language of its own (`und`) in the second.  Of rows that are
the same in id and text one stays in the third stage, as of near duplicates the smallest id; a row without an id stays
there.  Equal sizes of two languages reject; an empty table gives none.  Other columns are passed on as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflow.llm import kneserney, langid, packing, simhash
from gridflow.llm.common import bounded_batches, materialise
from gridflow.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; the model comes from the labelled languages of all documents."""
    bounded_batches(spark)
    return langid.accepted(docs, langid.fit(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's perplexity threshold."""
    bounded_batches(spark)
    scored = kneserney.classify(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    rejected = materialise(scored.where("not keep").select(F.col("doc_id").alias("id_"), F.col("lang").alias("lang_"), F.col("text_hash").alias("hash_")).distinct(), "rejected")
    if rejected.count() <= simhash.MOST_BROADCAST:  # an id and a hash each; then no text is moved
        rejected = F.broadcast(rejected)
    gone = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.coalesce("lang", F.lit("und")) == F.col("lang_")) & (F.xxhash64("text") == F.col("hash_"))
    return docs.join(rejected, gone, "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates over five-word shingles."""
    bounded_batches(spark)
    return simhash.first_of_each(docs, simhash.near_classes(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path(packing.TOKENIZER))


STAGES: list[tuple[str, Stage]] = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", sequences)]

#: None: none of the stages can be put in SQL; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
