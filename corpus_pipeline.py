"""Stages of the corpus pipeline, each over all that its predecessor kept.

Toxic documents go; of near-duplicates one stays; passages that repeat are removed from the texts; the sources are mixed to
their target weights, which repeats some documents and leaves others out; what is left is encoded to pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import curriculum, radix_windows, sentencepiece_trie, simhash_gray, toxicity_ordinal
from kinfold.llm.common import column, cut, table, words_in

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _like(docs: DataFrame, result: DataFrame) -> DataFrame:
    return result.select(*[column(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on their labels, does not reject."""
    scored = toxicity_ordinal.graded(docs, table(spark, sf_dir, "labels"))
    return _like(docs, scored.where(~F.col("rejected")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return _like(docs, simhash_gray.survivors(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the passages that repeat; n_chars follows the text. A null text becomes empty."""
    stripped = radix_windows.strip(docs)
    return _like(docs, stripped.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by their training position."""
    sized = docs.withColumn("size", words_in(F.col("text")))
    planned = curriculum.plan(sized, cut(curriculum.narrow(sized)))
    return _like(docs, curriculum.stream(planned, whole=True))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces in place of the text."""
    return sentencepiece_trie.tokenized(docs, keep_text=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources), ("pieces", encode_pieces)]
#: Models, fingerprints and tokenizers are no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
