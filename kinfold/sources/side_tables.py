"""Instrument files, description files, gene backgrounds and scores."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import pheno

INSTRUMENT_SUFFIXES = (".csv", ".txt")


def instrument_name(path: str) -> str:
    """File name up to its first dot."""
    return os.path.basename(path.rstrip("/")).split(".")[0]


def discover_instruments(spark: SparkSession, patterns: list[str], overrides: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Instrument files by instrument: glob patterns, directories (searched to the bottom) or files.

    ``overrides`` names the instrument of single paths. Listing goes through Spark's file index, so
    any supported file system works; only paths reach the driver.
    """
    found: dict[str, list[str]] = {}
    for pattern in patterns:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        paths = sorted(r["path"] for r in reader.load(pattern).select("path").collect())
        for path in paths:
            base = os.path.basename(path)
            if any(s in base for s in INSTRUMENT_SUFFIXES) and "." + base.split(".")[1] in INSTRUMENT_SUFFIXES:
                found.setdefault(instrument_name(path), []).append(path)
    for path, name in (overrides or {}).items():
        found.setdefault(name, []).append(path)
    return found


def read_instrument(spark: SparkSession, paths: list[str], person: str = "personId", sep: str = ",") -> DataFrame:
    """Raw text table of one instrument; for a person in several files or lines the last one wins."""
    parts = []
    for i, path in enumerate(paths):
        raw = spark.read.csv(path, sep=sep, header=True, enforceSchema=False)
        parts.append(raw.withColumnRenamed(person, "person_id").withColumn("_file", F.lit(i)).withColumn(
            "_line", F.monotonically_increasing_id()))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return pheno.last_value_per_person(stacked.filter("person_id IS NOT NULL"), ["_file", "_line"])


def read_descriptions(
    spark: SparkSession, paths: list[str], instrument: str | None = None, sep: str = "\t",
    instrument_column: str = "instrumentName", measure_column: str | None = "measureName",
    description_column: str = "description",
) -> DataFrame:
    """``(measure_id, description)``, or ``(instrument_name, description)`` without a measure column."""
    def one(path: str) -> DataFrame:
        raw = spark.read.csv(path, sep=sep, header=True, enforceSchema=False)
        name = F.lit(instrument) if instrument else F.col(instrument_column)
        if measure_column is None:
            return raw.select(name.alias("instrument_name"), F.col(description_column).alias("description"))
        return raw.select(
            F.concat_ws(".", name, F.col(measure_column)).alias("measure_id"), F.col(description_column).alias("description"))
    return reduce(DataFrame.unionByName, [one(p) for p in paths])


def read_gene_weights(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``gene, gene_weight``."""
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select(F.upper("gene").alias("gene"), F.col("gene_weight").cast("double").alias("gene_weight"))


def read_mutation_rates(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated ``gene, F, M, P_LGDS, P_MISSENSE, P_SYNONYMOUS``."""
    raw = spark.read.csv(path, header=True)
    numbers = ["F", "M", "P_LGDS", "P_MISSENSE", "P_SYNONYMOUS"]
    return raw.select("gene", *[F.col(c).cast("double").alias(c) for c in numbers])


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited text with a header, one file per partition."""
    df.write.mode("errorifexists").csv(path, sep=sep, header=True)


def gene_score_table(scores: DataFrame, score_id: str) -> DataFrame:
    """``gene`` and one score column, for download."""
    return scores.filter(F.col("score_id") == score_id).select("gene", F.col("value").alias(score_id))
