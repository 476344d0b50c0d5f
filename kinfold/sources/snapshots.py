"""States of a stored study: a change rewrites only the directories it touches, and one small file makes it count.

A state names the directory of the pedigree and, for the summary and the family alleles, their parts: a directory and the values of
partition columns that count no longer because a later part holds those rows. Files of earlier parts are never changed, so a run that
breaks off before its state is written changes nothing, and earlier states stay readable.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = {"pedigree": "pedigree", "summary": [{"path": "summary", "left_out": {}}], "family": [{"path": "family", "left_out": {}}]}


def commit(spark: SparkSession, path: str, state: dict, number: int) -> None:
    """State ``number`` of the study; a second run that changes the same state before it fails here."""
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/states/number={number}")


def state_of(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict]:
    """The state with the number, by default the latest."""
    states = spark.read.parquet(f"{path}/states")
    wanted = states if number is None else states.filter(F.col("number") == number)
    row = wanted.orderBy(F.desc("number")).first()
    if row is None:
        raise ValueError(f"{path} has no state {number}")
    return row["number"], json.loads(row["state"])


def rows_of(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame:
    """The rows of all parts; what a part has left out is not read."""
    return reduce(DataFrame.unionByName, [_rows_of_part(spark, path, part) for part in parts])


def _rows_of_part(spark: SparkSession, path: str, part: dict) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{part['path']}")
    if "region_bin" in rows.columns:  # directory names that read as numbers are still names
        rows = rows.withColumn("region_bin", F.col("region_bin").cast("string"))
    for column, values in part["left_out"].items():
        rows = rows.filter(~_value(column).isin(values))
    return rows


def _value(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def replaced(
    spark: SparkSession, path: str, parts: list[dict], column: str | None, values: list[str], change: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame, str], None], name: str,
) -> list[dict]:
    """The parts after the rows whose ``column`` has one of the ``values`` (all rows without a column) went through ``change`` into a new part."""
    if column is not None and not values:
        return parts
    touched = rows_of(spark, path, parts)
    fresh = change(touched if column is None else touched.filter(_value(column).isin(values)))
    kept = [] if column is None else [
        {"path": p["path"], "left_out": p["left_out"] | {column: sorted({*p["left_out"].get(column, []), *values})}} for p in parts]
    if kept and fresh.isEmpty():
        return kept
    target = f"{name}-{uuid4().hex}"
    write(fresh, f"{path}/{target}")
    return [*kept, {"path": target, "left_out": {}}]
