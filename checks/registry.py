"""Registered queries: a Spark callable and, where SQL can state it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base_sql import sql as with_base

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: widened(function(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_base(sql) if base else sql.strip()
        return function
    return keep


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and real numbers as DOUBLE, as the SQL side states them."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long")
        elif isinstance(field.dataType, (T.FloatType, T.DecimalType)):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)
