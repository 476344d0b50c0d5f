"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinfold.session import scratch_dir, written

#: A word is a run of anything but the space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: a lost executor costs no recomputation before it."""
    return written(df, scratch_dir(df.sparkSession))


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges both. Spark's guess of a table's size is that of its compressed files, or less, and
    what it would have the driver build and broadcast for it can be twenty times as large."""
    return df.hint("merge")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names, in any case, are about to be given to new ones."""
    taken = {n.lower() for n in names}
    return df.select(*[column(c) for c in df.columns if c.lower() not in taken])


def column(name: str) -> Column:
    """The column called exactly ``name``, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8_size(text: Column) -> Column:
    """Bytes of the text in UTF-8; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def words_in(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The record batches cut into runs of rows with about ``most_bytes`` of text, at least one row each.

    What a task holds in arrays then depends on one long row at most, not on the batch size.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if i > first and held + n > most_bytes:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        yield batch.slice(first)


def arrow_type(kind: T.DataType) -> pa.DataType:
    return to_arrow_type(kind)


def batch_of(columns: dict[str, Any], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the named columns in the order of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)
