"""Mixing sources to target weights by a time-varying curriculum.

Each source has a share of all tokens and a schedule, the course of its weight over training time from 0 to 1. The integral
of the schedule is the source's cumulative token demand; inverting it at the offset of a document in its source's stream
gives the time at which the document is due. The demand of all sources up to that time is the document's training position,
and the stream is range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import column, cut, without

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more than so many times.
MOST_EPOCHS = 3
#: Courses of the weight as (time, level) knots, linear in between, repeating over the sources: falling, flat, rising.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 2.0)))
#: Hexadecimal digits of a document's hash that name its block; a stream is summed block by block.
BLOCK_DIGITS = 3


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """Start, length, level and slope of each piece, scaled so that the whole course integrates to 1."""
    area = sum((t2 - t1) * (a + b) / 2 for (t1, a), (t2, b) in zip(knots, knots[1:]))
    if knots[0][0] != 0 or knots[-1][0] != 1 or area <= 0 or any(b[0] <= a[0] or min(a[1], b[1]) < 0 for a, b in zip(knots, knots[1:])):
        raise ValueError("a schedule runs from time 0 to 1 at levels that are not negative")
    return [(t1, t2 - t1, a / area, (b - a) / area / (t2 - t1)) for (t1, a), (t2, b) in zip(knots, knots[1:])]


def demand(time: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Part of a source's tokens that its schedule asks for up to a time: the integral of its weight."""
    total = F.lit(0.0)
    for start, length, level, slope in _segments(knots):
        t = F.least(F.greatest(time - start, F.lit(0.0)), F.lit(length))
        total = total + t * (level + slope / 2 * t)
    return total


def due(part: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the demand reaches ``part``: the inverse of ``demand``."""
    reached, answer = 0.0, None
    for start, length, level, slope in _segments(knots):
        rest = F.greatest(part - reached, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(level * level) + 2 * slope * rest, F.lit(0.0)))
        time = F.least(start + F.when(rest > 0, 2 * rest / (level + root)).otherwise(0.0), F.lit(start + length))
        answer = F.when(part >= reached, time) if answer is None else F.when(part >= reached, time).otherwise(answer)
        reached += length * (level + slope * length / 2)
    return answer


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: int = MOST_EPOCHS, schedules: int = len(SCHEDULES)) -> DataFrame:
    """One row per source of ``sizes`` (source, size): rank, source_size, target and the number of its schedule.

    The sources share all tokens by weight. A target stops at ``most_epochs`` times its source's size; the excess is shared
    again by weight until none is above. One level does both: with the sources in the order in which they stop, it is what
    is left to the others per unit of their weight, at the first source that does not stop below it.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    stops = Window.orderBy("stop", "rank")
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_source) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("most", (F.col("source_size") * most_epochs).cast("double"))
        .withColumn("stop", F.col("most") / F.col("weight"))
        .withColumn("level", (
            F.sum("source_size").over(everything).cast("double")
            - F.coalesce(F.sum("most").over(stops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            / F.sum("weight").over(stops.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("level") * F.col("weight"), F.col("most")))
        .withColumn("schedule", (F.col("rank") % schedules).cast("int"))
        .select("source", "rank", "source_size", "target", "schedule"))


def _stream_columns() -> tuple[Column, Column, Column]:
    md5 = F.md5(F.coalesce(column("doc_id").cast("string"), F.lit("")))
    return F.coalesce(column("size"), F.lit(0)).cast("long"), md5, F.substring(md5, 1, BLOCK_DIGITS)


def narrow(docs: DataFrame) -> DataFrame:
    """source, block and size of every document (doc_id, source, size): what totals and offsets are summed from."""
    size, _, block = _stream_columns()
    return docs.select(column("source").alias("source"), block.alias("block"), size.alias("size"))


def plan(
        docs: DataFrame, sizes: DataFrame | None = None, weights: Sequence[float] = WEIGHTS, most_epochs: int = MOST_EPOCHS,
        schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, order: Sequence[str] = ()) -> DataFrame:
    """``docs`` (doc_id, source, size) with source_size, target, taken and occurrences (epoch, words, position).

    A source's stream is its documents in the order of the MD5 of their id, once per epoch. A document occurs in an epoch
    when its offset in the stream is below the target; ``words`` are its words up to the target, so only the last document
    of a stream counts in part and a source's words come to its target, rounded. Documents without words never occur. Equal
    ids are ordered by size and the ``order`` columns; rows equal in all of these are interchangeable. A null id or source
    is one like any other; a null size is 0. Columns with the name of a new one are replaced. ``sizes`` is ``narrow(docs)``,
    if it is at hand as a written table.
    """
    knots = [tuple(s) for s in schedules]
    docs = without(docs, "source_size", "target", "taken", "occurrences")
    size, md5, block = _stream_columns()
    rows = docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("row"), column("source").alias("source"), size.alias("size"), md5.alias("md5"),
        block.alias("block"), F.struct(md5.alias("md5"), column("doc_id"), size.alias("size"), *[column(c) for c in order]).alias("by"))
    sizes = narrow(docs) if sizes is None else sizes
    shared = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goals = targets(sizes, weights, most_epochs, len(knots))
    for k in range(len(knots)):
        goals = goals.withColumn(f"all_{k}", F.sum(F.when(F.col("schedule") == k, F.col("target")).otherwise(0.0)).over(shared))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        sizes.groupBy("source", "block").agg(F.sum("size").alias("n"))
        .select("source", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    starts = blocks.join(goals.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")), "left") \
        .withColumnRenamed("source", "start_source").withColumnRenamed("block", "start_block")
    within = Window.partitionBy("source", "block").orderBy("by").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.col("start") + F.col("ahead")
    goal = F.round("target").cast("long")

    def occurrence(epoch: Column) -> Column:
        begins = epoch * F.col("source_size") + offset
        words = F.least(F.col("size"), F.greatest(goal - begins, F.lit(0).cast("long")))
        part = F.try_divide(begins.cast("double"), "target")  # a target of 0 takes nothing
        time = None
        for k, course in enumerate(knots):
            time = F.when(F.col("schedule") == k, due(part, course)) if time is None else time.when(F.col("schedule") == k, due(part, course))
        return F.struct(epoch.cast("int").alias("epoch"), words.alias("words"), time.alias("time"))

    occurrences = F.filter(F.array(*[occurrence(F.lit(e)) for e in range(most_epochs)]), lambda o: o["words"] > 0)

    def positioned(o: Column) -> Column:
        position = F.lit(0.0)
        for k, course in enumerate(knots):
            position = position + F.col(f"all_{k}") * demand(o["time"], course)
        return F.struct(o["epoch"].alias("epoch"), o["words"].alias("words"), F.floor(position).alias("position"))

    return (
        rows.withColumn("ahead", F.sum("size").over(within) - F.col("size"))
        .join(starts, F.col("source").eqNullSafe(F.col("start_source")) & (F.col("block") == F.col("start_block")))
        .withColumn("due", occurrences)
        .withColumn("occurrences", F.transform("due", positioned))
        .select(
            "row.*", "source_size", "target",
            F.aggregate("occurrences", F.lit(0).cast("long"), lambda n, o: n + o["words"]).alias("taken"), "occurrences"))


def stream(planned: DataFrame, whole: bool = False) -> DataFrame:
    """The rows of ``plan`` once per occurrence, with epoch, words and position, range-sorted by position.

    With ``whole`` an occurrence of which less than half the words are due is left out and any other stands for the whole
    document: a document is never cut.
    """
    kept = without(planned, "occurrences", "epoch", "words", "position")
    rows = planned.select(*[column(c) for c in kept.columns], F.explode("occurrences").alias("occurrence")) \
        .select(*[column(c) for c in kept.columns], "occurrence.*")
    if whole:
        rows = rows.where(2 * F.col("words") >= F.col("size"))
    return in_order(rows, "position", "doc_id", "epoch")


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def sized(docs: DataFrame, words: Column, *keep: str) -> DataFrame:
    """Narrow rows (doc_id, source, size and ``keep``) of all documents, written once."""
    return cut(docs.select("doc_id", "source", words.alias("size"), *keep))
