"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import cut, merged


def stars(edges: DataFrame, few: int = 0) -> DataFrame:
    """Every node of ``edges`` (a, b) that is not the smallest of its component, as (node, root).

    Large and small stars alternate: first the larger neighbours of every node, then the smaller ones and the node itself,
    are linked to the smallest of the neighbourhood. Both are a minimum per node, combined before the shuffle, and a join
    that can split a node with very many neighbours. Each round is written; the rounds end when one changes nothing, after
    a number that grows with the logarithm of the nodes. While there are at most ``few`` links, which are counted in every
    round, one task takes them, without a shuffle. Without ``few`` nothing is broadcast.
    """
    links = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    state = _state(links)
    while state[0]:
        is_few = state[0] <= few
        beside = F.broadcast if is_few else (lambda minima: minima) if few else merged
        sides = F.array(F.struct("node", "root"), F.struct(F.col("root").alias("node"), F.col("node").alias("root")))
        both = (links.coalesce(1) if is_few else links).select(F.inline(sides))
        lowest = both.groupBy("node").agg(F.min("root").alias("low"))
        large = (
            both.join(beside(lowest), "node").where(F.col("root") > F.col("node"))
            .select(F.col("root").alias("node"), F.least("low", "node").alias("root")))
        if not is_few:
            large = large.distinct()
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(beside(low), "node").select(F.explode(F.array("node", "root")).alias("node"), F.col("low").alias("root"))
        links = cut(small.where(F.col("node") != F.col("root")).distinct())
        before, state = state, _state(links)
        if state == before:
            break
    return links


def moved(rooted: DataFrame, roots: DataFrame, few: int) -> DataFrame:
    """``rooted`` (… root) with the roots that the written ``roots`` (node, root) give to its roots; at most ``few`` of them are broadcast."""
    new = roots.select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    new = F.broadcast(new) if new.count() <= few else new
    return rooted.join(new, "root", "left").withColumn("root", F.coalesce("new_root", "root")).drop("new_root")


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("node", "root").cast("decimal(20,0)")), F.lit(0))).first()
    return row[0], int(row[1])
