"""Sharding by a weighted hash tree.

Shards hang under racks, racks under regions. A key descends region, rack and shard; at each level every child draws an
exponential waiting time from the key's hash at the rate of its weight and the earliest child wins. A child's draw depends on
nothing but the key, its name and its weight, so a changed weight moves keys only into or out of the subtrees above it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import column, without

#: Parts into which the rows of a shard are dealt to be numbered, so that no task numbers a whole shard.
BLOCKS = 1024


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def layout(shards: int, racks_per_region: int = 4, shards_per_rack: int = 5) -> list[Shard]:
    """``shards`` equal shards, filled rack by rack and region by region."""
    per_region = racks_per_region * shards_per_rack
    return [
        Shard(f"region{n // per_region}", f"rack{n % per_region // shards_per_rack}", n) for n in range(shards)]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` and one more shard in a region of its own.

    All other draws are unchanged, so every row that moves goes into the new shard. A shard added to an existing rack would
    pull rows into that rack's region, but there they may also land on its old shards.
    """
    number = max((s.number for s in tree), default=-1) + 1
    return [*tree, Shard(f"region-of-{number}", "rack0", number, weight)]


def shard_of(key: Sequence[Column], tree: Sequence[Shard]) -> Column:
    """Number of the shard a key descends to. Shards of weight 0 or less take nothing."""
    children: dict[str, dict[str, float]] = {}
    numbers = {}
    for s in tree:
        if s.weight > 0:
            path = [s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.number}"]
            for parent, child in zip(["", *path], path):
                below = children.setdefault(parent, {})
                below[child] = below.get(child, 0.0) + s.weight
            numbers[path[-1]] = s.number
    if not numbers:
        raise ValueError("no shard has a weight")
    nodes = F.create_map(*[x for parent, below in children.items() for x in (
        F.lit(parent), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in below.items()]))])

    def waiting(node: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(node["name"], *key), 11).cast("double") + 0.5) * 2.0 ** -53
        return F.struct((-F.log(draw) / node["weight"]).alias("at"), node["name"].alias("name"))

    chosen = F.lit("")
    for _ in ("region", "rack", "shard"):  # equal draws go to the smaller name
        chosen = F.array_min(F.transform(F.element_at(nodes, chosen), waiting))["name"]
    return F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), chosen)


def place(rows: DataFrame, tree: Sequence[Shard], key: Sequence[str] = ("doc_id",), order: Sequence[str] = (), blocks: int = BLOCKS) -> DataFrame:
    """``rows`` with shard, grown_shard (with one shard more) and slot, which counts every shard's rows from 0 without gaps.

    The key alone decides the shard, so rows of equal keys meet; a null key is a key like any other. Slots follow the key's
    hash, then the key, then the ``order`` columns; rows equal in all of them are interchangeable. Columns with the name of a
    new one are replaced. Two steps number a shard: rows are counted by shard and block, and numbered in each block from
    where the blocks before it end.
    """
    own = [column(k) for k in key]
    kept = without(rows, "shard", "grown_shard", "slot")
    placed = rows.select(
        F.struct(*[column(c) for c in kept.columns]).alias("row"), F.struct(*own, *[column(c) for c in order]).alias("by"),
        shard_of(own, tree).alias("shard"), shard_of(own, grown(tree)).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("block"), *own), F.lit(blocks)).cast("int").alias("block"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    within = Window.partitionBy("shard", "block").orderBy("by")
    return (
        placed.withColumn("place", F.row_number().over(within))
        .join(starts, ["shard", "block"])
        .select("row.*", "shard", "grown_shard", (F.col("start") + F.col("place") - 1).alias("slot")))
