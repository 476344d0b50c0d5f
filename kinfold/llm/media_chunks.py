"""Media columns as content-defined chunks that are stored once.

A rolling gear hash cuts a payload where its content says so, so that equal stretches of different payloads are cut alike.
Chunks are known by their SHA-256. Counting digests tells which chunks more than one place needs; those go to a chunk table
that has each once, all others into one packed run beside the payload's recipe, the ordered list of its chunks. Reading joins
recipes to the chunk table by digest, puts the payload together and checks every chunk against its digest.

Which digests are shared is handed to the tasks as a bit map of fixed size. A digest that meets another's bit goes to the chunk
table without need; nothing else depends on the map, whatever the number of chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import arrow_type, column, cut, pieces

#: Bytes of a chunk: at least, at most, and how many more until a cut on average.
LEAST, MOST, MORE_BITS = 1024, 16384, 10
#: A payload is filled up with zero bytes to a positive multiple of this.
UNIT = 64
#: Bits of the map of shared digests (2 MB), and digests of which a task remembers that it has sent their chunk.
MAP_BITS, SENT = 24, 1 << 16
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)
RECIPE = "array<struct<digest: binary, size: int, shared: boolean>>"


def payload(text: str | None) -> bytes:
    """UTF-8 of the text, null as empty, with zero bytes up to a positive multiple of ``UNIT``."""
    data = (text or "").encode()
    return data + bytes(max(-len(data) % UNIT, UNIT - len(data)))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a payload.

    The hash at a byte depends on the 32 bytes up to it, which lie in its chunk because chunks are longer.
    """
    if len(data) <= LEAST:
        return [len(data)] if data else []
    rolled = _GEAR[np.frombuffer(data, np.uint8)]
    for size in (1, 2, 4, 8, 16):
        rolled = rolled + np.concatenate([np.zeros(size, np.uint32), rolled[:-size] << np.uint32(size)])
    at = (np.flatnonzero(rolled >> np.uint32(32 - MORE_BITS) == 0) + 1).tolist()
    ends, begin, k = [], 0, 0
    while len(data) - begin > LEAST:
        while k < len(at) and at[k] < begin + LEAST:
            k += 1
        begin = min(at[k] if k < len(at) else len(data), begin + MOST, len(data))
        ends.append(begin)
    return ends if begin == len(data) else [*ends, len(data)]


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """Digest and bytes of each chunk."""
    ends = cuts(data)
    return [(hashlib.sha256(part).digest(), part) for part in (data[a:b] for a, b in zip([0, *ends], ends))]


def serialized(recipe: list[tuple[bytes, int]]) -> bytes:
    """A recipe as bytes: for each chunk its digest and its size in four bytes, lowest first."""
    return b"".join(digest + size.to_bytes(4, "little") for digest, size in recipe)


def _bit(digest: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(digest), 64 - MAP_BITS)


@dataclass(frozen=True)
class Store:
    """Recipes (row, n_bytes, recipe_id, recipe, packed) and shared chunks (digest, packed), as written tables."""

    recipes: DataFrame
    shared: DataFrame


def store(docs: DataFrame, text: str = "text") -> Store:
    """The texts of ``docs`` stored as media in the shared folder; the other columns stay beside their recipes. Null texts are empty, and an empty payload is one unit of
    zero bytes. Rows with equal texts have equal recipes, and none of them holds chunks of its own.
    """
    names = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[column(c) for c in names], F.lit(0).alias("_")).alias("row"), column(text).alias("text"))
    bits = _map_of_shared(rows.select("text"))

    def is_shared(digest: bytes) -> bool:
        place = xxhash.xxh64_intdigest(digest, 42) >> 64 - MAP_BITS
        return bool(bits[place >> 3] >> (place & 7) & 1)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=6)
        for batch in pieces(batches, "text"):
            sizes, ids, recipes, packed = [], [], [], []
            for value in batch.column("text").to_pylist():
                data = payload(value)
                parts = [(digest, part, is_shared(digest)) for digest, part in chunks(data)]
                own = b"".join(part for _, part, shared in parts if not shared)
                sizes.append(len((value or "").encode()))
                ids.append(hashlib.sha256(serialized([(digest, len(part)) for digest, part, _ in parts])).digest())
                recipes.append([{"digest": digest, "size": len(part), "shared": shared} for digest, part, shared in parts])
                packed.append(packer.compress(own) if own else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(recipes, recipe_type), pa.array(packed, pa.binary())],
                names=["row", "n_bytes", "recipe_id", "recipe", "packed"])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shared chunks, those a task has sent lately not again."""
        packer, sent = zstandard.ZstdCompressor(level=6), set()
        for batch in pieces(batches, "text"):
            digests, packed = [], []
            for value in batch.column("text").to_pylist():
                for digest, part in chunks(payload(value)):
                    if digest not in sent and is_shared(digest):
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(digest)
                        digests.append(digest)
                        packed.append(packer.compress(part))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "packed"])

    recipe_type = arrow_type(T._parse_datatype_string(RECIPE))
    added = T.StructType.fromDDL(f"n_bytes bigint, recipe_id binary, recipe {RECIPE}, packed binary")
    recipes = rows.mapInArrow(stored, T.StructType([rows.schema["row"], *added]))
    shared = rows.select("text").mapInArrow(needed, "digest binary, packed binary").groupBy("digest").agg(F.min("packed").alias("packed"))
    return Store(cut(recipes), cut(shared))


def _map_of_shared(texts: DataFrame) -> np.ndarray:
    """Bit map of the digests that occur more than once; 2^18 words at most reach the driver, however many digests there are."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [digest for value in batch.column("text").to_pylist() for digest, _ in chunks(payload(value))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])

    again = texts.mapInArrow(digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    bit = _bit(F.col("digest"))
    words = (
        again.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("mask"))
        .groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow())
    filled = np.zeros(1 << MAP_BITS - 6, np.int64)
    filled[words["word"].to_numpy()] = words["mask"].to_numpy()
    return filled.astype("<i8").view(np.uint8)


Finish = Callable[[bytes, list[tuple[bytes, int]], int], tuple[Any, ...]]


def read(stored: Store, finish: Finish, finished: T.StructType) -> DataFrame:
    """The columns beside the media, with what ``finish`` makes of each payload, its recipe and the bytes it had before it was filled up.

    Payloads are put together from the stored bytes once per recipe and checked chunk by chunk; one that does not agree with its
    digests is an error. Columns named like those of ``finished`` are replaced.
    """
    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            made = []
            for recipe, packed, fetched, n_bytes in zip(*(batch.column(n).to_pylist() for n in ("recipe", "packed", "fetched", "n_bytes"))):
                own, at = unpack(packed) if packed is not None else b"", 0
                other = {f["digest"]: unpack(f["packed"]) for f in fetched or []}
                parts = []
                for c in recipe:
                    part = other[c["digest"]] if c["shared"] else own[at:at + c["size"]]
                    at += 0 if c["shared"] else c["size"]
                    if hashlib.sha256(part).digest() != c["digest"]:
                        raise ValueError(f"a stored chunk does not agree with its digest {c['digest'].hex()}")
                    parts.append(part)
                made.append(dict(zip(finished.names, finish(b"".join(parts), [(c["digest"], c["size"]) for c in recipe], n_bytes))))
            beside = [n for n in batch.schema.names if n not in ("recipe", "packed", "fetched") and (n != "n_bytes" or "row" not in batch.schema.names)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, beside), pa.array(made, arrow_type(finished))], names=[*beside, "made"])

    made_type = T.StructField("made", finished)
    recipes = stored.recipes.withColumn("complete", ~F.exists("recipe", lambda c: c["shared"]))
    nothing = F.lit(None).cast("array<struct<digest: binary, packed: binary>>").alias("fetched")
    alone = (
        recipes.where("complete").select("row", "n_bytes", "recipe", "packed", nothing)
        .mapInArrow(rebuilt, T.StructType([recipes.schema["row"], made_type])))
    # recipes with own chunks are unique, since such a chunk occurs nowhere else; the others are taken once
    joint = recipes.where(~F.col("complete")).select("recipe_id", "n_bytes", "recipe", "packed")
    once = joint.where(F.col("packed").isNotNull()).unionAll(
        joint.where(F.col("packed").isNull()).groupBy("recipe_id", "n_bytes").agg(F.first("recipe").alias("recipe")).select("*", F.lit(None).cast("binary").alias("packed")))
    wanted = once.select("recipe_id", "n_bytes", F.explode(F.array_distinct(F.transform(F.filter("recipe", lambda c: c["shared"]), lambda c: c["digest"]))).alias("digest"))
    fetched = (
        wanted.join(stored.shared, "digest").groupBy("recipe_id", "n_bytes").agg(F.collect_list(F.struct("digest", "packed")).alias("fetched")))
    together = (
        once.join(fetched, ["recipe_id", "n_bytes"]).select("recipe_id", "n_bytes", "recipe", "packed", "fetched")
        .mapInArrow(rebuilt, T.StructType([recipes.schema["recipe_id"], recipes.schema["n_bytes"], made_type])))
    joined = recipes.where(~F.col("complete")).select("row", "recipe_id", "n_bytes").join(together, ["recipe_id", "n_bytes"]).select("row", "made")
    names = [c for c in recipes.schema["row"].dataType.names if c != "_" and c.lower() not in {n.lower() for n in finished.names}]
    return alone.unionAll(joined).select(*[F.col("row")[c].alias(c) for c in names], "made.*")
