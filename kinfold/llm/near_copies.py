"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates agree in a band of minima of their shingles' hashes; a pair at 0.8 shares none of the bands once in 20 million times,
a closer pair more rarely. Every candidate pair that could still join two groups is then compared by its whole sets, so no pair
below 0.8 is linked. The sets are built only for texts that share a band, and meet band by band, so rows grow with the members
of a group and not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import column, cut, merged, pieces
from kinfold.llm.components import stars

SHINGLE, SEED = 5, 42
#: The least similarity as a fraction, so that it is compared in whole numbers.
ALIKE = (4, 5)
BANDS, ROWS = 32, 4
#: Hashes for which minima are taken, and hashes of sets compared, at a time.
HASHES_AT_ONCE, COMPARED_AT_ONCE = 1 << 12, 1 << 20
#: Odd factors that make the hash functions of the minima out of one.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of one whole text, of A-Z lower-cased words; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > SHINGLE:
        starts, ends = starts[:1 - SHINGLE], ends[SHINGLE - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number for each band of minima; a set of nothing has no band."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        mixed = hashes[at:at + HASHES_AT_ONCE, None] * FACTORS
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed.min(axis=0))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less the text, with copy (a 128-bit digest of the shingle set) and the bands of the set."""
    names = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("copy", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            copies, found = [], []
            for value in batch.column(text).to_pylist():
                hashes = shingles(value)
                copies.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                found.append(bands(hashes))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(copies, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=[*names, "copy", "bands"])

    return docs.select(*[column(c) for c in [*names, text]]).mapInArrow(mark, schema)


def links(docs: DataFrame, rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs (a, b) of copies that join all those alike; ``rows`` has doc_id, row_hash, copy and bands of ``docs`` (doc_id, row_hash, text).

    ``candidates`` (a, b), which an index found, are compared first. Then come the bands whose copies these links do not yet join;
    of bands with the same copies one is compared.
    """
    nodes = cut(
        rows.groupBy("copy").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_hash")).alias("first"), F.min("bands").alias("bands")))
    spread = nodes.select("copy", F.posexplode("bands").alias("band", "key"))
    held = [F.bit_xor(F.xxhash64("copy", F.lit(i))).alias(f"x{i}") for i in range(2)]  # 128 bits tell which copies a band has
    shared = (
        spread.groupBy("band", "key").agg(F.count("*").alias("n"), *held).where(F.col("n") > 1)
        .groupBy("n", "x0", "x1").agg(F.min(F.struct("band", "key")).alias("first")).select("first.*"))
    members = cut(spread.join(merged(shared), ["band", "key"]).select("copy", "band", "key"))
    wanted = (
        nodes.join(merged(members.select("copy").distinct()), "copy", "left_semi")
        .select("copy", F.col("first.doc_id").alias("id"), F.col("first.row_hash").alias("hash")))
    texts = docs.join(merged(wanted), docs["doc_id"].eqNullSafe(wanted["id"]) & (docs["row_hash"] == wanted["hash"])).select("copy", "text")
    sets = cut(texts.mapInArrow(_sets, "copy binary, hashes array<long>").dropDuplicates(["copy"]))
    own, other = (sets.select(F.col("copy").alias(c), F.col("hashes").alias(f"{c}_hashes")) for c in ("a", "b"))
    known = cut(candidates.join(merged(own), "a").join(merged(other), "b").select("a", "b", "a_hashes", "b_hashes").mapInArrow(_alike_pairs, "a binary, b binary"))
    rooted = members.join(merged(stars(known).withColumnRenamed("node", "copy")), "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    apart = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band", "key")
    ordered = (
        members.join(merged(apart), ["band", "key"]).join(merged(sets), "copy").select("band", "key", "copy", "hashes")
        .repartition("band", "key").sortWithinPartitions("band", "key"))
    return known.unionByName(ordered.mapInArrow(_link_partition, "a binary, b binary"))


def _alike_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets are alike."""
    for batch in batches:
        sides = [batch.column(c) for c in ("a_hashes", "b_hashes")]
        near = [bool(alike([side[k].values.to_numpy().view(np.uint64) for side in sides])[0]) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        found = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("copy"), pa.array(found, pa.list_(pa.int64()))], names=["copy", "hashes"])


def _link_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the bands of one partition; rows arrive band by band."""
    at, copies, sets = None, [], []

    def found() -> pa.RecordBatch:
        pairs = alike(sets)
        return pa.RecordBatch.from_arrays([pa.array([copies[k] for k in side], pa.binary()) for side in pairs], names=["a", "b"])

    for batch in batches:
        keys = zip(batch.column("band").to_pylist(), batch.column("key").to_pylist())
        for key, copy, hashes in zip(keys, batch.column("copy").to_pylist(), batch.column("hashes")):
            if key != at:
                if len(copies) > 1:
                    yield found()
                at, copies, sets = key, [], []
            copies.append(copy)
            sets.append(hashes.values.to_numpy().view(np.uint64).copy())
    if len(copies) > 1:
        yield found()


def alike(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Pairs that connect all the sorted ``sets`` with a similarity of ``ALIKE`` or more; those already connected are not compared."""
    top, base = ALIKE
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, root = sizes[order], np.arange(len(sets))
    a, b = [], []
    for i, k in enumerate(order.tolist()):
        one = sets[k]
        end = int(np.searchsorted(sizes * top, len(one) * base, side="right"))
        others = i + 1 + np.flatnonzero(root[i + 1:end] != root[i])
        held = np.cumsum(sizes[others]) // COMPARED_AT_ONCE
        for part in np.split(others, np.flatnonzero(np.diff(held)) + 1) if len(others) else ():
            part = part[root[part] != root[i]]
            if not len(part):
                continue
            values = np.concatenate([sets[j] for j in order[part].tolist()])
            hits = one[np.minimum(np.searchsorted(one, values), len(one) - 1)] == values
            common = np.add.reduceat(hits, np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
            near = part[common * base >= top * (len(one) + sizes[part] - common)]
            a += [k] * len(near)
            b += order[near].tolist()
            root[np.isin(root, root[near])] = root[i]
    return a, b
