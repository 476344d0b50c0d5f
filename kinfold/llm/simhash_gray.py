"""Near-duplicates by SimHash with a hierarchical index in Gray order.

Fingerprints that differ in at most two bits agree in two of their four 16-bit blocks. The agreeing blocks are the uppermost
nodes of the index and what Spark partitions by; a crowded one is divided once more in the same way, after which it can hold
2^16 fingerprints at most. Below them a node's fingerprints are sorted by Gray rank, so that neighbours share bits, and runs
of neighbours are grouped level by level. Each node keeps the bits all its fingerprints share beyond those of its parent. A
search adds up the differences from shared bits on its way down and drops a whole group when they exceed two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm import near_copies
from kinfold.llm.common import column, cut, merged, pieces, without
from kinfold.llm.components import stars

SHINGLE, SEED = 3, 42
MOST_BITS = 2
#: A node of the uppermost level with more fingerprints than this is divided once more.
CROWD = 1 << 16
#: Children of a node of the sorted levels.
FAN = 8
#: Shingles hashed, and pairs of a query and a node compared, at a time.
SHINGLES_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 21


def fingerprint(text: str | None) -> int:
    """SimHash of one whole text: of A-Z lower-cased words, in 3-word shingles, repeats included; no words give 0."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > SHINGLE:
        starts, ends = starts[:1 - SHINGLE], ends[SHINGLE - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprinted(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with bits, the fingerprint as a long, and without the text if so asked. A column called bits is replaced."""
    kept = without(docs, "bits")
    names = [c for c in kept.columns if keep_text or c != text]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            bits = pa.array([fingerprint(t) for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), bits], names=[*names, "bits"])

    schema = T.StructType([*[kept.schema[c] for c in names], T.StructField("bits", T.LongType())])
    return docs.select(*[column(c) for c in kept.columns]).mapInArrow(add, schema)


def as_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def _agreeing(bits: Column, mask: int, width: int, blocks: list[int]) -> Column:
    """Each two of the blocks (given by their lowest bits) as (kind, key): what two fingerprints that agree in them share."""
    def part(low: int) -> Column:
        return F.shiftrightunsigned(bits, low).bitwiseAND(F.lit(mask))
    return F.array(*[
        F.struct(F.lit(n).alias("kind"), F.shiftleft(part(a), width).bitwiseOR(part(b)).alias("key"))
        for n, (a, b) in enumerate(combinations(blocks, 2))])


def _finer(bits: Column, kind: Column) -> Column:
    """The same for the 32 bits outside the two blocks of ``kind``, in blocks of 8 bits."""
    answer = None
    for n, pair in enumerate(combinations([0, 16, 32, 48], 2)):
        rest = [low + k for low in (0, 16, 32, 48) if low not in pair for k in (0, 8)]
        value = _agreeing(bits, 0xFF, 8, rest)
        answer = F.when(kind == n, value) if answer is None else answer.when(kind == n, value)
    return answer


def gray_rank(bits: Column) -> Column:
    """Place of a bit pattern in the Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


def links(fingerprints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of distinct ``fingerprints`` (bits) that join all those within two differing bits.

    Every link between different fingerprints is found; of the links inside one node of the index only as many are returned
    as hold its connected fingerprints together, so a dense group costs a row per fingerprint, not per pair.
    """
    nodes = fingerprints.select("bits", F.inline(_agreeing(F.col("bits"), 0xFFFF, 16, [0, 16, 32, 48])))
    crowded = (
        nodes.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        .select("kind", "key", (F.col("n") > crowd).alias("crowded")))
    upper = nodes.join(merged(crowded), ["kind", "key"]).select(
        "bits", "kind", "key", F.explode(
            F.when(F.col("crowded"), _finer(F.col("bits"), F.col("kind")))
            .otherwise(F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("key"))))).alias("finer"))
    ordered = (
        upper.select("bits", "kind", "key", F.col("finer.kind").alias("kind2"), F.col("finer.key").alias("key2"))
        .repartition("kind", "key", "kind2", "key2")
        .sortWithinPartitions("kind", "key", "kind2", "key2", gray_rank(F.col("bits"))))
    return ordered.mapInArrow(_search_partition, "a long, b long")


def _search_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the nodes of one partition; rows arrive node by node in Gray order."""
    held = np.zeros((0, 5), np.int64)
    names = ("kind", "key", "kind2", "key2", "bits")

    def found(rows: np.ndarray) -> pa.RecordBatch:
        a, b = search(_starts(rows[:, :4]), rows[:, 4])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names], axis=1)
        held = np.concatenate([held, rows])
        if len(held):
            whole = _starts(held[:, :4])[-1]  # the last node may go on in the next batch
            if whole:
                yield found(held[:whole])
                held = held[whole:]
    if len(held):
        yield found(held)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))


def search(starts: np.ndarray, bits: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of fingerprints in Gray order: every fingerprint with the first one it is connected to."""
    value = bits.view(np.uint64)
    n = len(value)
    sizes = np.diff(np.append(starts, n))
    # levels of the index, from the fingerprints up to one root per run
    both, any_, last, run = [value], [value], [np.arange(n)], np.repeat(np.arange(len(starts)), sizes)
    first_child = []
    while len(both[-1]) > len(starts):
        run_starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        place = np.arange(len(run)) - np.repeat(run_starts, np.diff(np.append(run_starts, len(run))))
        group = np.flatnonzero(place % FAN == 0)
        both.append(np.bitwise_and.reduceat(both[-1], group))
        any_.append(np.bitwise_or.reduceat(any_[-1], group))
        last.append(last[-1][np.append(group[1:], len(run)) - 1])
        first_child.append(np.append(group, len(run)))
        run = run[group]
    shared = [~(x ^ y) for x, y in zip(both, any_)]
    root = np.arange(n)
    # as many queries at a time as cannot meet more than so many fingerprints
    work = np.cumsum(np.repeat(sizes, sizes)) // PAIRS_AT_ONCE
    for block in np.split(np.arange(n), np.flatnonzero(np.diff(work)) + 1):
        query = block[np.repeat(sizes, sizes)[block] > 1]
        node = np.searchsorted(starts, query, side="right") - 1
        apart = np.zeros(len(query), np.uint8)
        for level in range(len(both) - 1, 0, -1):
            begin, end = first_child[level - 1][node], first_child[level - 1][node + 1]
            count = end - begin
            owner = np.repeat(np.arange(len(query)), count)
            child = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
            beyond = shared[level - 1][child] & ~shared[level][node[owner]]
            query, node = query[owner], child
            apart = apart[owner] + np.bitwise_count((value[query] ^ both[level - 1][child]) & beyond)
            near = (apart <= most) & (last[level - 1][child] > query)
            query, node, apart = query[near], node[near], apart[near]
        if len(both) > 1:
            _join(root, query, node)
    linked = root != np.arange(n)
    return bits[linked], bits[root[linked]]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let the connected members of pairs point to the smallest one."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(further := root[root], root):
            root[:] = further


def components(rows: DataFrame, pairs: DataFrame, node: str = "bits") -> DataFrame:
    """(node, root, component_id) of the distinct nodes of ``rows`` (doc_id, node), which ``pairs`` (a, b) link.

    root is the node that stands for the component, and the only name of it that is its own. component_id is the smallest
    doc_id whose node can be reached; null ids count only where there is no other.
    """
    distinct = cut(rows.groupBy(node).agg(F.min("doc_id").alias("first_id")))
    linked = stars(pairs)
    rooted = distinct.join(merged(linked), distinct[node] == linked["node"], "left").select(distinct[node], "first_id", F.coalesce("root", node).alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(merged(lowest), "root").select(node, "root", "component_id")


def near_links(texts: DataFrame, rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) of the near copies in ``rows`` (doc_id, row_hash, bits, copy, bands) of ``texts``: the index over their fingerprints
    gives candidates, which are compared by their whole sets; bands join what differs in more bits."""
    prints = cut(rows.select("bits", "copy").distinct())
    first = cut(prints.groupBy("bits").agg(F.min("copy").alias("first")))
    found = links(first.select("bits"), crowd)
    a, b = (first.select(F.col("bits").alias(c), F.col("first").alias(f"first_{c}")) for c in ("a", "b"))
    equal = prints.join(merged(first), "bits").select(F.col("copy").alias("a"), F.col("first").alias("b"))
    close = found.join(merged(a), "a").join(merged(b), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return near_copies.links(texts, rows, equal.unionByName(close).where(F.col("a") != F.col("b")).distinct())


def groups(docs: DataFrame, crowd: int = CROWD, near: bool = True) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Linked are near copies, as ``survivors`` takes them; or, if not ``near``, fingerprints within two bits. Null and empty
    texts have fingerprint 0 and are linked like any other. Repeated rows stay.
    """
    if near:
        texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text")
        rows = cut(near_copies.marked(fingerprinted(texts)))
        found = components(rows, near_links(texts, rows, crowd), "copy")
        joined = rows.join(merged(found), "copy")
    else:
        rows = cut(fingerprinted(docs.select("doc_id", "text"), keep_text=False))
        joined = rows.join(merged(components(rows, links(cut(rows.select("bits").distinct()), crowd))), "bits")
    return joined.select("doc_id", as_hex(F.col("bits")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies (``near_copies``) in ``docs``, with all its columns: that of the smallest id.

    Groups are told apart by their texts, not by an id, which may be null or repeated. Of several rows with the smallest id,
    the one with the smallest hash over all columns stays, once. Null ids come last.
    """
    names = docs.columns
    whole = F.xxhash64(*[column(c) for c in names])
    texts = docs.select("doc_id", whole.alias("row_hash"), "text")
    rows = cut(near_copies.marked(fingerprinted(texts)))
    first = (
        rows.join(merged(components(rows, near_links(texts, rows), "copy")), "copy").groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_hash")).alias("first")).select("first.*"))
    packed = docs.select(F.struct(*[column(c) for c in names]).alias("row"), column("doc_id").alias("id"), whole.alias("hash"))
    return (
        packed.join(merged(first), packed["id"].eqNullSafe(first["doc_id"]) & (packed["hash"] == first["row_hash"]), "left_semi")
        .dropDuplicates(["id", "hash"]).select("row.*"))
