"""Repeated passages by a depth-limited radix sort of the suffixes of all texts.

Two places start the same passage when the suffixes there agree in their first 200 bytes, so suffixes need to be ordered no
deeper. They are divided digit by digit, the most significant first, and a group that is down to one suffix is dropped at
once. Digits are hashes of byte runs, and one row carries all suffixes that share one:

1. Every 200-byte window has 137 runs of 64 bytes; the one with the lowest hash is its leader. Neighbouring windows with the
   same leader form a family, about one per 60 bytes, and the leader is their first digit. Most families end here, alone.
2. The second digit of a family is all bytes its windows cover. Families that agree in it repeat in whole.
3. The others share a leader with a family of other bytes, as happens where a passage ends. They are divided into blocks of
   16 windows, with the bytes common to all windows of a block as its first digit and all its bytes as the second.
4. Blocks still undecided are unfolded into windows; the last digit is the window itself. Of families and blocks that repeat
   in whole one is divided further too, for the others to be compared with.

Equal groups are then the repeated windows. Counts are combined before they are shuffled, and joins split what is skewed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import arrow_type, column, cut, pieces, without

#: Bytes that make a repeated passage, bytes of a leader, windows of a block.
THRESHOLD, LEADER, BLOCK = 200, 64, 16
CORE = THRESHOLD - BLOCK + 1
#: Bytes of text hashed together; a longer text is read in parts that overlap by a window.
PART, PLACE_BITS = 1 << 20, 24
_RANDOM = np.random.default_rng(20240229)
_TABLE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BASE = int(_RANDOM.integers(0, 2**64, dtype=np.uint64)) | 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
KEY = "id bigint, crc bigint"


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Polynomial hashes of all runs of 1, 2, 4 ... 128 bytes, from which those of any length follow."""

    def __init__(self, data: np.ndarray):
        self.doubled = [_TABLE[data]]
        for level in range(THRESHOLD.bit_length() - 1):
            h, size = self.doubled[-1], 1 << level
            self.doubled.append(h[:max(len(h) - size, 0)] * _power(size) + h[size:])

    def of(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Hash of the run of ``size`` bytes at each start."""
        total, at = np.zeros(len(starts), np.uint64), starts
        for level in range(size.bit_length() - 1, -1, -1):
            if size >> level & 1:
                total = total * _power(1 << level) + self.doubled[level][at]
                at = at + (1 << level)
        return _mixed(total)

    def span(self, first: np.ndarray, last: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Hash of all bytes of the windows from ``first`` to ``last``, which overlap, and of a number that goes with them."""
        both = self.of(first, THRESHOLD) * _MIX + self.of(last, THRESHOLD)
        return _mixed(both + _mixed((last - first).astype(np.uint64) * np.uint64(_BASE) + shape.astype(np.uint64)))


def families(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Families of texts laid end to end: text, first and last window start, place of the leader, first and second digit."""
    begins = np.append(0, ends[:-1])
    windows = np.maximum(ends - begins - THRESHOLD + 1, 0)
    text = np.repeat(np.arange(len(ends)), windows)
    window = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[text]
    if not len(window):
        return {n: np.zeros(0, np.int64) for n in ("text", "first", "last", "leader", "high", "low")}
    hashes = Hashes(data)
    runs = _mixed(hashes.doubled[LEADER.bit_length() - 1])
    shift = np.uint64(PLACE_BITS)
    lowest = (runs >> shift << shift) | np.arange(len(runs), dtype=np.uint64)  # of equal runs the first leads
    width, size = THRESHOLD - LEADER + 1, 1
    while 2 * size <= width:
        lowest = np.minimum(lowest[:len(lowest) - size], lowest[size:])
        size *= 2
    lowest = np.minimum(lowest[:len(lowest) - (width - size)], lowest[width - size:])
    leader = (lowest[window] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    head = np.flatnonzero(np.append(True, (leader[1:] != leader[:-1]) | (text[1:] != text[:-1])))
    first, last, leader, text = window[head], window[np.append(head[1:], len(window)) - 1], leader[head], text[head]
    return {
        "text": text, "first": first - begins[text], "last": last - begins[text], "leader": leader - begins[text],
        "high": runs[leader].view(np.int64), "low": hashes.span(first, last, leader - first).view(np.int64)}


def blocks(data: np.ndarray, first: np.ndarray, last: np.ndarray, leader: np.ndarray, high: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of some families of one text: family, first and last window start, first and second digit.

    Blocks are counted from the leader, so that those of different families compare. The first digit of a block is the bytes
    that all its windows would share, also where the family has only some of them.
    """
    most, least = leader - first, leader - last
    each = most // BLOCK - least // BLOCK + 1
    family = np.repeat(np.arange(len(first)), each)
    block = least[family] // BLOCK + np.arange(len(family)) - np.repeat(np.cumsum(each) - each, each)
    begin = leader[family] - np.minimum(most[family], block * BLOCK + BLOCK - 1)
    end = leader[family] - np.maximum(least[family], block * BLOCK)
    hashes = Hashes(data)
    core = hashes.of(leader[family] - block * BLOCK, CORE)
    return {
        "family": family, "first": begin, "last": end,
        "high": _mixed(core ^ high[family].view(np.uint64) + block.astype(np.uint64)).view(np.int64),
        "low": hashes.span(begin, end, leader[family] - begin).view(np.int64)}


def covered(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end) of the bytes under windows that start from the first to the last of each range."""
    if not len(ranges):
        return np.zeros((0, 2), np.int64)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    end = np.maximum.accumulate(ranges[:, 1] + THRESHOLD)
    head = np.flatnonzero(np.append(True, ranges[1:, 0] > end[:-1]))
    return np.stack([ranges[head, 0], end[np.append(head[1:], len(end)) - 1]], axis=1)


def rest(data: bytes, spans: np.ndarray) -> bytes:
    """The bytes outside the spans."""
    edges = [0, *spans.reshape(-1).tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def sift(rows: DataFrame) -> DataFrame:
    """Rows (high, low and a place: id, crc, first, last, leader) whose first digit another row shares.

    repeated: another row agrees in both digits. undecided: no other does, or the row stands for those that agree with it
    while others with the same first digit do not.
    """
    # written, so that the join has an exchange of its own on either side and can split a digit that fills a partition
    shared = cut(rows.groupBy("high").agg(F.count("*").alias("n"), F.min("low").alias("least"), F.max("low").alias("most")).where(F.col("n") > 1))
    met = cut(rows.join(shared, "high").withColumn("mixed", F.col("least") != F.col("most")).drop("n", "least", "most"))
    place = F.struct("id", "crc", "first")
    kinds = cut(met.where("mixed").groupBy("high", "low").agg(F.count("*").alias("n"), F.min(place).alias("one")))
    mixed = met.where("mixed").join(kinds, ["high", "low"]).select(
        *rows.columns, (F.col("n") > 1).alias("repeated"), ((F.col("n") == 1) | place.eqNullSafe(F.col("one"))).alias("undecided"))
    return met.where(~F.col("mixed")).select(*rows.columns, F.lit(True).alias("repeated"), F.lit(False).alias("undecided")).unionAll(mixed)


def _by_text(sifted: DataFrame) -> DataFrame:
    """Of each text (id, crc): ranges of repeated windows, and what is undecided. As many as the text is long, at most."""
    return sifted.groupBy("id", "crc").agg(
        F.collect_set(F.when(F.col("repeated"), F.struct("first", "last"))).alias("ranges"),
        F.collect_set(F.when(F.col("undecided"), F.struct("first", "last", "leader", "high"))).alias("open"))


def _structs(values: pa.Array, *names: str) -> list[np.ndarray]:
    """A list column of structs of longs as one two-dimensional array per row; null is empty."""
    items = values.flatten()
    flat = np.stack([pc.struct_field(items, n).to_numpy(zero_copy_only=False) for n in names], axis=1).astype(np.int64)
    lengths = np.nan_to_num(pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.split(flat, np.cumsum(lengths)[:-1])


def _families_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``sift`` of a partition of texts (id, crc, text)."""
    def made(ids: list, crcs: list, texts: list[bytes], shift: int = 0) -> pa.RecordBatch:
        found = families(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
        text = found["text"]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()).take(pa.array(text)), pa.array(crcs, pa.int64()).take(pa.array(text)),
            *[pa.array(found[n] + shift, pa.int64()) for n in ("first", "last", "leader")], pa.array(found["high"]), pa.array(found["low"])],
            names=["id", "crc", "first", "last", "leader", "high", "low"])

    for batch in pieces(batches, "text", PART):
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        ids, crcs = batch.column("id").to_pylist(), batch.column("crc").to_pylist()
        if len(texts) == 1 and len(texts[0]) > PART:
            for at in range(0, len(texts[0]) - THRESHOLD + 1, PART):
                yield made(ids, crcs, [texts[0][at:at + PART + THRESHOLD - 1]], at)
        else:
            yield made(ids, crcs, texts)


def _parts(data: bytes, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Parts of a text with the windows (by number) that start in them; a window's family may start a little earlier."""
    for part in np.unique(first // PART).tolist():
        begin = max(part * PART - THRESHOLD, 0)
        yield begin, np.flatnonzero(first // PART == part), data[begin:(part + 1) * PART + 2 * THRESHOLD]


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``sift`` of the undecided families of texts (id, crc, packed, open)."""
    unpack = zstandard.ZstdDecompressor().decompress
    names = ("first", "last", "leader", "high", "low")
    for batch in batches:
        for key, crc, packed, open_ in zip(
                batch.column("id").to_pylist(), batch.column("crc").to_pylist(), batch.column("packed"), _structs(batch.column("open"), "first", "last", "leader", "high")):
            data = unpack(packed.as_py())
            for begin, which, part in _parts(data, open_[:, 0]):
                first, last, leader, high = open_[which].T
                found = blocks(np.frombuffer(part, np.uint8), first - begin, last - begin, leader - begin, np.ascontiguousarray(high))
                found["first"], found["last"], found["leader"] = found["first"] + begin, found["last"] + begin, leader[found["family"]]
                n = len(found["first"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.int64()), pa.array([crc] * n, pa.int64()), *[pa.array(found[c], pa.int64()) for c in names]],
                    names=["id", "crc", *names])


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, crc, first, digit) of the windows of undecided blocks of texts (id, crc, packed, open)."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for key, crc, packed, open_ in zip(
                batch.column("id").to_pylist(), batch.column("crc").to_pylist(), batch.column("packed"), _structs(batch.column("open"), "first", "last", "leader", "high")):
            data = unpack(packed.as_py())
            for begin, which, part in _parts(data, open_[:, 0]):
                first, last, leader, high = open_[which].T
                each = last - first + 1
                block = np.repeat(np.arange(len(which)), each)
                start = first[block] + np.arange(len(block)) - np.repeat(np.cumsum(each) - each, each)
                window = Hashes(np.frombuffer(part, np.uint8)).of(start - begin, THRESHOLD)
                digit = _mixed(window ^ _mixed(high[block].astype(np.int64).view(np.uint64) + (leader[block] - start).astype(np.uint64)))
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.int64()), pa.array([crc] * n, pa.int64()), pa.array(start, pa.int64()), pa.array(digit.view(np.int64))],
                    names=["id", "crc", "first", "digit"])


Finish = Callable[[bytes, np.ndarray], tuple[Any, ...]]


def kept_text(data: bytes, spans: np.ndarray) -> tuple[Any, ...]:
    """The removed spans and the text that is left; what is left of a character that was cut is dropped."""
    return spans.tolist(), rest(data, spans).decode("utf-8", "ignore")


KEPT_TEXT = T.StructType([T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.StringType())])


def strip(docs: DataFrame, finish: Finish = kept_text, finished: T.StructType = KEPT_TEXT) -> DataFrame:
    """``docs`` (doc_id, text) less the text, with what ``finish`` makes of its bytes and of the spans that repeat.

    A byte is in a span when a 200-byte string that covers it also starts anywhere else in ``docs``, the same text included;
    strings do not cross texts and overlaps count. Null texts are empty; texts under 200 bytes have no span. Every row stays;
    rows that repeat are occurrences of their own. A null id is one like any other. Columns named like those of ``finished``
    are replaced.
    """
    names = [c for c in without(docs, *finished.names).columns if c != "text"]
    data = F.coalesce(column("text"), F.lit("")).cast("binary")
    keyed = docs.select(
        F.struct(*[column(c) for c in names]).alias("row"), *_named(data), data.alias("text"))
    rows = keyed.select("id", "crc", "text").mapInArrow(_families_of, f"{KEY}, first bigint, last bigint, leader bigint, high bigint, low bigint")
    first = _by_text(sift(rows))
    row_type = keyed.schema["row"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([packer.compress(t.as_buffer()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("crc"), packed], names=["row", "id", "crc", "packed"])

    key_type = [T.StructField("id", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("packed", T.BinaryType())]
    range_type, open_type = (T.StructField(n, first.schema[n].dataType) for n in ("ranges", "open"))
    made_type = T.StructField("made", finished)
    packed = keyed.mapInArrow(pack, T.StructType([row_type, *key_type]))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without undecided windows are finished; the others wait with what is known of them."""
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            waits = np.nan_to_num(pc.list_value_length(batch.column("open")).fill_null(0).to_numpy(zero_copy_only=False)) > 0
            ranges = _structs(batch.column("ranges"), "first", "last")
            made = [
                None if w else dict(zip(finished.names, finish(unpack(z.as_py()), covered(r))))
                for w, z, r in zip(waits.tolist(), batch.column("packed"), ranges)]
            keep = pa.array(waits)
            null = lambda c: pc.if_else(keep, c, pa.scalar(None, c.type))
            lists = [pa.array([x if w else None for w, x in zip(waits.tolist(), batch.column(n).to_pylist())], batch.column(n).type) for n in ("ranges", "open")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("crc"), null(batch.column("packed")), *lists, pa.array(made, arrow_type(finished))],
                names=["row", "id", "crc", "packed", "ranges", "open", "made"])

    visited = cut(
        _beside(packed, first).select("row", "id", "crc", "packed", "ranges", "open")
        .mapInArrow(visit, T.StructType([row_type, *key_type, range_type, open_type, made_type])))
    done = visited.where(F.col("made").isNotNull()).select("row", "made")
    waiting = visited.where(F.col("made").isNull())

    second = cut(_by_text(sift(
        waiting.select("id", "crc", "packed", "open").mapInArrow(_blocks_of, f"{KEY}, first bigint, last bigint, leader bigint, high bigint, low bigint"))))
    windows = (
        waiting.select("id", "crc", "packed").join(_renamed(second.where(F.size("open") > 0).select("id", "crc", "open")), _same_key())
        .select("id", "crc", "packed", "open").mapInArrow(_windows_of, f"{KEY}, first bigint, digit bigint"))
    equal = cut(windows.groupBy("digit").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    third = windows.join(equal, "digit").groupBy("id", "crc").agg(F.collect_set(F.struct("first", F.col("first").alias("last"))).alias("ranges"))
    later = (
        second.select("id", "crc", "ranges").unionAll(third)
        .groupBy("id", "crc").agg(F.flatten(F.collect_list("ranges")).alias("more")))

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            known, more = _structs(batch.column("ranges"), "first", "last"), _structs(batch.column("more"), "first", "last")
            made = [
                dict(zip(finished.names, finish(unpack(z.as_py()), covered(np.concatenate([a, b])))))
                for z, a, b in zip(batch.column("packed"), known, more)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, arrow_type(finished))], names=["row", "made"])

    ended = _beside(waiting.drop("open", "made"), later).select("row", "packed", "ranges", "more").mapInArrow(end, T.StructType([row_type, made_type]))
    return done.unionAll(ended).select("row.*", "made.*")


def _named(data: Any) -> list[Any]:
    """Two 64-bit hashes of a row's id and whole text, from different starts: together (id, crc) name the text in all joins.

    A null or repeated id does not make two texts one.
    """
    return [F.xxhash64(F.lit(0), column("doc_id"), data).alias("id"), F.xxhash64(F.lit(1), data, F.octet_length(data), column("doc_id")).alias("crc")]


def _renamed(side: DataFrame) -> DataFrame:
    return side.withColumnRenamed("id", "id_").withColumnRenamed("crc", "crc_")


def _same_key() -> Any:
    return F.col("id").eqNullSafe(F.col("id_")) & (F.col("crc") == F.col("crc_"))


def _beside(texts: DataFrame, found: DataFrame) -> DataFrame:
    return texts.join(_renamed(found), _same_key(), "left")
