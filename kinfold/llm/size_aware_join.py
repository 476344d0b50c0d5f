"""Jaccard join of shingle sets, size-aware: subsets of small sets, inverted lists of large ones.

Equal sets are one. Two sets of a and b members (a <= b) are alike when they share need(a, b) of them, a number that follows from
the bound on their similarity.

Small sets are light: each gives all its subsets of need(a, b) members, for every size its partner can have, and who gives the
same subset is alike by that alone. A subset's smallest set of each size stands for the others, so links grow with the subsets and
not with their pairs.

Large sets are heavy: for them inverted lists are scanned. Members are put in one order for all sets, the frequent ones last, and of a
set only so many first members are listed that any set alike must be listed with it once. Before the first member that two sets share
they share none, so its places in both bound what they share, and most pairs that meet by a shared passage are left out. Each set has 256 bits, of which every member turns one over: sets
differ in as many members at least as in bits, so most pairs that are not alike are left out without their sets. Some sets of a list lead it: they
are compared, whole, with all others of the list that they are not yet connected to, and leave it. The first to lead are those outside the list's
largest component; there are sixteen times as many leaders in each round, until every list is of one component or has no pair
left. Links of a round join the components of the round before, so only these are searched for components again. So groups of near copies cost a few comparisons for each set, no pair is missed, and no list is held in one task.

A set is small up to a boundary, at which the subsets to be made and the list entries to be scanned are the fewest in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import cut, pieces
from kinfold.llm.components import moved, stars

SHINGLE, SEED = 4, 42
#: The least similarity as a fraction, compared in whole numbers.
ALIKE = (85, 100)
#: Sets of more members than this are never small.
MOST_SMALL = 20
#: A table of at most so many rows of a few numbers is broadcast; it is counted first, and beyond that both sides are shuffled.
FEW, FEW_MEMBERS = 1 << 17, 1 << 21
#: Members kept of a set beyond those that are listed, to stand in for frequent ones: a share of the listed, and a number.
SPARE_SHARE, SPARE = 4, 8
#: Leaders of a list in the first round, and how many times as many there are in each next one.
LEADERS, MORE_LEADERS = 4, 16
#: 64-bit numbers that hold the parity bits of a set.
PARITIES = 4
#: Words whose hashes a task remembers, and words hashed at a time.
REMEMBERED, WORDS_AT_ONCE = 1 << 19, 1 << 18


def need(a: int, b: int, alike: tuple[int, int] = ALIKE) -> int:
    """Members that sets of ``a`` and ``b`` members must share: s / (a + b - s) >= alike."""
    top, base = alike
    return -(-top * (a + b) // (top + base))


def largest_partner(a: int, alike: tuple[int, int] = ALIKE) -> int:
    top, base = alike
    return a * base // top


def listed_first(n: int, alike: tuple[int, int] = ALIKE) -> int:
    """Members that are listed of a set of ``n``: sets alike share at least alike * n, so they share one of these."""
    top, base = alike
    return n - -(-top * n // base) + 1


class Shingles:
    """Sorted hashes (signed, as Spark sorts them) of the distinct shingles of texts; those of words are remembered."""

    _FACTORS = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(SHINGLE)], np.uint64)

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
        if not words:
            return np.zeros(0, np.int64)
        hashed = np.concatenate([self._hashed(words[i:i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)])
        size = min(SHINGLE, len(words))
        n = len(words) - size + 1
        mixed = np.full(n, size, np.uint64)
        for i in range(size):
            mixed += hashed[i:i + n] * self._FACTORS[i]
        mixed ^= mixed >> np.uint64(32)
        mixed *= self._FACTORS[0]
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed.view(np.int64))

    def _hashed(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            if len(known) > REMEMBERED:
                known.clear()
            for word in words:
                if word not in known:
                    known[word] = xxhash.xxh64_intdigest(word, SEED)
            found = list(map(known.__getitem__, words))
        return np.fromiter(found, np.uint64, len(found))


_SETS = Shingles()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_shingles, copy (a 128-bit digest of the set) and its first members: of a set that may be small all, of others those listed and spare ones."""
    for batch in pieces(batches, "text"):
        sets = [_SETS.of(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        firsts = [s[:max(listed_first(len(s)) + listed_first(len(s)) // SPARE_SHARE + SPARE, MOST_SMALL)] for s in sets]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("row_hash"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(firsts, pa.list_(pa.int64()))],
            names=["doc_id", "row_hash", "n_shingles", "copy", "firsts"])


def _parities(members: np.ndarray) -> list[int]:
    odd = np.bincount(members & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets and parity bits of the texts that have the set of their node."""
    for batch in pieces(batches, "text"):
        found = [_SETS.of(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        own = [xxhash.xxh3_128_digest(s.tobytes()) == copy for s, copy in zip(found, batch.column("copy").to_pylist())]
        bits = [_parities(s) for s in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(found, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
            names=["node", "members", "bits"]).filter(pa.array(own, pa.bool_()))


def subset_keys(n: int) -> int:
    """Subsets that a set of ``n`` members gives."""
    return sum(comb(n, c) for c in {need(*sorted((n, m))) for m in _partners(n)})


def _partners(n: int) -> list[int]:
    return [m for m in range(1, largest_partner(n) + 1) if largest_partner(m) >= n]


def _subsets(boundary: int):
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(sizes, subset, side, node): a set's subsets for each pair of sizes that it can be part of; side 0 is the smaller size."""
        for batch in batches:
            for node, members in zip(batch.column("node").to_pylist(), batch.column("firsts").to_pylist()):
                n, made = len(members), {}
                for m in _partners(n):
                    if m > boundary:
                        continue
                    a, b = sorted((n, m))
                    c = need(a, b)
                    if c not in made:
                        made[c] = [xxhash.xxh3_128_digest(np.array(x, np.int64).tobytes()) for x in combinations(members, c)]
                    k = len(made[c])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([a * (MOST_SMALL + 1) + b] * k, pa.int32()), pa.array(made[c], pa.binary()), pa.array([int(n > m)] * k, pa.int32()),
                        pa.array([node] * k, pa.int64())], names=["sizes", "subset", "side", "node"])
    return give


def small_links(small: DataFrame, boundary: int) -> DataFrame:
    """Links (a, b) that connect the ``small`` sets (node, firsts) alike: who shares a subset is linked to its first set of the other side."""
    given = cut(small.mapInArrow(_subsets(boundary), "sizes int, subset binary, side int, node long"))
    firsts = given.groupBy("sizes", "subset").agg(
        F.min(F.when(F.col("side") == 0, F.col("node"))).alias("low"), F.min(F.when(F.col("side") == 1, F.col("node"))).alias("high"),
        F.count("*").alias("n")).where("n > 1").drop("n")
    same = F.col("sizes") % (MOST_SMALL + 1) == F.floor(F.col("sizes") / (MOST_SMALL + 1))
    met = given.join(cut(firsts), ["sizes", "subset"]).select(
        F.col("node").alias("a"), F.when(same | (F.col("side") == 1), F.col("low")).otherwise(F.col("high")).alias("b"))
    return met.where(F.col("a") != F.col("b")).distinct()  # no other side: b is null


def boundary_of(entries: DataFrame, sizes: DataFrame) -> int:
    """The largest size of a small set: subsets to be made up to it, and entries of the lists scanned beyond it, are fewest in all.

    ``entries`` (size, scanned) has the lengths of the lists of sets of each size, ``sizes`` (size, n) how many sets there are.
    """
    made = {r[0]: r[1] * subset_keys(r[0]) for r in sizes.where(F.col("size").between(1, MOST_SMALL)).collect()}
    scanned = {r[0]: r[1] for r in entries.where(F.col("size").between(1, MOST_SMALL)).collect()}
    costs = [sum(made.get(n, 0) if n <= x else scanned.get(n, 0) for n in range(1, MOST_SMALL + 1)) for x in range(MOST_SMALL + 1)]
    return costs.index(min(costs))


def _links_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (node, leader, root, leader_root) whose whole ``sets`` (node, members) are alike, as links (a, b) of their roots.

    The sets of the leaders are broadcast if they have few members in all, so that a pair is not shuffled with a set.
    """
    top, base = ALIKE
    leading = cut(sets.join(pairs.select(F.col("leader").alias("node")).distinct(), "node", "left_semi"))
    few = (leading.agg(F.sum(F.size("members"))).first()[0] or 0) <= FEW_MEMBERS
    own, other = sets.select("node", F.col("members").alias("own")), leading.select(F.col("node").alias("leader"), F.col("members").alias("other"))
    both = pairs.join(own, "node").join(F.broadcast(other) if few else other, "leader")
    both = both.withColumn("shared", F.size(F.array_intersect("own", "other")).cast("long"))
    return both.where(base * F.col("shared") >= top * (F.size("own") + F.size("other") - F.col("shared"))).select(F.col("root").alias("a"), F.col("leader_root").alias("b")).distinct()


def _if_few(small: DataFrame) -> DataFrame:
    """``small``, written and counted, as the side of a join that is broadcast if it has few rows."""
    written = cut(small)
    return F.broadcast(written) if written.count() <= FEW else written


def whole_sets(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, members, bits) of the ``wanted`` nodes, from the text of the row that stands for each."""
    own = nodes.join(wanted, "node", "left_semi").select("node", "copy", F.col("first.doc_id").alias("id"), F.col("first.row_hash").alias("hash"))
    found = texts.join(_if_few(own), texts["doc_id"].eqNullSafe(F.col("id")) & (texts["row_hash"] == F.col("hash"))).select("node", "copy", "text")
    return cut(found.mapInArrow(_whole, "node long, members array<long>, bits array<long>").dropDuplicates(["node"]))


def _count(size: Column | str) -> Column:
    """``listed_first`` as a column."""
    top, base = ALIKE
    size = F.col(size) if isinstance(size, str) else size
    return (size - F.ceil(F.lit(top) * size / base) + 1).cast("int")


def _listed(members: Column, frequent: Column, size: Column) -> Column:
    """The members of a set that are listed: the first of those not ``frequent``, and the first frequent ones where they do not suffice."""
    return F.slice(F.concat(F.array_except(members, frequent), F.array_intersect(members, frequent)), F.lit(1), _count(size))


def _with_frequent(sets: DataFrame, members: str, frequent: DataFrame) -> DataFrame:
    """``sets`` (node, …) with those of its members that are frequent."""
    held = sets.select("node", F.explode(members).alias("member")).join(frequent, "member").groupBy("node").agg(F.collect_list("member").alias("frequent"))
    return sets.join(cut(held), "node", "left").withColumn("frequent", F.coalesce("frequent", F.array().cast("array<long>")))


def lists(nodes: DataFrame, texts: DataFrame, counted: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Entries (member, node, size, place) of the lists that hold several sets, and the whole sets (node, members, bits) in them.

    ``counted`` has the members that are among the first ones of several sets. These are the frequent ones, and listed last by every
    set; any choice gives right lists if it holds for all sets, and this one keeps shared passages out of them. Most sets have enough
    members of their own among their first ones, and are in lists by themselves. A set that has not is listed by its whole members:
    near copies, and texts that are mostly shared passages. Sets of fewer than ``least`` members are left out.
    """
    told = cut(
        _with_frequent(nodes.where(F.col("size") >= least).select("node", "size", "firsts"), "firsts", counted)
        .withColumn("listed", _listed(F.col("firsts"), F.col("frequent"), F.col("size")))
        .withColumn("short", F.arrays_overlap("listed", "frequent") | (F.size("listed") < _count("size")))
        .select("node", "size", F.when(~F.col("short"), F.col("listed")).alias("listed"), "short"))
    short = cut(told.where("short").select("node"))
    sets = whole_sets(short, nodes, texts)
    whole = _with_frequent(sets.drop("bits"), "members", counted)
    size = F.size("members").cast("long")
    anew = cut(whole.select("node", size.alias("size"), F.posexplode(_listed(F.col("members"), F.col("frequent"), size)).alias("place", "member")))
    # a set with enough members of its own shares a listed one only with sets listed anew, and none that is frequent
    met = _if_few(anew.select("member").distinct().join(counted, "member", "left_anti"))
    own = told.where("not short").select("node", "size", F.posexplode("listed").alias("place", "member")).join(met, "member", "left_semi")
    entries = cut(own.select("member", "node", "size", "place").unionByName(anew.select("member", "node", "size", "place")))
    several = entries.groupBy("member").agg(F.count("*").alias("n")).where("n > 1").select("member")
    kept = cut(entries.join(cut(several), "member", "left_semi"))
    rest = kept.select("node").distinct().join(short, "node", "left_anti")
    return kept, sets if rest.isEmpty() else sets.unionByName(whole_sets(rest, nodes, texts))


def connected(entries: DataFrame, sets: DataFrame, boundary: int, known: DataFrame, leaders: int = LEADERS) -> DataFrame:
    """(node, root) of all nodes that the links (a, b) ``known`` and those of all sets alike of which one at least is large give a smaller root."""
    top, base = ALIKE
    rooted, listed = cut(stars(known, FEW)), None
    columns = ["member", "node", "size", "place", "bits", "root"]
    state = cut(entries.join(sets.select("node", "bits"), "node").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node")).select(*columns))
    while True:
        parts = state.groupBy("member", "root").agg(F.count("*").alias("n"))
        heads = cut(parts.groupBy("member").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
                    .select("member", F.col("top.root").alias("top")))
        if heads.isEmpty():
            return rooted
        open_ = cut(state.join(heads, "member"))
        rank = F.row_number().over(W.partitionBy("member").orderBy(F.col("root") == F.col("top"), F.xxhash64("node"), "node"))
        ranked = open_.select(*columns, "top", rank.alias("nth")).where(F.col("nth") <= leaders)
        leading = cut(ranked.select("member", *(F.col(c).alias(f"leader_{c}") for c in ("size", "place", "bits", "root")), F.col("node").alias("leader")))
        # alike sets pass in the list of the first member that they share: both share nothing before it
        left = F.least(F.col("size") - F.col("place"), F.col("leader_size") - F.col("leader_place"))
        both = F.col("size") + F.col("leader_size")
        apart = sum(F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("leader_bits")[i])) for i in range(PARITIES))
        fits = (
            (F.col("root") != F.col("leader_root")) & (base * F.least("size", "leader_size") >= top * F.greatest("size", "leader_size"))
            & (F.greatest("size", "leader_size") > boundary) & ((top + base) * left >= top * both)
            & ((top + base) * (both - apart) >= 2 * top * both))
        pair = ["node", "leader", "root", "leader_root"]
        if listed is None:  # most lists are short and end with this round
            in_order = F.array_sort(F.collect_list(F.struct("place", "member")))
            listed = cut(entries.groupBy("node").agg(in_order["member"].alias("listed")))
            pairs = open_.join(leading, "member").where(fits).select(*pair).distinct()
        else:
            # two sets that meet in many lists are compared for the first of them alone: all of these are read until they are decided
            theirs = cut(listed.join(open_.select("node").distinct(), "node", "left_semi"))
            led = cut(leading.join(theirs.select(F.col("node").alias("leader"), F.col("listed").alias("leader_listed")), "leader"))
            first = F.try_element_at(F.array_intersect("listed", "leader_listed"), F.lit(1)) == F.col("first_of")
            members = cut(open_.join(theirs, "node").withColumn("first_of", F.col("member")))
            pairs = members.join(led, "member").where(fits & first).select(*pair)
        found = cut(_links_of(cut(pairs), sets))
        state = open_.select(*columns).join(
            leading.select("member", F.col("leader").alias("node")), ["member", "node"], "left_anti")
        if not found.isEmpty():
            roots = cut(stars(found, FEW))
            state = moved(state, roots, FEW).select(*columns)
            rooted = cut(moved(rooted, roots, FEW).select("node", "root").unionByName(roots))
        state = cut(state)
        leaders *= MORE_LEADERS


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text; other columns are ignored).

    Linked are rows whose sets of 4-word shingles have a similarity of ``ALIKE`` or more; component_id is the smallest doc_id that
    links reach, the row's own included. Null ids count only where there is no other. Rows with equal sets are linked; null, empty
    and blank texts have no shingle and are linked with nothing, repeated ones neither. Every row stays.
    """
    texts = docs.select(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("row_hash"), F.col("text"))
    rows = cut(texts.mapInArrow(_digests, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_hash long, n_shingles long, copy binary, firsts array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_hash")).alias("first")
    nodes = cut(
        rows.where("n_shingles > 0").groupBy("copy").agg(first, F.min("n_shingles").alias("size"), F.min("firsts").alias("firsts"))
        .withColumn("node", F.monotonically_increasing_id()))
    counted = cut(nodes.select(F.explode("firsts").alias("member")).groupBy("member").agg(F.count("*").alias("n")).where("n > 1"))
    light = nodes.where(F.col("size") <= MOST_SMALL).select("size", F.explode(F.slice("firsts", F.lit(1), _count("size"))).alias("member"))
    scanned = light.join(counted, "member", "left").groupBy("size").agg(F.sum(F.coalesce("n", F.lit(1))).alias("scanned"))
    boundary = boundary_of(scanned, nodes.groupBy("size").agg(F.count("*").alias("n")))
    links = cut(small_links(nodes.where(F.col("size") <= boundary).select("node", "firsts"), boundary))
    top, base = ALIKE
    entries, sets = lists(nodes, texts, counted.select("member"), -(-top * (boundary + 1) // base))  # smaller ones are no partner of a large set
    roots = connected(entries, sets, boundary, links)
    rooted = nodes.select("node", "copy", F.col("first.doc_id").alias("first_id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    found = cut(rooted.join(lowest, "root").select("copy", "component_id"))
    return rows.join(found, "copy", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
