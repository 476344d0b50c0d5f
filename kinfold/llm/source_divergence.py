"""How far the vocabularies of a language's sources lie apart, by in-mapper stripes.

A task folds whole documents into stripes, one per term of a language: the number of documents that hold it and its count in
every source. A task whose stripes outgrow its memory writes them out and goes on with none. The stripes are sorted by
language and term and merged as they pass by; those of terms in enough documents are kept, many to a row. Every kept stripe
then gives its part of each divergence by itself, so no term meets another and no document is read again.

For a group of documents (a source of a language, or the whole language) with N occurrences of the V kept terms, a term that
occurs c times has the share p = 1 + floor(10^9 (c + 2) / (N + 2 V)). Of two groups with shares p and q, a term adds
f = floor((p - q)^2 / (p + q)). All of it is done in whole numbers.

Most terms are missing from most sources, where the share depends on the source alone. A pair of sources therefore begins with V
times the f of two missing terms, and a stripe adds only what its own cells change.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import cut, pieces

#: A term is in at least so many documents of its language; of the terms a source has more often than its language so many are listed.
LEAST_DOCS, LISTED = 10, 10
SCALE = 10 ** 9
#: Bytes of one text that are split at a time.
TEXT_AT_ONCE = 1 << 22
#: Letters A-Z become a-z, other ASCII bytes become spaces, and bytes of longer characters stay: what is left is terms and spaces.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

STRIPES = "lang string, term string, n_docs long, sources array<string>, counts array<long>"
BLOCKS = "lang string, terms array<string>, sizes array<int>, sources array<string>, counts array<long>"
PARTS = "lang string, source string, part string, item string, value long"


@dataclass(frozen=True)
class Limits:
    """What a task holds at most; results do not depend on it."""

    #: Cells (terms and their sources) and bytes of terms of the stripes of a task, before they are written out.
    cells: int = 1 << 20
    term_bytes: int = 1 << 26
    #: Cells in a row of merged stripes.
    row_cells: int = 1 << 16
    #: Cells times sources computed at a time, and numbers that the sums of a task hold.
    at_once: int = 1 << 20
    sums: int = 1 << 22


def terms(text: bytes, at_once: int = TEXT_AT_ONCE) -> Counter[bytes]:
    """Terms of one whole text and how often they occur; long texts are split in parts between terms."""
    folded, at, found = text.translate(FOLDED), 0, Counter()
    while at < len(folded):
        end = folded.find(b" ", at + at_once)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def _folding(limits: Limits):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stripes of the documents (lang, source, text) of one task."""
        stripes: dict[str, dict[bytes, tuple[list[int], dict[str, int]]]] = {}
        cells = held = 0
        for batch in batches:
            for part in pieces([batch], "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts):
                    of_lang = stripes.setdefault(lang, {})
                    for term, n in terms(text).items():
                        stripe = of_lang.get(term)
                        if stripe is None:
                            of_lang[term] = stripe = ([0], {})
                            held += len(term)
                        docs, counts = stripe
                        docs[0] += 1
                        if source in counts:
                            counts[source] += n
                        else:
                            counts[source] = n
                            cells += 1
                    if cells >= limits.cells or held >= limits.term_bytes:
                        yield from _written_out(stripes)
                        stripes, cells, held = {}, 0, 0
        yield from _written_out(stripes)
    return fold


def _written_out(stripes: dict[str, dict[bytes, tuple[list[int], dict[str, int]]]]) -> Iterator[pa.RecordBatch]:
    for lang, of_lang in stripes.items():
        names = list(of_lang)
        for at in range(0, len(names), 1 << 14):
            some = names[at:at + (1 << 14)]
            counts = [of_lang[t][1] for t in some]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([of_lang[t][0][0] for t in some], pa.int64()),
                pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
                names=["lang", "term", "n_docs", "sources", "counts"])


def _lists(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column without nulls; a value that is there often becomes one Python object."""
    found = column.flatten().dictionary_encode()
    values = np.array([*found.dictionary.to_pylist(), None], object)[found.indices.to_numpy()].tolist()
    ends = np.cumsum(column.value_lengths().to_numpy()).tolist()
    return (values[a:b] for a, b in zip([0, *ends], ends))


def _merging(least: int, limits: Limits):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of merged stripes of ``least`` documents or more, each of one language and in the order of its terms."""
        at, n_docs, counts, block = None, 0, {}, []
        block_lang, cells = None, 0

        def row() -> pa.RecordBatch:
            columns = [
                [block_lang], [[t for t, _ in block]], [[len(c) for _, c in block]], [[s for _, c in block for s in c]],
                [[n for _, c in block for n in c.values()]]]
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "terms", "sizes", "sources", "counts"])

        def stripes():
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in ("lang", "term", "n_docs")), *(_lists(batch.column(n)) for n in ("sources", "counts")))
            yield None, None, 0, [], []

        for lang, term, docs, sources, numbers in stripes():
            if (lang, term) != at:
                if n_docs >= least:
                    if block and (block_lang != at[0] or cells >= limits.row_cells):
                        yield row()
                        block, cells = [], 0
                    block_lang = at[0]
                    block.append((at[1], counts))
                    cells += len(counts)
                at, n_docs, counts = (lang, term), 0, {}
            n_docs += docs
            for source, n in zip(sources, numbers):
                counts[source] = counts.get(source, 0) + n
        if block:
            yield row()
    return merge


def shares(counts: np.ndarray, all_: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / (all_ + 2 * kept)), three digits at a time so that nothing overflows below 9 * 10^15."""
    whole, rest, below = 0, counts + 2, all_ + 2 * kept
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // below, rest % below
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _emitting(listed: int, limits: Limits):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the stripes of one task add to the pairs of sources, and the ``listed`` first terms of every row and source."""
        names, sums = {}, {}

        def summed() -> Iterator[pa.RecordBatch]:
            for (lang, s), row in sums.items():
                others = np.flatnonzero(row)
                if len(others):
                    yield _parts(lang, [names[lang][s]] * len(others), "pair", [names[lang][t] for t in others.tolist()], row[others])

        for batch in batches:
            for k in range(batch.num_rows):
                lang, groups, kept = (batch.column(n)[k].as_py() for n in ("lang", "groups", "n_kept"))
                if lang not in names:
                    names[lang] = [g["source"] for g in groups]
                place = {s: i for i, s in enumerate(names[lang])}
                sizes, of_source = batch.column("sizes")[k].values.to_numpy(), np.array([g["n"] for g in groups], np.int64)
                counts = batch.column("counts")[k].values.to_numpy()
                source = np.array([place[s] for s in batch.column("sources")[k].as_py()], np.int64)
                term = np.repeat(np.arange(len(sizes)), sizes)
                p = shares(counts, of_source[source], kept)
                q = shares(np.add.reduceat(counts, np.cumsum(sizes) - sizes), int(of_source.sum()), kept)[term]
                yield from _first_terms(lang, names[lang], batch.column("terms")[k], term, source, p, q, listed)
                absent = shares(np.zeros(len(of_source), np.int64), of_source, kept)
                for s, row in _changes(term, source, p, absent, len(sizes), limits.at_once):
                    sums[lang, s] = sums[lang, s] + row if (lang, s) in sums else row
                if sum(map(len, sums.values())) > limits.sums:
                    yield from summed()
                    sums = {}
        yield from summed()
    return emit


def _parts(lang: str, sources: list[str], part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
    same = [[lang] * len(sources), [part] * len(sources)]
    return pa.RecordBatch.from_arrays([
        pa.array(same[0], pa.string()), pa.array(sources, pa.string()), pa.array(same[1], pa.string()), pa.array(items, pa.string()),
        pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])


def _first_terms(lang, names, spelled, term, source, p, q, listed) -> Iterator[pa.RecordBatch]:
    """Of each source the terms of one row that it has most above its language; terms are in order, so ties are too."""
    over = np.flatnonzero(p > q)
    value = apart(p[over], q[over])
    order = np.lexsort((term[over], -value, source[over]))
    group = source[over][order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)])
    nth = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    top = order[nth < listed]
    if len(top):
        yield _parts(lang, [names[s] for s in source[over[top]].tolist()], "term", [spelled.values[t].as_py() for t in term[over[top]].tolist()], value[top])


def _changes(term, source, p, absent, n_terms, at_once) -> Iterator[tuple[int, np.ndarray]]:
    """(source, what its cells change in its pairs with each source); a term that both have counts at the first of the two."""
    n = len(absent)
    base = apart(absent[:, None], absent[None, :]) if n * n <= at_once else None
    step = max(1, at_once // n)
    first = np.searchsorted(term, np.arange(n_terms + 1))
    at = 0
    while at < len(term):  # whole terms, as many as fit
        last = np.searchsorted(first, first[term[at]] + step, side="right") - 1
        end = int(first[max(last, term[at] + 1)])
        t0 = term[at]
        cells = slice(at, end)
        full = np.tile(absent, (int(term[end - 1] - t0) + 1, 1))
        has = np.zeros(full.shape, bool)
        full[term[cells] - t0, source[cells]] = p[cells]
        has[term[cells] - t0, source[cells]] = True
        for s in np.unique(source[cells]).tolist():
            mine = np.flatnonzero(source[cells] == s)
            own, rows = p[cells][mine], term[cells][mine] - t0
            plain = base[s] if base is not None else apart(absent[s], absent)
            change = apart(own[:, None], full[rows]) - plain
            change[:, :s][has[rows][:, :s]] = 0
            change[:, s] = 0
            yield s, change.sum(axis=0)
        at = end


def stripes(docs: DataFrame, least: int = LEAST_DOCS, limits: Limits = Limits()) -> DataFrame:
    """Merged stripes of the terms in at least ``least`` documents of a language, many to a row: lang, terms, sizes (sources of
    each term), sources and counts (of all terms end to end). ``docs`` has lang, source and text, none of them null."""
    folded = docs.select("lang", "source", "text").mapInArrow(_folding(limits), STRIPES)
    return folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merging(least, limits), BLOCKS)


def audit(docs: DataFrame, least: int = LEAST_DOCS, listed: int = LISTED, limits: Limits = Limits()) -> DataFrame:
    """lang, source, part, item, value and rank: how far the sources of ``docs`` (text, lang, source; other columns are ignored) lie apart.

    Part ``pair`` has every other source of the language with the f summed over all kept terms, 0 without any; part ``term`` the
    ``listed`` terms whose share in the source is most above that in its language. Ranks begin with the largest value, ties with the
    smallest item. A null text, language or source is the empty string. Repeated rows count as often as they are there; a language
    of one source has no pairs, and an empty table gives no rows.
    """
    known = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = cut(stripes(known, least, limits))
    occurring = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(
        F.sum("c.counts").alias("n"))
    groups = cut(
        known.select("lang", "source").distinct().join(occurring, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    vocabulary = kept.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_kept"))
    langs = cut(
        groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
        .join(vocabulary, "lang", "left").select("lang", "groups", F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept")))
    found = cut(kept.join(langs, "lang").mapInArrow(_emitting(listed, limits), PARTS))
    # a pair without any occurrence of a term: each share is that of a count of 0
    absent = lambda n: F.expr(f"1 + {2 * SCALE} div ({n} + 2 * n_kept)")
    pair = groups.join(langs.select("lang", "groups", "n_kept"), "lang").select("lang", "source", "n", "n_kept", F.inline("groups").alias("item", "m"))
    base = pair.where(F.col("item") != F.col("source")).withColumn("p", F.when(F.col("n_kept") > 0, absent("n"))).withColumn(
        "q", F.when(F.col("n_kept") > 0, absent("m"))).select(
        "lang", "source", "item", F.coalesce(F.expr("(p - q) * (p - q) div (p + q) * n_kept"), F.lit(0)).alias("value"))
    changed = found.where("part = 'pair'").select("lang", F.inline(F.array(
        F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))))
    pairs = base.unionByName(changed).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    top = found.where("part = 'term'").select(*columns, ranked).where(F.col("rank") <= listed)
    return pairs.select(*columns, ranked).unionByName(top)
