"""Toxicity by cumulative-link ordinal regression.

A document's sparse text features give one score, and ordered thresholds cut it into severity grades:
``P(grade > k) = sigmoid(score - threshold_k)``. All thresholds share the feature weights, and the expected severity is the
sum of these probabilities.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import batch_of, column, cut, pieces, without

TOKEN = re.compile(r"\w+")
#: Features are hashed to so many places.
PLACES = 1 << 20
#: Leading characters of a word that make its second feature.
STEM = 5
#: Clean and toxic labelled documents that training reads at most.
MOST_CLEAN, MOST_TOXIC = 6000, 3000
#: A telling feature is so many times as frequent in toxic texts as in clean ones; of the telling ones so many may be so by chance.
OFTEN, BY_CHANCE = 10, 0.05
#: A toxic document with more telling words than this is one grade higher, for each of the numbers.
GRADE_HITS = (2, 6)
#: Documents of this expected severity and more are rejected.
REJECT_AT = 0.5
#: Words of which a task remembers the weight.
REMEMBERED = 1 << 16


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return _sigmoid(scores[:, None] - self.thresholds).sum(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def word_places(word: str) -> tuple[int, int]:
    """Places of the word and of its stem."""
    return zlib.crc32(word.encode()) % PLACES, zlib.crc32(b"^" + word[:STEM].encode()) % PLACES


def _counted(text: str | None) -> Counter[str]:
    return Counter(TOKEN.findall(text.lower())) if text else Counter()


def _by_id(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of every labelled id: toxic if one of its labels says so; null ids and labels are left out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (MOST_CLEAN, MOST_TOXIC)) -> DataFrame:
    """Labelled documents (doc_id, toxic, text): of either class the ids that come first by their hash, so ``most`` bounds their number.

    Of the rows of a repeated id the one whose text has the smallest hash is taken.
    """
    first = None
    for toxic in (0, 1):
        part = _by_id(labels).where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[toxic])
        first = part if first is None else first.unionAll(part)
    # sum(most) narrow rows at most: a proven bound
    rows = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))


def features(word: str) -> tuple[int, int]:
    """The two features of a word: it and its stem, each by its place."""
    a, b = word_places(word)
    return a, PLACES + b


def design(labelled: DataFrame, tells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each document and, per document, distinct word and feature of it that ``tells``, its row, the feature and the count.

    The features are built where the texts are; the driver receives numbers of a bounded number of documents, in the order of
    their ids, so that the model does not depend on the order in which tasks end.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("text_hash", pa.int64()), ("features", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    bits = np.packbits(tells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.unpackbits(bits)
        for batch in pieces(batches, "text"):
            found, counts = [], []
            for text in batch.column("text").to_pylist():
                held = [(f, n) for word, n in _counted(text).items() for f in features(word) if told[f]]
                found.append([f for f, _ in held])
                counts.append([n for _, n in held])
            yield batch_of({
                "doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "text_hash": batch.column("text_hash"), "features": found, "counts": counts}, schema)

    got = labelled.select("doc_id", "toxic", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        count, "doc_id bigint, toxic int, text_hash bigint, features array<int>, counts array<int>").toArrow().sort_by(
        [("doc_id", "ascending"), ("text_hash", "ascending")])
    lengths = pc.list_value_length(got["counts"]).to_numpy()
    return (
        got["toxic"].to_numpy(), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths),
        np.asarray(pc.list_flatten(got["features"])), np.asarray(pc.list_flatten(got["counts"])))


@dataclass(frozen=True)
class Holders:
    """How many toxic and clean texts there are and, per feature, how many of them hold it."""
    n_bad: int
    n_good: int
    bad: np.ndarray
    good: np.ndarray


def holders(docs: DataFrame, labels: DataFrame | None = None, among: np.ndarray | None = None) -> Holders:
    """Counts over ``docs`` (doc_id, text and, if there are no ``labels`` by id, toxic), of the features ``among`` those given.

    Of a repeated id one text counts, and copies of a text count once: they are no further evidence.
    """
    bits = None if among is None else np.packbits(among)
    kept = ["doc_id", *([] if labels is not None else ["toxic"]), "text_hash"]

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = None if bits is None else np.unpackbits(bits)
        known: dict[str, tuple[int, ...]] = {}
        for batch in pieces(batches, "text"):
            found = []
            for text in batch.column("text").to_pylist():
                held = {-1}  # every text holds this one
                for word in set(TOKEN.findall(text.lower())) if text else ():
                    if (own := known.get(word)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        own = known[word] = tuple(f for f in features(word) if chosen is None or chosen[f])
                    held.update(own)
                found.append(sorted(held))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(found, pa.list_(pa.int32()))], names=[*kept, "features"])

    texts = docs.select(*[c for c in kept if c != "text_hash"], F.xxhash64("text").alias("text_hash"), "text")
    rows = texts.mapInArrow(hold, T.StructType([*[texts.schema[c] for c in kept], T.StructField("features", T.ArrayType(T.IntegerType()))]))
    if labels is not None:
        rows = rows.join(_by_id(labels), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text_hash", "toxic", "features")).alias("one")).select("one.*")
    each = one.groupBy("text_hash").agg(F.max("toxic").alias("toxic"), F.min("features").alias("features"))
    got = (
        each.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).toArrow())
    bad, good = np.zeros(2 * PLACES + 1, np.int64), np.zeros(2 * PLACES + 1, np.int64)
    at = got["feature"].to_numpy()  # at most one row per feature; -1 is the last place
    bad[at], good[at] = got["bad"].to_numpy(), got["good"].to_numpy()
    return Holders(int(bad[-1]), int(good[-1]), bad[:-1], good[:-1])


def telling(found: Holders, reach: np.ndarray | None = None) -> np.ndarray:
    """Whether each feature tells: it is held by toxic texts ``OFTEN`` times as often as by clean ones, and not by chance.

    Chance is bounded by the divergence of the feature's share of toxic texts from that of all texts. As so many features are
    tried, the bound is set where at most ``BY_CHANCE`` of those that pass are expected to do so by chance; features of which
    so few texts know (``reach``, by default the counts themselves) that they could not pass in any case are not counted.
    """
    n_bad, n_good, bad, good = found.n_bad, found.n_good, found.bad, found.good
    held = bad + good
    often = np.flatnonzero((bad > 0) & (bad / max(n_bad, 1) > OFTEN * (good + 0.5) / (n_good + 1)))
    tells = np.zeros(len(bad), bool)
    if not n_bad or not n_good or not len(often):
        return tells
    usual, n = n_bad / (n_bad + n_good), held[often]
    share = bad[often] / n
    clean = np.where(share < 1, (1 - share) * np.log(np.maximum(1 - share, 1e-300) / (1 - usual)), 0)
    log_chance = -n * (share * np.log(share / usual) + clean)
    order = np.argsort(log_chance, kind="stable")
    rest = np.sort((held if reach is None else reach)[(held if reach is None else reach) > 0])
    # a feature of n texts, all of them toxic, has chance usual ** n
    tried = len(rest) - np.searchsorted(rest, log_chance[order] / math.log(usual) - 1e-9)
    passed = np.flatnonzero(log_chance[order] + np.log(np.maximum(tried, 1) / (1 + np.arange(len(order)))) <= math.log(BY_CHANCE))
    if len(passed):
        tells[often[log_chance <= log_chance[order[passed[-1]]]]] = True
    return tells


def told(labelled: DataFrame, every: tuple[DataFrame, DataFrame] | None = None) -> np.ndarray:
    """The features of the ``labelled`` sample that tell, by all labelled texts of ``every`` (documents, labels) if given."""
    found = holders(labelled)
    if every is None or not found.n_bad or not found.n_good:
        return telling(found)
    whole = holders(*every, among=(found.bad * found.n_good > OFTEN * found.good * found.n_bad))
    return telling(whole, found.bad * (whole.n_bad / found.n_bad) + found.good * (whole.n_good / found.n_good))


def grades(toxic: np.ndarray, rows: np.ndarray, counts: np.ndarray, tells: np.ndarray, hits: tuple[int, ...] = GRADE_HITS) -> np.ndarray:
    """Severity grade of each document: 0 when it is clean, else 1 and one more for each of ``hits`` that its telling words exceed."""
    found = np.bincount(rows, weights=counts * tells, minlength=len(toxic))
    return np.where(toxic > 0, 1 + sum((found > h).astype(int) for h in hits), 0)


def fit(labelled: DataFrame, steps: int = 600, rate: float = 0.3, shrink: float = 1e-5, every: tuple[DataFrame, DataFrame] | None = None) -> Model:
    """Weights and thresholds by proximal gradient steps on the ordinal likelihood of the grades; small weights shrink to none.

    Only telling features get a weight; whether they tell is counted over all labelled texts of ``every``, if given. Without documents of both classes no score can be learnt; the model then expects
    severity 0 of everything.
    """
    tells = told(labelled, every)
    toxic, row, found, counts = design(labelled, tells)
    levels = len(GRADE_HITS) + 2
    weights = np.zeros(PLACES, np.float32)
    if not toxic.any() or toxic.all():
        return Model(weights, np.full(levels - 1, 50.0))
    grade = grades(toxic, row, counts, found < PLACES)
    value = 1 + np.log(counts)
    places, feature = np.unique(found % PLACES, return_inverse=True)
    n = len(toxic)
    w, squares, gaps, gap_squares = np.zeros(len(places)), np.full(len(places), 1e-8), np.array([2.0, 1.0, 1.0]), np.full(levels - 1, 1e-8)
    for _ in range(steps):
        score = np.bincount(row, weights=w[feature] * value, minlength=n)
        cuts = np.concatenate([[-np.inf], np.cumsum(gaps), [np.inf]])
        upper, lower = _sigmoid(cuts[grade + 1] - score), _sigmoid(cuts[grade] - score)
        likely = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / likely / n, lower * (1 - lower) / likely / n
        slope = np.bincount(feature, weights=(up - low)[row] * value, minlength=len(places))
        at_cut = np.array([low[grade == k + 1].sum() - up[grade == k].sum() for k in range(levels - 1)])
        by_gap = np.cumsum(at_cut[::-1])[::-1]
        squares, gap_squares = squares + slope * slope, gap_squares + by_gap * by_gap
        pace = rate / np.sqrt(squares)
        w = w - pace * slope
        w = np.sign(w) * np.maximum(np.abs(w) - pace * shrink, 0)
        gaps = gaps - rate / np.sqrt(gap_squares) * by_gap
        gaps[1:] = np.maximum(gaps[1:], 0.05)
    weights[places] = w
    return Model(weights, np.cumsum(gaps))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with expected_severity (0 to the highest grade) and rejected, and without the text if so asked.

    Null and empty texts have no features and score 0. Columns with the name of a new one are replaced; every row stays.
    """
    kept = without(docs, "expected_severity", "rejected")
    names = [c for c in kept.columns if keep_text or c != text]
    schema = T.StructType([*[kept.schema[c] for c in names], T.StructField("expected_severity", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        weights = model.weights

        def weight(word: str) -> float:
            if len(known) >= REMEMBERED:
                known.clear()
            a, b = word_places(word)
            known[word] = found = float(weights[a]) + float(weights[b])
            return found

        for batch in pieces(batches, text):
            scores = []
            for value in batch.column(text).to_pylist():
                total = 0.0
                for word, n in _counted(value).items():
                    if found := (known[word] if word in known else weight(word)):
                        total += found * (1 + math.log(n))
                scores.append(total)
            expected = model.expected(np.array(scores))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(expected), pa.array(expected >= REJECT_AT)],
                names=[*names, "expected_severity", "rejected"])

    return docs.select(*[column(c) for c in kept.columns]).mapInArrow(judge, schema)


def graded(docs: DataFrame, labels: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` scored by a model that is fitted on a bounded sample of their ``labels``; all labelled texts choose its features."""
    return score(docs, fit(cut(sample(docs, labels)), every=(docs, labels)), keep_text=keep_text)
