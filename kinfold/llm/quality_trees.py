"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms of a bounded labelled sample; splits on chosen statistics may move the verdict in one direction
only. The trees are flattened into arrays of nodes, and all rows of a batch descend one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import batch_of, column, pieces, without

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistic and the direction in which a larger value may move the quality; 0 leaves it free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeat_share": -1, "upper_share": -1,
    "exclamations": -1, "digit_share": 0, "distinct_share": 1, "top_share": -1, "line_words": 0, "punctuation": 0}
#: Labelled documents that training reads at most, of each of the two classes.
MOST_PER_CLASS = 4000
MIN_WORDS, MOST_REPEAT_PERCENT = 50, 50


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text; null is empty."""
    data = (text or "").encode()
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n = len(words)
    chars = int(len(data) - bytes_[0x80:0xC0].sum() - bytes_[SPACES].sum())
    symbols = int(bytes_[SYMBOLS].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated, distinct, top = repeat_words(words)
    per_word, per_char = 1 / max(n, 1), 1 / max(chars, 1)
    marks = bytes_[[0x21, 0x2C, 0x2E, 0x3A, 0x3B, 0x3F]]
    return [n, chars, symbols, dup_lines, repeated], [
        np.log1p(n), chars * per_word, symbols * per_word, dup_lines / max(len(lines), 1), repeated * per_word,
        float(bytes_[0x41:0x5B].sum()) * per_char, float(marks[0]) * per_word, float(bytes_[0x30:0x3A].sum()) * per_char,
        distinct * per_word, top * per_word, n / max(len(lines), 1), float(marks[1:].sum()) * per_word]


def repeat_words(words: list[bytes]) -> tuple[int, int, int]:
    """Words inside a 3-word window that occurs again in the text, distinct words, and occurrences of the commonest word."""
    seen: dict[bytes, int] = {}
    code = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    top = int(np.bincount(code).max()) if len(words) else 0
    if len(words) < 4:
        return 0, len(seen), top
    v = len(seen)
    pair = code[:-1] * v + code[1:]
    if v >= 1 << 20:  # three codes no longer fit a number
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * v + code[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(window) + k] |= again
    return int(covered.sum()), v, top


@dataclass(frozen=True)
class Trees:
    """All trees as one set of node arrays; a leaf points at itself and has its value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def grow(
        x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64,
        least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosted trees for logistic loss. A class that is missing leaves a constant verdict for the other."""
    p = float(np.clip(y.mean() if len(y) else 1.0, 0.01, 0.99))
    start = float(np.log(p / (1 - p)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.array([0.0]) for j in range(len(directions))]
    place = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, len(cuts)), int)

    def leaf(v: float) -> int:
        feature.append(0), threshold.append(np.inf), left.append(len(value)), right.append(len(value)), value.append(v)
        return len(value) - 1

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, levels: int, low: float, high: float) -> int:
        whole_g, whole_h = g[rows].sum(), h[rows].sum()
        own = float(np.clip(whole_g / (whole_h + ridge), low, high))
        best = (1e-6, 0, 0, 0.0, 0.0)
        for j, direction in enumerate(directions if levels and len(rows) >= 2 * least else []):
            size = len(cuts[j]) + 1
            sums = [np.bincount(place[rows, j], weights=s, minlength=size).cumsum()[:-1] for s in (g[rows], h[rows], None)]
            a, b = (np.clip(s / (t + ridge), low, high) for s, t in ((sums[0], sums[1]), (whole_g - sums[0], whole_h - sums[1])))
            gain = (
                a * sums[0] - a * a * (sums[1] + ridge) / 2 + b * (whole_g - sums[0]) - b * b * (whole_h - sums[1] + ridge) / 2
                - own * whole_g + own * own * (whole_h + ridge) / 2)
            allowed = (sums[2] >= least) & (len(rows) - sums[2] >= least) & ((b - a) * direction >= 0)
            gain = np.where(allowed, gain, -np.inf)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), j, k, float(a[k]), float(b[k]))
        if best[0] <= 1e-6:
            return leaf(rate * own)
        _, j, k, a, b = best
        middle = (a + b) / 2
        lows, highs = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[directions[j]]
        here = leaf(0.0)
        goes_left = place[rows, j] <= k
        l, r = node(rows[goes_left], g, h, levels - 1, *lows), node(rows[~goes_left], g, h, levels - 1, *highs)
        feature[here], threshold[here], left[here], right[here] = j, float(cuts[j][k]), l, r
        return here

    score = np.full(len(x), start)
    made = Trees(np.array([], int), np.array([], int), np.array([]), np.array([], int), np.array([], int), np.array([]), start, depth)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        q = 1 / (1 + np.exp(-score))
        roots.append(node(np.arange(len(x)), y - q, np.maximum(q * (1 - q), 1e-6), depth, -4.0, 4.0))
        made = Trees(*map(np.array, (roots, feature, threshold, left, right, value)), start, depth)
        last = Trees(made.roots[-1:], made.feature, made.threshold, made.left, made.right, made.value, 0.0, depth)
        p_last = last.predict(x)
        score += np.log(p_last / (1 - p_last))
    return made


def sample(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> DataFrame:
    """Labelled documents (quality, text): of each class the ``most_per_class`` ids that come first by their hash.

    An id with several labels has the lowest quality among them; null ids and labels are left out.
    """
    by_id = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    first = None
    for good in (0, 1):
        part = by_id.where((F.col("quality") > 0) == bool(good)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class)
        first = part if first is None else first.unionAll(part)
    # 2 * most_per_class narrow rows at most: a proven bound
    return docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("doc_id", (F.col("quality") > 0).cast("int").alias("quality"), "text")


def fit(labelled: DataFrame) -> Trees:
    """Trees on the features of the sample, which the driver receives as bounded numbers."""
    schema = pa.schema([("quality", pa.int32()), ("features", pa.list_(pa.float64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield batch_of({"quality": batch.column("quality"), "features": [statistics(t)[1] for t in batch.column("text").to_pylist()]}, schema)

    got = labelled.select("quality", "text").mapInArrow(measure, "quality int, features array<double>").toArrow()
    rows = sorted(zip(got["quality"].to_pylist(), got["features"].to_pylist()))
    x = np.array([f for _, f in rows], float).reshape(len(rows), len(FEATURES))
    return grow(x, np.array([q for q, _ in rows], float), list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the base counts, base_failed, quality (probability) and kept, and without the text if so asked.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows; such documents are not kept, all
    others are when their quality is 0.5 or more. A null text is empty. Columns with the name of a new one are replaced.
    """
    kept = without(docs, *BASE, "base_failed", "quality", "kept")
    names = [c for c in kept.columns if keep_text or c != text]
    added = [*[T.StructField(n, T.LongType()) for n in BASE], T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = [statistics(t) for t in batch.column(text).to_pylist()]
            base = np.array([b for b, _ in found], np.int64)
            quality = trees.predict(np.array([f for _, f in found], float))
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MOST_REPEAT_PERCENT * base[:, 0])
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), *[pa.array(base[:, k]) for k in range(len(BASE))], pa.array(failed), pa.array(quality), pa.array(~failed & (quality >= 0.5))],
                names=[*names, *[f.name for f in added]])

    return docs.select(*[column(c) for c in kept.columns]).mapInArrow(judged, T.StructType([*[kept.schema[c] for c in names], *added]))


def screened(docs: DataFrame, labels: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` judged by trees that are fitted on a bounded sample of their ``labels``."""
    return judge(docs, fit(sample(docs, labels)), keep_text=keep_text)
