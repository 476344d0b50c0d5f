import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import quality_trees


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)]


def test_base_counts():
    draw = random.Random(4)
    texts = [None, "", "\n \n", "a b c", "a b c a b c", "x\x1cy z\x85w", "é#é\n é#é\né#é", "a a a a a", "ß\tß\x0bß\r\n" * 50]
    texts += ["".join(draw.choice(["a ", "b ", "cc ", "d\n", "#| ", "é "]) for _ in range(draw.randint(0, 60))) for _ in range(150)]
    for text in texts:
        assert quality_trees.statistics(text)[0] == brute(text), text


def test_many_distinct_words():
    words = [str(i).encode() for i in range(1 << 20)]
    assert quality_trees.repeat_words(words + words[:3]) == (6, 1 << 20, 2)


def test_trees_keep_to_their_directions_and_fit():
    draw = np.random.default_rng(1)
    x = draw.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * draw.standard_normal(3000)) > 0.6).astype(float)
    trees = quality_trees.grow(x[:2000], y[:2000], [1, 0, -1])
    assert ((trees.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    for feature, sign in ((0, 1), (2, -1)):
        probe = np.repeat(draw.random((200, 1, 3)), 30, axis=1)
        probe[:, :, feature] = np.linspace(0, 1, 30)
        along = trees.predict(probe.reshape(-1, 3)).reshape(200, 30)
        assert (sign * np.diff(along, axis=1) >= -1e-12).all()


def test_one_class_or_none():
    for y in (np.ones(50), np.zeros(50), np.zeros(0)):
        trees = quality_trees.grow(np.zeros((len(y), 2)), y, [0, 0])
        assert ((trees.predict(np.zeros((3, 2))) > 0.5) == (len(y) == 0 or bool(y[0]))).all()


def test_verdicts(spark, docs_of):
    good = lambda k: " ".join(f"plain{(i * 7 + k * 13) % 211}" for i in range(100))
    bad = lambda k: " ".join(f"JUNK{(i * 5 + k) % 199}###" for i in range(100))
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(1, None), (None, 0)], "doc_id bigint, quality int")
    more = [(900, None), (901, ""), (902, "too short"), (902, "too short"), (903, "same words again " * 40000), (None, good(3))]
    docs = docs_of(rows + more).withColumn("KEPT", F.lit("x"))
    got = quality_trees.screened(docs, labels).collect()
    assert len(got) == 206
    assert all(r.kept == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert all(r.base_failed and not r.kept for r in got if r.doc_id is not None and r.doc_id >= 900)
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert quality_trees.screened(docs.limit(0), labels).count() == 0
    assert quality_trees.screened(docs, labels.limit(0)).count() == 206
