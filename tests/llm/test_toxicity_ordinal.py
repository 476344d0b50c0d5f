import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import toxicity_ordinal

BAD = ["vileword", "nastything", "awfulname"]


def made(n, seed):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{min(int(draw.expovariate(0.01)), 900)}" for _ in range(draw.randint(5, 120))]
        bad = draw.choice([0, 0, 1, 4, 9])
        for _ in range(bad):
            words.insert(draw.randrange(len(words)), draw.choice(BAD))
        rows.append((i, " ".join(words).title() if i % 3 else " ".join(words)))
        labels.append((i, int(bad > 0)))
    return rows, labels


def test_held_out_accuracy_and_severity(spark, docs_of):
    rows, labels = made(900, 1)
    frame = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity_ordinal.fit(toxicity_ordinal.sample(docs_of(rows[:600]), frame, (300, 300)))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity_ordinal.score(docs_of(rows[600:]), model).collect()}
    truth = dict(labels)
    assert np.mean([r.rejected == bool(truth[i]) for i, r in got.items()]) > 0.97
    hits = {i: sum(t.lower().count(w) for w in BAD) for i, t in rows[600:]}
    means = [np.mean([r.expected_severity for i, r in got.items() if hits[i] == h]) for h in (0, 1, 4, 9)]
    assert means == sorted(means) and means[0] < 0.3 and means[3] > 2


def test_the_sample_is_bounded_and_takes_one_label_per_document(spark, docs_of):
    rows, _ = made(60, 2)
    labels = [(i, i % 2) for i in range(60)] + [(0, 1), (None, 1), (1, None)]
    drawn = toxicity_ordinal.sample(docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"), (7, 9)).collect()
    assert sorted(r.toxic for r in drawn) == [0] * 7 + [1] * 9


def test_edges(spark, docs_of):
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    docs = docs_of([(1, None), (2, ""), (2, ""), (None, "word " * 30000)]).withColumn("REJECTED", F.lit("x"))
    for some in (labels, labels.limit(0)):
        got = toxicity_ordinal.graded(docs, some).collect()
        assert len(got) == 4 and not any(r.rejected for r in got) and all(r.expected_severity < 1e-9 for r in got)
    assert toxicity_ordinal.graded(docs.limit(0), labels).count() == 0


def test_expected_severity_is_the_sum_of_the_threshold_probabilities():
    model = toxicity_ordinal.Model(np.zeros(1, np.float32), np.array([0.0, 1.0, 2.0]))
    assert model.expected(np.array([1.0]))[0] == pytest.approx(sum(1 / (1 + np.exp(t - 1)) for t in (0, 1, 2)))


def test_toxic_documents_of_a_small_table_are_rejected(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    insult = re.compile(r"\b(trash|idiot|clown|scum|worthless|moron|pathetic|loser|disgusting|stupid)\b")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity_ordinal.graded(docs, labels).collect()
    rude = {r.doc_id for r in rows if insult.search(r.text.lower())}
    gone = {r.doc_id for r in rows if r.rejected}
    assert len(rude) == 9 and len(rude & gone) >= 8 and not any(toxic.get(i) == 0 for i in gone)


def test_a_rare_insult_tells_also_where_the_sample_holds_few(spark, docs_of):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{draw.randrange(300)}" for _ in range(20)]
        toxic = i % 10 == 0
        words += ["vileword"] * (toxic and i % 50 > 0) + ["seltenwort"] * (toxic and i % 50 == 0)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, frame = docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    some = toxicity_ordinal.sample(docs, frame, (60, 30))
    assert 0 < some.where(F.col("text").contains("seltenwort")).count() < 8
    model = toxicity_ordinal.fit(some, every=(docs, frame))
    got = toxicity_ordinal.score(docs_of([(1, "w1 w2 seltenwort"), (2, "w1 w2 vileword"), (3, "w1 w2 w3")]), model).collect()
    assert {r.doc_id: r.rejected for r in got} == {1: True, 2: True, 3: False}


def test_words_of_chance_do_not_tell():
    found = toxicity_ordinal.Holders(100, 900, np.array([100, 6, 2, 30]), np.array([0, 0, 0, 400]))
    chance = toxicity_ordinal.telling(found, np.concatenate([found.bad + found.good, np.full(50000, 2)]))
    assert chance.tolist() == [True, True, False, False]


def test_a_repeated_id_is_read_once_and_only_telling_words_reach_the_driver(spark, docs_of):
    rows = [(i, f"plain{i} words{i} " + "vileword " * (i % 2)) for i in range(40)] + [(1, f"text {i}") for i in range(300)]
    frame = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    drawn = toxicity_ordinal.sample(docs_of(rows), frame)
    assert drawn.count() == 40
    tells = toxicity_ordinal.told(drawn)
    toxic, row, found, counts = toxicity_ordinal.design(drawn, tells)
    assert len(toxic) == 40 and set(found) == set(toxicity_ordinal.features("vileword")) and len(row) == len(counts) <= 40
