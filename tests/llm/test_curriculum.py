import random

import pytest
from pyspark.sql import functions as F

from kinfold.llm import curriculum

SCHEMA = "doc_id bigint, source string, size bigint"


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop what is above, share the rest again, until nothing is above."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    stopped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {**stopped, **share}
        stopped.update((s, most * sizes[s]) for s in above)


def test_targets(spark):
    draw = random.Random(3)
    for n in (1, 2, 5, 30):
        sizes = {f"s{i}" if i else None: draw.choice([0, 1, 10, 1000, 50000]) for i in range(n)}
        rows = spark.createDataFrame([(s, x) for s, x in sizes.items()], "source string, size bigint")
        got = {r.source: r.target for r in curriculum.targets(rows).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_schedules_and_their_inverse(spark):
    for knots in curriculum.SCHEDULES + (((0.0, 0.0), (0.3, 2.0), (1.0, 0.0)), ((0.0, 1.0), (0.5, 0.0), (0.6, 0.0), (1.0, 1.0))):
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("part"))
        found = rows.select("part", curriculum.due(F.col("part"), knots).alias("t")).select("part", "t", curriculum.demand(F.col("t"), knots).alias("back")).collect()
        assert all(r.back == pytest.approx(r.part, abs=1e-9) for r in found)
        assert [r.t for r in found] == sorted(r.t for r in found) and 0 <= found[0].t and found[-1].t == pytest.approx(1)
    with pytest.raises(ValueError):
        curriculum._segments([(0.0, 1.0), (0.9, 1.0)])


def made(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice(["a", "a", "a", "b", "c", "d", None]), draw.choice([0, 1, 7, 300])) for i in range(400)] + [(None, "a", 9), (None, None, 5), (5, "b", None), (5, "b", 7), (5, "b", 7)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_plan_takes_targets_in_md5_order(spark):
    rows, frame = made(spark)
    got = curriculum.plan(frame.withColumn("TAKEN", F.lit(0))).collect()
    again = curriculum.plan(frame.repartition(3)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    want = brute_targets({s: sum(x or 0 for _, t, x in rows if t == s) for s in {r[1] for r in rows}})
    for source, target in want.items():
        mine = [r for r in got if r.source == source]
        assert sum(r.taken for r in mine) == pytest.approx(target, abs=1) and all(r.target == pytest.approx(target) for r in mine)
        assert all(r.taken <= 3 * (r.size or 0) and r.taken == sum(o.words for o in r.occurrences) for r in mine)


def test_stream_follows_the_schedules(spark):
    rows = [(i, s, 10) for s in ("a", "b", "c") for i in range(ord(s) * 1000, ord(s) * 1000 + 300)]
    frame = curriculum.stream(curriculum.plan(spark.createDataFrame(rows, SCHEMA)))
    got = frame.collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and got[-1].position < 9000
    early = [sum(r.source == s for r in got[:len(got) // 4]) / sum(r.source == s for r in got) for s in ("a", "b", "c")]
    assert early[0] > early[1] > early[2]  # falling, flat and rising
    assert len(curriculum.stream(curriculum.plan(spark.createDataFrame(rows, SCHEMA)), whole=True).collect()) == pytest.approx(900, abs=3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert curriculum.plan(none).count() == 0 and curriculum.stream(curriculum.plan(none)).count() == 0
    blank = curriculum.plan(spark.createDataFrame([(1, "a", 0), (2, None, None)], SCHEMA)).collect()
    assert [r.taken for r in blank] == [0, 0]
