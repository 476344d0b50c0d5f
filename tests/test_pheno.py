import math
import random

import pytest
from small_pedigrees import TWO_QUADS, ped_rows
from pyspark.sql import functions as F

from kinfold.functions import stats
from kinfold.operators import pheno


def report(spark, values, **config):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "person_id string, m string")
    return pheno.measure_report(pheno.long_values(df, ["m"]), pheno.Inference(**config)).first()


@pytest.mark.parametrize("values,kind,measure,unique,domain", [
    ([str(i) for i in range(12)], "int", "continuous", 12, "0, 11"),
    (["1", "2", "2"], "int", "ordinal", 2, "1, 2"),
    (["1", "2.5", None, ""], "float", "ordinal", 2, "1.0, 2.5"),
    (["a", "b", "a"], "str", "categorical", 2, "a, b"),
    ([f"v{i:02}" for i in range(30)], "str", "raw", 30, ", ".join(f"v{i:02}" for i in range(20))),
    (["1"] * 30 + ["x"], "int", "ordinal", 1, "1, 1"),
    (["1"] * 10 + ["x"], "str", "categorical", 2, "1, x"),
    (["True", "False"], "float", "ordinal", 2, "0.0, 1.0"),
    ([None, ""], "int", "raw", 0, ""),
    ([" 3 ", "+4", "-5"], "int", "ordinal", 3, "-5, 4"),
])
def test_inference(spark, values, kind, measure, unique, domain):
    r = report(spark, values)
    assert (r["value_type"], r["measure_type"], r["count_unique_values"], r["values_domain"]) == (kind, measure, unique, domain)
    assert r["count_total"] == len(values)


def test_forced_types(spark):
    assert report(spark, ["1", "2"], value_type="str")["measure_type"] == "categorical"
    assert report(spark, ["1", "2"], histogram_type="number")["measure_type"] == "continuous"
    assert report(spark, ["1"], min_individuals=5)["measure_type"] == "raw"


def test_left_joins_equal_full_outer_joins(spark):
    a = spark.createDataFrame([("p1", 1), ("p2", 2)], "person_id string, x int")
    b = spark.createDataFrame([("p2", 5), ("p3", 6)], "person_id string, y int")
    got = sorted(tuple(r) for r in pheno.measure_values({"a": a, "b": b}, ["a.x", "b.y"]).collect())
    full = sorted(tuple(r) for r in a.join(b, "person_id", "full").collect())
    assert got == full == [("p1", 1, None), ("p2", 2, 5), ("p3", None, 6)]


def test_partitions_differ_at_the_upper_bound(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(None,)], "v double")
    closed, half = (pheno.partitions(df, "v", 2.0, 4.0, closed=c).first() for c in (True, False))
    assert (closed["left_count"], closed["mid_count"], closed["right_count"]) == (1, 3, 0)
    assert (half["left_count"], half["mid_count"], half["right_count"]) == (1, 2, 1)
    assert closed["left_percent"] == 0.2
    open_ended = pheno.partitions(df, "v", None, None, closed=True).first()
    assert open_ended["mid_count"] == 4


def test_histogram(spark):
    np = pytest.importorskip("numpy")
    rng = random.Random(2)
    values = [rng.gauss(0, 3) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    rows = sorted(pheno.numeric_histogram(df, "v").collect(), key=lambda r: r["bin"])
    bars, edges = np.histogram(values, 25)
    assert [r["bar"] for r in rows] == list(bars)
    assert rows[0]["bin_start"] == pytest.approx(edges[0]) and rows[-1]["bin_end"] == pytest.approx(edges[-1])
    same = sorted(pheno.numeric_histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v").collect(), key=lambda r: r["bin"])
    assert [r["bar"] for r in same] == list(np.histogram([2.0] * 3, 25)[0])


def test_log_scale(spark):
    h = spark.createDataFrame([(1,), (5,), (100,)], "bar long")
    assert pheno.needs_log_scale(h, "bar", numeric=True).first()[0]
    assert not pheno.needs_log_scale(spark.createDataFrame([(50,), (100,)], "bar long"), "bar", numeric=False).first()[0]


def test_association_against_numpy(spark):
    np = pytest.importorskip("numpy")
    rng = random.Random(4)
    people = [(f"p{i}", 1 + i % 2, rng.gauss(10, 2), rng.gauss(0, 1), rng.gauss(5, 3)) for i in range(200)]
    df = spark.createDataFrame(people, "person_id string, sex int, `i.y` double, `i.a` double, `i.b` double")
    hit = {f"p{i}" for i in range(200) if rng.random() < 0.3}
    carriers = spark.createDataFrame([("e", p) for p in hit] + [("one", "p0")], "effect string, person_id string")
    normal = pheno.normalized(df, "i.y", ["i.a", "i.b"])
    x = np.column_stack([np.ones(200), [p[3] for p in people], [p[4] for p in people]])
    y = np.array([p[2] for p in people])
    resid = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = {r["person_id"]: r["normalized"] for r in normal.collect()}
    assert all(got[p[0]] == pytest.approx(r, abs=1e-9) for p, r in zip(people, resid))
    result = {(r["effect"], r["sex"]): r for r in pheno.association(normal, carriers, ["e", "one", "none"]).collect()}
    for sex, name in ((1, "M"), (2, "F")):
        pos = np.array([r for p, r in zip(people, resid) if p[1] == sex and p[0] in hit])
        neg = np.array([r for p, r in zip(people, resid) if p[1] == sex and p[0] not in hit])
        r = result[("e", name)]
        n1, n0 = len(pos), len(neg)
        pooled = (pos.var() * n1 + neg.var() * n0) / (n1 + n0 - 2)
        t = (pos.mean() - neg.mean()) / math.sqrt(pooled * (1 / n1 + 1 / n0))
        assert (r["positive_count"], r["negative_count"]) == (n1, n0)
        assert r["positive_mean"] == pytest.approx(pos.mean()) and r["negative_mean"] == pytest.approx(neg.mean())
        assert r["positive_deviation"] == pytest.approx(1.96 * pos.std() / math.sqrt(n1))
        assert r["negative_deviation"] == pytest.approx(1.96 * neg.std() / math.sqrt(n0))
        assert r["t"] == pytest.approx(t) and r["pvalue"] == pytest.approx(stats.t_two_sided(t, n1 + n0 - 2))
        nobody = result[("none", name)]
        assert nobody["positive_count"] == 0 and nobody["positive_mean"] == 0 and nobody["pvalue"] is None
    assert result[("one", "M")]["pvalue"] is None  # one carrier cannot be tested
    filled = {(r["effect"], r["sex"]): r for r in pheno.aligned(pheno.association(normal, carriers, ["none"])).collect()}
    assert filled[("none", "F")]["positive_mean"] == filled[("none", "F")]["negative_mean"]


def test_regression_against_numpy(spark):
    np = pytest.importorskip("numpy")
    rng = random.Random(6)
    rows = [(f"p{i}", 1 if i < 40 else 2, float(np.float32(rng.uniform(1, 50))), 0.0) for i in range(42)]
    rows = [(p, s, x, 2 * x + rng.gauss(0, 5)) for p, s, x, _ in rows]
    df = spark.createDataFrame(rows, "person_id string, sex int, `i.age` double, `i.y` double")
    got = {r["sex"]: r for r in pheno.regression_by_sex(df, "i.y", "i.age").collect()}
    x = np.array([r[2] for r in rows if r[1] == 1])
    y = np.array([r[3] for r in rows if r[1] == 1])
    slope, intercept = np.polyfit(x, y, 1)
    resid = y - slope * x - intercept
    error = math.sqrt(resid @ resid / (len(x) - 2) / ((x - x.mean()) ** 2).sum())
    assert got["M"]["slope"] == pytest.approx(slope) and got["M"]["t"] == pytest.approx(slope / error)
    assert got["M"]["pvalue"] == pytest.approx(stats.t_two_sided(slope / error, len(x) - 2))
    assert got["F"]["pvalue"] is None  # two rows are too few
    few = pheno.regression_by_sex(df.limit(5), "i.y", "i.age").collect()
    assert all(r["pvalue"] is None for r in few)


def test_keyword_wildcards_are_plain_text(spark):
    df = spark.createDataFrame([("i", "a_b", "i.a_b"), ("i", "axb", "i.axb"), ("i", "c%d", "i.c%d"), ("j/k", "z", "j/k.z"), ("q", "e\\f", "q.e\\f")],
                               "instrument_name string, measure_name string, measure_id string")
    names = lambda k, i=None: {r["measure_name"] for r in pheno.matching(df, k, i).collect()}
    assert names("A_B") == {"a_b"} and names("%") == {"c%d"} and names("/K") == {"z"}
    assert names("i", "i") == {"a_b", "axb", "c%d"}  # every id of the instrument contains it
    assert names("it's") == set() and names("E\\F") == {"e\\f"}


def test_family_measure_uses_the_last_person(spark):
    ped = ped_rows(spark, TWO_QUADS + "f1 prb1b mom1 dad1 F affected prb\n")
    values = spark.createDataFrame([("prb1", 1.0), ("prb1b", 2.0), ("prb2", 3.0)], "person_id string, `i.m` double")
    got = {r[0]: r[1] for r in pheno.family_measure(values, ped, "i.m", "prb").collect()}
    assert got == {"f1": 2.0, "f2": 3.0}


def test_typed_values(spark):
    df = spark.createDataFrame([("p", "1", "x", " "), ("q", "oops", "True", "t")], "person_id string, a string, b string, c string")
    rows = [tuple(r) for r in pheno.typed_values(df, {"a": "int", "b": "float", "c": "str"}).collect()]
    assert rows == [("p", 1, None, None), ("q", None, 1.0, "t")]


def test_repeated_measures_are_marked(spark):
    one = spark.createDataFrame([("a",), ("b",)], "measure_id string")
    marked = {(r[0], r[1]) for r in pheno.merge_catalogues([one, one.filter("measure_id = 'a'")]).select("measure_id", "repeated").collect()}
    assert marked == {("a", True), ("b", False)}
    assert one.select(F.lit(pheno.association_title("i.m", ["i.a", "i.b"]))).first()[0] == "i.m ~ i.a + i.b"
