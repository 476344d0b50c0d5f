"""Enrichment, gene sets and profiles against plain Python on small random events."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.functions import stats
from kinfold.operators import enrichment, gene_sets

GENES = ["A", "B", "C", "D"]
GROUPS = ["LGDs", "Missense"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(9)
    events = []
    for i in range(150):
        family = f"f{rng.randrange(12)}"
        carriers = [p for p in (f"{family}.p", f"{family}.s") if rng.random() < 0.7] or [f"{family}.p"]
        genes = [(rng.choice(GENES).lower(), rng.choice(["nonsense", "missense", "intron"])) for _ in range(rng.choice([1, 1, 2]))]
        events.append((family, i, carriers, genes))
    rows = [(f, f"{f}.{i}", "c", i, "r", "a", c, g, c, [4] * len(c)) for f, i, c, g in events]
    denovo = spark.createDataFrame(rows, (
        "family_id string, fvuid string, chromosome string, position int, reference string, site_alternative string, "
        "allele_in_members array<string>, effect_gene array<struct<effect_gene_symbols:string,effect_types:string>>, "
        "member_ids array<string>, inheritance_by_member array<int>"))
    people = [(f"f{k}", f"f{k}.{r}", 1 if (k + (r == "s")) % 3 else (2 if k % 2 else 4), "x" if r == "p" else "y") for k in range(12) for r in "ps"]
    sets = spark.createDataFrame(
        [("c", s, f, p, sex, 2, 128, True) for f, p, sex, s in people],
        "psc_id string, set_id string, family_id string, person_id string, sex int, status int, role int, is_child boolean")
    return events, people, denovo, sets


def plain_counts(events, people, set_id, effects, gene_set):
    out = {}
    for group, sexes in (("all", {1, 2, 4}), ("male", {1}), ("female", {2}), ("unspecified", {4})):
        chosen = {p for _, p, sex, s in people if s == set_id and sex in sexes}
        seen, counted, hit, genes, families = set(), 0, 0, set(), defaultdict(set)
        for family, _, carriers, gs in events:
            if not chosen & set(carriers):
                continue
            symbols = {g.upper() for g, e in gs if e in effects}
            genes |= symbols
            for g in symbols:
                families[g].add(family)
            fresh = {g for g in symbols if (family, g) not in seen}
            if fresh:
                seen |= {(family, g) for g in fresh}
                counted += 1
                hit += bool(fresh & gene_set)
        out[group] = (counted, hit, len(genes), len(genes & gene_set))
        if group == "all":
            rec = {g for g, f in families.items() if len(f) > 1}
            out["rec"] = (len(rec), len(rec & gene_set), len(rec), len(rec & gene_set))
    return out


def test_event_counts(spark, data):
    events, people, denovo, sets = data
    gene_set = {"A", "C"}
    genes = spark.createDataFrame([("a",), ("C",)], "gene string")
    grouped = enrichment.grouped_events(enrichment.denovo_events(denovo), sets, GROUPS)
    tables = {c: {
        (r["set_id"], r["effect_group"], r["counted"]): (r["events"], r["overlapped"])
        for r in enrichment.full_matrix(enrichment.event_counts(grouped, genes, c), sets, GROUPS).collect()} for c in ("events", "genes")}
    for set_id in "xy":
        for group, effects in (("LGDs", {"nonsense"}), ("Missense", {"missense"})):
            want = plain_counts(events, people, set_id, effects, gene_set)
            for name, (e, eo, g, go) in want.items():
                assert tables["events"][(set_id, group, name)] == (e, eo), (set_id, group, name)
                assert tables["genes"][(set_id, group, name)] == (g, go), (set_id, group, name)


def test_p_values(spark, data):
    _, _, denovo, sets = data
    genes = spark.createDataFrame([("A",), ("C",)], "gene string")
    grouped = enrichment.grouped_events(enrichment.denovo_events(denovo), sets, GROUPS)
    matrix = enrichment.full_matrix(enrichment.event_counts(grouped, genes, "events"), sets, GROUPS)
    weights = spark.createDataFrame([("A", 1.0), ("B", 3.0), ("C", 2.0), ("D", 4.0)], "gene string, gene_weight double")
    for r in enrichment.gene_weight_test(matrix, weights, genes).collect():
        assert r["expected"] == pytest.approx(0.3 * r["events"])
        want = 1.0 if r["overlapped"] == 0 else stats.binomial_two_sided(r["overlapped"], r["events"], 0.3)
        assert r["pvalue"] == pytest.approx(want)
    rates = spark.createDataFrame([("A", 1.0, 1.5, 0.2, 0.3), ("B", 1.0, 1.0, 9.0, 9.0)], "gene string, M double, F double, P_LGDS double, P_MISSENSE double")
    rows = {(r["set_id"], r["effect_group"], r["counted"]): r for r in enrichment.mutation_rate_test(matrix, rates, genes).collect()}
    for (set_id, group, name), r in rows.items():
        p = 0.2 if group == "LGDs" else 0.3
        full = p * (r["male"] + r["unspecified"]) + 1.5 * p * r["female"]
        everything, recurrent = rows[(set_id, group, "all")]["events"], rows[(set_id, group, "rec")]["events"]
        want = {"all": full, "male": p * r["male"], "female": 1.5 * p * r["female"], "unspecified": 0.0,
                "rec": full * recurrent / everything if everything and recurrent else 0.0}[name]
        assert r["expected"] == pytest.approx(want)
        if name == "unspecified":
            assert (r["events"], r["overlapped"], r["pvalue"]) == (0, 0, 1.0)
        else:
            assert r["pvalue"] == pytest.approx(stats.poisson_two_sided(r["overlapped"], want))


def test_denovo_gene_sets(spark, data):
    events, people, denovo, sets = data
    cache = gene_sets.denovo_cache(denovo, sets, {"LGDs": ["lgds"], "Missense": ["missense"]})
    by_person = {p: (sex, s) for _, p, sex, s in people}
    families = defaultdict(set)
    for family, _, carriers, gs in events:
        for p in carriers:
            sex, set_id = by_person[p]
            for g, e in gs:
                if e == "nonsense" and sex == 1 and set_id == "x":
                    families[g].add(family)
    for name, keep in (("Single", lambda n: n == 1), ("Recurrent", lambda n: n >= 2), ("Triple", lambda n: n >= 3), (None, lambda n: True)):
        got = {r["gene"]: r["families"] for r in gene_sets.denovo_gene_set(cache, "c", ["x"], ["LGDs"], ["Male"], name).collect()}
        assert got == {g: len(f) for g, f in families.items() if keep(len(f))}
    rows = gene_sets.all_denovo_gene_sets({"s": cache}, {"s": {"c": ["x"]}}, ["LGDs.Male", "LGDs.Male.Triple"]).collect()
    assert {r["gene"]: r["families"] for r in rows if r["name"] == "LGDs.Male"} == {g: len(f) for g, f in families.items()}
    assert {r["gene"] for r in rows if r["name"] == "LGDs.Male.Triple"} == {g for g, f in families.items() if len(f) >= 3}


def test_gene_score_filter(spark):
    scores = spark.createDataFrame([("A", "s", 1.0), ("B", "s", 2.0), ("C", "t", 1.0), ("D", "s", 0.0)], "gene string, score_id string, value double")
    names = lambda **k: sorted(r[0] for r in gene_sets.by_score(scores, "s", **k).collect())
    assert names(low=1.0) == ["A", "B"] and names(high=1.0) == ["A", "D"] and names(values=[2.0, 0.0]) == ["B", "D"]
    assert scores.filter(F.col("score_id") == "t").count() == 1
