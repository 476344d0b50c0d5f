import itertools
import random

from small_pedigrees import QUAD, TWO_QUADS, ped_rows
from pyspark.sql import functions as F

from kinfold.functions import codes
from kinfold.operators import filters, pedigree, person_sets, reports, variants
from kinfold.sources import pedigree_files

THREE_GENERATIONS = """
f pgf 0 0 M unspecified none
f pgm 0 0 F unspecified none
f mgf 0 0 M unspecified none
f mgm 0 0 F unspecified none
f dad pgm pgf M unaffected none
f mom mgm mgf F unaffected none
f uncle pgm pgf M unaffected none
f uwife 0 0 F unaffected none
f cousin uwife uncle F unaffected none
f aunt mgm mgf F unaffected none
f mcousin aunt ahub M unaffected none
f ahub 0 0 M unaffected none
f prb mom dad M affected none
f sib mom dad F unaffected none
f wife 0 0 F unaffected none
f kid wife prb M unaffected none
f smom 0 0 F unaffected none
f phalf smom dad M unaffected none
f sdad 0 0 M unaffected none
f mhalf mom sdad F unaffected none
f stranger 0 0 U unspecified none
"""
WANT = {
    "pgf": "paternal_grandfather", "pgm": "paternal_grandmother", "mgf": "maternal_grandfather",
    "mgm": "maternal_grandmother", "dad": "dad", "mom": "mom", "uncle": "paternal_uncle",
    "cousin": "paternal_cousin", "aunt": "maternal_aunt", "mcousin": "maternal_cousin", "prb": "prb",
    "sib": "sib", "wife": "spouse", "kid": "child", "smom": "step_mom", "phalf": "paternal_half_sibling",
    "sdad": "step_dad", "mhalf": "maternal_half_sibling", "uwife": "unknown", "ahub": "unknown", "stranger": "unknown",
}


def test_inferred_roles(spark):
    ped = ped_rows(spark, THREE_GENERATIONS)
    got = {r["person_id"]: r["n"] for r in pedigree.infer_roles(ped).select(
        "person_id", codes.decode(codes.ROLES, F.col("inferred_role")).alias("n")).collect()}
    assert got == WANT


def test_family_without_proband_gets_unknown_roles(spark):
    ped = ped_rows(spark, "f a 0 0 M unaffected none\nf b 0 0 F unaffected none")
    assert {r[0] for r in pedigree.infer_roles(ped).select("inferred_role").collect()} == {codes.ROLES["unknown"]}


def test_trios_and_flags(spark):
    ped = ped_rows(spark, TWO_QUADS).withColumn("not_sequenced", F.col("person_id") == "dad2")
    assert {tuple(r) for r in pedigree.trios(ped).collect()} == {("f1", "prb1", "mom1", "dad1"), ("f1", "sib1", "mom1", "dad1")}
    flags = {r["person_id"]: r for r in pedigree.with_parent_flags(ped).collect()}
    assert flags["prb2"]["has_mom"] and not flags["prb2"]["has_dad"] and not flags["prb2"]["is_child"]
    assert not flags["prb2"]["is_founder"] and flags["mom2"]["is_founder"] and not flags["dad2"]["is_founder"]


def test_tags(spark):
    ped = ped_rows(spark, TWO_QUADS + "f3 mom3 0 0 F affected mom\nf3 prb3 mom3 0 M affected prb\n")
    tags = {r["family_id"]: r for r in pedigree.family_tags(ped).collect()}
    assert tags["f1"]["tag_quad_family"] and tags["f1"]["tag_nuclear_family"] and not tags["f1"]["tag_trio_family"]
    assert tags["f1"]["tag_simplex_family"] and tags["f2"]["tag_multiplex_family"]
    assert tags["f3"]["tag_missing_dad_family"] and not tags["f3"]["tag_nuclear_family"] and tags["f3"]["tag_affected_mom_family"]
    assert tags["f1"]["tag_family_type_full"] == "4:dad.M.unaffected:mom.F.unaffected:prb.F.affected:sib.M.unaffected"
    both = pedigree.tagged_family_ids(pedigree.family_tags(ped), ["tag_quad_family"], ["tag_multiplex_family"])
    assert [r[0] for r in both.collect()] == ["f1"]
    either = pedigree.tagged_family_ids(pedigree.family_tags(ped), ["tag_simplex_family"], ["tag_quad_family"], or_mode=True)
    assert {r[0] for r in either.collect()} == {"f1", "f3"}


def test_stranger_breaks_nuclear_family(spark):
    ped = ped_rows(spark, QUAD + "f1 extra 0 0 F unaffected unknown\n")
    assert not pedigree.family_tags(ped).first()["tag_nuclear_family"]


def test_combined_families(spark):
    a = ped_rows(spark, "f p 0 0 U affected prb\nf q 0 0 M unspecified sib\nf r 0 0 M affected sib\nf s 0 0 F affected sib")
    b = ped_rows(spark, "f p 0 0 M affected prb\nf q 0 0 M affected sib\nf r 0 0 F affected sib\nf t 0 0 F affected sib")
    got = {r["person_id"]: (r["sex"], r["status"]) for r in pedigree.combine_families(a, b).collect()}
    assert got == {"p": (1, 2), "q": (1, 2), "r": (2, 2), "s": (2, 2), "t": (2, 2)}
    kept = pedigree.combine_families(b, a)
    assert {r["person_id"]: r["sex"] for r in kept.collect()}["p"] == 1


def test_pedigree_reader(spark, tmp_path):
    path = tmp_path / "ped.tsv"
    path.write_text(
        "# comment\nfamilyId\tpersonId\tmomId\tdadId\tsex\tstatus\trole\tnot_sequenced\tsite\n"
        "f1\tm1\t0\t0\t2\t1\tmother\t\tA\nf1\td1\t0\t0\tmale\tunaffected\tdad\ttrue\tB\nf1\tp1\tm1\td1\tU\t2\tproband\t\t\n")
    rows = pedigree_files.read(spark, str(path)).orderBy("member_index").collect()
    assert [(r["person_id"], r["sex"], r["status"], r["role"], r["sample_id"], r["site"]) for r in rows] == [
        ("m1", 2, 1, 16, "m1", "A"), ("d1", 1, 1, 32, None, "B"), ("p1", 4, 2, 128, "p1", None)]
    assert rows[2]["mom_id"] == "m1" and rows[0]["mom_id"] is None and rows[1]["not_sequenced"]


def test_headerless_pedigree(spark, tmp_path):
    path = tmp_path / "ped.txt"
    path.write_text("f1,m1,0,0,2,1\nf1,p1,m1,0,1,2\n")
    names = {"family_id": 0, "person_id": 1, "mom_id": 2, "dad_id": 3, "sex": 4, "status": 5}
    rows = pedigree_files.read(spark, str(path), sep=",", columns=names, header=False, with_role=False).orderBy("member_index").collect()
    assert [(r["person_id"], r["mom_id"], r["sex"], r["role"]) for r in rows] == [("m1", None, 2, None), ("p1", "m1", 1, None)]


def test_simple_families(spark, tmp_path):
    path = tmp_path / "fam.tsv"
    path.write_text("familyId\tpersonId\tgender\trole\nf\tm\tF\tmom\nf\td\tM\tdad\nf\tp\tM\tprb\nf\ts\tF\tsib\n")
    rows = {r["person_id"]: r for r in pedigree_files.read_simple(spark, str(path)).collect()}
    assert rows["p"]["mom_id"] == "m" and rows["p"]["dad_id"] == "d" and rows["p"]["status"] == 2
    assert rows["s"]["status"] == 1 and rows["m"]["mom_id"] is None


def test_stored_codes(spark):
    ped = ped_rows(spark, "f a 0 0 U unspecified prb")
    stored = pedigree_files.stored(ped)
    assert tuple(stored.select("sex", "status").first()) == (0, 0)
    assert tuple(pedigree_files.loaded(stored).select("sex", "status").first()) == (4, 4)


def test_person_sets_and_reports(spark):
    ped = ped_rows(spark, TWO_QUADS)
    diagnosis = person_sets.Collection(
        "status", "Status", (("pedigree", "status"),), (person_sets.PersonSet("aff", "affected", ("affected",)),),
        person_sets.PersonSet("rest", "rest", ()))
    sets = person_sets.assign(ped, diagnosis)
    assert {(r["set_id"], r["people_total"]) for r in reports.people_counters(sets).collect()} == {("aff", 3), ("rest", 5)}
    assert {r["counter"] for r in reports.people_counter_rows(reports.people_counters(sets)).collect()} == {
        "people_male", "people_female", "people_total"}
    stats = {r["set_id"]: (r["male"], r["female"], r["total"]) for r in person_sets.children_by_sex(sets).collect()}
    assert stats == {"aff": (1, 2, 3), "rest": (1, 0, 1)}
    types = reports.family_type_counters(reports.family_types(ped, sets)).collect()
    assert [t["pedigrees_count"] for t in types] == [1, 1]
    assert types[0]["family_type"].startswith("4:")


def test_attribute_queries():
    two = person_sets.Collection(
        "c", "c", (("pedigree", "sex"), ("pedigree", "role")),
        (person_sets.PersonSet("a", "a", ("M", "prb")), person_sets.PersonSet("b", "b", ("F", "sib")),
         person_sets.PersonSet("c", "c", ("F", "prb"))), person_sets.PersonSet("d", "d", ()))
    assert person_sets.attribute_queries(two, ["a"]) == {"sexes": "any([M])", "roles": "any([prb])"}
    assert person_sets.attribute_queries(two, ["a", "c"]) == {"sexes": "any([F,M])", "roles": "any([prb])"}
    assert person_sets.attribute_queries(two, ["a", "b"]) is None
    assert person_sets.attribute_queries(two, ["a", "d"]) is None
    assert person_sets.attribute_queries(two, ["a", "b", "c"], default_empty=True) == {}


def merged_plain(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_merged_intervals_against_plain_python(spark):
    rng = random.Random(3)
    spans = [(k, a, a + rng.choice([0, 3, 9, 60])) for k in "xy" for a in (rng.randrange(0, 900) for _ in range(120))]
    df = spark.createDataFrame(spans, "key string, begin long, finish long")
    for block in (10, 64, 100_000):
        got = sorted(tuple(r) for r in filters.merge_intervals(df, block).collect())
        want = [(k, a, b) for k in "xy" for a, b in merged_plain([(a, b) for q, a, b in spans if q == k])]
        assert got == want, block


def test_region_join_against_plain_python(spark):
    rng = random.Random(5)
    variants_ = [(f"c{rng.randrange(2)}", p, p + rng.choice([0, 0, 0, 5, 400]), i) for i, p in enumerate(rng.randrange(1, 3000) for _ in range(300))]
    regions = [(f"c{rng.randrange(2)}", a, a + rng.choice([1, 30, 700])) for a in (rng.randrange(1, 3000) for _ in range(12))]
    df = spark.createDataFrame(variants_, "chromosome string, position int, end_position int, i int")
    rdf = spark.createDataFrame(regions, "chrom string, start long, stop long")
    got = sorted(r["i"] for r in filters.join_regions(df, rdf, bin_length=100).collect())
    want = sorted(i for c, p, e, i in variants_ if any(c == rc and e >= a and p <= b for rc, a, b in regions))
    assert got == want
    few = [filters.Region(*r) for r in regions]
    assert sorted(r["i"] for r in df.filter(filters.in_regions(few)).collect()) == want


def test_running_index_is_dense_and_ordered(spark):
    rng = random.Random(7)
    rows = [("a" if rng.random() < 0.8 else "b", rng.randrange(1, 50_000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "bucket string, position int, i int")
    got = variants.running_index(df, "bucket", "position", ["i"], "n", block=1000).collect()
    for bucket in "ab":
        mine = sorted((r for r in got if r["bucket"] == bucket), key=lambda r: r["n"])
        assert [r["n"] for r in mine] == list(range(len(mine)))
        assert [(r["position"], r["i"]) for r in mine] == sorted((r["position"], r["i"]) for r in mine)


def test_open_regions_are_closed_intervals(spark):
    df = spark.createDataFrame([("c", 10, None), ("c", 20, None), ("c", 5, 12)], "chromosome string, position int, end_position int")
    at = lambda *r: sorted(x["position"] for x in df.filter(filters.in_regions([filters.Region(*r)])).collect())
    assert at("c", 10, None) == [5, 10, 20]
    assert at("c", None, 10) == [5, 10]
    assert at("c", 12, 12) == [5]
    assert at("d") == []
    assert df.filter(filters.in_regions([])).count() == 0


def test_withdrawn_person_kept_in_another_family(spark):
    ped = ped_rows(spark, "f1 a 0 0 M affected prb\nf2 a 0 0 M affected prb\nf1 b 0 0 F unaffected sib")
    gone = spark.createDataFrame([("f1",)], "family_id string")
    values = spark.createDataFrame([("a", 1), ("b", 2)], "person_id string, v int")
    assert [r["person_id"] for r in pedigree.without_persons(values, ped, gone).collect()] == ["a"]


def test_all_subsets_of_categorical_filters(spark):
    df = spark.createDataFrame([("x",), (None,), ("y",)], "c string")
    assert df.filter(filters.categorical_attribute("c", None)).count() == 1
    assert df.filter(filters.categorical_attribute("c", [])).count() == 2
    for n in range(1, 3):
        for values in itertools.combinations(["x", "y"], n):
            assert df.filter(filters.categorical_attribute("c", list(values))).count() == n
