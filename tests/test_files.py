import pytest
from small_pedigrees import QUAD, TWO_QUADS, ped_rows
from pyspark.sql import functions as F

from kinfold.functions import genotypes
from kinfold.operators import variants
from kinfold.plans import browser, imports
from kinfold.plans import study as plan
from kinfold.sources import call_tables, exports, liftover, side_tables, vcf

HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def write_vcf(path, samples, lines):
    body = "".join(
        "\t".join([c, str(p), ".", r, a, ".", ".", ".", "GT", *g.split()]) + "\n" for c, p, r, a, g in lines)
    path.write_text(HEADER + "\t".join(samples) + "\n" + body)
    return str(path)


def texts(sites, calls):
    rows = calls.join(sites, ["bucket_index", "summary_index"]).select(
        "chromosome", "position", "family_id", genotypes.genotype_text(F.col("members")).alias("g")).collect()
    return {(r["chromosome"], r["position"], r["family_id"]): r["g"] for r in rows}


def test_vcf_reader(spark, tmp_path):
    ped = ped_rows(spark, TWO_QUADS)
    people = ["mom1", "dad1", "prb1", "sib1", "mom2", "dad2", "prb2"]
    path = write_vcf(tmp_path / "a.vcf", [*people, "nobody"], [
        ("chr1", 10, "A", "C,G", "0/0 0/0 0/1 0|2 0/0 ./. 1/1 0/0"),
        ("chrX", 20, "A", "T", "0/1 1 0 0 0/0 0 0 0"),
        ("HLA-A", 5, "A", "T", "0/1 0/1 0/1 0/1 0/1 0/1 0/1 0/1")])
    sites, calls, matched, odd = vcf.read(spark, [[path]], ped, skip_contigs="HLA")
    got = texts(sites, calls)
    assert got[("chr1", 10, "f1")] == "0/0;0/0;0/1;0/2"
    assert got[("chr1", 10, "f2")] == "0/0;./.;1/1;./."  # sib2 has no sample
    assert got[("chrX", 20, "f1")] == "0/1;1/.;0/.;0/."
    assert not any(c.startswith("HLA") for c, _, _ in got)
    assert odd.count() == 0
    assert any(c.startswith("HLA") for c, _, _ in texts(*vcf.read(spark, [[path]], ped)[:2]))
    _, calls_ref, _, _ = vcf.read(spark, [[path]], ped, fill=0, skip_contigs="HLA")
    assert texts(sites, calls_ref)[("chr1", 10, "f2")] == "0/0;./.;1/1;0/0"
    _, calls_free, free, _ = vcf.read(spark, [[path]], ped, fixed_pedigree=False, skip_contigs="HLA")
    assert texts(sites, calls_free)[("chr1", 10, "f2")] == "0/0;./.;1/1"
    assert [r[0] for r in free.filter("not_sequenced").select("person_id").collect()] == ["sib2"]


def test_vcf_batches(spark, tmp_path):
    ped = ped_rows(spark, TWO_QUADS)
    one = write_vcf(tmp_path / "one.vcf", ["mom1", "dad1", "prb1", "sib1"], [("chr1", 10, "A", "C", "0/1 0/0 0/1 0/0")])
    chr2 = write_vcf(tmp_path / "one2.vcf", ["mom1", "dad1", "prb1", "sib1"], [("chr2", 7, "G", "T", "0/0 0/0 0/1 0/0")])
    two = write_vcf(tmp_path / "two.vcf", ["prb1", "mom2", "dad2", "prb2", "sib2"], [
        ("chr1", 10, "A", "T", "1/1 0/0 0/1 0/0 0/0"), ("chr1", 11, "C", "G", "0/0 0/0 0/1 0/0 0/0")])
    sites, calls, _, _ = vcf.read(spark, [[one, chr2], [two]], ped)
    got = texts(sites, calls)
    assert got[("chr1", 10, "f1")] == "0/1;0/0;0/1;0/0"  # first batch wins for prb1
    assert got[("chr1", 10, "f2")] == "0/0;0/1;0/0;0/0"
    assert got[("chr1", 11, "f1")] == "./.;./.;0/0;./."
    assert got[("chr2", 7, "f1")] == "0/0;0/0;0/1;0/0"
    shapes = {(r["chromosome"], r["position"]): r["alternatives"] for r in sites.collect()}
    assert shapes[("chr1", 10)] == ["C"]


def test_vcf_batches_filled_as_reference_count_absent_families(spark, tmp_path):
    trios = ped_rows(spark, "".join(f"f{i} m{i} 0 0 F unaffected mom\nf{i} d{i} 0 0 M unaffected dad\nf{i} p{i} m{i} d{i} M affected prb\n" for i in (1, 2)))
    one = write_vcf(tmp_path / "one.vcf", ["m1", "d1", "p1"], [("chr1", 10, "A", "C", "0/1 0/0 0/1"), ("chr1", 20, "A", "C", "./. 0/0 0/1")])
    two = write_vcf(tmp_path / "two.vcf", ["m2", "d2", "p2"], [("chr1", 20, "A", "C", "0/1 0/1 0/1")])

    def frequencies(fill):
        sites, calls, _, _ = vcf.read(spark, [[one], [two]], trios, fill=fill)
        study = imports.build_study(sites, calls, trios, absent_are_reference=fill == 0)
        return {r["position"]: (r["af_parents_called_count"], r["af_allele_count"], r["af_allele_freq"]) for r in study.summary.collect()}

    assert frequencies(-1) == {10: (2, 1, 25.0), 20: (2, 2, 50.0)}
    assert frequencies(0) == {10: (4, 1, 12.5), 20: (2, 2, 50.0)}


def test_vcf_records_that_cannot_be_read_are_set_apart(spark, tmp_path):
    ped = ped_rows(spark, QUAD)
    path = write_vcf(tmp_path / "a.vcf", ["mom1", "dad1", "prb1", "sib1"], [
        ("chr1", 10, "A", "C", "0/0 0/0 0/1/1 0/0"), ("chr1", "x", "A", "C", "0/0 0/0 0/1 0/0"), ("chr1", 12, "A", "C", "0/0 0/0 0/1 0/0")])
    sites, calls, _, odd = vcf.read(spark, [[path]], ped)
    assert [k[1] for k in texts(sites, calls)] == [12] and odd.count() == 2


def test_best_states_of_three_alternatives(spark, tmp_path):
    ped = ped_rows(spark, QUAD)
    path = write_vcf(tmp_path / "a.vcf", ["mom1", "dad1", "prb1", "sib1"], [
        ("chr1", 10, "A", "C,G,T", "0/3 0/0 0/3 1/2"), ("chr1", 20, "A", "C", "0/1 0/0 ./. 0/1")])
    sites, calls, _, _ = vcf.read(spark, [[path]], ped)
    found = browser.answer(plan.query_variants(imports.build_study(sites, calls, ped)), ["location", "best_st"]).collect()
    assert {(r["location"], r["best_st"]) for r in found} == {("chr1:10", "1210/0001/0001/1010"), ("chr1:20", "12?1/10?1")}


def test_vcf_repeated_positions_stay_apart(spark, tmp_path):
    ped = ped_rows(spark, QUAD)
    people = ["mom1", "dad1", "prb1", "sib1"]
    path = write_vcf(tmp_path / "a.vcf", people, [
        ("chr1", 10, "A", "C", "0/0 0/0 0/1 0/0"), ("chr1", 10, "AT", "A", "0/1 0/0 0/0 0/0"), ("chr1", 11, "A", "C", "0/0 0/1 0/0 0/0")])
    sites, calls, _, _ = vcf.read(spark, [[path]], ped)
    found = {(r["reference"], r["alternatives"][0], r["g"]) for r in calls.join(sites, ["bucket_index", "summary_index"]).select(
        "reference", "alternatives", genotypes.genotype_text(F.col("members")).alias("g")).collect()}
    assert found == {("A", "C", "0/0;0/0;0/1;0/0"), ("AT", "A", "0/1;0/0;0/0;0/0"), ("A", "C", "0/0;0/1;0/0;0/0")}


def test_vcf_import_modes(spark, tmp_path):
    ped = ped_rows(spark, QUAD)
    path = write_vcf(tmp_path / "a.vcf", ["mom1", "dad1", "prb1", "sib1"], [
        ("chr1", 1, "A", "C", "0/0 0/0 0/1 0/0"), ("chr1", 2, "A", "C", "1/1 0/0 0/0 0/1"),
        ("chr1", 3, "A", "C", "0/1 0/0 0/1 0/0"), ("chr1", 4, "A", "C", "0/0 0/0 0/0 0/0"),
        ("chr1", 5, "A", "C", "./. 0/0 0/1 0/0")])
    sites, calls, _, _ = vcf.read(spark, [[path]], ped)

    def classes(**modes):
        study = imports.build_study(sites, calls, ped, **modes)
        return {r["position"]: r["inheritance_in_members"] for r in plan.query_variants(study).collect()}

    assert classes() == {1: 8 | 128 | 256, 2: 32 | 2 | 256, 3: 2 | 128 | 256, 5: 256}
    assert classes(denovo_mode="denovo", omission_mode="omission") == {1: 4 | 128 | 256, 2: 16 | 2 | 256, 3: 2 | 128 | 256, 5: 256}
    # site 1: de novo; site 2: omission of the alternative, and the reference allele is de novo in nobody
    assert set(classes(denovo_mode="ignore", omission_mode="omission")) >= {2, 3}
    assert 1 not in classes(denovo_mode="ignore")
    assert 2 not in classes(omission_mode="ignore", denovo_mode="denovo")
    assert 5 not in classes(include_unknown_persons=False)
    study = imports.build_study(sites, calls, ped)
    freq = {r["position"]: (r["af_parents_called_count"], r["af_allele_count"], r["af_allele_freq"]) for r in study.summary.collect()}
    assert freq[2] == (2, 2, 50.0) and freq[3] == (2, 1, 25.0) and freq[5] == (0, 0, 0.0)
    assert 4 not in freq  # no family allele is stored for an all-reference site
    with_reference = imports.build_study(sites, calls, ped, include_reference=True)
    assert with_reference.summary.filter("position = 4 AND allele_index = 0").count() == 1


def test_vcf_export_round_trip(spark, tmp_path):
    ped = ped_rows(spark, TWO_QUADS)
    people = [f"{r}{i}" for i in (1, 2) for r in ("mom", "dad", "prb", "sib")]
    path = write_vcf(tmp_path / "a.vcf", people, [
        ("chr1", 10, "A", "C,G", "0/0 0/0 0/1 0/2 0/0 ./. 1/1 0/0"), ("chrX", 20, "A", "T", "0/1 1 0 0 0/0 0 0 0/1")])
    sites, calls, _, _ = vcf.read(spark, [[path]], ped)
    out = str(tmp_path / "out")
    exports.write_vcf(exports.vcf_lines(sites, calls, people), exports.vcf_header(people, {"chr1": 100}), out)
    back_sites, back_calls, _, _ = vcf.read(spark, [[out]], ped)
    assert texts(back_sites, back_calls) == texts(sites, calls)


def test_denovo_tables(spark, tmp_path):
    ped = ped_rows(spark, TWO_QUADS)
    path = tmp_path / "dn.tsv"
    path.write_text(
        "location\tvariant\tperson_id\tnote\nchr1:10\tsub(A->C)\tprb1;sib1\tx\nchr1:10\tsub(A->C)\tprb2\ty\n"
        "chr1:30\tdel(2)\tprb1,nobody\tz\nchr1:40\tins(GT)\tsib2\tz\nchr1:50\twhat\tsib2\tz\n")
    bases = spark.createDataFrame([("chr1", 29, "TACGG"), ("chr1", 39, "GAA")], "chromosome string, start int, bases string")
    raw = call_tables.read_table(spark, str(path))
    rows = call_tables.denovo_rows(raw, location="location", variant="variant", base_before=bases)
    found = call_tables.denovo_by_person(rows, ped)
    got = {(r["position"], r["reference"], r["alternative"], r["family_id"]): r["carriers"] for r in found.collect()}
    assert got == {
        (10, "A", "C", "f1"): ["prb1", "sib1"], (10, "A", "C", "f2"): ["prb2"],
        (29, "TAC", "T", "f1"): ["prb1"], (39, "G", "GGT", "f2"): ["sib2"]}
    sites, calls = call_tables.denovo_study_inputs(found, ped)
    study = imports.build_study(sites, calls, ped, frequencies=False, denovo_source=True)
    hits = plan.query_variants(study, inheritance="denovo")
    assert hits.count() == 4
    assert study.summary.filter("af_allele_count IS NOT NULL").count() == 0
    assert study.summary.filter("position = 10").select("family_variants_count").first()[0] == 2


def test_denovo_best_state_and_genotype(spark):
    ped = ped_rows(spark, QUAD)
    states = spark.createDataFrame([("chr1", 10, "A", "C", "f1", "2 2 1 2/0 0 1 0")], "chromosome string, position int, reference string, alternative string, family_id string, bs string")
    sites, calls = call_tables.denovo_study_inputs(states, ped, best_state="bs")
    assert texts(sites, calls)[("chr1", 10, "f1")] == "0/0;0/0;1/0;0/0"
    gts = spark.createDataFrame([("chr1", 10, "A", "C,T", "f1", "0/0,0/0,0/1,./2")], "chromosome string, position int, reference string, alternative string, family_id string, gt string")
    sites, calls = call_tables.denovo_study_inputs(gts, ped, genotype="gt")
    assert texts(sites, calls)[("chr1", 10, "f1")] == "0/0;0/0;0/1;./2"
    assert sites.first()["alternatives"] == ["C", "T"]


def test_person_in_several_families_is_reported(spark):
    ped = ped_rows(spark, "f1 a 0 0 M affected prb\nf2 a 0 0 M affected prb\nf2 b 0 0 M affected prb")
    rows = spark.createDataFrame([("a;b",)], "person_id string")
    assert [r["person_id"] for r in call_tables.ambiguous_persons(rows, ped).collect()] == ["a"]


def test_transmitted_tables(spark):
    columns = "`#chr` string, position string, variant string, familyData string, `all.nParCalled` string, `all.prcntParCalled` string, `all.nAltAlls` string, `all.altFreq` string"
    lines = spark.createDataFrame([
        ("1", "10", "sub(A->C)", "f1:2121/0101:1 2;f2:2222/0000:3", "4", "100.0", "2", "25.0"),
        ("1", "20", "sub(A->C)", "TOOMANY", "4", "100.0", "2", "25.0"),
        ("1", "30", "sub(A->C)", "TOOMANY", "4", "100.0", "2", "25.0"),
        ("1", "x", "sub(A->C)", "f1:22/00:1", "4", "100.0", "2", "25.0"),
        ("1", "40", "odd", "f1:22/00:1", "4", "100.0", "2", "25.0")], columns)
    more = spark.createDataFrame([("1", "20", "sub(A->C)", "f9:2/0:1")], "`#chr` string, position string, variant string, familyData string")
    readable, quarantined = call_tables.transmitted_rows(lines, more)
    assert sorted(r["position"] for r in readable.collect()) == ["10", "20"]
    assert quarantined.count() == 3
    families = {(r["position"], r["family_id"]): r["states"] for r in call_tables.transmitted_families(readable).collect()}
    assert families[(10, "f1")] == [[2, 0], [1, 1], [2, 0], [1, 1]] and (20, "f9") in families
    freq = {(r["position"], r["allele_index"]): (r["af_allele_count"], r["af_allele_freq"]) for r in call_tables.transmitted_alleles(readable).collect()}
    assert freq[(10, 0)] == (6, 0.75) and freq[(10, 1)] == (2, 25.0)


def test_cnv_tables(spark):
    ped = ped_rows(spark, QUAD)
    raw = spark.createDataFrame([("chrX:100-200", "CNV-", "prb1;sib1"), ("chr1:5-9", "CNV+", "sib1")], "location string, variant string, person_id string")
    states = call_tables.cnv_states_by_person(call_tables.cnv_rows(raw), ped)
    got = {(r["chromosome"], r["person_id"]): r["state"] for r in states.collect()}
    assert got[("chrX", "prb1")] == [1, 1] and got[("chrX", "sib1")] == [0, 1] and got[("chrX", "dad1")] == [1, 0]
    sites, calls = call_tables.cnv_study_inputs(states)
    study = imports.build_study(sites, calls, ped, frequencies=False, denovo_source=True)
    found = {(r["chromosome"], r["variant_type"], r["location"]) for r in plan.query_variants(study, inheritance="denovo").collect()}
    assert found == {("chrX", 16, "chrX:100-200"), ("chr1", 32, "chr1:5-9")}
    observed = spark.createDataFrame([("chrX:100-200", "CNV-", "f1", "2 1 1 0")], "location string, variant string, family_id string, best_state string")
    by_family = call_tables.cnv_states_by_family(call_tables.cnv_rows(observed), ped)
    assert {r["person_id"]: r["state"] for r in by_family.collect()} == {
        "mom1": [2, 0], "dad1": [1, 0], "prb1": [1, 1], "sib1": [0, 1]}


def test_liftover(spark):
    chain = spark.createDataFrame(
        [("c", 100, 199, "t", 1100, "+"), ("c", 200, 299, "u", 999, "-")],
        "chrom string, start long, stop long, target_chrom string, target_start long, strand string")
    df = spark.createDataFrame(
        [("c", 150, "A", "C"), ("c", 250, "AC", "A"), ("c", 199, "AG", "A"), ("c", 900, "A", "C")],
        "chromosome string, position int, reference string, alternative string")
    got = {r["position_src"]: (r["chromosome"], r["position"], r["reference"], r["alternative"]) for r in liftover.lift_sites(df, chain).collect()}
    assert got == {150: ("t", 1150, "A", "C"), 250: ("u", 948, "GT", "T")}
    assert 199 in {r["position_src"] for r in liftover.lift_sites(df, chain, whole_allele=False).collect()}
    cnv = spark.createDataFrame([("c", 110, 190), ("c", 110, 250)], "chromosome string, position int, end_position int")
    lifted = liftover.lift_intervals(cnv, chain).collect()
    assert [(r["location"], r["size_change"], r["large_change"]) for r in lifted] == [("t:1110-1190", 0.0, False)]


def test_instrument_discovery(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "i1.csv").write_text("personId,age\np1,3\np2,\n")
    (tmp_path / "deep" / "i1.extra.txt").write_text("x\n")
    (tmp_path / "deep" / "i2.csv").write_text("personId,iq\np1,100\n")
    (tmp_path / "notes.md").write_text("no")
    found = side_tables.discover_instruments(spark, [str(tmp_path)])
    assert {k: len(v) for k, v in found.items()} == {"i1": 1, "i2": 1}
    rows = side_tables.read_instrument(spark, found["i1"]).collect()
    assert {(r["person_id"], r["age"]) for r in rows} == {("p1", "3"), ("p2", None)}


@pytest.mark.parametrize("prefix,add,want", [("chr", True, "chr1"), (None, True, "1")])
def test_chromosome_prefix(spark, prefix, add, want):
    df = spark.createDataFrame([("1",)], "c string")
    assert df.select(vcf.adjusted_chrom(F.col("c"), prefix, add)).first()[0] == want


def test_summary_key_is_unique(spark):
    df = spark.createDataFrame([(1, 5, 2), (2, 0, 0)], "bucket_index int, summary_index int, allele_index int")
    assert [r[0] for r in df.select(variants.sj_index()).collect()] == [10_000_000_050_002, 20_000_000_000_000]


def test_chain_text_gives_blocks_and_the_best_one_counts(spark, tmp_path):
    (tmp_path / "a.chain").write_text(
        "# comment\nchain 50 c 1000 + 99 400 t 2000 - 100 390 1\n100 10 0\n50\t5\t20\n120\n\nchain 9 c 1000 + 0 900 u 900 + 0 900 2\n900\n\nchain x c 1 + 0 1 t 1 + 0 1 3\n1\n\n")
    blocks = liftover.read_chain(spark, str(tmp_path / "a.chain"))
    assert sorted((r.start, r.stop, r.target_chrom, r.target_start, r.strand, r.score) for r in blocks.collect()) == [
        (1, 900, "u", 1, "+", 9.0), (100, 199, "t", 1900, "-", 50.0), (210, 259, "t", 1800, "-", 50.0), (265, 384, "t", 1730, "-", 50.0)]
    assert [r.value for r in liftover.unreadable_chains(spark, str(tmp_path / "a.chain")).collect()] == ["chain x c 1 + 0 1 t 1 + 0 1 3\n1"]
    df = spark.createDataFrame(
        [("c", 100, "A", "C"), ("c", 100, "A", "C"), ("c", 199, "AC", "A"), ("c", 205, "A", "C"), ("c", 950, "A", "C"), ("d", 1, "A", "C"), (None, None, None, None)],
        "chromosome string, position int, reference string, alternative string")
    lifted, rejected = liftover.lift_sites_apart(df, blocks)
    assert sorted((r.position_src, r.chromosome, r.position, r.reference) for r in lifted.collect()) == [(100, "t", 1900, "T"), (100, "t", 1900, "T"), (205, "u", 205, "A")]
    assert sorted((repr(r.position), r.reason) for r in rejected.collect()) == [
        ("1", "no block covers the position"), ("199", "the allele leaves its block"), ("950", "no block covers the position"), ("None", "no block covers the position")]
    cnv = spark.createDataFrame([("c", 100, 150), ("c", 950, 960), ("c", 100, 205), ("c", 100, 990)], "chromosome string, position int, end_position int")
    lifted, rejected = liftover.lift_intervals_apart(cnv, blocks)
    assert [r.location for r in lifted.collect()] == ["t:1850-1900"]
    assert sorted((r.position, r.reason) for r in rejected.collect()) == [
        (100, "no block covers the end"), (100, "the ends are on two chromosomes"), (950, "no block covers the start")]


def test_bad_lines_and_persons_are_returned(spark):
    ped = ped_rows(spark, TWO_QUADS + "f3 prb1 0 0 F affected prb\n")
    raw = spark.createDataFrame(
        [("c:5", "A", "C", "sib1;nobody", "x"), ("c:5", "A", "C", "mom1", "y"), ("c:?", "A", "C", "sib1", "z"), ("c:6", None, "C", "sib1", "z"), ("c:7", "A", "C", "prb1", "w")],
        "location string, ref string, alt string, person_id string, note string")
    assert sorted((r.note, r.reason) for r in call_tables.denovo_rejects(raw, location="location").collect()) == [("z", "no position"), ("z", "unreadable alleles")]
    rows = call_tables.denovo_rows(raw, location="location")
    assert sorted((r.person_id, r.note, r.reason) for r in call_tables.rejected_carriers(rows, ped).collect()) == [
        ("nobody", "x", "unknown person"), ("prb1", "w", "person of several families")]
    good = rows.filter("position = 5")
    assert [(r.carriers, [x.note for x in r.lines]) for r in call_tables.denovo_by_person(good, ped, extra=["note"]).collect()] == [(["mom1", "sib1"], ["x", "y"])]
    for bad, options in ((rows, {}), (good, {"unknown": "error"})):
        with pytest.raises(Exception, match="several families|unknown person"):
            call_tables.denovo_by_person(bad, ped, **options).collect()
    cnv = call_tables.cnv_rows(spark.createDataFrame([("c:1-9", "CNV+", "mom1"), ("c:1", "CNV+", "mom1"), ("c:1-9", "odd", "mom1")], "location string, variant string, person_id string"))
    assert sorted(r.reason for r in call_tables.cnv_rejects(cnv).collect()) == ["no interval", "unknown type"]


def test_short_best_states_leave_the_rest_unknown(spark):
    ped = ped_rows(spark, QUAD)
    rows = spark.createDataFrame([("c", 5, "A", "C", "f1", "2 1/0 1")], "chromosome string, position int, reference string, alternative string, family_id string, state string")
    _, calls = call_tables.denovo_study_inputs(rows, ped, best_state="state")
    assert [(m["a1"], m["a2"]) for m in calls.first()["members"]] == [(0, 0), (1, 0), (-1, -1), (-1, -1)]
