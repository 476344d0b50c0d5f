"""What keeps time and disk in proportion to the input."""

import gzip
import os
from dataclasses import replace
from glob import glob

from pyspark.sql import functions as F

from checks import derive, storage_queries
from kinfold.functions import alleles, genotypes
from kinfold.functions.bins import Partitioning
from kinfold.operators import variants
from kinfold.plans import browser
from kinfold.plans import study as plan
from kinfold.plans.study import Study
from kinfold.session import scratch_dir
from kinfold.sources import store

SF = "/root/testdata/sf0.001"


def test_sides_of_a_call_are_listed_once_per_line(spark):
    text = derive.calls(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lookups = [part.split("lambda x")[0] for part in text.split("lambdafunction(sides")[1:]]
    assert len(lookups) == 2 and not any("CASE" in part for part in lookups)


def test_bins_of_many_values_are_columns_of_the_files():
    columns = ["region_bin", "frequency_bin", "coding_bin", "family_bin"]
    values = {"region_bin": 5_000, "frequency_bin": 4, "coding_bin": 2, "family_bin": 8}
    assert store.directory_columns(columns, values) == columns[1:]
    assert store.directory_columns(columns, values | {"region_bin": 30}) == columns
    assert store.directory_columns(columns, values, 7) == ["coding_bin"]
    assert store.directory_columns([], {}) == []


def small_study(spark, part):
    families = spark.range(12).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("family_id"))
    people = families.select(
        "family_id", F.concat(F.lit("p"), "family_id").alias("person_id"), F.lit(None).cast("string").alias("mom_id"),
        F.lit(None).cast("string").alias("dad_id"), F.lit(1).alias("sex"), F.lit(2).alias("status"), F.lit(128).alias("role"),
        F.concat(F.lit("p"), "family_id").alias("sample_id"), F.lit(False).alias("generated"), F.lit(False).alias("not_sequenced"), F.lit(0).alias("member_index"))
    summary = spark.range(40).select(
        F.lit(1).alias("bucket_index"), F.col("id").cast("int").alias("summary_index"), F.lit(1).alias("allele_index"),
        F.lit("chr1").alias("chromosome"), (F.col("id") * 100 + 1).cast("int").alias("position"), (F.col("id") * 100 + 1).cast("int").alias("end_position"),
        F.array(F.struct(F.lit("g").alias("effect_gene_symbols"), F.lit("missense").alias("effect_types"))).alias("effect_gene"))
    family = summary.select("bucket_index", "summary_index", "allele_index").crossJoin(families)
    key = lambda df: df.withColumn("sj_index", variants.sj_index())
    return Study(people, key(summary), key(family), part)


def test_study_of_many_region_bins_has_few_directories_and_the_same_rows(spark, monkeypatch):
    part = Partitioning(region_length=100, chromosomes=("chr1",), family_bins=4)
    monkeypatch.setattr(store, "MOST_DIRECTORIES", 50)
    path = scratch_dir(spark)
    store.write_study(small_study(spark, part), path)
    study = store.read_study(spark, path)
    assert sorted(os.listdir(f"{path}/family"))[-1].startswith("family_bin=") and len([d for d in os.listdir(f"{path}/family") if "=" in d]) <= 4
    rows = study.family.select("family_id", "summary_index", "region_bin", "family_bin")
    assert rows.count() == 480 and rows.select("region_bin").distinct().count() == 40
    assert rows.filter("region_bin = 'chr1_7'").select("summary_index").distinct().collect()[0][0] == 7
    gone = spark.createDataFrame([("f3",)], "family_id string")
    store.withdraw_families(spark, path, gone)
    left = store.read_study(spark, path)
    assert left.family.count() == 440 and left.family.filter("family_id = 'f3'").isEmpty()
    number = store.compact_study(spark, path, "family")
    assert store.compact_study(spark, path, "family") == number and store.read_study(spark, path).family.count() == 440
    target = scratch_dir(spark)
    store.compact(spark, f"{path}/family", target, part.family_columns)
    assert spark.read.parquet(target).count() == 480


def test_text_of_sample_matrix_is_compressed(spark):
    paths = storage_queries.vcf_paths(spark, SF)
    files = [f for batch in paths for p in batch for f in glob(f"{p}/part-*")]
    assert files and all(f.endswith(".gz") for f in files)
    assert sum(os.path.getsize(f) for f in files) * 5 < sum(len(gzip.open(f).read()) for f in files)


def test_calls_meet_their_lines_and_sites_in_one_shuffle(spark):
    text = derive.calls(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [summary_index" in text


def test_only_named_fields_of_the_members_are_shuffled_for_the_browser(spark):
    found = browser.answer(plan.query_variants(derive.study(spark, SF)), ["family", "genotype", "carrier_person_attributes"])
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_extract_a1" in text.split("Join Inner")[0] and "genotype" not in text.split("Join Inner")[0].replace("AS genotype", "")


def test_variant_ids_of_a_table_keep_whole_family_variants(spark):
    whole = plan.query_variants(derive.study(spark, SF)).withColumn("id", F.concat_ws(":", "location", alleles.short_notation(F.col("variant_desc"))))
    ids = whole.filter("allele_index = 2 AND summary_index % 3 = 0").select("id").distinct()
    keys = ["summary_index", "family_id"]
    expected = whole.join(whole.join(ids, "id", "left_semi").select(*keys).distinct(), keys, "left_semi").select(*keys, "allele_index")
    got = plan.query_variants(derive.study(spark, SF), summary_variant_ids=ids).select(*keys, "allele_index")
    assert sorted(got.collect()) == sorted(expected.collect()) and got.filter("allele_index = 1").count() > 0


def test_alleles_present(spark):
    rows = [([0, 2, -1], [1, -2, 2]), ([0, 0], [0, -2]), ([-1], [-1]), ([3], [3])]
    df = spark.createDataFrame(rows, "a1 array<int>, a2 array<int>").select(F.arrays_zip("a1", "a2").alias("members"))
    got = [r[0] for r in df.select(genotypes.alleles_present(F.col("members"))).collect()]
    assert got == [[1, 2], [], [], [3]]
    assert "lambdafunction" not in df.select(genotypes.alleles_present(F.col("members")))._jdf.queryExecution().optimizedPlan().toString()


def big_and_small_families(spark):
    """Calls of families of two to six members with unknown copies, homozygous parents and a member twice."""
    member = lambda i, role, sex, mom, dad, a1, a2: (f"p{i}", sex, 1 + i % 2, role, role.bit_length(), sex, 1 + i % 2, mom, dad, role in (16, 32), a1, a2)
    rows = []
    for n in range(2, 7):
        for k in range(60):
            copy = lambda i: ((k * 7 + i * 3 + n) % 5 - 1 if k % 3 else (k + i) % 3, -2 if (k + i) % 11 == 0 else (k * 5 + i) % 4 - (k % 4 == 1))
            people = [member(0, 16, 2, 0, 0, *copy(0)), member(1, 32, 1, 0, 0, *copy(1))]
            people += [member(2 + i % 3, 128 if i == 0 else 256, 1 + i % 2, 1, 2, *copy(2 + i)) for i in range(n - 2)]
            rows.append((1, k, f"f{n}", people))
    fields = "person_id:string,sex:int,status:int,role:int,role_bit:int,sex_bit:int,status_bit:int,mom_ix:int,dad_ix:int,founder:boolean,a1:int,a2:int"
    return spark.createDataFrame(rows, f"bucket_index int, summary_index int, family_id string, members array<struct<{fields}>>")


def test_families_worked_out_by_place_give_what_functions_over_the_array_give(spark, monkeypatch):
    calls, founders = big_and_small_families(spark), spark.sql("SELECT 10L AS founders")

    def results():
        made = [variants.family_alleles(calls, **modes) for modes in (
            {}, {"denovo_mode": "denovo", "omission_mode": "ignore"}, {"denovo_source": True}, {"include_reference": True, "include_unknown_persons": False})]
        made += [variants.allele_frequencies(calls, founders, absent).withColumn("_counts", F.array_sort(F.map_entries("_counts"))) for absent in (False, True)]
        return [sorted(map(repr, df.collect())) for df in made]

    by_place = results()
    monkeypatch.setattr(genotypes, "PLACES", 1)
    assert by_place == results() and all(by_place)


def test_counters_and_frequencies_read_only_their_member_fields(spark):
    path = scratch_dir(spark)
    big_and_small_families(spark).write.parquet(path)
    calls = spark.read.parquet(path)
    read = lambda df: df._jdf.queryExecution().sparkPlan().collectLeaves().apply(0).requiredSchema().catalogString()
    counters = read(variants.allele_counters(variants.family_alleles(calls)))
    assert "status:" in counters and not any(f"{f}:" in counters for f in ("person_id", "sex", "role", "role_bit"))
    assert "members:array<struct<founder:boolean,a1:int,a2:int>>" in read(variants.allele_frequencies(calls, spark.sql("SELECT 10L AS founders")))


def test_filter_by_inheritance_does_not_repeat_the_classes(spark):
    found = variants.family_alleles(big_and_small_families(spark)).filter("(inheritance_in_members & 4) <> 0 AND allele_index > 0")
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_family_alleles_are_worked_out_at_the_queried_sites_only(spark):
    from checks import derive
    from kinfold.operators.filters import Region
    from kinfold.plans import study as plan

    sf, asked = "/root/testdata/sf0.001", []

    def family_of(sites):
        asked.append(sites)
        return derive.family_of(spark, sf, sites)

    study, regions = derive.study(spark, sf), [Region("chr1", 5_000, 9_000), Region("chrX", None, 3_000)]
    shown = ["family_id", "sj_index", "location", "inheritance_by_member"]
    want = sorted(plan.query_variants(study, regions=regions).select(*shown).collect())
    got = sorted(plan.query_variants(study, regions=regions, family_of=family_of).select(*shown).collect())
    assert got == want and want
    sites = {(r.bucket_index, r.summary_index) for r in asked[0].collect()}
    found = {(r.bucket_index, r.summary_index) for r in family_of(asked[0]).select("bucket_index", "summary_index").collect()}
    assert found and found <= sites
    # without a filter of summary alleles the family alleles of the study are taken
    plan.query_variants(study, inheritance="denovo", family_of=lambda sites: 1 / 0)


def test_only_used_columns_are_compared_for_unique_variants(spark):
    found = spark.createDataFrame([
        ("f1", "chr1:5", "A", "C", "b", 1, "x" * 9), ("f1", "chr1:5", "A", "C", "a", 7, "y" * 9), ("f1", "chr1:5", "A", "C", "a", 3, "z" * 9),
        ("f1", "chr1:5", "A", "C", "a", 3, "z" * 9), ("f1", "chr1:5", "A", None, "b", 2, "w" * 9), (None, "chr1:5", "A", "C", "b", 1, "v" * 9),
    ], "family_id string, location string, reference string, alternative string, study_id string, sj_index long, wide string")
    first = plan.first_of_studies(found)
    assert first.columns == found.columns
    assert sorted(tuple(map(str, r)) for r in first.select("family_id", "study_id", "sj_index", "wide").collect()) == [
        ("None", "b", "1", "v" * 9), ("f1", "a", "3", "z" * 9), ("f1", "b", "2", "w" * 9)]
    text = plan.first_of_studies(found.repartition(2)).select("family_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Project" in text and "wide" not in text.split("RepartitionByExpression")[0].split("Repartition")[0]


def test_family_rows_with_the_facts_of_their_site_get_their_bins_without_a_join(spark):
    part = Partitioning(region_length=1000, chromosomes=("chr1",), rare_boundary=5.0, coding_effects=("missense",), family_bins=4)
    study = small_study(spark, part)
    twice = study.summary.unionByName(study.summary.filter("summary_index = 3")).filter("summary_index <> 4")
    summary = twice.withColumns({"af_allele_count": F.col("summary_index"), "af_allele_freq": F.col("summary_index") / 2.0, "seen_as_denovo": F.lit(False)})
    family = study.family.withColumn("is_denovo", F.col("family_id") == "f2")
    family = family.unionByName(family.filter("summary_index < 9").withColumn("allele_index", F.lit(0)))
    facts = store.site_facts(store.with_summary_bins(summary, part), part)
    brought = family.join(facts, ["bucket_index", "summary_index"])
    joined, looked_up = (store.with_family_bins(rows, summary, part) for rows in (family, brought.localCheckpoint()))
    bins_of = lambda df: sorted(df.select("family_id", "summary_index", "allele_index", *part.family_columns).collect())
    assert bins_of(looked_up) == bins_of(joined) and len(bins_of(joined)) == (39 + 1) * 12 + (8 + 1) * 12
    assert "Join" not in looked_up._jdf.queryExecution().optimizedPlan().toString()


def test_family_rows_of_a_rewritten_study_keep_their_bins(spark, monkeypatch):
    path, again, other = scratch_dir(spark), scratch_dir(spark), scratch_dir(spark)
    store.write_study(small_study(spark, Partitioning(region_length=1000, chromosomes=("chr1",), coding_effects=("missense",), family_bins=4)), path)
    study = store.read_study(spark, path)
    asked = []
    whole = store.with_family_bins
    monkeypatch.setattr(store, "with_family_bins", lambda *given: asked.append(given) or whole(*given))
    notes = study.summary.select("chromosome", "position", F.lit(None).cast("string").alias("reference"), F.lit(None).cast("string").alias("alternative"))
    study = replace(study, summary=study.summary.withColumns({"reference": F.lit(None).cast("string"), "alternative": F.lit(None).cast("string")}))
    rows_of = lambda df: sorted(df.select("family_id", "summary_index", "region_bin", "coding_bin", "family_bin").collect())
    store.reannotate(study, notes.withColumn("depth", F.lit(1)), again)
    assert not asked and rows_of(store.read_study(spark, again).family) == rows_of(study.family)
    new_effect = F.array(F.struct(F.lit("g").alias("effect_gene_symbols"), F.lit("intron").alias("effect_types")))
    store.reannotate(study, notes.withColumn("effect_gene", new_effect), other, drop=["effect_gene"])
    assert len(asked) == 1 and {r[3] for r in rows_of(store.read_study(spark, other).family)} == {0}
