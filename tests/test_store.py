"""Stored studies: pruned queries must equal unpruned ones."""

import random
from dataclasses import replace

import pytest
from small_pedigrees import ped_rows
from pyspark.sql import functions as F

from kinfold.functions import codes
from kinfold.functions.bins import Partitioning, coding_effects
from kinfold.operators import filters, pedigree, variants
from kinfold.plans import imports
from kinfold.plans import study as plan
from kinfold.session import scratch_dir
from kinfold.sources import store

FAMILIES = 12
PART = Partitioning(
    region_length=100, chromosomes=("chr1", "chr2"), rare_boundary=20.0, coding_effects=coding_effects(["coding"]),
    family_bins=10, chromosome_lengths={"chr1": 1000, "chr2": 1000, "chr9": 1000})


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(11)
    ped = ped_rows(spark, "\n".join(
        f"f{i} m{i} 0 0 F unaffected mom\nf{i} d{i} 0 0 M unaffected dad\nf{i} p{i} m{i} d{i} M affected prb" for i in range(FAMILIES)))
    sites, calls = [], []
    for s in range(60):
        cnv = s % 7 == 3
        pos = rng.randrange(1, 990)
        sites.append((
            1, s, rng.choice(["chr1", "chr2", "chr9"]), pos, pos + rng.randrange(50, 400) if cnv else None,
            None if cnv else "A", [None] if cnv else ["C"], 16 if cnv else None, 1))
        for i in range(FAMILIES):
            if rng.random() < 0.5:
                copies = [rng.choice([0, 0, 0, 0, 0, 1, -1 if rng.random() < 0.1 else 0]) for _ in range(6)]
                for k, p in enumerate((f"m{i}", f"d{i}", f"p{i}")):
                    calls.append((1, s, f"f{i}", p, copies[2 * k], copies[2 * k + 1]))
    sites = spark.createDataFrame(sites, (
        "bucket_index int, summary_index int, chromosome string, position int, end_position int, reference string, "
        "alternatives array<string>, variant_type int, transmission_type int"))
    long = spark.createDataFrame(calls, "bucket_index int, summary_index int, family_id string, person_id string, a1 int, a2 int")
    people = variants.persons_of(pedigree.layout(ped))
    grouped = variants.family_calls(long.join(people, ["family_id", "person_id"]))
    effects = sites.select(
        "chromosome", "position", "reference", F.get("alternatives", F.lit(0)).alias("alternative"),
        F.array(F.struct(
            F.concat(F.lit("g"), (F.col("summary_index") % 4).cast("string")).alias("effect_gene_symbols"),
            F.when(F.col("summary_index") % 3 == 0, "intergenic").when(F.col("summary_index") % 3 == 1, "missense").otherwise("nonsense").alias("effect_types"))).alias("effect_gene"))
    # one effect row per site identity: sites of the fixture may share a position
    effects = effects.dropDuplicates(["chromosome", "position", "reference", "alternative"])
    built = imports.build_study(sites, grouped, ped, PART, effects, denovo_mode="denovo", omission_mode="omission")
    path = scratch_dir(spark)
    store.write_study(built, path, {"id": "fixture"})
    store.write_metadata(spark, f"{path}/meta", {"id": "renamed", "extra": "1"})
    return path, store.read_study(spark, path)


QUERIES = [
    {},
    {"regions": [filters.Region("chr1", 120, 180)]},
    {"regions": [filters.Region("chr2", 500), filters.Region("chr9", None, 90)]},
    {"regions": [filters.Region("chr9", 250, 260)]},
    {"effect_types": ["lgds"]},
    {"effect_types": ["missense", "intergenic"]},
    {"inheritance": "denovo"},
    {"inheritance": ["denovo or mendelian"]},
    {"ultra_rare": True},
    {"frequency_filter": [("af_allele_freq", None, 10.0)]},
    {"frequency_filter": [("af_allele_freq", 5.0, 30.0)]},
    {"frequency_filter": [("af_allele_freq", None, 10.0)], "ultra_rare": True},
    {"family_ids": ["f1", "f5"]},
    {"roles": "prb and not mom and not dad"},
    {"regions": [filters.Region("chr1", 1, 300)], "effect_types": ["coding"], "inheritance": "denovo"},
    {"return_reference": True, "return_unknown": True},
    {"genes": ["g1"]},
    {"genes": ["g1", "absent"], "effect_types": ["lgds"]},
    {"genes": ["absent"]},
    {"genes": [f"g{i}" for i in range(30)], "regions": [filters.Region("chr2")]},
    {"family_ids": [f"f{i}" for i in range(11)]},
    {"family_ids": []},
    {"regions": []},
    {"regions": [filters.Region("chr9", 980, 1400), filters.Region("chr5", 1, 5)]},
    *[{"inheritance": name, "return_reference": True, "return_unknown": True} for name in codes.INHERITANCE],
    {"inheritance": ["denovo or unknown", "not mendelian"], "return_unknown": True},
]


@pytest.fixture(scope="module")
def dataset(spark, stored):
    """The study, its alleles in integer bins of another length, and unpartitioned."""
    _, study = stored
    plain = study.summary.drop(*PART.family_columns), study.family.drop(*PART.family_columns)
    path = scratch_dir(spark)
    store.write_study(plan.Study(study.pedigree, *plain, Partitioning(region_length=70, chromosomes=("chr2",), integer_region_bins=True, rare_boundary=10.0)), path)
    other = store.read_study(spark, path)
    return plan.union_studies({"a": study, "b": other, "c": plan.Study(study.pedigree, *plain)})


@pytest.mark.parametrize("query", QUERIES[::3], ids=[",".join(q) or "all" for q in QUERIES[::3]])
def test_pruning_of_differently_partitioned_studies(stored, dataset, query):
    _, study = stored
    ids = lambda df, *more: sorted(tuple(r) for r in df.select(*more, "family_id", "sj_index").collect())
    single = ids(plan.query_variants(study, prune=False, **query))
    assert ids(plan.query_variants(dataset, **query), "study_id") == sorted((s, *r) for s in "abc" for r in single)


@pytest.mark.parametrize("query", QUERIES, ids=[",".join(map(str, q)) or "all" for q in QUERIES])
def test_pruning_keeps_results(stored, query):
    _, study = stored
    def ids(df):
        return sorted(tuple(r) for r in df.select("family_id", "sj_index").collect())
    with_pruning = ids(plan.query_variants(study, **query))
    assert with_pruning == ids(plan.query_variants(study, prune=False, **query))
    if not query:
        assert with_pruning


def test_event_reaching_into_a_later_bin_is_found(stored):
    _, study = stored
    long = study.summary.filter("variant_type = 16 AND floor((position - 1) / 100) < floor((end_position - 1) / 100)").collect()
    assert long
    for r in long:
        region = filters.Region(r["chromosome"], r["end_position"], r["end_position"])
        found = [x["sj_index"] for x in plan.summary_query(study, regions=[region]).select("sj_index").collect()]
        assert r["sj_index"] in found


def test_region_filter_reaches_the_partitions(stored):
    _, study = stored
    df = plan.query_variants(study, regions=[filters.Region("chr1", 120, 180)], inheritance="denovo")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("PartitionFilters: [") >= 2
    assert "region_bin" in text.split("PartitionFilters: [")[1] and "frequency_bin" in text


def test_metadata_and_files(spark, stored):
    path, study = stored
    meta = {r["key"]: r["value"] for r in store.read_metadata(spark, f"{path}/meta").collect()}
    assert meta == {"id": "renamed", "extra": "1"}
    target = scratch_dir(spark)
    store.compact(spark, f"{path}/family", target, PART.family_columns)
    keys = ["sj_index", "family_id"]
    differences = store.compare(
        study.family.select(*keys, "allele_in_roles"), spark.read.parquet(target).select(*keys, "allele_in_roles"), keys)
    assert {r["item"]: r["differences"] for r in differences.collect()} == {"only left": 0, "only right": 0, "allele_in_roles": 0}
    assert store.file_counts(spark, target).agg(F.sum("rows")).first()[0] == study.family.count()


def test_corrupt_file_is_reported(spark, stored, tmp_path):
    good = tmp_path / "t"
    spark.range(10).write.parquet(str(good))
    (good / "part-bad.parquet").write_bytes(b"PAR1 nothing PAR1")
    with pytest.raises(Exception):
        store.file_counts(spark, str(good)).collect()


def test_region_reader(stored):
    _, study = stored
    part = store.read_region(study, filters.Region("chr1", 120, 180))
    whole = study.summary.filter(filters.in_regions([filters.Region("chr1", 120, 180)]))
    assert part.summary.count() == whole.count()
    assert part.family.count() == study.family.join(
        whole.select("bucket_index", "summary_index").distinct(), ["bucket_index", "summary_index"], "left_semi").count()


def test_union_of_studies_and_unique_variants(stored):
    _, study = stored
    both = plan.union_studies({"a": study, "b": study})
    single = plan.query_variants(study).count()
    assert plan.query_variants(both).count() == 2 * single
    identities = plan.query_variants(study).select("family_id", "location", "reference", "alternative").distinct().count()
    unique = plan.query_variants(plan.union_studies({"b": study, "a": study}), unique=True)
    assert unique.count() == identities and {r[0] for r in unique.select("study_id").distinct().collect()} == {"a"}
    assert plan.query_variants(both, study_ids=["b"]).count() == single
    assert plan.query_variants(both, unique=True, limit=3).count() == 3


def test_a_filter_on_summary_alleles_reaches_the_scan_of_family_alleles(stored):
    from kinfold.plans.study import key_ranges
    _, study = stored
    assert study.by_key
    found = plan.query_variants(study, genes=["g1"])
    text = found._jdf.queryExecution().executedPlan().toString()
    keys = [r[0] for r in study.summary.filter("exists(effect_gene, g -> g.effect_gene_symbols = 'g1')").select("sj_index").distinct().collect()]
    assert keys and f">= {min(keys)})" in text and f"<= {max(keys)})" in text
    rows = study.summary.filter("summary_index in (3, 20, 21)").select("sj_index")
    for most in (1, 2, 64):
        kept = study.summary.filter(key_ranges(rows, most))
        assert rows.join(kept, "sj_index", "left_anti").isEmpty()
        assert most < 64 or kept.select("summary_index").distinct().count() == 3
    assert study.summary.filter(key_ranges(rows.limit(0))).isEmpty()


COARSE = Partitioning(region_length=500, chromosomes=("chr1", "chr2"), family_bins=4, chromosome_lengths={"chr1": 1000, "chr2": 1000, "chr9": 1000})


@pytest.fixture
def copied(spark, stored):
    """A copy of the stored study, with fewer directories, that may be changed."""
    path, dropped = scratch_dir(spark), PART.family_columns
    study = stored[1]
    store.write_study(replace(
        study, summary=study.summary.drop(*dropped), family=study.family.drop(*dropped).filter("summary_index < 20"), partitioning=COARSE), path)
    return path


def family_rows(study):
    return sorted(tuple(r) for r in study.family.select("family_id", "summary_index", "allele_index", "family_bin", "region_bin").collect())


def test_withdrawal_rewrites_only_bins_of_withdrawn_families(spark, copied):
    before, files = family_rows(store.read_study(spark, copied)), {tuple(r) for r in store.table_files(spark, copied, "family").collect()}
    gone = spark.createDataFrame([("f1",), ("f2",), ("f1",), ("unknown",)], "family_id string")
    assert store.withdraw_families(spark, copied, gone) == 1
    after = store.read_study(spark, copied)
    assert family_rows(after) == [r for r in before if r[0] not in ("f1", "f2")]
    assert {r[0] for r in after.pedigree.select("family_id").collect()} == {f"f{i}" for i in range(FAMILIES)} - {"f1", "f2"}
    touched = {r[3] for r in before if r[0] in ("f1", "f2")}
    kept = {tuple(r) for r in store.table_files(spark, copied, "family").collect()}
    place = COARSE.family_columns.index("family_bin")
    assert {f for f in files if f[place] not in touched} <= kept
    assert not {f for f in files if f[place] in touched} & kept
    assert family_rows(store.read_study(spark, copied, 0)) == before
    assert store.withdraw_families(spark, copied, gone) == 1  # nothing left to withdraw


def test_withdrawal_of_all_families_in_turn(spark, copied):
    held = {r[0] for r in family_rows(store.read_study(spark, copied))}
    for family in ("f0", "f7"):
        store.withdraw_families(spark, copied, spark.createDataFrame([(family,)], "family_id string"))
    assert {r[0] for r in family_rows(store.read_study(spark, copied))} == held - {"f0", "f7"}
    everyone = store.read_study(spark, copied).pedigree.select("family_id")
    store.withdraw_families(spark, copied, everyone)
    left = store.read_study(spark, copied)
    assert family_rows(left) == [] and left.pedigree.count() == 0


def test_broken_off_withdrawal_changes_nothing(spark, copied, monkeypatch):
    before = family_rows(store.read_study(spark, copied))
    gone = spark.createDataFrame([("f1",)], "family_id string")

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(store.snapshots, "commit", fail)
        with pytest.raises(RuntimeError):
            store.withdraw_families(spark, copied, gone)
    assert family_rows(store.read_study(spark, copied)) == before
    store.withdraw_families(spark, copied, gone)
    assert family_rows(store.read_study(spark, copied)) == [r for r in before if r[0] != "f1"]


def test_compaction_merges_only_bins_with_several_small_files(spark, stored, copied):
    whole = store.read_study(spark, copied).summary
    some = whole.select("region_bin").distinct().orderBy("region_bin").first()[0]
    # one region bin is written row by row, as many small appends would leave it
    _, state = store.snapshots.state_of(spark, copied)
    parts = store.snapshots.replaced(
        spark, copied, state["summary"], "region_bin", [some], lambda rows: rows,
        lambda rows, target: rows.write.option("maxRecordsPerFile", 1).partitionBy(*COARSE.summary_columns).parquet(target), "summary")
    store.snapshots.commit(spark, copied, state | {"summary": parts}, 1)
    files = {tuple(r) for r in store.table_files(spark, copied, "summary").collect()}
    assert store.compact_study(spark, copied, "summary") in (1, 2)
    merged = {tuple(r) for r in store.table_files(spark, copied, "summary").collect()}
    assert {f for f in files if f[0] != some} == {f for f in merged if f[0] != some}
    assert len({f[:-2] for f in merged}) == len(merged) <= len(files)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(store.read_study(spark, copied).summary) == rows(whole)
    number = store.compact_study(spark, copied, "summary")
    assert store.compact_study(spark, copied, "summary") == number
