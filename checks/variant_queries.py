"""Variant filters, joins, scalar columns and summary aggregates."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from checks import derive
from checks.registry import register
from kinfold.functions import alleles, bins, codes, flags, genotypes
from kinfold.operators import filters, pedigree, person_sets, variants
from kinfold.plans import browser
from kinfold.plans import study as plan

LGDS = "('frame-shift', 'nonsense', 'splice-site', 'no-frame-shift-newStop')"


def rows(df, *more):
    """Identity columns of family alleles."""
    return df.select(*more, "family_id", "location", "allele_index", F.array_join("allele_in_members", ";").alias("carriers"))


ROWS_SQL = "SELECT family_id, location, ai::BIGINT AS allele_index, carriers FROM v WHERE {}"


def filter_query(name, where, counters=False, frequencies=False, **query):
    """Register one family variant filter with its SQL condition."""
    @register(name, ROWS_SQL.format(where))
    def run(spark, sf):
        # counters and frequencies need the alleles of all sites
        family_of = None if counters or frequencies else partial(derive.family_of, spark, sf)
        return rows(plan.query_variants(derive.study(spark, sf, counters, frequencies), family_of=family_of, **query))


@register("denovo_by_gene_and_status", f"""
SELECT gene, CASE WHEN (statuses & 2) <> 0 THEN 'affected' ELSE 'other' END AS carriers,
  count(DISTINCT fvuid) AS variants, count(DISTINCT family_id) AS families
FROM v WHERE (inheritance & 4) <> 0 AND effect IN {LGDS} GROUP BY 1, 2""")
def denovo_by_gene_and_status(spark, sf):
    """Flagship: de-novo likely-gene-disrupting variants by gene and carrier status."""
    found = plan.query_variants(derive.study(spark, sf), inheritance="denovo", effect_types=["lgds"])
    gene = F.explode(F.transform(
        F.filter("effect_gene", lambda g: g["effect_types"].isin(codes.EFFECT_GROUPS["lgds"])),
        lambda g: g["effect_gene_symbols"])).alias("gene")
    status = F.when(F.col("allele_in_statuses").bitwiseAND(2) != 0, "affected").otherwise("other")
    return found.select(gene, status.alias("carriers"), "fvuid", "family_id").groupBy("gene", "carriers").agg(
        F.count_distinct("fvuid").alias("variants"), F.count_distinct("family_id").alias("families"))


# ---- predicates -------------------------------------------------------------------------------

REGIONS = [filters.Region("chr1", 20_000, 60_000), filters.Region("chr2", None, 9_000), filters.Region("chrX", 150_000)]
filter_query("p01_regions", """(chromosome = 'chr1' AND NOT (end_position < 20000 OR position > 60000))
  OR (chromosome = 'chr2' AND position <= 9000) OR (chromosome = 'chrX' AND end_position >= 150000)""", regions=REGIONS)
filter_query("p01_regions_empty_or", "chromosome = 'chr3'", regions=[filters.Region("chr3")])
filter_query("p02_genes", "gene IN ('Brand#1', 'Brand#7') OR gene2 IN ('Brand#1', 'Brand#7')", genes=["Brand#1", "Brand#7"])
filter_query("p03_effect_types", "effect IN ('missense', 'synonymous') OR (gene2 IS NOT NULL AND 'intron' IN ('missense', 'synonymous'))",
             effect_types=["missense", "synonymous"])
filter_query("p04_genes_and_effects_same_pair", "gene2 IN ('Brand#1', 'Brand#6', 'Brand#11')",
             genes=["Brand#1", "Brand#6", "Brand#11"], effect_types=["intron"])
filter_query("p06_variant_type", "(variant_type & 32) <> 0 OR ((variant_type & 2) <> 0 AND NOT (variant_type & 1) <> 0)",
             variant_type="cnv+ or (ins and not sub)")
filter_query("p06_variant_type_indel", "(variant_type & 14) <> 0", variant_type="indel")
filter_query("p07_real_attribute", "score >= 920 AND score <= 960", real_attr_filter=[("score", 920.0, 960.0)])
filter_query("p07_real_attribute_present", "score IS NOT NULL", real_attr_filter=[("score", None, None)])
filter_query("p10_categorical_values", "label IN ('small ring', 'red widget')",
             categorical_attr_filter=[("label", ["small ring", "red widget"])])
filter_query("p10_categorical_missing", "label IS NULL", categorical_attr_filter=[("label", None)])
filter_query("p10_categorical_present", "label IS NOT NULL", categorical_attr_filter=[("label", [])])
filter_query("p11_alternative_only", "ai > 0")
filter_query("p12_roles", "(roles & 128) <> 0 AND NOT (roles & 256) <> 0", roles="prb and not sib")
filter_query("p13_sexes", "(sexes & 1) <> 0 OR (sexes & 4) <> 0", sexes="male or U")
filter_query("p14_statuses", "(statuses & 2) <> 0 AND NOT (statuses & 1) <> 0", affected_statuses="affected and not unaffected")
filter_query("p15_inheritance", "NOT (inheritance & 4) <> 0 AND ((inheritance & 2) <> 0 OR (inheritance & 256) <> 0)",
             inheritance=["not denovo", "any([mendelian, unknown])"])
filter_query("p16_zygosity_roles", f"(roles & 128) <> 0 AND (zroles & {1 << 14}) <> 0", roles="prb~homozygous")
filter_query("p16_zygosity_sexes", "(sexes & 2) <> 0 AND (zsexes & 8) <> 0", sexes="female~heterozygous")
filter_query("p16_zygosity_statuses", "(statuses & 2) <> 0 AND (zstatus & 4) <> 0", affected_statuses="affected~homozygous")
filter_query("p17_expression_forms", "((roles & 128) <> 0 AND (roles & 256) <> 0) OR NOT ((roles & 16) <> 0 OR (roles & 32) <> 0)",
             roles="all([prb, sib]) or not any([mom, dad])")
filter_query("p18_zygosity_added", f"((roles & 16) <> 0 AND (zroles & {2 << 8}) <> 0) AND NOT ((roles & 32) <> 0 AND (zroles & {2 << 10}) <> 0)",
             roles=flags.with_zygosity("mom and not dad", "heterozygous"))
filter_query("p19_zygosity_stripped", "(roles & 16) <> 0 AND NOT (roles & 32) <> 0",
             roles=flags.without_zygosity("mom~heterozygous and not dad~heterozygous"))
filter_query("p20_family_ids", "family_id IN ('F1', 'F7', 'F20')", family_ids=["F1", "F7", "F20"])
filter_query("p21_person_ids", "list_has_any(string_split(carriers, ';'), ['P2', 'P6', 'P41'])", person_ids=["P2", "P6", "P41"])


@register("p08_frequency", """
SELECT v.family_id, v.location, v.ai::BIGINT AS allele_index, v.carriers FROM v JOIN freq f ON f.s = v.s AND f.ai = v.ai
WHERE f.af_allele_freq <= 12.5""")
def p08_frequency(spark, sf):
    return rows(plan.query_variants(
        derive.study(spark, sf, frequencies=True), frequency_filter=[("af_allele_freq", None, 12.5)]))


@register("p08_frequency_missing_passes", "SELECT s::BIGINT AS s, ai::BIGINT AS ai FROM sa WHERE score <= 930 OR score IS NULL")
def p08_frequency_missing_passes(spark, sf):
    found = derive.alleles(spark, sf).filter(filters.frequency("score", None, 930.0))
    return found.select(F.col("summary_index").alias("s"), F.col("allele_index").alias("ai"))


@register("p09_ultra_rare", """
SELECT v.family_id, v.location, v.ai::BIGINT AS allele_index, v.carriers FROM v JOIN freq f ON f.s = v.s AND f.ai = v.ai
WHERE f.af_allele_count <= 1""")
def p09_ultra_rare(spark, sf):
    return rows(plan.query_variants(derive.study(spark, sf, frequencies=True), ultra_rare=True))


TAGS_SQL = """, fam AS (
  SELECT family_id, count(*) FILTER (WHERE NOT missing) AS size,
    bool_or(role = 16 AND NOT missing) AS mom, bool_or(role = 32 AND NOT missing) AS dad,
    bool_or(role IN (128, 256) AND NOT missing) AS kids,
    max(status) FILTER (WHERE role = 16 AND NOT missing) AS mom_status,
    max(status) FILTER (WHERE role = 32 AND NOT missing) AS dad_status,
    max(status) FILTER (WHERE role = 128 AND NOT missing) AS prb_status,
    max(status) FILTER (WHERE role = 256 AND NOT missing) AS sib_status,
    max(sex) FILTER (WHERE role = 128 AND NOT missing) AS prb_sex,
    count(*) FILTER (WHERE status = 2) AS affected,
    concat(count(*) FILTER (WHERE NOT missing)::VARCHAR, ':', string_agg(
      CASE role WHEN 16 THEN 'mom' WHEN 32 THEN 'dad' WHEN 128 THEN 'prb' ELSE 'sib' END || '.'
      || CASE sex WHEN 1 THEN 'M' WHEN 2 THEN 'F' ELSE 'U' END || '.'
      || CASE status WHEN 1 THEN 'unaffected' WHEN 2 THEN 'affected' ELSE 'unspecified' END, ':'
      ORDER BY CASE role WHEN 16 THEN 'mom' WHEN 32 THEN 'dad' WHEN 128 THEN 'prb' ELSE 'sib' END, idx) FILTER (WHERE NOT missing)) AS full_type
  FROM ped GROUP BY 1),
tags AS (
  SELECT family_id, size >= 3 AND mom AND dad AND kids AS tag_nuclear_family,
    size = 4 AND mom AND dad AND kids AS tag_quad_family, size = 3 AND mom AND dad AND kids AS tag_trio_family,
    affected = 1 AS tag_simplex_family, affected > 1 AS tag_multiplex_family, affected = 0 AS tag_control_family,
    coalesce(dad_status = 2, false) AS tag_affected_dad_family, coalesce(mom_status = 2, false) AS tag_affected_mom_family,
    coalesce(prb_status = 2, false) AS tag_affected_prb_family, coalesce(sib_status = 2, false) AS tag_affected_sib_family,
    coalesce(dad_status = 1, false) AS tag_unaffected_dad_family, coalesce(mom_status = 1, false) AS tag_unaffected_mom_family,
    coalesce(prb_status = 1, false) AS tag_unaffected_prb_family, coalesce(sib_status = 1, false) AS tag_unaffected_sib_family,
    coalesce(prb_sex = 1, false) AS tag_male_prb_family, coalesce(prb_sex = 2, false) AS tag_female_prb_family,
    NOT mom AS tag_missing_mom_family, NOT dad AS tag_missing_dad_family, full_type AS tag_family_type_full
  FROM fam)
"""
PICK = "SELECT v.family_id, v.location, v.ai::BIGINT AS allele_index, v.carriers FROM v"


def joined_query(name, ctes, condition, run, **options):
    """Register a filter whose SQL needs extra CTEs; ``run(spark, sf)`` gives query arguments."""
    def execute(spark, sf):
        return rows(plan.query_variants(derive.study(spark, sf, **options), **run(spark, sf)))
    register(name, f"{ctes}\n{PICK} WHERE {condition}")(execute)


def carried(condition: str) -> str:
    return (
        "EXISTS (SELECT 1 FROM member_class c JOIN ped p ON p.person_id = c.person_id "
        f"WHERE c.carrier AND c.family_id = v.family_id AND c.s = v.s AND c.ai = v.ai AND ({condition}))")


GM = ", gm AS (SELECT 'G' || (s // 25) AS gene, chromosome AS chrom, position AS cds_start, position + size * 1000 AS cds_end FROM sites)"
joined_query(
    "p05_gene_regions", GM + """, gr AS (
  SELECT chrom, greatest(1, min(cds_start) - 20000) AS a, max(cds_end) + 20000 AS b FROM gm
  WHERE gene IN ('G3', 'G40') GROUP BY gene, chrom)""",
    "EXISTS (SELECT 1 FROM gr WHERE gr.chrom = v.chromosome AND v.end_position >= a AND v.position <= b)",
    lambda spark, sf: {"regions": filters.gene_regions(derive.gene_models(spark, sf), ["G3", "G40"])})
joined_query(
    "p22_family_tags_and", TAGS_SQL,
    "v.family_id IN (SELECT family_id FROM tags WHERE tag_male_prb_family AND NOT tag_affected_sib_family)",
    lambda spark, sf: {"selected_tags": ["tag_male_prb_family"], "deselected_tags": ["tag_affected_sib_family"]})
joined_query(
    "p23_family_tags_or", TAGS_SQL,
    "v.family_id IN (SELECT family_id FROM tags WHERE tag_multiplex_family OR NOT tag_quad_family)",
    lambda spark, sf: {
        "selected_tags": ["tag_multiplex_family"], "deselected_tags": ["tag_quad_family"], "tags_or_mode": True})
joined_query("p24_person_set", "", carried("p.status = 2"),
             lambda spark, sf: {"person_set": (derive.diagnosis(), ["affected"])})
joined_query("p24_person_set_of_two_fields", "", carried("p.segment = 'MACHINERY' AND p.sex IN (1, 2)"),
             lambda spark, sf: {"person_set": (derive.market(), ["machine_m", "machine_f"])})
filter_query("p24_person_set_as_expression", "(statuses & 2) <> 0",
             **person_sets.attribute_queries(derive.diagnosis(), ["affected"]))
joined_query(
    "p25_person_filter_values", "", carried("p.segment IN ('MACHINERY', 'BUILDING') AND p.role = 128"),
    lambda spark, sf: {"person_ids": filters.persons_with_value(
        derive.ped(spark, sf), "segment", ["MACHINERY", "BUILDING"], ["prb"])})
joined_query(
    "p26_person_filter_range", "", carried("p.balance >= 1000 AND p.balance <= 2500"),
    lambda spark, sf: {"person_ids": filters.persons_in_range(derive.ped(spark, sf), "balance", 1000.0, 2500.0)})
ORDERS_CTE = ", oc AS (SELECT 'P' || o_custkey AS person_id, min(o_totalprice) AS cheapest, count(*) AS orders, min(o_orderpriority) AS priority FROM orders GROUP BY 1)"
joined_query(
    "p27_pheno_filter_set", ORDERS_CTE, carried("p.person_id IN (SELECT person_id FROM oc WHERE priority IN ('1-URGENT')) AND p.role IN (128, 256)"),
    lambda spark, sf: {"person_ids": filters.persons_by_measure(
        derive.ped(spark, sf), derive.instruments(spark, sf)["i2"], "priority", values=["1-URGENT"], roles=["prb", "sib"])})
joined_query(
    "p27_pheno_filter_range", ORDERS_CTE, carried("p.person_id IN (SELECT person_id FROM oc WHERE cheapest >= 20000 AND cheapest <= 40000)"),
    lambda spark, sf: {"person_ids": filters.persons_by_measure(
        derive.ped(spark, sf), derive.instruments(spark, sf)["i2"], "cheapest", low=20000.0, high=40000.0)})
joined_query(
    "p28_family_filter", "", "v.family_id IN (SELECT family_id FROM ped WHERE segment = 'FURNITURE' AND role = 16)",
    lambda spark, sf: {"family_ids": filters.families_of(derive.ped(spark, sf), filters.persons_with_value(
        derive.ped(spark, sf), "segment", ["FURNITURE"], ["mom"]))})
joined_query(
    "p29_filters_intersected", "", carried("p.segment = 'BUILDING' AND p.balance >= 0 AND p.balance <= 5000"),
    lambda spark, sf: {"person_ids": filters.intersect_ids([
        filters.persons_with_value(derive.ped(spark, sf), "segment", ["BUILDING"]),
        filters.persons_in_range(derive.ped(spark, sf), "balance", 0.0, 5000.0)])})
CHILD = "((roles & 128) <> 0 AND NOT (roles & 256) <> 0) OR ((roles & 128) <> 0 AND (roles & 256) <> 0)"
filter_query("p30_present_in_child", CHILD, roles=browser.present_in_child({"proband only", "proband and sibling"}))
filter_query("p30_present_in_child_zygosity", f"(roles & 256) <> 0 AND (zroles & {2 << 16}) <> 0 AND NOT ((roles & 128) <> 0 AND (zroles & {2 << 14}) <> 0)",
             roles=browser.present_in_child({"sibling only"}, "heterozygous"))
filter_query("p31_present_in_parent", "((roles & 16) <> 0 AND NOT (roles & 32) <> 0) OR (NOT (roles & 16) <> 0 AND NOT (roles & 32) <> 0)",
             roles=browser.present_in_parent({"mother only", "neither"}))
filter_query("p32_present_inheritance", "(inheritance & 2) <> 0 OR (inheritance & 128) <> 0",
             inheritance=browser.present_inheritance({"neither"}, {"mother only"}))
filter_query("p34_affected_status", "((statuses & 2) <> 0 AND NOT (statuses & 1) <> 0) OR ((statuses & 2) <> 0 AND (statuses & 1) <> 0)",
             affected_statuses=browser.affected_status(["affected only", "affected and unaffected"]))
filter_query("p43_merged_parent_and_child_roles", "((roles & 16) <> 0 OR (roles & 32) <> 0) AND (roles & 128) <> 0",
             roles=browser.merged_roles("mom or dad", "prb"))
filter_query("p40_region_prefix_repaired", "chromosome = 'chr2' AND end_position >= 1000 AND position <= 50000",
             regions=filters.repair_chromosomes([filters.Region.parse("2:1,000-50,000")], ["chr1", "chr2"], "chr"))
joined_query("p37_genomic_scores", "", "v.score >= 910 AND v.score <= 990 AND v.label IS NULL",
             lambda spark, sf: browser.score_filters([
                 {"score": "score", "rangeStart": 910.0, "rangeEnd": 990.0}]) | {"categorical_attr_filter": [("label", None)]})
joined_query(
    "p36_gene_scores", """, gs AS (SELECT p_brand AS gene FROM part GROUP BY 1 HAVING sum(p_size) BETWEEN 1500 AND 2200)""",
    "v.gene IN (SELECT gene FROM gs) OR v.gene2 IN (SELECT gene FROM gs)",
    lambda spark, sf: {"genes": browser.Scores(derive.gene_scores(spark, sf), "size_total", 1500.0, 2200.0).genes()})


@register("p33_rarity", f"""
{PICK} JOIN freq f ON f.s = v.s AND f.ai = v.ai
WHERE f.af_allele_freq >= 5 AND f.af_allele_freq <= 20""")
def p33_rarity(spark, sf):
    return rows(plan.query_variants(
        derive.study(spark, sf, frequencies=True), **browser.rarity(low=5.0, high=20.0)))


def dataset(spark, sf):
    """Three leaf studies by the return flag of the first order line."""
    fa = derive.family(spark, sf, ["flag"])
    sa, ped = derive.alleles(spark, sf), derive.ped(spark, sf)
    return plan.union_studies({
        f"study_{flag}": plan.Study(ped, sa, fa.filter(F.col("flag") == flag)) for flag in ("A", "N", "R")})


@register("p38_study_filters", "SELECT 'study_' || flag AS study_id, family_id, location, ai::BIGINT AS allele_index, carriers FROM v WHERE flag IN ('A', 'R')")
def p38_study_filters(spark, sf):
    found = plan.query_variants(dataset(spark, sf), **browser.translate(
        {"studyFilters": ["study_A", "study_R"], "allowedStudies": ["study_A", "study_R", "study_X"]}) | {"inheritance": None})
    return found.select("study_id", "family_id", "location", "allele_index", F.array_join("allele_in_members", ";").alias("carriers"))


@register("u01_dataset_union", "SELECT 'study_' || flag AS study_id, count(*) AS alleles, count(DISTINCT fvuid) AS variants FROM v GROUP BY 1")
def u01_dataset_union(spark, sf):
    return plan.query_variants(dataset(spark, sf)).groupBy("study_id").agg(
        F.count("*").alias("alleles"), F.count_distinct("fvuid").alias("variants"))


@register("a07_unique_family_variants", f"{PICK} WHERE flag IN ('A', 'N', 'R')")
def a07_unique_family_variants(spark, sf):
    """Two overlapping studies: every family variant is kept once."""
    fa = derive.family(spark, sf, ["flag"])
    sa, ped = derive.alleles(spark, sf), derive.ped(spark, sf)
    both = plan.union_studies({
        "one": plan.Study(ped, sa, fa.filter(F.col("flag").isin("A", "N"))),
        "two": plan.Study(ped, sa, fa.filter(F.col("flag").isin("N", "R")))})
    return rows(plan.query_variants(both, unique=True))


@register("p39_summary_variant_ids", f"""
{PICK} WHERE (v.family_id, v.s) IN (SELECT (o.family_id, o.s) FROM v o SEMI JOIN (
  SELECT DISTINCT location || ':' || variant AS id FROM sa SEMI JOIN (SELECT min(s) AS s FROM sites GROUP BY gene) f ON f.s = sa.s) k
  ON k.id = o.location || ':' || o.variant)""")
def p39_summary_variant_ids(spark, sf):
    """Variants picked by ``location:variant``: the first site of every gene."""
    sa = derive.alleles(spark, sf)
    first = sa.groupBy(F.col("effect_gene")[0]["effect_gene_symbols"].alias("g")).agg(F.min("summary_index").alias("summary_index"))
    ids = sa.join(first, "summary_index", "left_semi").select(F.concat_ws(
        ":", plan.location(), alleles.short_notation(F.col("variant_desc"))).alias("id"))
    return rows(plan.query_variants(derive.study(spark, sf), summary_variant_ids=ids))


@register("p41_matched_alleles", """
SELECT family_id, s::BIGINT AS s, string_agg(ai::VARCHAR, ',' ORDER BY ai) AS matched FROM v
WHERE (roles & 128) <> 0 GROUP BY 1, 2""")
def p41_matched_alleles(spark, sf):
    found = plan.query_variants(derive.study(spark, sf), roles="prb")
    return variants.matched_alleles(found).select(
        "family_id", F.col("summary_index").alias("s"),
        F.array_join(F.transform("matched_alleles", lambda a: a.cast("string")), ",").alias("matched"))


joined_query("p44_pedigree_fields", "", carried("((p.role = 128 AND p.segment = 'MACHINERY') OR p.segment = 'BUILDING') AND (p.sex <> 1 OR p.nation <> 3)"),
             lambda spark, sf: {"person_ids": filters.pedigree_matches(
                 derive.ped(spark, sf), [{"role": 128, "segment": "MACHINERY"}, {"segment": "BUILDING"}], [{"sex": 1, "nation": 3}])})


POSSIBLE = "NOT (v.inheritance & 4) <> 0 AND NOT (v.inheritance & 16) <> 0"


@register("p35_browser_guard", f"{PICK} WHERE {POSSIBLE} AND (v.inheritance & 2) <> 0")
def p35_browser_guard(spark, sf):
    """Transmitted sources call unconfirmed classes possible; browser requests leave them out."""
    fa = derive.family(spark, sf, denovo_mode="possible_denovo", omission_mode="possible_omission")
    study = plan.Study(derive.ped(spark, sf), derive.alleles(spark, sf), fa)
    guard = browser.translate({"inheritanceTypeFilter": ["mendelian"]})["inheritance"]
    return rows(plan.query_variants(study, inheritance=[*guard, "mendelian"]))


# ---- scalar columns ---------------------------------------------------------------------------

def site():
    return [F.col("summary_index").alias("s"), F.col("allele_index").alias("ai")]


@register("x01_allele_type", "SELECT s::BIGINT AS s, ai::BIGINT AS ai, variant_type::BIGINT AS variant_type, end_position::BIGINT AS end_position FROM sa")
def x01_allele_type(spark, sf):
    return derive.alleles(spark, sf).select(*site(), "variant_type", "end_position")


@register("x02_short_notation", "SELECT s::BIGINT AS s, ai::BIGINT AS ai, variant FROM sa")
def x02_short_notation(spark, sf):
    return derive.alleles(spark, sf).select(*site(), alleles.short_notation(F.col("variant_desc")).alias("variant"))


@register("x03_tandem_repeat", """
SELECT s::BIGINT AS s, ai::BIGINT AS ai, CASE WHEN reference = 'ACACAC' AND ai = 1 THEN 'TR(3xAC->4)' ELSE variant END AS variant FROM sa""")
def x03_tandem_repeat(spark, sf):
    return derive.alleles(spark, sf).select(*site(), alleles.full_notation(F.col("variant_desc")).alias("variant"))


@register("x04_combined_notation", """
SELECT s::BIGINT AS s, CASE
  WHEN n_alts = 1 AND reference = 'ACACAC' THEN 'TR(3xAC->4)' WHEN n_alts = 1 THEN max(variant) FILTER (WHERE ai = 1)
  WHEN reference = 'ACACAC' THEN 'ins(AC)|ins(ACT)'
  WHEN size % 4 = 0 THEN 'sub(A->C)|comp(A->CT)' WHEN size % 4 = 1 THEN 'ins(GT,GTT)'
  WHEN size % 4 = 2 THEN 'del(1)' ELSE 'comp(ACT->GG,GG)' END AS variant
FROM sa GROUP BY s, n_alts, reference, size""")
def x04_combined_notation(spark, sf):
    grouped = derive.alleles(spark, sf).groupBy("summary_index").agg(
        F.array_sort(F.collect_list(F.struct("allele_index", "variant_desc"))).alias("d"))
    descs = F.transform("d", lambda x: x["variant_desc"])
    return grouped.select(
        F.col("summary_index").alias("s"), F.array_join(alleles.combined_notation(descs), "|").alias("variant"))


@register("x05_identifiers", """
SELECT location || '.' || coalesce(reference, 'None') || '.' || coalesce(alternative, 'None') || '.1' AS svuid, location FROM sa""")
def x05_identifiers(spark, sf):
    return derive.alleles(spark, sf).select(plan.svuid().alias("svuid"), plan.location().alias("location"))


@register("x06_type_words", """
SELECT s::BIGINT AS s, ai::BIGINT AS ai, CASE WHEN variant LIKE 'sub%' THEN 1 WHEN variant LIKE 'ins%' THEN 2
  WHEN variant LIKE 'del%' THEN 4 WHEN variant LIKE 'comp%' THEN 8 WHEN variant = 'CNV+' THEN 32 ELSE 16 END::BIGINT AS by_text,
  CASE WHEN cnv THEN CASE WHEN size > 25 THEN 32 ELSE 16 END END::BIGINT AS by_name FROM sa""")
def x06_type_words(spark, sf):
    sa = derive.alleles(spark, sf)
    word = F.when(F.col("variant_type") == 32, " CNV+ ").when(F.col("variant_type") == 16, "large_deletion")
    return sa.select(
        *site(), alleles.type_from_notation(alleles.short_notation(F.col("variant_desc"))).alias("by_text"),
        alleles.type_from_name(word).alias("by_name"))


# the first two members of a family are its parents; their copies stand beside every child in one pass
TRIO_SQL = """
SELECT family_id, s::BIGINT AS s, person_id, {} AS value
FROM (SELECT family_id, s, person_id, idx, a1 = 1 OR a2 = 1 AS has,
    bool_or(idx = 0) OVER w AND bool_or(idx = 1) OVER w AS trio,
    bool_or(idx < 2 AND (a1 = 1 OR a2 = 1)) OVER w AS parent_has, bool_or(idx < 2 AND a1 = 1 AND a2 = 1) OVER w AS parent_hom
  FROM gt WINDOW w AS (PARTITION BY family_id, s))
WHERE idx > 1 AND trio"""
MENDEL, DENOVO, OMIT = "(has AND parent_has)", "(has AND NOT parent_has)", "(NOT has AND parent_hom)"


def trio_query(name, sql_value, value):
    """A trio check of allele 1 on every child of every family genotype."""
    @register(name, TRIO_SQL.format(sql_value))
    def run(spark, sf):
        child = derive.calls(spark, sf).withColumn("c", F.explode("members")).filter("c.mom_ix > 0 AND c.dad_ix > 0")
        mom = F.get("members", F.col("c.mom_ix") - 1)
        dad = F.get("members", F.col("c.dad_ix") - 1)
        return child.select(
            "family_id", F.col("summary_index").alias("s"), F.col("c.person_id").alias("person_id"),
            value(F.col("c"), mom, dad, 1).alias("value"))


trio_query("x07_mendelian_trio", MENDEL, genotypes.mendelian_trio)
trio_query("x08_denovo_trio", DENOVO, genotypes.denovo_trio)
trio_query("x09_omission_trio", OMIT, genotypes.omission_trio)
trio_query("x10_trio_inheritance", f"(CASE WHEN {MENDEL} THEN 2 WHEN {DENOVO} THEN 4 WHEN {OMIT} THEN 16 ELSE 64 END)::BIGINT",
           genotypes.trio_inheritance)


@register("x11_member_inheritance", """
SELECT family_id, s::BIGINT AS s, ai::BIGINT AS ai, string_agg(inh::VARCHAR, ',' ORDER BY idx) AS classes FROM member_class GROUP BY 1, 2, 3""")
def x11_member_inheritance(spark, sf):
    return derive.family(spark, sf).select(
        "family_id", *site(), F.array_join(F.col("inheritance_by_member").cast("array<string>"), ",").alias("classes"))


@register("x12_possible_modes", """
SELECT family_id, s::BIGINT AS s, ai::BIGINT AS ai, bit_or(CASE inh WHEN 4 THEN 8 WHEN 16 THEN 32 ELSE inh END)::BIGINT AS inheritance FROM member_class
GROUP BY 1, 2, 3""")
def x12_possible_modes(spark, sf):
    fa = derive.family(spark, sf, denovo_mode="possible_denovo", omission_mode="possible_omission")
    return fa.select("family_id", *site(), F.col("inheritance_in_members").alias("inheritance"))


@register("x12_ignored_modes", """
SELECT f.family_id, f.s::BIGINT AS s, f.ai::BIGINT AS ai, f.inheritance::BIGINT AS inheritance FROM fa f
WHERE NOT EXISTS (SELECT 1 FROM member_class0 m WHERE m.family_id = f.family_id AND m.s = f.s AND m.inh IN (4, 16)
  AND (m.ai = 0 OR EXISTS (SELECT 1 FROM present p WHERE p.family_id = m.family_id AND p.s = m.s AND p.ai = m.ai)))""")
def x12_ignored_modes(spark, sf):
    fa = derive.family(spark, sf, denovo_mode="ignore", omission_mode="ignore")
    return fa.select("family_id", *site(), F.col("inheritance_in_members").alias("inheritance"))


@register("x13_denovo_source_override", """
SELECT family_id, s::BIGINT AS s, ai::BIGINT AS ai,
  bit_or(CASE WHEN carrier AND role IN (128, 256) AND inh = 256 THEN 4 ELSE inh END)::BIGINT AS inheritance
FROM member_class GROUP BY 1, 2, 3""")
def x13_denovo_source_override(spark, sf):
    return derive.family(spark, sf, denovo_source=True).select(
        "family_id", *site(), F.col("inheritance_in_members").alias("inheritance"))


@register("x14_carrier_masks", """
SELECT family_id, s::BIGINT AS s, ai::BIGINT AS ai, carriers, roles::BIGINT AS roles, sexes::BIGINT AS sexes, statuses::BIGINT AS statuses FROM fa""")
def x14_carrier_masks(spark, sf):
    return derive.family(spark, sf).select(
        "family_id", *site(), F.array_join("allele_in_members", ";").alias("carriers"),
        F.col("allele_in_roles").alias("roles"), F.col("allele_in_sexes").alias("sexes"), F.col("allele_in_statuses").alias("statuses"))


@register("x15_zygosity_masks", "SELECT family_id, s::BIGINT AS s, ai::BIGINT AS ai, zroles::BIGINT AS zroles, zsexes::BIGINT AS zsexes, zstatus::BIGINT AS zstatus FROM fa")
def x15_zygosity_masks(spark, sf):
    return derive.family(spark, sf).select(
        "family_id", *site(), F.col("zygosity_in_roles").alias("zroles"), F.col("zygosity_in_sexes").alias("zsexes"),
        F.col("zygosity_in_status").alias("zstatus"))


STATE = """, cnt AS (
  SELECT family_id, s, person_id, idx, sex, n_alts, position, a1 = -1 OR a2 = -1 AS unk, chromosome = 'chrX' AND NOT position BETWEEN 1 AND 40000 AS hx,
    (a1 = 1)::INT + (a2 = 1)::INT AS n1, (a1 = 2)::INT + (a2 = 2)::INT AS n2 FROM gt),
st0 AS (SELECT *, 2 - n1 - n2 AS n0 FROM cnt),
st AS (SELECT *,
    CASE WHEN hx AND sex = 1 AND n0 IN (1, 2) THEN n0 - 1 WHEN hx AND sex = 1 AND n0 = 2 THEN 1 ELSE n0 END AS r0,
    CASE WHEN hx AND sex = 1 AND n0 NOT IN (1, 2) AND n1 = 2 THEN 1 ELSE n1 END AS r1,
    CASE WHEN hx AND sex = 1 AND n0 NOT IN (1, 2) AND n2 = 2 THEN 1 ELSE n2 END AS r2 FROM st0)"""


def states(spark, sf):
    c = derive.calls(spark, sf).join(derive.sites(spark, sf).select(
        "bucket_index", "summary_index", "chromosome", "position", F.size("alternatives").alias("n")), ["bucket_index", "summary_index"])
    hx = (F.col("chromosome") == "chrX") & ~genotypes.in_intervals(F.col("chromosome"), F.col("position"), derive.PAR)
    return c.withColumn("states", genotypes.best_state(F.col("members"), F.col("n"), hx))


@register("x16_best_state", STATE + """
SELECT family_id, s::BIGINT AS s,
  string_agg(CASE WHEN unk THEN '?' ELSE r0::VARCHAR END, '' ORDER BY idx) || '/' || string_agg(CASE WHEN unk THEN '?' ELSE r1::VARCHAR END, '' ORDER BY idx)
  || CASE WHEN max(n_alts) = 2 THEN '/' || string_agg(CASE WHEN unk THEN '?' ELSE r2::VARCHAR END, '' ORDER BY idx) ELSE '' END AS best_state
FROM st GROUP BY 1, 2""")
def x16_best_state(spark, sf):
    return states(spark, sf).select(
        "family_id", F.col("summary_index").alias("s"),
        genotypes.best_state_text(F.col("states"), F.col("n")).alias("best_state"))


@register("x17_genotype_from_best_state", STATE + """
SELECT family_id, s::BIGINT AS s, person_id,
  CASE WHEN unk THEN 0 WHEN r2 = 2 OR (r2 = 1 AND r1 = 0) THEN 2 WHEN r1 >= 1 THEN 1 ELSE 0 END::BIGINT AS a1,
  CASE WHEN unk THEN 0 WHEN r0 + r1 + CASE WHEN n_alts = 2 THEN r2 ELSE 0 END = 1 THEN -2 WHEN r2 = 2 THEN 2 WHEN r1 = 2 THEN 1
       WHEN r1 = 1 AND r2 = 1 THEN 2 ELSE 0 END::BIGINT AS a2
FROM st""")
def x17_genotype_from_best_state(spark, sf):
    each = states(spark, sf).select(
        "family_id", F.col("summary_index").alias("s"),
        F.explode(F.arrays_zip(F.transform("members", lambda m: m["person_id"]).alias("p"), F.col("states").alias("st"))).alias("z"))
    pair = genotypes.genotype_from_best_state(F.col("st"))
    return each.select("family_id", "s", F.col("z.p").alias("person_id"), F.col("z.st").alias("st")).withColumn("g", pair).select(
        "family_id", "s", "person_id", F.col("g.a1").alias("a1"), F.col("g.a2").alias("a2"))


@register("x18_ploidy_and_model", """
SELECT family_id, s::BIGINT AS s, CASE WHEN max(chromosome) <> 'chrX' THEN 1
   WHEN max(position) BETWEEN 1 AND 40000 THEN CASE WHEN coalesce(bool_and(a2 <> -2) FILTER (WHERE sex = 1), true) THEN 3 ELSE 5 END
   WHEN coalesce(bool_or(a2 <> -2) FILTER (WHERE sex = 1), false) THEN 5 ELSE 4 END::BIGINT AS model,
  sum(CASE WHEN chromosome = 'chrX' AND NOT position BETWEEN 1 AND 40000 AND sex IN (1, 4) THEN 1 ELSE 2 END)::BIGINT AS ploidy
FROM gt GROUP BY 1, 2""")
def x18_ploidy_and_model(spark, sf):
    chrom, pos, members = F.col("chromosome"), F.col("position"), F.col("members")
    ploidies = F.transform(members, lambda m: genotypes.locus_ploidy(chrom, pos, m["sex"], derive.PAR))
    return states(spark, sf).select(
        "family_id", F.col("summary_index").alias("s"),
        genotypes.genetic_model(chrom, pos, members, derive.PAR).alias("model"),
        F.aggregate(ploidies, F.lit(0), lambda a, b: a + b).alias("ploidy"))


@register("x19_genotype_predicates", """
SELECT all_ref, any_unk, all_unk, ref_or_unk, count(*) AS genotypes FROM (
  SELECT v.*, EXISTS (SELECT 1 FROM gt g WHERE g.family_id = v.family_id AND g.s = v.s AND (g.a1 = 0 OR g.a2 = 0))
    AND NOT EXISTS (SELECT 1 FROM gt g WHERE g.family_id = v.family_id AND g.s = v.s AND (g.a1 NOT IN (0, -1) OR g.a2 NOT IN (0, -1))) AS ref_or_unk
  FROM fv v) GROUP BY 1, 2, 3, 4""")
def x19_genotype_predicates(spark, sf):
    m = F.col("members")
    return derive.calls(spark, sf).select(
        genotypes.all_reference(m).alias("all_ref"), genotypes.any_unknown(m).alias("any_unk"),
        genotypes.all_unknown(m).alias("all_unk"), genotypes.reference_or_unknown(m).alias("ref_or_unk"),
    ).groupBy("all_ref", "any_unk", "all_unk", "ref_or_unk").agg(F.count("*").alias("genotypes"))


RB = "CASE WHEN chromosome IN ('chr1', 'chr2', 'chr3') THEN chromosome ELSE 'other' END || '_' || ((position - 1) // 100000)"


@register("x20_region_bin", f"SELECT s::BIGINT AS s, {RB} AS region_bin FROM sites")
def x20_region_bin(spark, sf):
    return derive.sites(spark, sf).select(
        F.col("summary_index").alias("s"),
        bins.region_bin(F.col("chromosome"), F.col("position"), derive.PARTITIONING).alias("region_bin"))


@register("x20_integer_region_bin", """
SELECT s::BIGINT AS s, CASE WHEN chromosome IN ('chr1', 'chr2', 'chr3') THEN (substr(chromosome, 4)::INT - 1) * 10000 + (position - 1) // 100000
  ELSE 10000000 + (position - 1) // 100000 END::BIGINT AS region_bin FROM sites""")
def x20_integer_region_bin(spark, sf):
    from dataclasses import replace
    return derive.sites(spark, sf).select(
        F.col("summary_index").alias("s"),
        bins.region_bin(F.col("chromosome"), F.col("position"), replace(derive.PARTITIONING, integer_region_bins=True)).cast("long").alias("region_bin"))


@register("x21_region_bins", """
SELECT s::BIGINT AS s, CASE WHEN chromosome IN ('chr1', 'chr2', 'chr3') THEN chromosome ELSE 'other' END || '_' || b AS region_bin
FROM (SELECT *, unnest(range((position - 1) // 100000, (end_position - 1) // 100000 + 1)) AS b FROM sites)""")
def x21_region_bins(spark, sf):
    return derive.sites(spark, sf).select(
        F.col("summary_index").alias("s"), F.explode(bins.region_bins(
            F.col("chromosome"), F.col("position"), F.col("end_position"), derive.PARTITIONING)).alias("region_bin"))


@register("x22_frequency_bin", """
SELECT s.s::BIGINT AS s, s.ai::BIGINT AS ai, CASE WHEN s.seen_as_denovo THEN 0 WHEN f.af_allele_count <= 1 THEN 1
  WHEN f.af_allele_freq <= 5 THEN 2 ELSE 3 END::BIGINT AS frequency_bin
FROM summary s JOIN freq f ON f.s = s.s AND f.ai = s.ai""")
def x22_frequency_bin(spark, sf):
    sa = derive.study(spark, sf, counters=True, frequencies=True).summary
    return sa.select(*site(), bins.frequency_bin(
        F.col("af_allele_count"), F.col("af_allele_freq"), F.col("seen_as_denovo"), 5.0).alias("frequency_bin"))


@register("x23_coding_bin", "SELECT s::BIGINT AS s, ai::BIGINT AS ai, (effect <> 'intergenic')::BIGINT AS coding_bin FROM sa")
def x23_coding_bin(spark, sf):
    return derive.alleles(spark, sf).select(*site(), bins.coding_bin(
        F.col("effect_gene"), F.col("allele_index"), derive.PARTITIONING.coding_effects).alias("coding_bin"))


def folded(n: int) -> str:
    """SHA-256 modulo ``n`` in SQL, 32 bits at a time."""
    acc = "0::BIGINT"
    for i in range(8):
        acc = f"(({acc} * 4294967296 + ('0x' || substr(sha256(family_id), {8 * i + 1}, 8))::BIGINT) % {n})"
    return acc


@register("x24_family_bin", f"SELECT DISTINCT family_id, {folded(20)}::BIGINT AS family_bin FROM ped")
def x24_family_bin(spark, sf):
    return derive.ped(spark, sf).select("family_id", bins.family_bin(F.col("family_id"), 20).alias("family_bin")).distinct()
