"""Browser columns, joins, summary aggregates, running indexes, paging and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import derive
from checks.registry import register
from checks.variant_queries import GM, ROWS_SQL, rows, site
from kinfold.functions import codes
from kinfold.operators import filters, pedigree, person_sets, pheno, variants
from kinfold.plans import browser
from kinfold.plans import study as plan

COLS = [
    "family", "location", "variant", "genotype", "family_person_ids", "carrier_person_ids", "inheritance_type",
    "is_denovo", "worst_effect", "genes", "effects", "carrier_person_attributes"]


@register("x25_browser_columns", """, gtext AS (
  SELECT family_id, s, string_agg(CASE WHEN a1 < 0 THEN '.' ELSE a1::VARCHAR END || '/' || CASE WHEN a2 < 0 THEN '.' ELSE a2::VARCHAR END, ';' ORDER BY idx) AS genotype,
    string_agg(person_id, ';' ORDER BY idx) AS ids FROM gt GROUP BY 1, 2),
ctext AS (
  SELECT family_id, s, ai, string_agg(CASE role WHEN 16 THEN 'mom' WHEN 32 THEN 'dad' WHEN 128 THEN 'prb' ELSE 'sib' END || ':'
    || CASE sex WHEN 1 THEN 'M' WHEN 2 THEN 'F' ELSE 'U' END || ':'
    || CASE status WHEN 1 THEN 'unaffected' WHEN 2 THEN 'affected' ELSE 'unspecified' END, ';' ORDER BY idx) AS attrs
  FROM member_class WHERE carrier GROUP BY 1, 2, 3)
SELECT v.family_id AS family, v.location, CASE WHEN reference = 'ACACAC' AND v.ai = 1 THEN 'TR(3xAC->4)' ELSE variant END AS variant,
  g.genotype, g.ids AS family_person_ids, v.carriers AS carrier_person_ids,
  CASE WHEN (inheritance & 4) <> 0 THEN 'denovo' ELSE 'mendelian' END AS inheritance_type,
  CASE WHEN (inheritance & 4) <> 0 THEN 'true' ELSE 'false' END AS is_denovo,
  CASE WHEN effect = 'intergenic' AND gene2 IS NOT NULL THEN 'intron' ELSE effect END AS worst_effect,
  CASE WHEN effect = 'intergenic' AND gene2 IS NOT NULL THEN gene2 ELSE gene END AS genes,
  gene || ':' || effect || coalesce('|' || gene2 || ':intron', '') AS effects, c.attrs AS carrier_person_attributes
FROM v JOIN gtext g ON g.family_id = v.family_id AND g.s = v.s JOIN ctext c ON c.family_id = v.family_id AND c.s = v.s AND c.ai = v.ai""")
def x25_browser_columns(spark, sf):
    return browser.answer(plan.query_variants(derive.study(spark, sf)), COLS)


@register("x25_seen_in_status", "SELECT s::BIGINT AS s, ai::BIGINT AS ai, seen_in_status IN (2, 3) AS seen_in_affected, seen_in_status IN (1, 3) AS seen_in_unaffected FROM summary")
def x25_seen_in_status(spark, sf):
    sa = derive.study(spark, sf, counters=True).summary
    known = browser.columns()
    return sa.select(*site(), known["seen_in_affected"].alias("seen_in_affected"), known["seen_in_unaffected"].alias("seen_in_unaffected"))


@register("x26_variant_rows", """
SELECT family_id, s::BIGINT AS s, CASE WHEN count(DISTINCT coalesce(variant, '-')) = 1 THEN min(variant) ELSE string_agg(variant, '|' ORDER BY ai) END AS variant,
  CASE WHEN count(DISTINCT carriers) = 1 THEN min(carriers) ELSE string_agg(carriers, '|' ORDER BY ai) END AS carriers,
  coalesce(printf('%.2f', min(score)), '-') AS score
FROM (SELECT family_id, s, ai, carriers, score, CASE WHEN reference = 'ACACAC' AND ai = 1 THEN 'TR(3xAC->4)' ELSE variant END AS variant FROM v) GROUP BY 1, 2""")
def x26_variant_rows(spark, sf):
    found = browser.variant_rows(
        plan.query_variants(derive.study(spark, sf)), ["variant", "carrier_person_ids", "score"], {"score": "%.2f"})
    return found.select(
        "family_id", F.col("summary_index").alias("s"), F.array_join("variant", "|").alias("variant"),
        F.array_join("carrier_person_ids", "|").alias("carriers"), F.array_join("score", "|").alias("score"))


@register("x27_gene_scores_and_family_measures", """, gs AS (SELECT p_brand AS gene, sum(p_size)::DOUBLE AS size_total, count(*)::DOUBLE AS sites FROM part GROUP BY 1),
fm AS (SELECT family_id, balance FROM ped WHERE role = 128)
SELECT v.family_id, v.s::BIGINT AS s, v.ai::BIGINT AS ai, gs.size_total, gs.sites, fm.balance FROM v LEFT JOIN gs USING (gene) LEFT JOIN fm ON fm.family_id = v.family_id""")
def x27_gene_scores_and_family_measures(spark, sf):
    ped = derive.ped(spark, sf)
    measures = pheno.family_measure(pheno.measure_values(derive.instruments(spark, sf), ["i1.balance"]), ped, "i1.balance", "prb")
    found = browser.with_gene_scores(
        plan.query_variants(derive.study(spark, sf)), derive.gene_scores(spark, sf), ["size_total", "sites"])
    return browser.with_family_measures(found, measures).select(
        "family_id", *site(), "size_total", "sites", F.col("`i1.balance.prb`").alias("balance"))


@register("x25_phenotypes", """
SELECT v.family_id, v.s::BIGINT AS s, v.ai::BIGINT AS ai, f.all_sets AS family_phenotypes, c.sets AS carrier_phenotypes
FROM v JOIN (SELECT family_id, string_agg(CASE status WHEN 1 THEN 'unaffected' WHEN 2 THEN 'affected' ELSE 'unspecified' END, ':' ORDER BY idx) AS all_sets
  FROM members GROUP BY 1) f ON f.family_id = v.family_id
JOIN (SELECT family_id, s, ai, string_agg(CASE status WHEN 1 THEN 'unaffected' WHEN 2 THEN 'affected' ELSE 'unspecified' END, ':' ORDER BY idx) AS sets
  FROM member_class WHERE carrier GROUP BY 1, 2, 3) c ON c.family_id = v.family_id AND c.s = v.s AND c.ai = v.ai""")
def x25_phenotypes(spark, sf):
    sets = person_sets.assign(derive.ped(spark, sf), derive.diagnosis())
    return browser.with_phenotypes(plan.query_variants(derive.study(spark, sf)), sets).select(
        "family_id", *site(), "family_phenotypes", "carrier_phenotypes")


@register("x28_gene_view", """
SELECT location || '.' || coalesce(reference, 'None') || '.' || coalesce(alternative, 'None') || '.1' AS svuid, location, position::BIGINT AS position,
  end_position::BIGINT AS end_position, chromosome AS chrom, af_allele_freq AS frequency,
  CASE WHEN effect = 'intergenic' AND gene2 IS NOT NULL THEN 'intron' ELSE effect END AS effect, variant, family_variants_count,
  seen_as_denovo AS is_denovo, seen_in_status IN (2, 3) AS seen_in_affected, seen_in_status IN (1, 3) AS seen_in_unaffected
FROM summary JOIN freq USING (s, ai)""")
def x28_gene_view(spark, sf):
    return browser.gene_view(derive.study(spark, sf, counters=True, frequencies=True).summary, "af_allele_freq")


@register("d28_gene_browser_query", """
SELECT location, variant, family_variants_count, seen_as_denovo AS is_denovo FROM summary
WHERE (gene IN ('Brand#2', 'Brand#5') AND effect = 'missense')""")
def d28_gene_browser_query(spark, sf):
    found = plan.summary_query(
        derive.study(spark, sf, counters=True), genes=["Brand#2", "Brand#5"], effect_types=["missense"])
    return browser.gene_view(found, "score").select("location", "variant", "family_variants_count", "is_denovo")


@register("x29_clean_and_typed_values", base=False, sql="""
SELECT 'P' || c_custkey AS person_id, CASE WHEN c_mktsegment <> '' THEN c_mktsegment END AS segment, c_nationkey::BIGINT AS nation,
  (CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::DOUBLE AS solvent FROM customer""")
def x29_clean_and_typed_values(spark, sf):
    raw = derive.table(spark, sf, "customer").select(
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("person_id"), F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("nation"),
        F.when(F.col("c_acctbal") > 0, "True").otherwise("False").alias("solvent"))
    return pheno.typed_values(raw, {"segment": "str", "nation": "int", "solvent": "float"})


@register("x30_annotation_columns", """
SELECT s::BIGINT AS s, ai::BIGINT AS ai, CASE WHEN NOT cnv THEN size::BIGINT * 10 END AS depth FROM sa""")
def x30_annotation_columns(spark, sf):
    sa = derive.alleles(spark, sf)
    sizes = derive.table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("summary_index"), (F.col("p_size").cast("long") * 10).alias("depth"))
    notes = sa.join(sizes, "summary_index").filter("reference IS NOT NULL").select(
        "chromosome", "position", "reference", "alternative", "depth")
    return variants.annotate(sa, notes, drop=["score", "label"]).select(*site(), "depth")


@register("x31_role_words", """
SELECT person_id, role::BIGINT AS role, sex::BIGINT AS sex, status::BIGINT AS status FROM ped""")
def x31_role_words(spark, sf):
    """Codes written as words of several spellings and read back."""
    ped = derive.ped(spark, sf)
    words = ped.select(
        "person_id",
        F.when(F.col("role") == 16, "Mother").when(F.col("role") == 32, "DAD").when(F.col("role") == 128, "Proband").otherwise("younger sibling").alias("role"),
        F.when(F.col("sex") == 1, "male").when(F.col("sex") == 2, "2").otherwise("Unspecified").alias("sex"),
        F.when(F.col("status") == 1, "False").when(F.col("status") == 2, "affected").otherwise("-").alias("status"))
    return words.select(
        "person_id", codes.role_code(F.col("role")).alias("role"), codes.sex_code(F.col("sex")).alias("sex"),
        codes.status_code(F.col("status")).alias("status"))


@register("x32_effect_groups", """
SELECT g AS effect_group, count(*) AS alleles FROM (
  SELECT unnest(CASE WHEN effect IN ('frame-shift', 'nonsense', 'splice-site') THEN ['lgds', 'coding', 'nonsynonymous']
    WHEN effect = 'missense' THEN ['coding', 'nonsynonymous'] WHEN effect = 'synonymous' THEN ['coding'] ELSE ['noncoding'] END) AS g FROM sa) GROUP BY 1""")
def x32_effect_groups(spark, sf):
    from kinfold.operators.reports import label_array
    effect = F.array(F.col("effect_gene")[0]["effect_types"])
    labels = label_array(["lgds", "coding", "nonsynonymous", "noncoding", "utrs"], effect)
    return derive.alleles(spark, sf).select(F.explode(labels).alias("effect_group")).groupBy("effect_group").agg(
        F.count("*").alias("alleles"))


# ---- joins ------------------------------------------------------------------------------------

@register("j01_summary_with_family", ROWS_SQL.format("true"))
def j01_summary_with_family(spark, sf):
    return rows(plan.query_variants(derive.study(spark, sf)))


@register("j03_carriers_with_pedigree", """
SELECT segment, count(*) AS carriers FROM member_class c JOIN ped p USING (person_id) WHERE carrier AND ai > 0 GROUP BY 1""")
def j03_carriers_with_pedigree(spark, sf):
    fa = derive.family(spark, sf).filter("allele_index > 0")
    carriers = fa.select("family_id", F.explode("allele_in_members").alias("person_id"))
    return carriers.join(derive.ped(spark, sf), ["family_id", "person_id"]).groupBy("segment").agg(F.count("*").alias("carriers"))


@register("j04_alleles_by_gene_and_effect", """
SELECT gene, effect, count(*) AS alleles FROM (
  SELECT gene, effect FROM sa UNION ALL SELECT gene2, 'intron' FROM sa WHERE gene2 IS NOT NULL) GROUP BY 1, 2""")
def j04_alleles_by_gene_and_effect(spark, sf):
    pairs = derive.alleles(spark, sf).select(F.explode("effect_gene").alias("g"))
    return pairs.groupBy(
        F.col("g.effect_gene_symbols").alias("gene"), F.col("g.effect_types").alias("effect")).agg(F.count("*").alias("alleles"))


@register("j05_person_sets", """
SELECT family_id, person_id, CASE WHEN segment = 'MACHINERY' AND sex = 1 THEN 'machine_m' WHEN segment = 'MACHINERY' AND sex = 2 THEN 'machine_f'
  WHEN segment = 'BUILDING' AND sex = 1 THEN 'building_m' ELSE 'others' END AS set_id FROM members""")
def j05_person_sets(spark, sf):
    return person_sets.assign(derive.ped(spark, sf), derive.market()).select("family_id", "person_id", "set_id")


@register("j05_person_sets_from_measures", """, oc AS (SELECT 'P' || o_custkey AS person_id, min(o_orderpriority) AS priority FROM orders GROUP BY 1)
SELECT m.family_id, m.person_id, CASE WHEN priority = '1-URGENT' THEN 'urgent' WHEN priority = '2-HIGH' THEN 'high' ELSE 'rest' END AS set_id
FROM members m LEFT JOIN oc USING (person_id)""")
def j05_person_sets_from_measures(spark, sf):
    by_priority = person_sets.Collection(
        "priority", "Priority", (("phenotype", "i2.priority"),),
        (person_sets.PersonSet("urgent", "urgent", ("1-URGENT",)), person_sets.PersonSet("high", "high", ("2-HIGH",))),
        person_sets.PersonSet("rest", "rest", ()))
    values = pheno.measure_values(derive.instruments(spark, sf), ["i2.priority"])
    return person_sets.assign(derive.ped(spark, sf), by_priority, values).select("family_id", "person_id", "set_id")


MV = """, oc AS (SELECT 'P' || o_custkey AS person_id, min(o_totalprice) AS cheapest, count(*) AS orders, min(o_orderpriority) AS priority FROM orders GROUP BY 1)"""


@register("j06_measure_values", MV + """
SELECT p.person_id, p.family_id, p.role::BIGINT AS role, p.balance, oc.cheapest, oc.orders FROM ped p LEFT JOIN oc USING (person_id) WHERE p.role IN (128, 256)""")
def j06_measure_values(spark, sf):
    values = pheno.measure_values(
        derive.instruments(spark, sf), ["i1.balance", "i2.cheapest", "i2.orders"], derive.ped(spark, sf), roles=["prb", "sib"])
    return values.select(
        "person_id", "family_id", "role", F.col("`i1.balance`").alias("balance"),
        F.col("`i2.cheapest`").alias("cheapest"), F.col("`i2.orders`").alias("orders"))


@register("j07_measures_of_child_studies", MV + "SELECT person_id, p.balance, cheapest FROM ped p JOIN oc USING (person_id)")
def j07_measures_of_child_studies(spark, sf):
    inst = derive.instruments(spark, sf)
    both = pheno.measure_values_of_children([
        pheno.measure_values(inst, ["i1.balance"]), pheno.measure_values(inst, ["i2.cheapest"])])
    return both.select("person_id", F.col("`i1.balance`").alias("balance"), F.col("`i2.cheapest`").alias("cheapest"))


@register("j08_stacked_child_studies", MV + """
SELECT person_id, balance, NULL::DOUBLE AS cheapest FROM ped UNION ALL SELECT person_id, NULL, cheapest FROM oc""")
def j08_stacked_child_studies(spark, sf):
    inst = derive.instruments(spark, sf)
    stacked = pheno.stacked_children([
        pheno.measure_values(inst, ["i1.balance"]), pheno.measure_values(inst, ["i2.cheapest"])])
    return stacked.select("person_id", F.col("`i1.balance`").alias("balance"), F.col("`i2.cheapest`").alias("cheapest"))


@register("j09_measures_with_variant_counts", MV + """, vc AS (
  SELECT person_id, count(DISTINCT s) AS n FROM member_class WHERE carrier AND ai > 0 AND inh = 4 GROUP BY 1)
SELECT p.person_id, p.balance, coalesce(vc.n, 0) AS variant_count FROM ped p LEFT JOIN vc USING (person_id) WHERE p.role = 128""")
def j09_measures_with_variant_counts(spark, sf):
    fa = derive.family(spark, sf).filter("allele_index > 0")
    hits = fa.select("summary_index", F.explode(F.arrays_zip("member_ids", "inheritance_by_member", "genotype")).alias("z"), "allele_index")
    carrier = (F.col("z.genotype.a1") == F.col("allele_index")) | (F.col("z.genotype.a2") == F.col("allele_index"))
    counts = hits.filter(carrier & (F.col("z.inheritance_by_member") == 4)).groupBy(F.col("z.member_ids").alias("person_id")).agg(
        F.count_distinct("summary_index").alias("variant_count"))
    values = pheno.measure_values(derive.instruments(spark, sf), ["i1.balance"], derive.ped(spark, sf), roles=["prb"])
    return values.join(counts, "person_id", "left").fillna(0, ["variant_count"]).select(
        "person_id", F.col("`i1.balance`").alias("balance"), "variant_count")


@register("j11_trios", "SELECT family_id, person_id AS child, mom_id AS mom, dad_id AS dad FROM members WHERE is_child")
def j11_trios(spark, sf):
    return pedigree.trios(derive.ped(spark, sf))


@register("j12_region_table_overlap", GM + """
SELECT s::BIGINT AS s, ai::BIGINT AS ai FROM sa WHERE EXISTS (
  SELECT 1 FROM gm WHERE gm.gene IN (SELECT 'G' || s_suppkey FROM supplier WHERE s_nationkey < 12) AND gm.chrom = sa.chromosome
  AND sa.end_position >= cds_start AND sa.position <= cds_end)""")
def j12_region_table_overlap(spark, sf):
    """Alleles inside the transcripts of a gene table; the region list grows with the data."""
    wanted = derive.table(spark, sf, "supplier").filter("s_nationkey < 12").select(
        F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("gene"))
    regions = derive.gene_models(spark, sf).join(wanted, "gene", "left_semi").select(
        "chrom", F.col("cds_start").alias("start"), F.col("cds_end").alias("stop"))
    return plan.summary_query(derive.study(spark, sf), regions=regions).select(*site())


@register("j13_families_combined", """
SELECT family_id, person_id, CASE WHEN missing AND NOT (segment = 'BUILDING') THEN sex2 WHEN missing THEN sex2
   WHEN sex = 4 THEN sex2 WHEN segment = 'BUILDING' THEN sex WHEN sex <> sex2 THEN sex2 ELSE sex2 END::BIGINT AS sex
FROM (SELECT *, CASE WHEN nation = 3 THEN 3 - least(sex, 2) ELSE least(sex, 2) END AS sex2 FROM ped)""")
def j13_families_combined(spark, sf):
    """The second pedigree misses the BUILDING segment's genotypes and disagrees on one nation."""
    first = derive.ped(spark, sf)
    base = F.least(F.col("sex"), F.lit(2))
    second = first.withColumn("sex", F.when(F.col("nation") == 3, 3 - base).otherwise(base).cast("int")).withColumn(
        "not_sequenced", F.col("segment") == "BUILDING")
    return pedigree.combine_families(first, second).select("family_id", "person_id", "sex")


@register("j14_person_sets_combined", """
SELECT family_id, person_id, CASE WHEN segment = 'MACHINERY' THEN CASE status WHEN 1 THEN 'unaffected' WHEN 2 THEN 'affected' ELSE 'unspecified' END
  WHEN role IN (128, 256) THEN 'affected' ELSE 'unspecified' END AS set_id FROM members""")
def j14_person_sets_combined(spark, sf):
    ped = derive.ped(spark, sf)
    first = person_sets.assign(ped, derive.diagnosis()).join(
        ped.filter("segment = 'MACHINERY'").select("person_id"), "person_id", "left_semi")
    second = person_sets.assign(ped.filter("role IN (128, 256)"), derive.diagnosis()).withColumn("set_id", F.lit("affected"))
    return person_sets.combine([first, second], ped, "status", "unspecified").select("family_id", "person_id", "set_id")


@register("j15_withdrawn_families", """, gone AS (SELECT family_id FROM ped WHERE segment = 'AUTOMOBILE' AND role = 16)
SELECT 'family' AS stored, count(*) AS n FROM fa WHERE family_id NOT IN (SELECT family_id FROM gone)
UNION ALL SELECT 'pedigree', count(*) FROM ped WHERE family_id NOT IN (SELECT family_id FROM gone)
UNION ALL SELECT 'instrument', count(*) FROM ped WHERE family_id NOT IN (SELECT family_id FROM gone)""")
def j15_withdrawn_families(spark, sf):
    ped = derive.ped(spark, sf)
    gone = ped.filter("segment = 'AUTOMOBILE' AND role = 16").select("family_id")
    kept = {
        "family": pedigree.without_families(derive.family(spark, sf), gone),
        "pedigree": pedigree.without_families(ped, gone),
        "instrument": pedigree.without_persons(derive.instruments(spark, sf)["i1"], ped, gone)}
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("stored"), F.count("*").alias("n")) for n, df in kept.items()])


# ---- aggregates -------------------------------------------------------------------------------

@register("a01_allele_frequencies", """
SELECT s::BIGINT AS s, ai::BIGINT AS ai, af_parents_called_count, af_allele_count, af_ref_allele_count, af_parents_called_percent,
  af_allele_freq, af_ref_allele_freq FROM freq""")
def a01_allele_frequencies(spark, sf):
    freq = variants.allele_frequencies(derive.calls(spark, sf), derive.founders(spark, sf))
    return variants.with_frequency(derive.alleles(spark, sf), freq).select(
        *site(), "af_parents_called_count", "af_allele_count", "af_ref_allele_count", "af_parents_called_percent",
        "af_allele_freq", "af_ref_allele_freq")


@register("a02_a04_summary_counters", "SELECT s::BIGINT AS s, ai::BIGINT AS ai, seen_in_status, seen_as_denovo, family_variants_count FROM summary")
def a02_a04_summary_counters(spark, sf):
    return derive.study(spark, sf, counters=True).summary.select(
        *site(), "seen_in_status", "seen_as_denovo", "family_variants_count")


@register("a05_summaries_merged_over_studies", """
SELECT svuid, sum(n)::BIGINT AS family_variants_count, bit_or(st)::BIGINT AS seen_in_status, bool_or(dn) AS seen_as_denovo, min(study_id) AS study_id FROM (
  SELECT a.location || '.' || coalesce(a.reference, 'None') || '.' || coalesce(a.alternative, 'None') || '.1' AS svuid, 'study_' || k.flag AS study_id,
    count(f.s) AS n, coalesce(bit_or(f.statuses), 0) AS st, coalesce(bool_or((f.inheritance & 4) <> 0), false) AS dn
  FROM sa a JOIN (SELECT DISTINCT s, flag FROM fa) k ON k.s = a.s LEFT JOIN fa f ON f.s = a.s AND f.ai = a.ai AND f.flag = k.flag
  GROUP BY 1, 2) GROUP BY 1""")
def a05_summaries_merged_over_studies(spark, sf):
    fa = derive.family(spark, sf, ["flag"])
    sa = derive.alleles(spark, sf)
    parts = [
        variants.stored_summary(sa, fa.filter(F.col("flag") == f)).withColumn("study_id", F.lit(f"study_{f}")) for f in ("A", "N", "R")]
    stacked = reduce(DataFrame.unionByName, parts).withColumn("svuid", plan.svuid()).drop("effect_gene", "variant_desc", "family_alleles_count")
    return variants.merge_summaries(stacked).select(
        "svuid", "family_variants_count", "seen_in_status", "seen_as_denovo", "study_id")


@register("a06_summary_from_family_rows", """
SELECT f.s::BIGINT AS s, f.ai::BIGINT AS ai, count(DISTINCT f.family_id) AS family_variants_count, bit_or(m.status)::BIGINT AS seen_in_status,
  bool_or((f.inheritance & 4) <> 0) AS seen_as_denovo, min(f.flag) AS flag
FROM fa f JOIN member_class m ON m.family_id = f.family_id AND m.s = f.s AND m.ai = f.ai AND m.carrier
WHERE f.ai > 0 AND (f.inheritance & 134) <> 0 GROUP BY 1, 2""")
def a06_summary_from_family_rows(spark, sf):
    found = variants.summary_from_family(
        derive.family(spark, sf, ["flag"]), derive.ped(spark, sf), ["summary_index", "allele_index"], ["flag"])
    return found.select(*site(), "family_variants_count", "seen_in_status", "seen_as_denovo", "flag")


# ---- running indexes, paging, sets --------------------------------------------------------------

@register("w04_running_summary_index", """
SELECT chromosome, position::BIGINT AS position, row_number() OVER (PARTITION BY chromosome ORDER BY position) - 1 AS summary_number FROM sites""")
def w04_running_summary_index(spark, sf):
    numbered = variants.running_index(
        derive.sites(spark, sf).select("chromosome", "position", "reference"), "chromosome", "position", ["reference"], "summary_number")
    return numbered.select("chromosome", "position", "summary_number")


@register("w03_first_sample_call_wins", """
SELECT s::BIGINT AS s, person_id,
  (CASE WHEN substr(person_id, 2)::INT % 3 <> 0 THEN a1 WHEN s % 2 = 0 THEN 0 ELSE -1 END)::BIGINT AS a1,
  (CASE WHEN substr(person_id, 2)::INT % 3 <> 0 THEN a2 WHEN s % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS a2 FROM gt""")
def w03_first_sample_call_wins(spark, sf):
    """Two batches that share families: the first lacks every third sample, and the second, with other calls for all, every other site."""
    from kinfold.sources import vcf
    calls = derive.calls(spark, sf)

    def batch(rows, known, a1, a2):
        return rows.withColumn("members", F.transform("members", lambda m: F.when(known(m), m.withField("a1", a1(m)).withField("a2", a2(m))).otherwise(
            m.withField("a1", F.lit(-1)).withField("a2", F.lit(-1))).withField("known", known(m))))

    first = batch(calls, lambda m: F.substring(m["person_id"], 2, 20).cast("int") % 3 != 0, lambda m: m["a1"], lambda m: m["a2"])
    second = batch(calls.filter("summary_index % 2 = 0"), lambda m: m["person_id"].isNotNull(), lambda m: F.lit(0), lambda m: F.lit(1))
    merged = vcf.merged_calls([b.select("bucket_index", "summary_index", "family_id", "members") for b in (first, second)])
    return merged.select(F.col("summary_index").alias("s"), F.inline("members")).select("s", "person_id", "a1", "a2")


@register("w05_reference_beside_alternative", "SELECT s::BIGINT AS s, ai::BIGINT AS ai, af_allele_count, af_ref_allele_count FROM freq")
def w05_reference_beside_alternative(spark, sf):
    freq = variants.allele_frequencies(derive.calls(spark, sf), derive.founders(spark, sf))
    return variants.with_frequency(derive.alleles(spark, sf), freq).select(*site(), "af_allele_count", "af_ref_allele_count")


@register("l01_limit_after_dedupe", "SELECT count(*) AS n FROM (SELECT 1 FROM v LIMIT 500)")
def l01_limit_after_dedupe(spark, sf):
    return plan.query_variants(derive.study(spark, sf), unique=True, limit=500).agg(F.count("*").alias("n"))


@register("l02_values_ordered_by_person", MV + "SELECT p.person_id, p.balance, oc.cheapest FROM ped p LEFT JOIN oc USING (person_id) ORDER BY 1")
def l02_values_ordered_by_person(spark, sf):
    values = pheno.measure_values(derive.instruments(spark, sf), ["i1.balance", "i2.cheapest"])
    return pheno.download_rows(values, ["i1.balance", "i2.cheapest"]).select(
        "person_id", F.col("`i1.balance`").alias("balance"), F.col("`i2.cheapest`").alias("cheapest"))


@register("l05_preview", "SELECT count(*) AS n FROM (SELECT 1 FROM v WHERE (inheritance & 4) <> 0 LIMIT 1001)")
def l05_preview(spark, sf):
    found = plan.query_variants(derive.study(spark, sf), inheritance="denovo")
    return plan.variant_preview(found, 1000).agg(F.count("*").alias("n"))


@register("u02_people_of_instruments", "SELECT person_id FROM ped UNION SELECT 'P' || o_custkey FROM orders")
def u02_people_of_instruments(spark, sf):
    return pheno.instrument_people(derive.instruments(spark, sf), ["i1", "i2"])


@register("u03_ids_in_all_filters", "SELECT person_id FROM ped WHERE segment = 'BUILDING' AND balance >= 0 AND balance <= 5000 AND role = 128")
def u03_ids_in_all_filters(spark, sf):
    ped = derive.ped(spark, sf)
    return filters.intersect_ids([
        filters.persons_with_value(ped, "segment", ["BUILDING"]), filters.persons_in_range(ped, "balance", 0.0, 5000.0),
        filters.persons_with_value(ped, "role", ["prb"])])




@register("j02_alleles_of_tagged_families", "SELECT count(*) AS alleles FROM fa WHERE family_id IN (SELECT family_id FROM ped GROUP BY 1 HAVING count(*) FILTER (WHERE status = 2) > 1)")
def j02_alleles_of_tagged_families(spark, sf):
    """A tag is held by every member; each family row is still kept once."""
    chosen = pedigree.tagged_family_ids(pedigree.family_tags(derive.ped(spark, sf)), ["tag_multiplex_family"], None)
    return derive.family(spark, sf).join(chosen, "family_id", "left_semi").agg(F.count("*").alias("alleles"))


@register("u04_rows_of_kept_families", "SELECT person_id FROM ped WHERE family_id NOT IN (SELECT family_id FROM ped WHERE segment = 'AUTOMOBILE')")
def u04_rows_of_kept_families(spark, sf):
    ped = derive.ped(spark, sf)
    return pedigree.without_families(ped, ped.filter("segment = 'AUTOMOBILE'").select("family_id").distinct()).select("person_id")
