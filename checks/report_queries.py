"""Pedigree operators, reports, gene sets, enrichment and gene profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derive
from checks.registry import register
from checks.variant_queries import TAGS_SQL
from kinfold.operators import enrichment, gene_sets, pedigree, person_sets, reports
from kinfold.plans import gene_profiles
from kinfold.plans import study as plan

SET = "CASE status WHEN 1 THEN 'unaffected' WHEN 2 THEN 'affected' ELSE 'unspecified' END"
SETS = f", ps AS (SELECT family_id, person_id, idx, sex, status, role, is_child, {SET} AS set_id FROM members)"
LABELS = ["lgds", "nonsynonymous", "missense", "synonymous", "utrs"]
LABELS_SQL = """CASE effect WHEN 'missense' THEN ['nonsynonymous', 'missense'] WHEN 'synonymous' THEN ['synonymous']
  WHEN 'intergenic' THEN [] ELSE ['lgds', 'nonsynonymous'] END"""


def sets(spark, sf):
    return person_sets.assign(derive.ped(spark, sf), derive.diagnosis())


def denovo(spark, sf):
    return plan.query_variants(derive.study(spark, sf), inheritance="denovo")


# ---- pedigree -----------------------------------------------------------------------------------

@register("d29_family_tags", TAGS_SQL + "SELECT * FROM tags")
def d29_family_tags(spark, sf):
    return pedigree.family_tags(derive.ped(spark, sf))


@register("d30_inferred_roles", """
SELECT p.person_id, CASE WHEN NOT EXISTS (SELECT 1 FROM ped b WHERE b.family_id = p.family_id AND b.role = 128 AND b.status = 2 AND NOT b.missing)
    AND NOT EXISTS (SELECT 1 FROM ped b WHERE b.family_id = p.family_id AND b.role = 256 AND b.status = 2 AND NOT b.missing) THEN 33554432
  WHEN EXISTS (SELECT 1 FROM ped b WHERE b.family_id = p.family_id AND b.role = 128 AND b.status = 2 AND NOT b.missing) THEN p.role
  WHEN p.role = 256 THEN 128 WHEN p.role = 128 THEN 256 ELSE p.role END::BIGINT AS role
FROM ped p""")
def d30_inferred_roles(spark, sf):
    """Roles forgotten and inferred again from parent ids and affected children."""
    bare = derive.ped(spark, sf).withColumn("role", F.lit(None).cast("int"))
    return pedigree.infer_roles(bare).select("person_id", F.col("inferred_role").alias("role"))


@register("d31_founders_and_children", "SELECT family_id, person_id, is_child, is_founder, has_mom OR has_dad AS has_parent FROM members")
def d31_founders_and_children(spark, sf):
    return pedigree.with_parent_flags(derive.ped(spark, sf)).filter("NOT missing").select(
        "family_id", "person_id", "is_child", "is_founder", "has_parent")


@register("d31_families_of_persons", "SELECT DISTINCT family_id FROM ped WHERE segment = 'HOUSEHOLD'")
def d31_families_of_persons(spark, sf):
    ped = derive.ped(spark, sf)
    return pedigree.families_of_persons(ped, ped.filter("segment = 'HOUSEHOLD'").select("person_id"))


@register("d32_conflicting_definitions", "SELECT family_id, person_id, 2::BIGINT AS definitions FROM members WHERE nation = 7 AND role IN (128, 256)")
def d32_conflicting_definitions(spark, sf):
    """A second copy of the pedigree disagrees on the status of one nation's children."""
    ped = derive.ped(spark, sf)
    other = ped.withColumn("status", F.when(
        (F.col("nation") == 7) & F.col("role").isin(128, 256), 4).otherwise(F.col("status")))
    return pedigree.conflicting_definitions(ped.unionByName(other))


@register("d32_broken_families", "SELECT family_id FROM ped GROUP BY 1 HAVING bool_and(missing OR segment IN ('BUILDING', 'FURNITURE', 'MACHINERY'))")
def d32_broken_families(spark, sf):
    ped = derive.ped(spark, sf).withColumn(
        "not_sequenced", F.col("not_sequenced") | F.col("segment").isin("BUILDING", "FURNITURE", "MACHINERY"))
    return pedigree.broken_families(ped)


@register("d38_family_details", """
SELECT family_id, string_agg(person_id || ':' || role, ',' ORDER BY idx) AS members FROM ped GROUP BY 1""")
def d38_family_details(spark, sf):
    details = pedigree.family_details(derive.ped(spark, sf))
    return details.select("family_id", F.array_join(F.transform(
        "members", lambda m: F.concat_ws(":", m["person_id"], m["role"].cast("string"))), ",").alias("members"))


@register("d43_pedigree_rewrite", """
SELECT person_id, missing OR person_id NOT IN (SELECT 'P' || o_custkey FROM orders) AS not_sequenced FROM ped""")
def d43_pedigree_rewrite(spark, sf):
    """Persons without a sample among the ordering customers become not sequenced."""
    samples = derive.table(spark, sf, "orders").select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("sample_id"))
    return pedigree.match_samples(derive.ped(spark, sf), samples, fixed=False).select("person_id", "not_sequenced")


@register("s06_not_sequenced_over_batches", "SELECT person_id, missing AND segment = 'BUILDING' AS in_all, missing OR segment = 'BUILDING' AS in_any FROM ped")
def s06_not_sequenced_over_batches(spark, sf):
    ped = derive.ped(spark, sf)
    other = ped.withColumn("not_sequenced", F.col("segment") == "BUILDING")
    every = pedigree.combine_not_sequenced([ped, other]).select("person_id", F.col("not_sequenced").alias("in_all"))
    some = pedigree.combine_not_sequenced([ped, other], union=True).select("person_id", F.col("not_sequenced").alias("in_any"))
    return every.join(some, "person_id")


# ---- person sets and reports ----------------------------------------------------------------------

@register("a08_people_counters", SETS + """
SELECT set_id, counter, people FROM (
  SELECT set_id, unnest(['people_male', 'people_female', 'people_unspecified', 'people_total']) AS counter,
    unnest([count(*) FILTER (WHERE sex = 1), count(*) FILTER (WHERE sex = 2), count(*) FILTER (WHERE sex = 4), count(*)]) AS people
  FROM ps GROUP BY 1) x
WHERE counter IN (SELECT c FROM (SELECT 'people_male' AS c, count(*) FILTER (WHERE sex = 1) AS n FROM ps
  UNION ALL SELECT 'people_female', count(*) FILTER (WHERE sex = 2) FROM ps
  UNION ALL SELECT 'people_unspecified', count(*) FILTER (WHERE sex = 4) FROM ps UNION ALL SELECT 'people_total', count(*) FROM ps) WHERE n > 0)""")
def a08_people_counters(spark, sf):
    return reports.people_counter_rows(reports.people_counters(sets(spark, sf))).select("set_id", "counter", "people")


TYPES = SETS + """, types AS (
  SELECT family_id, concat(count(*)::VARCHAR, ':', string_agg(set_id || '.' || r || '.' || x || '.' || set_id, ':' ORDER BY x, r, idx)) AS family_type
  FROM (SELECT *, CASE role WHEN 16 THEN 'mom' WHEN 32 THEN 'dad' WHEN 128 THEN 'prb' ELSE 'sib' END AS r,
    CASE sex WHEN 1 THEN 'M' WHEN 2 THEN 'F' ELSE 'U' END AS x FROM ps) GROUP BY 1)"""


@register("a09_family_types", TYPES + "SELECT family_id, family_type FROM types")
def a09_family_types(spark, sf):
    return reports.family_types(derive.ped(spark, sf), sets(spark, sf))


@register("l04_family_type_counters", TYPES + "SELECT family_type, count(*) AS pedigrees_count, min(family_id) AS example_family FROM types GROUP BY 1 ORDER BY 2 DESC, 1")
def l04_family_type_counters(spark, sf):
    return reports.family_type_counters(reports.family_types(derive.ped(spark, sf), sets(spark, sf)))


HEADLINE = "SELECT count(DISTINCT family_id) AS families, count(*) FILTER (WHERE role = 128 AND is_child) AS number_of_probands, count(*) FILTER (WHERE role = 256 AND is_child) AS number_of_siblings FROM (SELECT p.family_id, p.role, coalesce(m.is_child, false) AS is_child FROM ped p LEFT JOIN members m USING (person_id))"


@register("a10_headline_counts", HEADLINE)
def a10_headline_counts(spark, sf):
    return reports.headline(derive.ped(spark, sf))


REPORT = SETS + f""", kids AS (SELECT set_id, bool_or(is_child) AS any_child FROM ps GROUP BY 1),
chosen AS (SELECT ps.* FROM ps JOIN kids USING (set_id) WHERE is_child OR NOT any_child),
n_kids AS (SELECT set_id, count(DISTINCT person_id) AS children FROM chosen GROUP BY 1),
ev AS (SELECT fvuid, family_id, s, ai, unnest({LABELS_SQL}) AS effect FROM v WHERE (inheritance & 4) <> 0),
hit AS (SELECT c.set_id, e.effect, e.fvuid, c.person_id FROM ev e JOIN member_class m ON m.family_id = e.family_id AND m.s = e.s AND m.ai = e.ai AND m.carrier
  JOIN chosen c ON c.person_id = m.person_id),
cells AS (SELECT set_id, effect, count(DISTINCT fvuid) AS n, count(DISTINCT person_id) AS k FROM hit GROUP BY 1, 2)
SELECT g.set_id, g.effect, g.children, coalesce(n, 0) AS number_of_observed_events, coalesce(k, 0) AS number_of_children_with_event,
  coalesce(n, 0)::DOUBLE / children AS observed_rate_per_child, coalesce(k, 0)::DOUBLE / children AS percent_of_children_with_events
FROM (SELECT * FROM n_kids, (SELECT DISTINCT effect FROM cells) WHERE set_id IN (SELECT set_id FROM cells)) g LEFT JOIN cells USING (set_id, effect)"""


@register("a11_denovo_report", REPORT)
def a11_denovo_report(spark, sf):
    return reports.denovo_report(denovo(spark, sf), sets(spark, sf), LABELS).drop("psc_id")


KIDS = """SELECT set_id, count(*) FILTER (WHERE is_child AND sex = 1) AS male, count(*) FILTER (WHERE is_child AND sex = 2) AS female,
  count(*) FILTER (WHERE is_child AND sex = 4) AS unspecified, count(*) FILTER (WHERE is_child) AS total FROM ps GROUP BY 1"""


@register("a12_children_by_sex", SETS + KIDS)
def a12_children_by_sex(spark, sf):
    return person_sets.children_by_sex(sets(spark, sf)).drop("psc_id")


@register("a13_person_set_stats", SETS + "SELECT set_id, 0::BIGINT AS parents, count(*) FILTER (WHERE is_child) AS children FROM ps GROUP BY 1")
def a13_person_set_stats(spark, sf):
    return person_sets.stats(sets(spark, sf)).drop("psc_id")


@register("d26_common_report", TYPES + f""", people AS (SELECT set_id, count(*) AS n FROM ps GROUP BY 1),
events AS (SELECT count(DISTINCT fvuid) AS n FROM v WHERE (inheritance & 4) <> 0), head AS ({HEADLINE})
SELECT 'people:' || set_id AS item, n FROM people
UNION ALL SELECT 'family types', count(DISTINCT family_type) FROM types
UNION ALL SELECT 'families', families FROM head UNION ALL SELECT 'probands', number_of_probands FROM head
UNION ALL SELECT 'siblings', number_of_siblings FROM head UNION ALL SELECT 'denovo', n FROM events""")
def d26_common_report(spark, sf):
    """People, family and de-novo sections with the headline counts, as one long table."""
    ped, ps = derive.ped(spark, sf), sets(spark, sf)
    people = reports.people_counters(ps).select(
        F.concat(F.lit("people:"), "set_id").alias("item"), F.col("people_total").alias("n"))
    types = reports.family_types(ped, ps).agg(
        F.lit("family types").alias("item"), F.count_distinct("family_type").alias("n"))
    head = reports.headline(ped).selectExpr(
        "stack(3, 'families', families, 'probands', number_of_probands, 'siblings', number_of_siblings) AS (item, n)")
    events = denovo(spark, sf).agg(F.lit("denovo").alias("item"), F.count_distinct("fvuid").alias("n"))
    return people.unionByName(types).unionByName(head).unionByName(events)


# ---- gene sets --------------------------------------------------------------------------------------

CRITERIA = {"LGDs": ["lgds"], "Missense": ["missense"], "Synonymous": ["synonymous"]}
CACHE = SETS + """, cache AS (
  SELECT DISTINCT p.set_id, CASE WHEN effect = 'missense' THEN 'Missense' WHEN effect = 'synonymous' THEN 'Synonymous' ELSE 'LGDs' END AS effect_criteria,
    CASE p.sex WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Unspecified' END AS sex_criteria, gene, m.family_id
  FROM member_class m JOIN sa a ON a.s = m.s AND a.ai = m.ai JOIN ps p ON p.person_id = m.person_id
  WHERE m.inh = 4 AND effect <> 'intergenic')"""


def cache(spark, sf, fa=None):
    found = plan.query_variants(derive.study(spark, sf), inheritance="denovo") if fa is None else fa
    return gene_sets.denovo_cache(found, sets(spark, sf), CRITERIA)


@register("d17_denovo_gene_set_cache", CACHE + "SELECT * FROM cache")
def d17_denovo_gene_set_cache(spark, sf):
    return cache(spark, sf).drop("psc_id")


@register("d18_denovo_gene_set", CACHE + """
SELECT gene, count(DISTINCT family_id) AS families FROM cache WHERE set_id = 'affected' AND effect_criteria = 'LGDs' AND sex_criteria = 'Male'
GROUP BY 1 HAVING count(DISTINCT family_id) >= 3""")
def d18_denovo_gene_set(spark, sf):
    return gene_sets.denovo_gene_set(cache(spark, sf), "status", ["affected"], ["LGDs"], ["Male"], "Triple")


@register("d18_single_gene_set", CACHE + """
SELECT gene, count(DISTINCT family_id) AS families FROM cache WHERE set_id = 'unaffected' AND effect_criteria = 'Missense' AND sex_criteria = 'Female'
GROUP BY 1 HAVING count(DISTINCT family_id) = 1""")
def d18_single_gene_set(spark, sf):
    return gene_sets.denovo_gene_set(cache(spark, sf), "status", ["unaffected"], ["Missense"], ["Female"], "Single")


@register("d19_gene_sets_over_studies", CACHE + """
SELECT 'LGDs' AS name, gene, count(DISTINCT family_id) AS families FROM cache WHERE effect_criteria = 'LGDs' AND set_id IN ('affected', 'unaffected') GROUP BY 2
UNION ALL SELECT 'LGDs.Female.Recurrent', gene, count(DISTINCT family_id) FROM cache
  WHERE effect_criteria = 'LGDs' AND sex_criteria = 'Female' AND set_id IN ('affected', 'unaffected') GROUP BY 2 HAVING count(DISTINCT family_id) >= 2
UNION ALL SELECT 'Missense.Triple', gene, count(DISTINCT family_id) FROM cache
  WHERE effect_criteria = 'Missense' AND set_id IN ('affected', 'unaffected') GROUP BY 2 HAVING count(DISTINCT family_id) >= 3""")
def d19_gene_sets_over_studies(spark, sf):
    """The de-novo rows split into two studies by chromosome and united again."""
    found = plan.query_variants(derive.study(spark, sf), inheritance="denovo")
    caches = {
        "x": cache(spark, sf, found.filter("chromosome = 'chrX'")),
        "autosomes": cache(spark, sf, found.filter("chromosome <> 'chrX'"))}
    spec = {"status": ["affected", "unaffected"]}
    return gene_sets.all_denovo_gene_sets(
        caches, {"x": spec, "autosomes": spec}, ["LGDs", "LGDs.Female.Recurrent", "Missense.Triple"])


GS = ", gs AS (SELECT DISTINCT 'types' AS collection_id, p_type AS set_id, 'large parts of type ' || lower(p_type) AS \"desc\", p_brand AS gene FROM part WHERE p_size > 40)"


@register("d39_gene_set_listing", GS + """
SELECT collection_id, set_id, "desc", count(DISTINCT gene) AS count FROM gs WHERE lower(set_id) LIKE '%m%' OR "desc" LIKE '%m%' GROUP BY 1, 2, 3 ORDER BY 2 LIMIT 3""")
def d39_gene_set_listing(spark, sf):
    return gene_sets.listing(derive.gene_sets(spark, sf), "types", "M", 3)


@register("d40_gene_set_lookup", GS + "SELECT gene FROM gs WHERE set_id = 'PROMO'")
def d40_gene_set_lookup(spark, sf):
    return gene_sets.lookup(derive.gene_sets(spark, sf), "types", "PROMO")


@register("j16_gene_set_membership", GS + "SELECT s::BIGINT AS s FROM sites WHERE gene IN (SELECT gene FROM gs WHERE set_id = 'PROMO')")
def j16_gene_set_membership(spark, sf):
    genes = derive.sites(spark, sf).select(F.col("summary_index").alias("s"), F.col("effect_gene")[0]["effect_gene_symbols"].alias("gene"))
    return gene_sets.members_of(genes, gene_sets.lookup(derive.gene_sets(spark, sf), "types", "PROMO")).select("s")


# ---- enrichment ---------------------------------------------------------------------------------------

GROUPS = ["LGDs", "Missense", "Synonymous"]
EVENTS = SETS + GS + """, genes AS (SELECT DISTINCT upper(gene) AS gene FROM gs WHERE set_id = 'PROMO'),
dn AS (SELECT * FROM v WHERE (inheritance & 4) <> 0),
vgene AS (SELECT DISTINCT family_id, fvuid, chromosome, position, upper(gene) AS gene,
  CASE WHEN effect = 'missense' THEN 'Missense' WHEN effect = 'synonymous' THEN 'Synonymous' ELSE 'LGDs' END AS effect_group FROM dn WHERE effect <> 'intergenic'),
vgroup AS (SELECT DISTINCT p.set_id, dn.family_id, dn.fvuid, unnest(['all', CASE p.sex WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unspecified' END]) AS sex_group
  FROM dn JOIN member_class m ON m.family_id = dn.family_id AND m.s = dn.s AND m.ai = dn.ai AND m.carrier JOIN ps p ON p.person_id = m.person_id WHERE p.is_child),
ge AS (SELECT * FROM vgroup JOIN vgene USING (family_id, fvuid)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY set_id, effect_group, sex_group, family_id, gene ORDER BY chromosome, position) AS rn FROM ge),
ev_counts AS (SELECT set_id, effect_group, sex_group AS counted, count(DISTINCT fvuid) AS events,
   count(DISTINCT fvuid) FILTER (WHERE gene IN (SELECT gene FROM genes)) AS overlapped FROM firsts WHERE rn = 1 GROUP BY 1, 2, 3),
gene_counts AS (SELECT set_id, effect_group, sex_group AS counted, count(DISTINCT gene) AS events,
   count(DISTINCT gene) FILTER (WHERE gene IN (SELECT gene FROM genes)) AS overlapped FROM ge GROUP BY 1, 2, 3),
rec AS (SELECT set_id, effect_group, 'rec' AS counted, count(*) AS events, count(*) FILTER (WHERE gene IN (SELECT gene FROM genes)) AS overlapped
  FROM (SELECT set_id, effect_group, gene FROM ge WHERE sex_group = 'all' GROUP BY 1, 2, 3 HAVING count(DISTINCT family_id) > 1) GROUP BY 1, 2),
kids AS (""" + KIDS + """),
grid AS (SELECT k.*, g.effect_group, c.counted FROM kids k, (SELECT unnest(['LGDs', 'Missense', 'Synonymous']) AS effect_group) g,
  (SELECT unnest(['all', 'rec', 'male', 'female', 'unspecified']) AS counted) c WHERE total > 0),
matrix AS (SELECT g.*, coalesce(n.events, 0) AS events, coalesce(n.overlapped, 0) AS overlapped
  FROM grid g LEFT JOIN (SELECT * FROM ev_counts UNION ALL SELECT * FROM rec) n USING (set_id, effect_group, counted))"""


def tested_genes(spark, sf):
    return gene_sets.lookup(derive.gene_sets(spark, sf), "types", "PROMO")


def grouped(spark, sf):
    return enrichment.grouped_events(enrichment.denovo_events(denovo(spark, sf)), sets(spark, sf), GROUPS)


def matrix(spark, sf, counter="events"):
    counts = enrichment.event_counts(grouped(spark, sf), tested_genes(spark, sf), counter)
    return enrichment.full_matrix(counts, sets(spark, sf), GROUPS)


@register("d01_denovo_events", """
SELECT family_id, fvuid, carriers AS persons, CASE WHEN gene2 IS NULL OR (gene = gene2 AND effect = 'intron') THEN upper(gene) || ':' || effect
  ELSE least(upper(gene) || ':' || effect, upper(gene2) || ':intron') || ',' || greatest(upper(gene) || ':' || effect, upper(gene2) || ':intron') END AS genes
FROM v WHERE (inheritance & 4) <> 0""")
def d01_denovo_events(spark, sf):
    events = enrichment.denovo_events(denovo(spark, sf))
    return events.select("family_id", "fvuid", F.array_join("persons", ";").alias("persons"), F.array_join(F.array_sort(
        F.transform("genes", lambda g: F.concat_ws(":", g["gene"], g["effect"]))), ",").alias("genes"))


@register("d02_events_by_child_sex", EVENTS + "SELECT set_id, sex_group, effect_group, count(DISTINCT fvuid) AS variants FROM ge GROUP BY 1, 2, 3")
def d02_events_by_child_sex(spark, sf):
    return grouped(spark, sf).groupBy("set_id", "sex_group", "effect_group").agg(F.count_distinct("fvuid").alias("variants"))


@register("d03_one_event_per_family", EVENTS + "SELECT * FROM ev_counts UNION ALL SELECT * FROM rec")
def d03_one_event_per_family(spark, sf):
    return enrichment.event_counts(grouped(spark, sf), tested_genes(spark, sf), "events").drop("psc_id")


@register("d04_gene_counting", EVENTS + "SELECT * FROM gene_counts UNION ALL SELECT * FROM rec")
def d04_gene_counting(spark, sf):
    return enrichment.event_counts(grouped(spark, sf), tested_genes(spark, sf), "genes").drop("psc_id")


@register("d05_recurrent_genes", EVENTS + """
SELECT set_id, effect_group, gene, count(DISTINCT family_id) AS families FROM ge WHERE sex_group = 'all' GROUP BY 1, 2, 3 HAVING count(DISTINCT family_id) > 1""")
def d05_recurrent_genes(spark, sf):
    return enrichment.recurrent_genes(grouped(spark, sf)).drop("psc_id")


@register("d06_overlap_matrix", EVENTS + "SELECT set_id, effect_group, counted, events, overlapped FROM matrix")
def d06_overlap_matrix(spark, sf):
    return matrix(spark, sf).select("set_id", "effect_group", "counted", "events", "overlapped")


@register("d07_gene_weight_expectation", EVENTS + """, w AS (SELECT upper(p_brand) AS gene, sum(p_size)::DOUBLE AS w FROM part GROUP BY 1),
p AS (SELECT sum(w) FILTER (WHERE gene IN (SELECT gene FROM genes)) / sum(w) AS p FROM w)
SELECT set_id, effect_group, counted, events, overlapped, round(events * (SELECT p FROM p), 6) AS expected FROM matrix""")
def d07_gene_weight_expectation(spark, sf):
    """Counts and expectations; p-values are checked in the tests."""
    tested = enrichment.gene_weight_test(matrix(spark, sf), derive.gene_weights(spark, sf), tested_genes(spark, sf))
    return tested.select("set_id", "effect_group", "counted", "events", "overlapped", F.round("expected", 6).alias("expected"))


@register("d07_gene_weight_test", EVENTS + """, w AS (SELECT upper(p_brand) AS gene, sum(p_size)::DOUBLE AS w FROM part GROUP BY 1),
p AS (SELECT sum(w) FILTER (WHERE gene IN (SELECT gene FROM genes)) / sum(w) AS p FROM w),
outcomes AS (
  SELECT set_id, effect_group, counted, events, overlapped, k, lgamma(events + 1) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END
    - CASE WHEN events = k THEN 0 ELSE lgamma(events - k + 1) END + k * ln(p) + (events - k) * ln(1 - p) AS lp
  FROM (SELECT *, unnest(range(0, events + 1)) AS k FROM matrix WHERE events > 0 AND overlapped > 0), p),
observed AS (SELECT set_id, effect_group, counted, lp FROM outcomes WHERE k = overlapped)
SELECT m.set_id, m.effect_group, m.counted, m.overlapped, round(coalesce(least(t.pvalue, 1), 1), 6) AS pvalue FROM matrix m LEFT JOIN (
  SELECT o.set_id, o.effect_group, o.counted, sum(exp(o.lp)) AS pvalue FROM outcomes o JOIN observed b USING (set_id, effect_group, counted)
  WHERE o.lp <= b.lp + 1e-7 GROUP BY 1, 2, 3) t USING (set_id, effect_group, counted)""")
def d07_gene_weight_test(spark, sf):
    """Binomial p-values; the SQL adds up every outcome at most as likely as the observed one."""
    tested = enrichment.gene_weight_test(matrix(spark, sf), derive.gene_weights(spark, sf), tested_genes(spark, sf))
    return tested.select("set_id", "effect_group", "counted", "overlapped", F.round("pvalue", 6).alias("pvalue"))


RATES = EVENTS + """, r AS (
  SELECT 'LGDs' AS effect_group, sum(n / 100000.0::DOUBLE) AS boys, sum(1.25::DOUBLE * n / 100000.0::DOUBLE) AS girls
    FROM (SELECT upper(p_brand) AS gene, sum(p_size)::DOUBLE AS n FROM part GROUP BY 1) WHERE gene IN (SELECT gene FROM genes)
  UNION ALL SELECT 'Missense', sum(n / 100000.0::DOUBLE), sum(1.25::DOUBLE * n / 100000.0::DOUBLE)
    FROM (SELECT upper(p_brand) AS gene, sum(p_size * 2)::DOUBLE AS n FROM part GROUP BY 1) WHERE gene IN (SELECT gene FROM genes)
  UNION ALL SELECT 'Synonymous', sum(n / 100000.0::DOUBLE), sum(1.25::DOUBLE * n / 100000.0::DOUBLE)
    FROM (SELECT upper(p_brand) AS gene, sum(p_size * 3)::DOUBLE AS n FROM part GROUP BY 1) WHERE gene IN (SELECT gene FROM genes)),
tot AS (SELECT set_id, effect_group, max(events) FILTER (WHERE counted = 'all') AS n_all, max(events) FILTER (WHERE counted = 'rec') AS n_rec FROM matrix GROUP BY 1, 2),
rated AS (SELECT set_id, effect_group, counted, CASE WHEN counted = 'unspecified' THEN 0 ELSE events END AS events,
  CASE WHEN counted = 'unspecified' THEN 0 ELSE overlapped END AS overlapped,
  CASE counted WHEN 'all' THEN boys * (male + unspecified) + girls * female WHEN 'male' THEN boys * male WHEN 'female' THEN girls * female
    WHEN 'rec' THEN CASE WHEN n_all > 0 AND n_rec > 0 THEN (boys * (male + unspecified) + girls * female) * n_rec / n_all ELSE 0 END ELSE 0 END AS expected
FROM matrix JOIN r USING (effect_group) JOIN tot USING (set_id, effect_group))
"""


@register("d08_mutation_rate_expectation", RATES + "SELECT set_id, effect_group, counted, events, overlapped, round(expected, 6) AS expected FROM rated")
def d08_mutation_rate_expectation(spark, sf):
    tested = enrichment.mutation_rate_test(matrix(spark, sf), derive.mutation_rates(spark, sf), tested_genes(spark, sf))
    return tested.select("set_id", "effect_group", "counted", "events", "overlapped", F.round("expected", 6).alias("expected"))


@register("d09_full_enrichment_matrix", RATES + """, terms AS (
  SELECT set_id, effect_group, counted, expected, overlapped,
    unnest(range(0, CASE WHEN overlapped >= expected THEN overlapped ELSE overlapped + 1 END)) AS k FROM rated WHERE counted <> 'unspecified'),
below AS (SELECT set_id, effect_group, counted, sum(exp(CASE WHEN expected > 0 THEN k * ln(expected) - expected ELSE CASE WHEN k = 0 THEN 0 ELSE -1e9 END END
    - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END)) AS cdf FROM terms GROUP BY 1, 2, 3)
SELECT r.set_id, r.effect_group, r.counted, r.overlapped, round(CASE WHEN r.counted = 'unspecified' THEN 1
  ELSE least(1, 2 * CASE WHEN r.overlapped >= r.expected THEN greatest(1 - coalesce(cdf, 0), 0) ELSE coalesce(cdf, 0) END) END, 6) AS pvalue
FROM rated r LEFT JOIN below USING (set_id, effect_group, counted)""")
def d09_full_enrichment_matrix(spark, sf):
    """Person sets x effect groups with the Poisson p-values; the SQL adds up the lower tail."""
    tested = enrichment.mutation_rate_test(matrix(spark, sf), derive.mutation_rates(spark, sf), tested_genes(spark, sf))
    return tested.select("set_id", "effect_group", "counted", "overlapped", F.round("pvalue", 6).alias("pvalue"))


@register("d10_event_count_cache", EVENTS + """
SELECT 'events' AS counter, set_id, effect_group, counted, events FROM matrix
UNION ALL SELECT 'genes', g.set_id, g.effect_group, g.counted, coalesce(n.events, 0) FROM grid g
  LEFT JOIN (SELECT * FROM gene_counts UNION ALL SELECT * FROM rec) n USING (set_id, effect_group, counted)""")
def d10_event_count_cache(spark, sf):
    return enrichment.event_count_cache(grouped(spark, sf), sets(spark, sf), GROUPS, tested_genes(spark, sf)).drop("psc_id")


@register("a14_synonymous_background", """
SELECT upper(gene) AS gene, count(*) AS gene_weight FROM v JOIN freq f ON f.s = v.s AND f.ai = v.ai
WHERE effect = 'synonymous' AND f.af_allele_count <= 1 AND f.af_parents_called_count >= 10 AND ((inheritance & 2) <> 0 OR (inheritance & 128) <> 0) GROUP BY 1""")
def a14_synonymous_background(spark, sf):
    found = plan.query_variants(
        derive.study(spark, sf, frequencies=True), effect_types=["synonymous"], inheritance="mendelian or missing",
        ultra_rare=True, frequency_filter=[("af_parents_called_count", 10, None)])
    return enrichment.synonymous_background(found)


@register("a15_coding_length_background", """, gm AS (SELECT 'G' || (s // 25) AS gene, chromosome AS chrom, position::BIGINT AS a, (position + size * 1000)::BIGINT AS b FROM sites),
m1 AS (SELECT *, max(b) OVER (PARTITION BY gene, chrom ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM gm),
m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gene, chrom ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m1),
m3 AS (SELECT gene, chrom, g, min(a) AS a, max(b) AS b FROM m2 GROUP BY 1, 2, 3)
SELECT gene, sum(b - a + 1)::BIGINT AS gene_weight FROM m3 GROUP BY 1""")
def a15_coding_length_background(spark, sf):
    return enrichment.coding_length_background(derive.gene_models(spark, sf))


@register("w02_merged_intervals", """, gm AS (SELECT chromosome AS chrom, position::BIGINT AS a, (position + size * 10)::BIGINT AS b FROM sites),
m1 AS (SELECT *, max(b) OVER (PARTITION BY chrom ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM gm),
m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m1)
SELECT chrom, min(a) AS begin_, max(b) AS finish FROM m2 GROUP BY chrom, g""")
def w02_merged_intervals(spark, sf):
    """Intervals longer than the blocks they are merged in."""
    from kinfold.operators import filters
    size = derive.table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("summary_index"), "p_size")
    spans = derive.sites(spark, sf).join(size, "summary_index").select(
        F.col("chromosome").alias("key"), F.col("position").cast("long").alias("begin"),
        (F.col("position") + F.col("p_size") * 10).cast("long").alias("finish"))
    return filters.merge_intervals(spans, block=300).select(
        F.col("key").alias("chrom"), F.col("begin").alias("begin_"), "finish")


@register("w01_first_variant_per_family_and_gene", EVENTS + "SELECT set_id, effect_group, sex_group, family_id, gene, fvuid FROM firsts WHERE rn = 1")
def w01_first_variant_per_family_and_gene(spark, sf):
    return grouped(spark, sf).groupBy("set_id", "effect_group", "sex_group", "family_id", "gene").agg(
        F.min_by("fvuid", "order").alias("fvuid"))


# ---- gene profiles --------------------------------------------------------------------------------------

STATISTICS = [
    gene_profiles.Statistic("denovo_lgds", "denovo", effects=("lgds",)),
    gene_profiles.Statistic("denovo_sub", "denovo", variant_types=("sub",)),
    gene_profiles.Statistic("denovo_prb", "denovo", roles=("prb",)),
    gene_profiles.Statistic("denovo_score", "denovo", scores=(("score", 950.0, None),)),
    gene_profiles.Statistic("rare_lgds", "rare", effects=("lgds", "missense")),
]
SET_IDS = ["affected", "unaffected"]
CATEGORIES = {"types": [("types", "PROMO"), ("types", "SMALL")]}
PROFILE_CTES = SETS + GS + """, kids AS (SELECT set_id, count(*) FILTER (WHERE is_child) AS children FROM ps GROUP BY 1),
vg AS (SELECT v.*, f.af_allele_freq, gene AS g, effect AS e FROM v JOIN freq f ON f.s = v.s AND f.ai = v.ai
  UNION ALL SELECT v.*, f.af_allele_freq, gene2, 'intron' FROM v JOIN freq f ON f.s = v.s AND f.ai = v.ai WHERE gene2 IS NOT NULL),
lab AS (
  SELECT *, 'denovo_lgds' AS st FROM vg WHERE (inheritance & 4) <> 0 AND e IN ('frame-shift', 'nonsense', 'splice-site')
  UNION ALL SELECT *, 'denovo_sub' FROM vg WHERE (inheritance & 4) <> 0 AND (variant_type & 1) <> 0
  UNION ALL SELECT *, 'denovo_prb' FROM vg WHERE (inheritance & 4) <> 0 AND (roles & 128) <> 0
  UNION ALL SELECT *, 'denovo_score' FROM vg WHERE (inheritance & 4) <> 0 AND score >= 950
  UNION ALL SELECT *, 'rare_lgds' FROM vg WHERE af_allele_freq <= 1 AND (inheritance & 4) = 0 AND (inheritance & 258) <> 0
    AND (roles & 896) <> 0 AND (roles & 48) <> 0 AND e IN ('frame-shift', 'nonsense', 'splice-site', 'missense')),
pc AS (SELECT l.g AS gene, p.set_id, l.st AS statistic, count(DISTINCT l.fvuid) AS count FROM lab l
  JOIN member_class m ON m.family_id = l.family_id AND m.s = l.s AND m.ai = l.ai AND m.carrier JOIN ps p ON p.person_id = m.person_id GROUP BY 1, 2, 3)"""


def wide_sql() -> str:
    cells = []
    for set_id in SET_IDS:
        for s in STATISTICS:
            hit = f"max(count) FILTER (WHERE pc.set_id = '{set_id}' AND statistic = '{s.id}')"
            rate = f"max(count::DOUBLE / children * 1000) FILTER (WHERE pc.set_id = '{set_id}' AND statistic = '{s.id}')"
            cells += [f"coalesce({hit}, 0) AS ds_{set_id}_{s.id}", f"coalesce({rate}, 0) AS ds_{set_id}_{s.id}_rate"]
    return ", ".join(cells)


def counts(spark, sf):
    found = plan.query_variants(derive.study(spark, sf, frequencies=True))
    return gene_profiles.variant_counts(found, sets(spark, sf), STATISTICS)


def profile_table(spark, sf):
    wide = gene_profiles.count_columns(
        counts(spark, sf), person_sets.children_by_sex(sets(spark, sf)), "ds", SET_IDS, STATISTICS)
    genes = derive.table(spark, sf, "part").select(F.col("p_brand").alias("gene"))
    return gene_profiles.profiles(
        genes, [gene_profiles.set_columns(derive.gene_sets(spark, sf), CATEGORIES), wide],
        gene_profiles.score_columns(derive.gene_scores(spark, sf), {"scores": ["size_total"]}))


PROFILE = PROFILE_CTES + f""", wide AS (SELECT pc.gene, {wide_sql()} FROM pc JOIN kids USING (set_id) GROUP BY 1),
members_ AS (SELECT gene, max((set_id = 'PROMO')::INT)::BIGINT AS types_PROMO, max((set_id = 'SMALL')::INT)::BIGINT AS types_SMALL FROM gs GROUP BY 1),
profile AS (SELECT b.gene, coalesce(types_PROMO, 0) AS types_PROMO, coalesce(types_SMALL, 0) AS types_SMALL,
  coalesce(types_PROMO + types_SMALL, 0) AS types_rank, w.* EXCLUDE (gene), sc.scores_size_total
FROM (SELECT DISTINCT p_brand AS gene FROM part) b LEFT JOIN members_ USING (gene) LEFT JOIN wide w USING (gene)
LEFT JOIN (SELECT p_brand AS gene, sum(p_size)::DOUBLE AS scores_size_total FROM part GROUP BY 1) sc USING (gene))"""


@register("d20_gene_profile_counts", PROFILE_CTES + "SELECT gene, set_id, statistic, count FROM pc")
def d20_gene_profile_counts(spark, sf):
    return counts(spark, sf)


@register("d21_merged_partial_counts", PROFILE_CTES + "SELECT gene, set_id, statistic, count FROM pc")
def d21_merged_partial_counts(spark, sf):
    """Counting over two parts of the genome equals counting once: ids are united, not numbers."""
    found = plan.query_variants(derive.study(spark, sf, frequencies=True))
    parts = found.filter("chromosome < 'chr3'").unionByName(found.filter("chromosome >= 'chr3'"))
    return gene_profiles.variant_counts(parts, sets(spark, sf), STATISTICS)


@register("d22_gene_profiles", PROFILE + "SELECT * FROM profile")
def d22_gene_profiles(spark, sf):
    return profile_table(spark, sf)


@register("d23_gene_profile_page", PROFILE + "SELECT gene, ds_affected_denovo_lgds FROM profile WHERE gene ILIKE '%brand#1%' ORDER BY 2 DESC, 1 LIMIT 5 OFFSET 5")
def d23_gene_profile_page(spark, sf):
    return gene_profiles.page(
        profile_table(spark, sf), 2, "BRAND#1", "ds_affected_denovo_lgds", page_size=5).select("gene", "ds_affected_denovo_lgds")


@register("d23_gene_symbols", "SELECT DISTINCT p_brand AS gene FROM part WHERE p_brand ILIKE 'brand#2%' ORDER BY 1 LIMIT 4", base=False)
def d23_gene_symbols(spark, sf):
    genes = derive.table(spark, sf, "part").select(F.col("p_brand").alias("gene")).distinct()
    return gene_profiles.symbols(genes, 1, "brand#2", page_size=4)


@register("d24_single_gene_profile", PROFILE + "SELECT * FROM profile WHERE gene = 'Brand#4'")
def d24_single_gene_profile(spark, sf):
    return gene_profiles.single(profile_table(spark, sf), "Brand#4")


@register("d25_updated_gene_profiles", PROFILE + """
SELECT gene, CASE WHEN gene IN (SELECT gene FROM gs WHERE set_id = 'PROMO') THEN 0 ELSE scores_size_total END AS scores_size_total, types_rank FROM profile""")
def d25_updated_gene_profiles(spark, sf):
    fresh = gene_sets.lookup(derive.gene_sets(spark, sf), "types", "PROMO").withColumn("scores_size_total", F.lit(0.0))
    return gene_profiles.updated(profile_table(spark, sf), fresh).select("gene", "scores_size_total", "types_rank")


@register("a16_gene_score_partitions", base=False, sql="""
SELECT count(*) FILTER (WHERE v < 1700) AS left_count, count(*) FILTER (WHERE v BETWEEN 1700 AND 2100) AS mid_count, count(*) FILTER (WHERE v > 2100) AS right_count,
  count(*) FILTER (WHERE v < 1700) / count(*)::DOUBLE AS left_percent, count(*) FILTER (WHERE v BETWEEN 1700 AND 2100) / count(*)::DOUBLE AS mid_percent,
  count(*) FILTER (WHERE v > 2100) / count(*)::DOUBLE AS right_percent FROM (SELECT sum(p_size)::DOUBLE AS v FROM part GROUP BY p_brand)""")
def a16_gene_score_partitions(spark, sf):
    from kinfold.operators import pheno
    scores = derive.gene_scores(spark, sf).filter("score_id = 'size_total'")
    return pheno.partitions(scores, "value", 1700.0, 2100.0, closed=True)


