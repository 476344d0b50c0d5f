"""Phenotype inference, search, histograms, associations and downloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derive
from checks.registry import register
from kinfold.operators import pedigree, pheno
from kinfold.plans import study as plan

I2 = """, oc AS (SELECT 'P' || o_custkey AS person_id, min(o_totalprice) AS cheapest, count(*) AS orders, min(o_orderpriority) AS priority FROM orders GROUP BY 1)"""


def raw(spark, sf):
    """Order attributes as raw text, with words, blanks and fractions mixed in."""
    o = derive.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("person_id"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_custkey") % 50 == 7, "n/a").otherwise((F.col("o_custkey") % 9).cast("string")).alias("level"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("finished"))


MEASURES = ["customer", "price", "level", "priority", "finished"]
RAW_SQL = """lv AS (
  SELECT 'customer' AS measure, o_custkey::VARCHAR AS v, o_custkey::DOUBLE AS n, true AS whole FROM orders
  UNION ALL SELECT 'price', CASE WHEN o_orderstatus <> 'P' THEN 'x' END, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, false FROM orders
  UNION ALL SELECT 'level', CASE WHEN o_custkey % 50 = 7 THEN 'n/a' ELSE (o_custkey % 9)::VARCHAR END, CASE WHEN o_custkey % 50 <> 7 THEN o_custkey % 9 END, true FROM orders
  UNION ALL SELECT 'priority', o_orderpriority, NULL, false FROM orders
  UNION ALL SELECT 'finished', 'x', CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END, false FROM orders)"""


@register("a20_measure_report", base=False, sql="WITH " + RAW_SQL + """, agg AS (
  SELECT measure, count(*) AS total, count(v) AS with_values, count(n) AS numeric, count(DISTINCT n) AS un, count(DISTINCT v) AS uv, min(n) AS lo, max(n) AS hi,
    bool_and(whole OR n IS NULL) AS whole FROM lv GROUP BY 1),
typed AS (SELECT *, CASE WHEN (with_values - numeric) / with_values > 0.06 THEN 'str' WHEN whole THEN 'int' ELSE 'float' END AS value_type FROM agg)
SELECT measure, value_type, total AS count_total, with_values AS count_with_values, total - with_values AS count_without_values,
  with_values - numeric AS count_non_numeric, CASE WHEN value_type = 'str' THEN uv ELSE un END AS count_unique_values,
  CASE WHEN value_type <> 'str' THEN lo END AS min_value, CASE WHEN value_type <> 'str' THEN hi END AS max_value FROM typed""")
def a20_measure_report(spark, sf):
    return pheno.measure_report(pheno.long_values(raw(spark, sf), MEASURES)).drop(
        "values_domain", "histogram_type", "measure_type")


@register("a20_text_domain", base=False, sql="""
SELECT 'priority' AS measure, string_agg(p, ', ' ORDER BY p) AS values_domain FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)
UNION ALL SELECT 'level', '0, 8' UNION ALL SELECT 'customer', min(o_custkey)::VARCHAR || ', ' || max(o_custkey)::VARCHAR FROM orders""")
def a20_text_domain(spark, sf):
    report = pheno.measure_report(pheno.long_values(raw(spark, sf), ["priority", "level", "customer"]))
    return report.select("measure", "values_domain")


@register("a21_measure_types", base=False, sql="""
SELECT * FROM (VALUES ('customer', 'number', 'continuous'), ('price', 'number', 'continuous'), ('level', 'categorical', 'ordinal'),
  ('priority', 'categorical', 'categorical'), ('finished', 'categorical', 'ordinal')) t(measure, histogram_type, measure_type)
WHERE (SELECT count(*) FROM orders) > 0""")
def a21_measure_types(spark, sf):
    report = pheno.measure_report(pheno.long_values(raw(spark, sf), MEASURES))
    return report.select("measure", "histogram_type", "measure_type")


# ---- catalogue and search: every supplier is a measure of its nation's instrument ---------------

def catalogue(spark, sf):
    s = derive.table(spark, sf, "supplier").join(
        derive.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        F.lower("n_name").alias("instrument_name"), F.col("s_name").alias("measure_name"),
        F.concat_ws(".", F.lower("n_name"), "s_name").alias("measure_id"),
        F.when(F.col("s_acctbal") > 5000, "continuous").when(F.col("s_acctbal") > 0, "categorical").alias("measure_type"))


CATALOGUE = """WITH cat AS (SELECT lower(n_name) AS instrument_name, s_name AS measure_name, lower(n_name) || '.' || s_name AS measure_id,
  CASE WHEN s_acctbal > 5000 THEN 'continuous' WHEN s_acctbal > 0 THEN 'categorical' END AS measure_type, s_nationkey, s_acctbal
FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def browser(spark, sf):
    s = derive.table(spark, sf, "supplier")
    cat = catalogue(spark, sf)
    nations = derive.table(spark, sf, "nation").select(
        F.lower("n_name").alias("instrument_name"), F.concat(F.lit("about "), "n_name").alias("description"))
    described = cat.filter("measure_type = 'continuous'").select("measure_id", F.concat(F.lit("the "), "measure_name").alias("description"))
    values = cat.join(s, F.col("measure_name") == F.col("s_name")).select("measure_id", "s_acctbal")
    regressions = values.selectExpr(
        "measure_id", "stack(2, 'age', s_acctbal / 10000, s_acctbal / 20000, 'iq', s_acctbal / 30000, s_acctbal / 40000) AS (regression_id, male, female)")
    return pheno.browser_rows(cat, nations, described, regressions, ["age", "iq"])


@register("j10_catalogue_with_descriptions", base=False, sql=CATALOGUE + """
SELECT measure_id, instrument_name, measure_name, measure_type, 'about ' || upper(instrument_name) AS instrument_description,
  CASE WHEN measure_type = 'continuous' THEN 'the ' || measure_name END AS description, s_acctbal / 10000 AS age_pvalue_regression_male,
  s_acctbal / 20000 AS age_pvalue_regression_female, s_acctbal / 30000 AS iq_pvalue_regression_male, s_acctbal / 40000 AS iq_pvalue_regression_female FROM cat""")
def j10_catalogue_with_descriptions(spark, sf):
    return browser(spark, sf)


@register("d27_measure_search", base=False, sql=CATALOGUE + """
SELECT measure_id, s_acctbal / 20000 AS age_pvalue_regression_female FROM cat WHERE instrument_name LIKE '%nation!_1%' ESCAPE '!' OR measure_id LIKE '%nation!_1%' ESCAPE '!'
  OR measure_name LIKE '%nation!_1%' ESCAPE '!' ORDER BY s_acctbal / 20000 DESC, measure_id LIMIT 10 OFFSET 10""")
def d27_measure_search(spark, sf):
    """An underscore in the keyword is a plain character."""
    return pheno.search(
        browser(spark, sf), "Nation_1", page=2, sort_by="age.female", descending=True, page_size=10,
    ).select("measure_id", "age_pvalue_regression_female")


@register("l03_measure_page_of_instrument", base=False, sql=CATALOGUE + """
SELECT measure_id FROM cat WHERE instrument_name = 'nation_3' AND (measure_id ILIKE '%supplier%' OR measure_name ILIKE '%supplier%') ORDER BY 1 LIMIT 1001""")
def l03_measure_page_of_instrument(spark, sf):
    return pheno.search(browser(spark, sf), "supplier", "nation_3").select("measure_id")


@register("a22_measure_count", base=False, sql=CATALOGUE + "SELECT count(*) AS measures FROM cat WHERE instrument_name ILIKE '%on!_2%' ESCAPE '!' OR measure_id ILIKE '%on!_2%' ESCAPE '!'")
def a22_measure_count(spark, sf):
    return pheno.count_measures(catalogue(spark, sf), "on_2")


@register("d36_measure_listing", base=False, sql=CATALOGUE + "SELECT measure_id FROM cat WHERE measure_type = 'continuous'")
def d36_measure_listing(spark, sf):
    return pheno.list_measures(catalogue(spark, sf), measure_type="continuous").select("measure_id")


@register("u06_merged_catalogues", base=False, sql=CATALOGUE + """
SELECT measure_id, s_acctbal > 9000 AS repeated FROM cat UNION ALL SELECT measure_id, true FROM cat WHERE s_acctbal > 9000""")
def u06_merged_catalogues(spark, sf):
    cat = catalogue(spark, sf)
    rich = derive.table(spark, sf, "supplier").filter("s_acctbal > 9000").select(F.col("s_name").alias("measure_name"))
    return pheno.merge_catalogues([cat, cat.join(rich, "measure_name", "left_semi").select(*cat.columns)]).select("measure_id", "repeated")


@register("u05_distinct_instruments", base=False, sql=CATALOGUE + "SELECT DISTINCT instrument_name FROM cat")
def u05_distinct_instruments(spark, sf):
    return catalogue(spark, sf).select("instrument_name").distinct()


@register("d42_upserted_descriptions", base=False, sql=CATALOGUE + """
SELECT measure_id, CASE WHEN measure_type = 'continuous' THEN 'new' ELSE 'old' END AS description FROM cat""")
def d42_upserted_descriptions(spark, sf):
    cat = catalogue(spark, sf)
    old = cat.select("measure_id", F.lit("old").alias("description"))
    new = cat.filter("measure_type = 'continuous'").select("measure_id", F.lit("new").alias("description"))
    return pheno.upsert_descriptions(old, new, "measure_id")


# ---- partitions and histograms -----------------------------------------------------------------

def values(spark, sf, *measures, roles=None):
    return pheno.measure_values(derive.instruments(spark, sf), list(measures), derive.ped(spark, sf), roles=roles)


@register("a17_measure_partitions", """, t AS (SELECT balance AS v FROM ped)
SELECT count(*) FILTER (WHERE v < 1000) AS left_count, count(*) FILTER (WHERE v >= 1000 AND v < 4000) AS mid_count, count(*) FILTER (WHERE v >= 4000) AS right_count,
  count(*) FILTER (WHERE v < 1000) / count(*)::DOUBLE AS left_percent, count(*) FILTER (WHERE v >= 1000 AND v < 4000) / count(*)::DOUBLE AS mid_percent,
  count(*) FILTER (WHERE v >= 4000) / count(*)::DOUBLE AS right_percent FROM t""")
def a17_measure_partitions(spark, sf):
    return pheno.partitions(values(spark, sf, "i1.balance"), "i1.balance", 1000.0, 4000.0, closed=False)


HISTOGRAM = I2 + """, t AS (SELECT cheapest AS v FROM ped JOIN oc USING (person_id) WHERE role IN (128, 256)),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM t),
b AS (SELECT least(floor((v - lo) * 25 / (hi - lo)), 24)::INT AS bin, count(*) AS bar FROM t, e GROUP BY 1)"""


@register("a18_numeric_histogram", HISTOGRAM + """
SELECT g.bin::BIGINT AS bin, round(lo + g.bin * ((hi - lo) / 25), 6) AS bin_start, coalesce(bar, 0) AS bar
FROM (SELECT unnest(range(0, 25)) AS bin) g CROSS JOIN e LEFT JOIN b ON b.bin = g.bin""")
def a18_numeric_histogram(spark, sf):
    found = pheno.numeric_histogram(values(spark, sf, "i2.cheapest", roles=["prb", "sib"]), "i2.cheapest")
    return found.select("bin", F.round("bin_start", 6).alias("bin_start"), "bar")


@register("d45_histogram_step", I2 + "SELECT min(cheapest) AS min, max(cheapest) AS max, (max(cheapest) - min(cheapest)) / 1000.0::DOUBLE AS step FROM ped LEFT JOIN oc USING (person_id)")
def d45_histogram_step(spark, sf):
    return pheno.histogram_step(values(spark, sf, "i2.cheapest"), "i2.cheapest")


@register("a19_categorical_histogram", """
SELECT d.value, count(segment) AS n FROM (VALUES ('MACHINERY'), ('BUILDING'), ('NOBODY')) d(value) LEFT JOIN ped ON segment = d.value GROUP BY 1""")
def a19_categorical_histogram(spark, sf):
    return pheno.categorical_histogram(values(spark, sf, "i1.segment"), "i1.segment", ["MACHINERY", "BUILDING", "NOBODY"])


@register("a23_role_distribution", I2 + """
SELECT CASE role WHEN 128 THEN 'probands' WHEN 256 THEN 'siblings' ELSE 'parents' END AS role_group, CASE status WHEN 1 THEN 'unaffected' ELSE 'affected' END AS status,
  count(*) AS total, count(*) FILTER (WHERE sex = 1) AS males, count(*) FILTER (WHERE sex = 2) AS females
FROM ped JOIN oc USING (person_id) WHERE status IN (1, 2) GROUP BY 1, 2 """)
def a23_role_distribution(spark, sf):
    return pheno.role_distribution(values(spark, sf, "i2.cheapest"), "i2.cheapest")


@register("a24_category_counts", "SELECT segment AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, segment) - 1 AS rank FROM ped GROUP BY 1")
def a24_category_counts(spark, sf):
    return pheno.category_counts(values(spark, sf, "i1.segment"), "i1.segment")


@register("a24_first_categories", "SELECT segment AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, segment) - 1 AS rank FROM ped GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def a24_first_categories(spark, sf):
    return pheno.category_counts(values(spark, sf, "i1.segment"), "i1.segment", most=3)


@register("a24_natural_order", "SELECT value, n, row_number() OVER (ORDER BY value) - 1 AS rank FROM (SELECT nation::BIGINT AS value, count(*) AS n FROM ped GROUP BY 1)")
def a24_natural_order(spark, sf):
    return pheno.category_counts(values(spark, sf, "i1.nation"), "i1.nation", natural_order=True)


@register("d37_person_roles", "SELECT DISTINCT CASE role WHEN 16 THEN 'mom' WHEN 32 THEN 'dad' WHEN 128 THEN 'prb' ELSE 'sib' END AS role FROM ped")
def d37_person_roles(spark, sf):
    return pheno.person_roles(derive.ped(spark, sf))


@register("d41_family_measures", I2 + """
SELECT p.family_id, p.balance AS prb_balance, oc.cheapest AS mom_cheapest FROM ped p LEFT JOIN ped m ON m.family_id = p.family_id AND m.role = 16
LEFT JOIN oc ON oc.person_id = m.person_id WHERE p.role = 128""")
def d41_family_measures(spark, sf):
    ped = derive.ped(spark, sf)
    inst = derive.instruments(spark, sf)
    prb = pheno.family_measure(pheno.measure_values(inst, ["i1.balance"]), ped, "i1.balance", "prb")
    mom = pheno.family_measure(pheno.measure_values(inst, ["i2.cheapest"]), ped, "i2.cheapest", "mom")
    return prb.join(mom, "family_id", "left").select(
        "family_id", F.col("`i1.balance.prb`").alias("prb_balance"), F.col("`i2.cheapest.mom`").alias("mom_cheapest"))


@register("s13_last_row_per_person", base=False, sql="""
SELECT 'P' || o_custkey AS person_id, max(struct_pack(a := o_orderdate, b := o_orderkey, c := o_totalprice)).c AS price FROM orders GROUP BY o_custkey""")
def s13_last_row_per_person(spark, sf):
    rows = derive.table(spark, sf, "orders").select(
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("person_id"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("price"))
    return pheno.last_value_per_person(rows, ["o_orderdate", "o_orderkey"])


# ---- association ---------------------------------------------------------------------------------

EFFECTS = ["LGDs", "missense", "CNV"]
CARRIERS = """, ce AS (SELECT DISTINCT m.person_id, CASE WHEN effect = 'missense' THEN 'missense' ELSE 'LGDs' END AS effect
  FROM v JOIN member_class m ON m.family_id = v.family_id AND m.s = v.s AND m.ai = v.ai AND m.carrier
  WHERE (v.inheritance & 4) <> 0 AND effect IN ('frame-shift', 'nonsense', 'splice-site', 'missense'))"""


def carriers(spark, sf):
    found = plan.query_variants(derive.study(spark, sf), inheritance="denovo")
    return pheno.people_by_effect(found, EFFECTS)


@register("d11_people_by_effect", CARRIERS + "SELECT effect, person_id FROM ce")
def d11_people_by_effect(spark, sf):
    return carriers(spark, sf)


NORMAL = I2 + """, t AS (SELECT person_id, sex, balance AS y, cheapest AS x1, orders::DOUBLE AS x2 FROM ped JOIN oc USING (person_id) WHERE role = 128),
mm AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS c11, covar_pop(x1, x2) AS c12, covar_pop(x2, x2) AS c22,
  covar_pop(x1, y) AS y1, covar_pop(x2, y) AS y2 FROM t),
bb AS (SELECT *, (y1 * c22 - y2 * c12) / (c11 * c22 - c12 * c12) AS b1, (y2 * c11 - y1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM mm),
nv AS (SELECT t.person_id, t.sex, t.y, t.y - (my + b1 * (x1 - m1) + b2 * (x2 - m2)) AS z FROM t, bb)"""


def normalized(spark, sf):
    return pheno.normalized(
        values(spark, sf, "i1.balance", "i2.cheapest", "i2.orders", roles=["prb"]), "i1.balance", ["i2.cheapest", "i2.orders"])


@register("d12_normalized_measure", NORMAL + "SELECT person_id, round(z, 4) AS normalized FROM nv")
def d12_normalized_measure(spark, sf):
    return normalized(spark, sf).select("person_id", F.round("normalized", 4).alias("normalized"))


STATS = CARRIERS + NORMAL + """, g AS (SELECT nv.*, e.effect, ce.person_id IS NOT NULL AS hit FROM nv CROSS JOIN (SELECT unnest(['LGDs', 'missense', 'CNV']) AS effect) e
  LEFT JOIN ce ON ce.person_id = nv.person_id AND ce.effect = e.effect WHERE sex IN (1, 2)),
st AS (SELECT effect, CASE sex WHEN 1 THEN 'M' ELSE 'F' END AS sex, count(*) FILTER (WHERE hit) AS n1, coalesce(avg(z) FILTER (WHERE hit), 0) AS m1, coalesce(var_pop(z) FILTER (WHERE hit), 0) AS v1,
  count(*) FILTER (WHERE NOT hit) AS n0, coalesce(avg(z) FILTER (WHERE NOT hit), 0) AS m0, coalesce(var_pop(z) FILTER (WHERE NOT hit), 0) AS v0 FROM g GROUP BY 1, 2)"""


@register("d12_association", STATS + """
SELECT effect, sex, n1 AS positive_count, round(m1, 3) AS positive_mean, round(CASE WHEN n1 > 0 THEN 1.96 * sqrt(v1) / sqrt(n1) ELSE 0 END, 3) AS positive_deviation,
  n0 AS negative_count, round(m0, 3) AS negative_mean, round(CASE WHEN n0 > 0 THEN 1.96 * sqrt(v0) / sqrt(n0) ELSE 0 END, 3) AS negative_deviation,
  round(CASE WHEN n1 >= 2 AND n0 >= 2 THEN (m1 - m0) / sqrt((n1 * v1 + n0 * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) END, 5) AS t FROM st""")
def d12_association(spark, sf):
    """Counts, means, deviations and the t statistic; its p-value is checked in the tests."""
    found = pheno.association(normalized(spark, sf), carriers(spark, sf), EFFECTS)
    return found.select("effect", "sex", "positive_count", "negative_count", F.round("t", 5).alias("t"), *[
        F.round(c, 3).alias(c) for c in ("positive_mean", "positive_deviation", "negative_mean", "negative_deviation")])


@register("d13_aligned_association", STATS + """
SELECT effect, sex, round(CASE WHEN n1 = 0 THEN m0 ELSE m1 END, 3) AS positive_mean, round(CASE WHEN n0 = 0 THEN m1 ELSE m0 END, 3) AS negative_mean,
  n1 < 2 OR n0 < 2 AS untested FROM st""")
def d13_aligned_association(spark, sf):
    found = pheno.aligned(pheno.association(normalized(spark, sf), carriers(spark, sf), EFFECTS))
    return found.select(
        "effect", "sex", F.round("positive_mean", 3).alias("positive_mean"), F.round("negative_mean", 3).alias("negative_mean"),
        F.col("pvalue").isNull().alias("untested"))


@register("d14_association_download", CARRIERS + NORMAL + """
SELECT nv.person_id, nv.y AS balance, round(z, 5) AS normalized, coalesce((a.person_id IS NOT NULL)::BIGINT, 0) AS lgds, coalesce((b.person_id IS NOT NULL)::BIGINT, 0) AS missense
FROM nv LEFT JOIN ce a ON a.person_id = nv.person_id AND a.effect = 'LGDs' LEFT JOIN ce b ON b.person_id = nv.person_id AND b.effect = 'missense'""")
def d14_association_download(spark, sf):
    table = pheno.association_download(normalized(spark, sf), carriers(spark, sf), "i1.balance", ["LGDs", "missense"])
    return table.select(
        "person_id", F.col("`i1.balance`").alias("balance"), "normalized",
        F.col("LGDs").alias("lgds"), "missense")


@register("d15_persons_in_scope", "SELECT person_id FROM members WHERE role IN (16, 32) AND family_id IN (SELECT family_id FROM ped WHERE segment = 'FURNITURE')")
def d15_persons_in_scope(spark, sf):
    ped = derive.ped(spark, sf)
    return pedigree.persons_in_scope(ped, ["mom", "dad"], ped.filter("segment = 'FURNITURE'").select("family_id").distinct())


@register("d16_regression_by_sex", I2 + """, t AS (SELECT sex, cheapest::FLOAT::DOUBLE AS x, balance AS y FROM ped JOIN oc USING (person_id) WHERE sex IN (1, 2)),
r AS (SELECT sex, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM t GROUP BY 1)
SELECT CASE sex WHEN 1 THEN 'M' ELSE 'F' END AS sex, n, round(slope, 8) AS slope, round(intercept, 3) AS intercept,
  round(slope / sqrt((syy - slope * sxy) / (n - 2) / sxx), 5) AS t FROM r""")
def d16_regression_by_sex(spark, sf):
    found = pheno.regression_by_sex(values(spark, sf, "i1.balance", "i2.cheapest"), "i1.balance", "i2.cheapest")
    return found.select("sex", "n", F.round("slope", 8).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("t", 5).alias("t"))


@register("k09_measure_download", I2 + "SELECT person_id, balance, cheapest FROM ped LEFT JOIN oc USING (person_id)")
def k09_measure_download(spark, sf):
    found = pheno.download_rows(values(spark, sf, "i1.balance", "i2.cheapest"), ["i1.balance", "i2.cheapest"])
    return found.select("person_id", F.col("`i1.balance`").alias("balance"), F.col("`i2.cheapest`").alias("cheapest"))
