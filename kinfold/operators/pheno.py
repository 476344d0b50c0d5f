"""Phenotype operators: measure values, type inference, search, histograms, associations.

``instruments`` maps an instrument name to its wide table ``person_id, measure…``; a measure id is
``instrument.measure``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import codes, stats

PERSON_COLUMNS = ["person_id", "family_id", "role", "status", "sex"]
SEARCH_PAGE = 1001
BINS = 25
# ---- fixed values: role groups of distribution columns --------------------------------------
ROLE_GROUPS = {
    "probands": ["prb"],
    "siblings": ["sib"],
    "parents": ["mom", "dad"],
    "grandparents": [
        "paternal_grandfather", "paternal_grandmother", "maternal_grandfather", "maternal_grandmother",
    ],
    "parental siblings": ["paternal_uncle", "paternal_aunt", "maternal_uncle", "maternal_aunt"],
    "step parents": ["step_mom", "step_dad"],
    "half siblings": ["paternal_half_sibling", "maternal_half_sibling"],
    "children": ["child"],
}


# ---- values ---------------------------------------------------------------------------------

def instrument_people(instruments: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """Distinct persons of the instruments."""
    return reduce(DataFrame.union, [instruments[n].select("person_id") for n in names]).distinct()


def measure_values(
    instruments: dict[str, DataFrame], measure_ids: list[str], ped: DataFrame | None = None,
    person_ids: DataFrame | None = None, family_ids: DataFrame | None = None,
    roles: list[str] | None = None,
) -> DataFrame:
    """Persons of the instruments with the requested measures, one column per measure id.

    The person side holds everybody of every instrument, so left joins equal full outer ones. With
    a pedigree, person attributes are added and its filters apply.
    """
    by_instrument: dict[str, list[str]] = {}
    for measure_id in measure_ids:
        instrument, measure = measure_id.split(".", 1)
        by_instrument.setdefault(instrument, []).append(measure)
    rows = instrument_people(instruments, list(by_instrument))
    if ped is not None:
        people = ped.select(*PERSON_COLUMNS)
        if roles is not None:
            people = people.filter(F.col("role").isin([codes.ROLES[r] for r in roles]))
        if family_ids is not None:
            people = people.join(family_ids, "family_id", "left_semi")
        rows = people.join(rows, "person_id", "left_semi")
    if person_ids is not None:
        rows = rows.join(person_ids, "person_id", "left_semi")
    for instrument, measures in by_instrument.items():
        values = instruments[instrument].select(
            "person_id", *[F.col(f"`{m}`").alias(f"{instrument}.{m}") for m in measures])
        rows = rows.join(values, "person_id", "left")
    return rows


def measure_values_of_children(parts: list[DataFrame]) -> DataFrame:
    """Measures of several child studies side by side; persons must be in all of them."""
    def only_new(df: DataFrame) -> DataFrame:
        return df.select("person_id", *[f"`{c}`" for c in df.columns if c not in PERSON_COLUMNS])
    return reduce(lambda a, b: a.join(only_new(b), "person_id"), parts)


def stacked_children(parts: list[DataFrame]) -> DataFrame:
    """Value rows of several child studies one after another."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def download_rows(values: DataFrame, measure_ids: list[str]) -> DataFrame:
    """Rows with any of the measures present, ordered by person."""
    return values.na.drop(how="all", subset=[f"`{m}`" for m in measure_ids]).orderBy("person_id")


def last_value_per_person(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of several files of one instrument: each measure keeps the person's last row."""
    values = [c for c in rows.columns if c not in ("person_id", *order)]
    return rows.groupBy("person_id").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("w")).select("person_id", "w.*")


def clean_text(value: Column) -> Column:
    """Raw cell text: empty is NULL, ``True``/``False`` are 1.0/0.0."""
    return F.when(value == "", F.lit(None)).when(value == "True", "1.0").when(value == "False", "0.0").otherwise(value)


def family_measure(values: DataFrame, ped: DataFrame, measure_id: str, role: str) -> DataFrame:
    """One value per family: that of its last person with the role."""
    holders = ped.filter(F.col("role") == codes.ROLES[role]).select("family_id", "person_id", "member_index")
    return (
        holders.join(values.select("person_id", F.col(f"`{measure_id}`").alias("v")), "person_id")
        .groupBy("family_id").agg(F.max_by("v", F.struct("member_index", "person_id")).alias(f"{measure_id}.{role}")))


def person_roles(ped: DataFrame) -> DataFrame:
    """Distinct roles of a phenotype data set."""
    return ped.select(codes.decode(codes.ROLES, F.col("role"), "unknown").alias("role")).distinct()


# ---- type inference -------------------------------------------------------------------------

@dataclass(frozen=True)
class Inference:
    """Inference settings; the defaults classify most instruments."""

    min_individuals: int = 1
    non_numeric_cutoff: float = 0.06
    continuous_rank: int = 10
    ordinal_rank: int = 1
    categorical_ranks: tuple[int, int] = (1, 15)
    value_type: str | None = None
    histogram_type: str | None = None


_WHOLE = r"^\s*[+-]?\d+\s*$"
_REAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def long_values(instrument: DataFrame, measures: list[str]) -> DataFrame:
    """``(measure, value)`` rows of raw text."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), clean_text(F.col(f"`{m}`").cast("string")).alias("value"))
        for m in measures]))
    return instrument.select("person_id", pairs.alias("p")).select("person_id", "p.measure", "p.value")


def measure_report(values: DataFrame, config: Inference = Inference()) -> DataFrame:
    """Inferred type, counts, range and domain of each measure of ``long_values``."""
    value = F.col("value")
    whole, real = value.rlike(_WHOLE), value.rlike(_REAL)
    number = F.when(real, F.trim(value).try_cast("double"))
    aggregated = values.groupBy("measure").agg(
        F.count("*").alias("count_total"), F.count(value).alias("count_with_values"),
        F.count(F.when(real, 1)).alias("numeric"), F.count(F.when(whole, 1)).alias("whole"),
        F.min(number).alias("lo"), F.max(number).alias("hi"))
    # distinct counts as a two-step grouping: one hot measure is spread over its values
    distinct = values.filter("value IS NOT NULL").select("measure", "value").distinct()
    uniques = distinct.groupBy("measure").agg(F.count("*").alias("unique_texts"))
    numbers = (
        distinct.select("measure", number.alias("n")).filter("n IS NOT NULL").distinct()
        .groupBy("measure").agg(F.count("*").alias("unique_numbers")))
    order = W.partitionBy("measure").orderBy("value")
    domain = (
        distinct.filter(F.trim(value) != "").withColumn("rn", F.row_number().over(order)).filter("rn <= 20")
        .groupBy("measure").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("text_domain")))
    joined = aggregated.join(uniques, "measure", "left").join(numbers, "measure", "left").join(domain, "measure", "left")
    non_numeric = F.col("count_with_values") - F.col("numeric")
    share = F.when(F.col("count_with_values") > 0, non_numeric / F.col("count_with_values")).otherwise(0.0)
    inferred = (
        F.when(share > config.non_numeric_cutoff, "str")
        .when(F.col("whole") == F.col("numeric"), "int").otherwise("float"))
    kind = F.lit(config.value_type) if config.value_type else inferred
    is_text = F.col("value_type") == "str"
    whole_text = lambda c: F.col(c).cast("long").cast("string")
    numeric_domain = F.when(
        F.col("value_type") == "int", F.concat(whole_text("lo"), F.lit(", "), whole_text("hi"))
    ).otherwise(F.concat(F.col("lo").cast("string"), F.lit(", "), F.col("hi").cast("string")))
    report = joined.withColumn("value_type", kind).select(
        "measure", "value_type", "count_total", "count_with_values",
        (F.col("count_total") - F.col("count_with_values")).alias("count_without_values"),
        non_numeric.alias("count_non_numeric"),
        F.coalesce(F.when(is_text, F.col("unique_texts")).otherwise(F.col("unique_numbers")), F.lit(0)).alias("count_unique_values"),
        F.when(~is_text, F.col("lo")).alias("min_value"), F.when(~is_text, F.col("hi")).alias("max_value"),
        F.coalesce(F.when(is_text, F.col("text_domain")).otherwise(numeric_domain), F.lit("")).alias("values_domain"))
    return report.withColumn("histogram_type", histogram_type(config)).withColumn("measure_type", measure_type())


def histogram_type(config: Inference = Inference()) -> Column:
    """``number``, ``categorical`` or ``null`` from the counts of a report."""
    if config.histogram_type is not None:
        return F.lit(config.histogram_type if config.histogram_type in ("number", "categorical") else "null")
    unique = F.col("count_unique_values")
    numeric = F.col("value_type") != "str"
    return (
        F.when(F.col("count_with_values") < config.min_individuals, "null")
        .when(numeric & (unique >= config.continuous_rank), "number")
        .when(numeric & (unique >= config.ordinal_rank), "categorical")
        .when(~numeric & unique.between(*config.categorical_ranks), "categorical")
        .otherwise("null"))


def measure_type() -> Column:
    return (
        F.when(F.col("histogram_type") == "number", "continuous")
        .when((F.col("histogram_type") == "categorical") & (F.col("value_type") == "str"), "categorical")
        .when(F.col("histogram_type") == "categorical", "ordinal")
        .otherwise("raw"))


def typed_values(instrument: DataFrame, types: dict[str, str]) -> DataFrame:
    """Instrument columns cast to their inferred types; unreadable cells become NULL."""
    spark_type = {"int": "int", "float": "float", "str": "string"}

    def cell(name: str, kind: str) -> Column:
        text = clean_text(F.col(f"`{name}`").cast("string"))
        if kind == "str":
            return F.when(F.trim(text) != "", text).alias(name)
        guard = _WHOLE if kind == "int" else _REAL
        return F.when(text.rlike(guard), F.trim(text).try_cast(spark_type[kind])).alias(name)

    return instrument.select("person_id", *[cell(n, k) for n, k in types.items()])


# ---- catalogue ------------------------------------------------------------------------------

def merge_catalogues(parts: list[DataFrame]) -> DataFrame:
    """Union of measure catalogues; ``repeated`` marks ids found in several, which is an error."""
    stacked = reduce(DataFrame.unionByName, parts)
    repeated = stacked.groupBy("measure_id").agg((F.count("*") > 1).alias("repeated"))
    return stacked.join(repeated, "measure_id")


def upsert_descriptions(current: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """New descriptions replace old ones, others stay."""
    return current.alias("o").join(update.alias("n"), key, "full").select(
        key, F.coalesce("n.description", "o.description").alias("description"))


def browser_rows(
    catalogue: DataFrame, instrument_descriptions: DataFrame, measure_descriptions: DataFrame,
    regressions: DataFrame, regression_ids: list[str],
) -> DataFrame:
    """Catalogue with descriptions and the p-values of every regression.

    The long regression table ``(measure_id, regression_id, male, female)`` is turned wide once, so
    one join serves any number of regressions.
    """
    wide = regressions.groupBy("measure_id").agg(*[
        F.max(F.when(F.col("regression_id") == r, F.col(sex))).alias(f"{r}_pvalue_regression_{sex}")
        for r in regression_ids for sex in ("male", "female")])
    return (
        catalogue.join(
            instrument_descriptions.select("instrument_name", F.col("description").alias("instrument_description")),
            "instrument_name", "left")
        .join(measure_descriptions.select("measure_id", "description"), "measure_id", "left")
        .join(wide, "measure_id", "left"))


def keyword_condition(keyword: str, instrument: str | None) -> Column:
    """The keyword, whatever its characters and case, in the measure's id or name, or the instrument's when none is given."""
    places = ["measure_id", "measure_name"] + ([] if instrument else ["instrument_name"])
    return reduce(lambda a, b: a | b, [F.contains(F.lower(p), F.lit(keyword.lower())) for p in places])


def search(
    rows: DataFrame, keyword: str | None = None, instrument: str | None = None, page: int = 1,
    sort_by: str | None = None, descending: bool = False, page_size: int = SEARCH_PAGE,
) -> DataFrame:
    """One page of measures; sorting falls back to the measure id to keep pages stable."""
    found = matching(rows, keyword, instrument)
    if sort_by in (None, "instrument"):
        column = "measure_id"
    elif sort_by in ("measure", "measure_type"):
        column = {"measure": "measure_name", "measure_type": "measure_type"}[sort_by]
    else:
        regression, _, sex = sort_by.partition(".")
        if sex not in ("male", "female"):
            raise ValueError(f"cannot sort by {sort_by!r}")
        column = f"{regression}_pvalue_regression_{sex}"
    order = F.desc(column) if descending else F.asc(column)
    return found.orderBy(order, "measure_id").offset(page_size * (page - 1)).limit(page_size)


def matching(rows: DataFrame, keyword: str | None = None, instrument: str | None = None) -> DataFrame:
    if keyword:
        rows = rows.filter(keyword_condition(keyword, instrument))
    return rows.filter(F.col("instrument_name") == instrument) if instrument else rows


def count_measures(rows: DataFrame, keyword: str | None = None, instrument: str | None = None) -> DataFrame:
    return matching(rows, keyword, instrument).agg(F.count("*").alias("measures"))


def list_measures(catalogue: DataFrame, instrument: str | None = None, measure_type: str | None = None) -> DataFrame:
    """Catalogue rows with a known type, optionally of one instrument or type."""
    rows = catalogue.filter(F.col("measure_type").isNotNull())
    if instrument is not None:
        rows = rows.filter(F.col("instrument_name") == instrument)
    return rows if measure_type is None else rows.filter(F.col("measure_type") == measure_type)


# ---- partitions and histograms --------------------------------------------------------------

def partitions(values: DataFrame, column: str, low: float | None, high: float | None, closed: bool) -> DataFrame:
    """Rows left of, inside and right of a range; ``closed`` includes the upper bound inside.

    Rows without a value count in the total only.
    """
    v = F.col(f"`{column}`")
    low = float("-inf") if low is None else low
    high = float("inf") if high is None else high
    right = v > high if closed else v >= high
    inside = (v >= low) & ((v <= high) if closed else (v < high))
    counts = values.agg(
        F.count("*").alias("total"), F.count(F.when(v < low, 1)).alias("left_count"),
        F.count(F.when(inside, 1)).alias("mid_count"), F.count(F.when(right, 1)).alias("right_count"))
    parts = ["left", "mid", "right"]
    return counts.select(
        *[f"{p}_count" for p in parts],
        *[(F.col(f"{p}_count") / F.col("total")).alias(f"{p}_percent") for p in parts])


def numeric_histogram(values: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal bins over the observed range, the last one closed; empty bins show zero."""
    clean = values.select(F.col(f"`{column}`").cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    extent = clean.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    widened = extent.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    bounds = widened.select(F.struct("lo", "hi")).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    index = F.least(F.floor((F.col("v") - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = clean.select(index.alias("bin")).groupBy("bin").agg(F.count("*").alias("bar"))
    step = (F.col("hi") - F.col("lo")) / bins
    edges = widened.filter("lo IS NOT NULL").select(
        "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * step).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("bin_end"),
        F.coalesce("bar", F.lit(0)).alias("bar"))


def histogram_step(values: DataFrame, column: str) -> DataFrame:
    """Range of a continuous measure and the slider step, a thousandth of it."""
    v = F.col(f"`{column}`")
    return values.agg(F.min(v).alias("min"), F.max(v).alias("max")).withColumn(
        "step", (F.col("max") - F.col("min")) / 1000.0)


def categorical_histogram(values: DataFrame, column: str, domain: list) -> DataFrame:
    """Rows per domain value, zeros kept."""
    counts = values.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"))
    listed = counts.filter(F.col("value").isin(list(domain)))
    zeros = values.sparkSession.createDataFrame([(v,) for v in domain], counts.select("value").schema)
    return zeros.join(listed, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def needs_log_scale(histogram: DataFrame, bar: str, numeric: bool) -> DataFrame:
    """Whether the largest bar is over ten times the second largest (numeric) or smallest one."""
    if numeric:
        top = histogram.orderBy(F.desc(bar)).limit(2).agg(F.min(bar).alias("low"), F.max(bar).alias("high"))
        return top.select(((F.col("low") != 0) & (F.col("low") * 10 < F.col("high"))).alias("log_scale"))
    return histogram.agg((F.min(bar) * 10 < F.max(bar)).alias("log_scale"))


def role_distribution(values: DataFrame, measure_id: str, merge_parents: bool = False, least: int = 1) -> DataFrame:
    """Persons with a value per role group and status, by sex; groups under ``least`` persons are left out."""
    present = values.filter(F.col(f"`{measure_id}`").isNotNull() & F.col("status").isin(1, 2))
    group = F.lit(None)
    for name, roles in ROLE_GROUPS.items():
        group = F.when(F.col("role").isin([codes.ROLES[r] for r in roles]), name).otherwise(group)
    return (
        present.withColumn("role_group", group).filter("role_group IS NOT NULL")
        .groupBy("role_group", codes.decode(codes.STATUSES, F.col("status")).alias("status"))
        .agg(F.count("*").alias("total"), F.count(F.when(F.col("sex") == 1, 1)).alias("males"),
             F.count(F.when(F.col("sex") == 2, 1)).alias("females"))
        .filter(F.col("total") >= least))


def category_counts(values: DataFrame, measure_id: str, natural_order: bool = False, most: int | None = None) -> DataFrame:
    """All categories of a measure with their number of persons and their rank, or the first ``most`` of them.

    The rank begins with the most frequent category, ties with the smallest, or follows the numeric order; values that are no
    numbers come last, in text order. Categories are ranked inside blocks of the order, and a block begins after the categories of
    the blocks before it, so no window holds them all.
    """
    counts = values.groupBy(F.col(f"`{measure_id}`").alias("value")).agg(F.count("*").alias("n"))
    number = F.col("value").try_cast("double")
    if natural_order:  # blocks of leading digits in numeric order
        block = F.when(number.isNull(), F.lit(float("inf"))).otherwise(F.signum(number) * F.floor(F.log2(F.abs(number) + 1) * 16))
        order = [number.isNull(), number, F.col("value")]
    else:
        block, order = -F.col("n").cast("double"), [F.col("value").isNotNull(), F.col("value")]
    # many categories may have one count: they are divided by their first letters
    part = F.lit(None).cast("string") if natural_order else F.substring(F.col("value").cast("string"), 1, 2)
    blocked = counts.withColumn("_block", block).withColumn("_part", part)
    sizes = blocked.groupBy("_block", "_part").agg(F.count("*").alias("_size"))
    ahead = F.coalesce(F.sum("_size").over(W.orderBy("_block", F.col("_part").isNotNull(), "_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_block").alias("_b"), F.col("_part").alias("_p"), ahead.alias("_ahead"))
    inside = F.row_number().over(W.partitionBy("_block", "_part").orderBy(*order)) - 1
    ranked = blocked.withColumn("_nth", inside).join(
        starts, (F.col("_block") == F.col("_b")) & F.col("_part").eqNullSafe(F.col("_p"))).select(
        "value", "n", (F.col("_nth") + F.col("_ahead")).cast("int").alias("rank"))
    return ranked if most is None else ranked.filter(F.col("rank") < most)


# ---- association ----------------------------------------------------------------------------

def people_by_effect(rows: DataFrame, labels: list[str]) -> DataFrame:
    """``(effect, person_id)`` of everyone carrying an allele with the effect or effect group."""
    from kinfold.operators.reports import label_array
    effects = F.transform("effect_gene", lambda g: g["effect_types"])
    return (
        rows.select(label_array(labels, effects).alias("labels"), "allele_in_members")
        .filter(F.size("labels") > 0)
        .select(F.explode("labels").alias("effect"), "allele_in_members")
        .select("effect", F.explode("allele_in_members").alias("person_id")).distinct())


def normalized(values: DataFrame, measure_id: str, by: list[str]) -> DataFrame:
    """Adds ``normalized``: the measure, or its residuals after least squares on other measures.

    Rows missing any of the measures are dropped. The fit needs only means and covariances, so one
    aggregate row reaches the driver whatever the number of persons.
    """
    import numpy as np

    rows = values.na.drop(subset=[f"`{m}`" for m in [measure_id, *by]])
    y = F.col(f"`{measure_id}`").cast("double")
    if not by:
        return rows.withColumn("normalized", y)
    xs = [F.col(f"`{m}`").cast("double") for m in by]
    moments = [F.avg(y).alias("my")] + [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]
    moments += [F.covar_pop(x, y).alias(f"y{i}") for i, x in enumerate(xs)]
    moments += [
        F.covar_pop(xs[i], xs[j]).alias(f"c{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    m = rows.agg(*moments).first()
    if m["my"] is None:
        return rows.withColumn("normalized", y)
    k = len(xs)
    cov = np.array([[m[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    beta = np.linalg.lstsq(cov, np.array([m[f"y{i}"] for i in range(k)]), rcond=None)[0]
    fitted = F.lit(float(m["my"]))
    for i, x in enumerate(xs):
        fitted = fitted + F.lit(float(beta[i])) * (x - F.lit(float(m[f"m{i}"])))
    return rows.withColumn("normalized", y - fitted)


def association(values: DataFrame, carriers: DataFrame, effects: list[str]) -> DataFrame:
    """Carriers against non-carriers per effect and sex: counts, means, 1.96 standard errors, t test.

    ``values`` has ``person_id, sex, normalized``; ``carriers`` is ``people_by_effect``. Sufficient
    statistics of the carriers come from one join; those of the others are the difference to the
    whole, so persons are not multiplied by effects.
    """
    def sums(df: DataFrame, keys: list) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count("*").alias("n"), F.avg("normalized").alias("mean"),
            F.var_pop("normalized").alias("var"))

    people = values.filter(F.col("sex").isin(1, 2))
    whole = sums(people, ["sex"])
    hit = sums(people.join(carriers, "person_id"), ["effect", "sex"])
    grid = whole.select(
        "sex", F.col("n").alias("n_all"), F.col("mean").alias("mean_all"), F.col("var").alias("var_all"),
        F.explode(F.array(*[F.lit(e) for e in effects])).alias("effect"))
    joined = grid.join(hit, ["effect", "sex"], "left").fillna(0, ["n"]).fillna(0.0, ["mean", "var"])
    n1, m1, v1 = F.col("n"), F.col("mean"), F.col("var")
    n0 = F.col("n_all") - n1
    m0 = F.when(n0 > 0, (F.col("n_all") * F.col("mean_all") - n1 * m1) / n0).otherwise(0.0)
    spread_all = F.col("n_all") * F.col("var_all")
    between = lambda n, m: n * (m - F.col("mean_all")) * (m - F.col("mean_all"))
    stage = joined.withColumn("n0", n0).withColumn("m0", m0)
    m0, n0 = F.col("m0"), F.col("n0")
    v0 = F.when(n0 > 0, F.greatest(
        spread_all - n1 * v1 - between(n1, m1) - between(n0, m0), F.lit(0.0)) / n0).otherwise(0.0)
    stage = stage.withColumn("v0", v0)
    v0 = F.col("v0")
    df = n1 + n0 - 2
    pooled = (n1 * v1 + n0 * v0) / df
    testable = (n1 >= 2) & (n0 >= 2)
    t = F.when(testable & (pooled > 0), (m1 - m0) / F.sqrt(pooled * (1 / n1 + 1 / n0)))
    error = lambda n, v: F.when(n > 0, 1.96 * F.sqrt(v) / F.sqrt(n)).otherwise(0.0)
    return stage.withColumn("t", t).withColumn("df", df).select(
        "effect", codes.decode(codes.SEXES, F.col("sex")).alias("sex"),
        n1.alias("positive_count"), m1.alias("positive_mean"), error(n1, v1).alias("positive_deviation"),
        n0.alias("negative_count"), m0.alias("negative_mean"), error(n0, v0).alias("negative_deviation"),
        "t", stats.t_test("t", "df").alias("pvalue"))


def aligned(result: DataFrame) -> DataFrame:
    """A group without persons takes the mean of the other one."""
    return result.withColumn(
        "positive_mean", F.when(F.col("positive_count") == 0, F.col("negative_mean")).otherwise(F.col("positive_mean"))
    ).withColumn(
        "negative_mean", F.when(F.col("negative_count") == 0, F.col("positive_mean")).otherwise(F.col("negative_mean")))


def association_title(measure_id: str, by: list[str]) -> str:
    return measure_id if not by else f"{measure_id} ~ {' + '.join(by)}"


def association_download(values: DataFrame, carriers: DataFrame, measure_id: str, effects: list[str]) -> DataFrame:
    """Person rows with the measure, the normalized value (5 places) and 0/1 per effect."""
    wide = carriers.groupBy("person_id").pivot("effect", effects).agg(F.lit(1))
    rows = values.join(wide, "person_id", "left").fillna(0, effects)
    return rows.select(
        "person_id", "family_id", "role", "status", "sex", F.col(f"`{measure_id}`").alias(measure_id),
        F.round("normalized", 5).alias("normalized"), *[F.col(f"`{e}`").cast("int").alias(e) for e in effects])


def regression_by_sex(values: DataFrame, dependent: str, independent: str) -> DataFrame:
    """Least squares of a measure on an age-like measure for men and women with slope p-values.

    Needs more than 5 rows with the independent measure, two distinct dependent values, and more
    than 2 complete rows per sex; NULL p-values otherwise.
    """
    x = F.col(f"`{independent}`").cast("float").cast("double")
    y = F.col(f"`{dependent}`").cast("double")
    finite = values.withColumn("x", x).withColumn("y", y).filter(
        "x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')")
    size = finite.agg(F.count("*").alias("n")).scalar()
    distinct = finite.agg(F.count_distinct("y").alias("d")).scalar()
    complete = finite.filter("y IS NOT NULL AND NOT isnan(y)").filter(F.col("sex").isin(1, 2))
    fit = complete.groupBy("sex").agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    residual = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    error = F.sqrt(residual / (F.col("n") - 2) / F.col("sxx"))
    enough = (F.col("n") > 2) & (F.col("sxx") > 0) & (size > 5) & (distinct >= 2)
    t = F.when(enough, F.when(error == 0, F.lit(float("inf"))).otherwise(F.col("slope") / error))
    return fit.withColumn("t", t).withColumn("df", F.col("n") - 2).select(
        codes.decode(codes.SEXES, F.col("sex")).alias("sex"), "n", "slope", "intercept", "t",
        stats.t_test("t", "df").alias("pvalue"))
