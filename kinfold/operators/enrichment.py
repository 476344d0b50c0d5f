"""Enrichment of de-novo events in gene sets, and the background models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import stats
from kinfold.operators import filters, person_sets
from kinfold.operators.reports import label_array

GROUPS = ["all", "rec", "male", "female", "unspecified"]


def denovo_events(denovo: DataFrame) -> DataFrame:
    """``(family_id, fvuid, order, persons, genes)`` per de-novo allele; gene symbols in upper case.

    ``order`` fixes the event order: chromosome, position, alleles, family.
    """
    genes = F.array_distinct(F.transform(
        F.filter("effect_gene", lambda g: g["effect_gene_symbols"].isNotNull() & g["effect_types"].isNotNull()),
        lambda g: F.struct(F.upper(g["effect_gene_symbols"]).alias("gene"), g["effect_types"].alias("effect"))))
    return denovo.select(
        "family_id", "fvuid",
        F.struct("chromosome", "position", "reference", "site_alternative", "family_id").alias("order"),
        F.col("allele_in_members").alias("persons"), genes.alias("genes"))


def grouped_events(events: DataFrame, sets: DataFrame, effect_groups: list[str]) -> DataFrame:
    """Rows of person set, sex group, effect group, variant and gene.

    A variant belongs to a group when a child of the group carries any of its alleles; then the
    genes of all its alleles count. Two carriers of one group repeat a row; all consumers take
    minima or distinct values.
    """
    sex_group = F.when(F.col("sex") == 1, "male").when(F.col("sex") == 2, "female").otherwise("unspecified")
    children = sets.filter("is_child").select(
        "psc_id", "set_id", "family_id", "person_id", F.explode(F.array(F.lit("all"), sex_group)).alias("sex_group"))
    # one row per family variant: the alleles of one site in one family
    variant = events.groupBy("family_id", "fvuid").agg(
        F.min("order").alias("order"), F.array_distinct(F.flatten(F.collect_list("persons"))).alias("persons"),
        F.array_distinct(F.flatten(F.collect_list("genes"))).alias("genes"))
    labelled = F.filter(
        F.transform("genes", lambda g: F.named_struct(
            F.lit("gene"), g["gene"], F.lit("groups"), label_array(effect_groups, F.array(g["effect"])))),
        lambda g: F.size(g["groups"]) > 0)
    carried = variant.select("family_id", "fvuid", "order", F.explode("persons").alias("person_id"), labelled.alias("genes"))
    return (
        carried.join(children, ["family_id", "person_id"])
        .select("psc_id", "set_id", "sex_group", "family_id", "fvuid", "order", F.explode("genes").alias("g"))
        .select("psc_id", "set_id", "sex_group", "family_id", "fvuid", "order", F.col("g.gene").alias("gene"),
                F.explode("g.groups").alias("effect_group")))


KEYS = ["psc_id", "set_id", "effect_group"]


def first_events(grouped: DataFrame) -> DataFrame:
    """The first variant that hits a gene in a family, per person set, effect group and sex group."""
    return grouped.groupBy(*KEYS, "sex_group", "family_id", "gene").agg(
        F.min(F.struct("order", "fvuid")).alias("first"))


def recurrent_genes(grouped: DataFrame) -> DataFrame:
    """Genes hit in more than one family among all children."""
    return (
        grouped.filter("sex_group = 'all'").groupBy(*KEYS, "gene")
        .agg(F.count_distinct("family_id").alias("families")).filter("families > 1"))


def event_counts(grouped: DataFrame, genes: DataFrame, counter: str) -> DataFrame:
    """Events and overlapping events per person set, effect group and group of ``GROUPS``.

    ``counter`` is ``events`` (a variant counts once when it is the first to hit some gene in its
    family) or ``genes`` (distinct genes). Every first hit is one item of its sex group, and those
    of all children are also items of the recurrent group, which keeps genes of several families;
    so all groups come from one pass.
    """
    if counter not in ("events", "genes"):
        raise ValueError(f"unknown counter {counter!r}")
    wanted = genes.select(F.upper("gene").alias("gene")).distinct().withColumn("in_set", F.lit(1))
    hits = first_events(grouped).join(wanted, "gene", "left")
    counted_item = F.col("first.fvuid") if counter == "events" else F.col("gene")
    items = F.array_compact(F.array(
        F.struct(F.col("sex_group").alias("counted"), counted_item.alias("item")),
        F.when(F.col("sex_group") == "all", F.struct(F.lit("rec").alias("counted"), F.col("gene").alias("item")))))
    each = hits.select(*KEYS, F.coalesce("in_set", F.lit(0)).alias("in_set"), F.explode(items).alias("i"))
    per_item = each.groupBy(*KEYS, F.col("i.counted").alias("counted"), F.col("i.item").alias("item")).agg(
        F.count("*").alias("families"), F.max("in_set").alias("in_set"))
    kept = per_item.filter((F.col("counted") != "rec") | (F.col("families") > 1))
    return kept.groupBy(*KEYS, "counted").agg(
        F.count("*").alias("events"), F.sum("in_set").alias("overlapped"))


def full_matrix(counts: DataFrame, sets: DataFrame, effect_groups: list[str]) -> DataFrame:
    """Counts completed with zeros for every set with children, effect group and group."""
    stats_ = person_sets.children_by_sex(sets).filter("total > 0")
    labels = F.array(*[F.lit(g) for g in effect_groups])
    grid = stats_.withColumn("effect_group", F.explode(labels)).withColumn(
        "counted", F.explode(F.array(*[F.lit(g) for g in GROUPS])))
    return grid.join(counts, [*KEYS, "counted"], "left").fillna(0, ["events", "overlapped"])


def event_count_cache(grouped: DataFrame, sets: DataFrame, effect_groups: list[str], genes: DataFrame) -> DataFrame:
    """Event counts of both counting models, to be stored and reused."""
    return reduce(DataFrame.unionByName, [
        full_matrix(event_counts(grouped, genes, c), sets, effect_groups).select(
            F.lit(c).alias("counter"), *KEYS, "counted", "events") for c in ("events", "genes")])


def gene_weight_test(matrix: DataFrame, weights: DataFrame, genes: DataFrame) -> DataFrame:
    """Binomial test against a gene-weight background ``(gene, gene_weight)``."""
    wanted = genes.select(F.upper("gene").alias("gene")).distinct().withColumn("in_set", F.lit(True))
    probability = weights.join(wanted, "gene", "left").agg(
        (F.coalesce(F.sum(F.when(F.col("in_set"), F.col("gene_weight"))), F.lit(0.0)) / F.sum("gene_weight")).alias("p"))
    with_p = matrix.withColumn("probability", probability.scalar())
    return with_p.withColumn("expected", F.col("events") * F.col("probability")).withColumn(
        "pvalue", stats.binomial_test("overlapped", "events", "probability"))


def mutation_rate_test(matrix: DataFrame, rates: DataFrame, genes: DataFrame) -> DataFrame:
    """Poisson test against per-gene mutation rates ``(gene, M, F, P_<effect>)``.

    Expected counts come from rates and children; the recurrent expectation is scaled by the share
    of recurrent events. The unspecified group is not tested: zeros and p-value 1.
    """
    effects = [c for c in rates.columns if c.startswith("P_")]
    wanted = genes.select(F.upper("gene").alias("gene")).distinct()
    pairs = ", ".join(f"'{c}', {c}" for c in effects)
    sums = (
        rates.join(wanted, "gene", "left_semi")
        .selectExpr("M", "F", f"stack({len(effects)}, {pairs}) AS (effect, p)")
        .groupBy("effect").agg(
            F.sum(F.col("M") * F.col("p")).alias("p_boys"), F.sum(F.col("F") * F.col("p")).alias("p_girls")))
    cells = W.partitionBy(*KEYS)  # the five groups of one person set and effect group
    totals = matrix.withColumn(
        "n_all", F.max(F.when(F.col("counted") == "all", F.col("events"))).over(cells)).withColumn(
        "n_rec", F.max(F.when(F.col("counted") == "rec", F.col("events"))).over(cells))
    joined = totals.join(
        sums, F.concat(F.lit("P_"), F.upper("effect_group")) == F.col("effect"), "left").fillna(0.0, ["p_boys", "p_girls"])
    male, female = F.col("p_boys") * F.col("male"), F.col("p_girls") * F.col("female")
    everyone = F.col("p_boys") * (F.col("male") + F.col("unspecified")) + female
    counted = F.col("counted")
    expected = (
        F.when(counted == "all", everyone).when(counted == "male", male).when(counted == "female", female)
        .when((counted == "rec") & (F.col("n_rec") > 0) & (F.col("n_all") > 0),
              everyone * F.col("n_rec") / F.col("n_all"))
        .otherwise(0.0))
    untested = counted == "unspecified"
    tested = joined.withColumn("expected", expected)
    for name in ("events", "overlapped"):
        tested = tested.withColumn(name, F.when(untested, F.lit(0)).otherwise(F.col(name)))
    return tested.withColumn(
        "pvalue", F.when(untested, F.lit(1.0)).otherwise(stats.poisson_test("overlapped", "expected"))
    ).drop("effect", "p_boys", "p_girls", "n_all", "n_rec")


# ---- backgrounds ----------------------------------------------------------------------------

def synonymous_background(alleles: DataFrame, effect: str = "synonymous") -> DataFrame:
    """Ultra-rare synonymous alleles per gene, from family alleles already filtered."""
    genes = F.array_distinct(F.transform(
        F.filter("effect_gene", lambda g: (g["effect_types"] == effect) & g["effect_gene_symbols"].isNotNull()),
        lambda g: F.upper(g["effect_gene_symbols"])))
    return alleles.select(F.explode(genes).alias("gene")).groupBy("gene").agg(
        F.count("*").alias("gene_weight"))


def coding_length_background(gene_models: DataFrame) -> DataFrame:
    """Merged coding length per gene from ``(gene, chrom, cds_start, cds_end)``.

    Alternative and fix contigs are skipped. Intervals are merged per gene and contig.
    """
    rows = gene_models.filter(~F.col("chrom").endswith("alt") & ~F.col("chrom").endswith("fix"))
    merged = filters.merge_intervals(rows.select(
        F.struct(F.upper("gene").alias("gene"), "chrom").alias("key"),
        F.col("cds_start").alias("begin"), F.col("cds_end").alias("finish")))
    return merged.groupBy(F.col("key.gene").alias("gene")).agg(
        F.sum(F.col("finish") - F.col("begin") + 1).alias("gene_weight"))


def score_background(scores: DataFrame, score_id: str) -> DataFrame:
    """A gene score used as gene weights."""
    return scores.filter(F.col("score_id") == score_id).select("gene", F.col("value").alias("gene_weight"))
