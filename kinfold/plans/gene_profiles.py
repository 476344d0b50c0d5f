"""Gene profiles: one wide row per gene with set memberships, scores and variant counts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import codes, flags
from kinfold.operators import filters

RARE_PERCENT = 1.0
PAGE = 50
RARE_INHERITANCE = [
    "not denovo and not possible_denovo and not possible_omission", "any([mendelian,unknown])"]
RARE_ROLES = "(prb or sib or child) and (mom or dad)"


@dataclass(frozen=True)
class Statistic:
    """One counted column: a de-novo or rare variant class with optional restrictions."""

    id: str
    category: str
    effects: tuple[str, ...] | None = None
    variant_types: tuple[str, ...] | None = None
    roles: tuple[str, ...] | None = None
    scores: tuple[tuple[str, float | None, float | None], ...] = ()

    def condition(self) -> Column:
        """Whether a family allele row counts."""
        if self.category == "denovo":
            tests = [flags.inheritance("denovo")]
        else:
            tests = [
                F.coalesce(F.col("af_allele_freq") <= RARE_PERCENT, F.lit(False)),
                flags.inheritance(RARE_INHERITANCE),
                flags.roles(" or ".join(self.roles) if self.roles else RARE_ROLES)]
        if self.roles:
            tests.append(flags.roles(" or ".join(self.roles)))
        if self.variant_types:
            mask = reduce(lambda a, b: a | b, [codes.ALLELE_TYPE_WORDS[t.lower()] for t in self.variant_types])
            tests.append(F.col("variant_type").bitwiseAND(mask) != 0)
        tests += [filters.real_attribute(*s) for s in self.scores]
        return reduce(lambda a, b: a & b, tests)

    def genes(self) -> Column:
        """Genes of the row that the statistic counts."""
        hit = F.col("effect_gene")
        if self.effects:
            wanted = codes.expand_effects(list(self.effects))
            hit = F.filter(hit, lambda g: g["effect_types"].isin(wanted))
        return F.array_distinct(F.transform(hit, lambda g: F.struct(
            F.lit(self.id).alias("statistic"), g["effect_gene_symbols"].alias("gene"))))


def variant_counts(rows: DataFrame, sets: DataFrame, statistics: list[Statistic]) -> DataFrame:
    """Distinct family variants per gene, person set and statistic.

    One pass over the family alleles labels every row with the statistics it satisfies, so adding
    a statistic adds no scan. Counting distinct ids merges partial counts by union.
    """
    nothing = F.array().cast("array<struct<statistic:string,gene:string>>")
    labels = F.flatten(F.array(*[
        F.when(s.condition(), s.genes()).otherwise(nothing) for s in statistics]))
    labelled = rows.select("family_id", "fvuid", "allele_in_members", labels.alias("labels")).filter(F.size("labels") > 0)
    # persons are looked up before the labels are unfolded, to join the narrow side
    in_sets = (
        labelled.withColumn("person_id", F.explode("allele_in_members"))
        .join(sets.select("set_id", "family_id", "person_id"), ["family_id", "person_id"])
        .select("set_id", "fvuid", F.explode("labels").alias("l"))
        .select("set_id", "fvuid", "l.statistic", "l.gene"))
    return in_sets.filter("gene IS NOT NULL").groupBy("gene", "set_id", "statistic").agg(
        F.count_distinct("fvuid").alias("count"))


def count_columns(
    counts: DataFrame, children: DataFrame, dataset: str, set_ids: list[str], statistics: list[Statistic],
) -> DataFrame:
    """Wide counts ``<dataset>_<set>_<statistic>`` and rates per 1000 children; zero without children."""
    joined = counts.join(children.select("set_id", F.col("total").alias("children")), "set_id")
    known = F.col("children") > 0
    pairs = [(s, st.id) for s in set_ids for st in statistics]

    def cell(set_id: str, statistic: str, value: Column, name: str) -> Column:
        return F.coalesce(F.max(F.when(
            (F.col("set_id") == set_id) & (F.col("statistic") == statistic) & known, value)), F.lit(0)).alias(name)

    cells = []
    for set_id, statistic in pairs:
        name = f"{dataset}_{set_id}_{statistic}"
        cells.append(cell(set_id, statistic, F.col("count"), name))
        cells.append(cell(set_id, statistic, F.col("count") / F.col("children") * 1000, f"{name}_rate"))
    return joined.groupBy("gene").agg(*cells)


def set_columns(gene_sets: DataFrame, categories: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """0/1 per configured ``(collection, set)`` and the number of sets per category."""
    def member(collection: str, set_id: str) -> Column:
        hit = (F.col("collection_id") == collection) & (F.col("set_id") == set_id)
        return F.max(F.when(hit, 1).otherwise(0))

    cells = [member(c, s).alias(f"{c}_{s}") for sets in categories.values() for c, s in sets]
    wide = gene_sets.groupBy("gene").agg(*cells)
    ranks = [
        reduce(lambda a, b: a + b, [F.col(f"`{c}_{s}`") for c, s in sets]).alias(f"{category}_rank")
        for category, sets in categories.items()]
    return wide.select("*", *ranks)


def score_columns(scores: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    return scores.groupBy("gene").agg(*[
        F.max(F.when(F.col("score_id") == s, F.col("value"))).alias(f"{category}_{s}")
        for category, names in categories.items() for s in names])


def profiles(genes: DataFrame, parts: list[DataFrame], scores: DataFrame | None = None) -> DataFrame:
    """One row per gene; counts and memberships default to zero, scores to NULL."""
    rows = genes.select("gene").distinct()
    zero = [c for p in parts for c in p.columns if c != "gene"]
    for part in parts:
        rows = rows.join(part, "gene", "left")
    rows = rows.fillna(0, zero)
    return rows if scores is None else rows.join(scores, "gene", "left")


def page(
    table: DataFrame, number: int, symbol: str | None = None, sort_by: str | None = None,
    descending: bool = True, page_size: int = PAGE,
) -> DataFrame:
    """One page of profiles, case-insensitive substring on the symbol, sorted by any column."""
    rows = table if not symbol else table.filter(F.lower("gene").contains(symbol.lower()))
    if sort_by is not None:
        key = F.col(f"`{sort_by}`")
        rows = rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "gene")
    else:
        rows = rows.orderBy("gene")
    return rows.offset(page_size * (number - 1)).limit(page_size)


def symbols(table: DataFrame, number: int, prefix: str | None = None, page_size: int = PAGE) -> DataFrame:
    """One page of gene symbols with a case-insensitive prefix."""
    rows = table.select("gene")
    if prefix:
        rows = rows.filter(F.lower("gene").startswith(prefix.lower()))
    return rows.orderBy("gene").offset(page_size * (number - 1)).limit(page_size)


def single(table: DataFrame, gene: str) -> DataFrame:
    return table.filter(F.col("gene") == gene)


def updated(table: DataFrame, values: DataFrame) -> DataFrame:
    """Profile columns replaced by newer values where a gene has them."""
    names = [c for c in values.columns if c != "gene"]
    fresh = values.select("gene", F.lit(True).alias("_hit"), *[F.col(f"`{c}`").alias(f"_new_{c}") for c in names])
    joined = table.join(fresh, "gene", "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"`_new_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`")
        for c in table.columns])
