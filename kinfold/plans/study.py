"""Study queries: all filters of a request in one plan over summary, family and pedigree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import alleles, codes, flags, genotypes
from kinfold.functions.bins import Partitioning
from kinfold.operators import filters, pedigree, person_sets

Range = tuple[str, float | None, float | None]


@dataclass(frozen=True)
class Study:
    """Stored tables of one study or of a dataset of studies (told apart by ``study_id``).

    ``gene_bins`` (gene, region_bin) says in which region bins rows of a gene are stored. ``leaves`` are the studies of a
    dataset by their id; each has its own partitioning. ``by_key`` says that files are sorted by ``sj_index``.
    """

    pedigree: DataFrame
    summary: DataFrame
    family: DataFrame
    partitioning: Partitioning = Partitioning()
    gene_bins: DataFrame | None = None
    leaves: dict[str, Study] = field(default_factory=dict)
    by_key: bool = False


def union_studies(studies: dict[str, Study], people: DataFrame | None = None) -> Study:
    """A dataset over leaf studies; every row names its study."""
    def stack(name: str) -> DataFrame:
        return reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True),
            [getattr(s, name).withColumn("study_id", F.lit(i)) for i, s in studies.items()])
    if people is None:
        people = reduce(pedigree.combine_families, [s.pedigree for s in studies.values()])
    return Study(people, stack("summary"), stack("family"), leaves=studies)


def pruned(
    study: Study, regions=None, genes=None, effect_types: list[str] | None = None,
    inheritance: str | list[str] | None = None, ultra_rare: bool = False,
    frequency_filter: list[Range] | None = None, family_ids=None, **_,
) -> Study:
    """The study with only the partitions that can answer the filters.

    The predicates hold on summary and family rows alike and go to both, because Catalyst infers them only for join keys.
    Each study of a dataset is pruned by its own partitioning. The bins of genes are a table, so any number of genes prunes,
    and a gene that is stored nowhere has none.
    """
    query = dict(
        regions=regions, genes=genes, effect_types=effect_types, inheritance=inheritance, ultra_rare=ultra_rare,
        frequency_filter=frequency_filter, family_ids=family_ids)
    if study.leaves:
        return union_studies({i: pruned(s, **query) for i, s in study.leaves.items()}, study.pedigree)
    part = study.partitioning
    effects = None if effect_types is None else codes.expand_effects(effect_types)
    texts = [inheritance] if isinstance(inheritance, str) else inheritance
    found = [
        filters.region_bin_filter(part, regions if isinstance(regions, list) else None),
        filters.coding_bin_filter(part, effects),
        filters.frequency_bin_filter(part, texts, ultra_rare, frequency_filter)]
    summary, family = study.summary, study.family
    for condition in found:
        if condition is not None:
            summary, family = summary.filter(condition), family.filter(condition)
    of_families = filters.family_bin_filter(part, family_ids if isinstance(family_ids, list) else None)
    if of_families is not None:
        family = family.filter(of_families)
    if study.gene_bins is not None and "region_bin" in part.summary_columns and (isinstance(genes, DataFrame) or genes):
        wanted = filters.bins_of_genes(study.gene_bins, genes)
        summary, family = (rows.join(wanted, "region_bin", "left_semi") for rows in (summary, family))
    return replace(study, summary=summary, family=family)


def _allele_conditions(
    regions, genes, effect_types, variant_type, real_attr_filter, categorical_attr_filter,
    ultra_rare, frequency_filter, return_reference, return_unknown,
) -> list[Column]:
    conditions: list[Column] = []
    if regions is not None:
        conditions.append(filters.in_regions(regions))
    for name, low, high in real_attr_filter or []:
        conditions.append(filters.real_attribute(name, low, high))
    for name, values in categorical_attr_filter or []:
        conditions.append(filters.categorical_attribute(name, values))
    for name, low, high in frequency_filter or []:
        conditions.append(filters.frequency(name, low, high))
    if ultra_rare:
        conditions.append(filters.ultra_rare())
    if variant_type is not None:
        conditions.append(flags.variant_type(variant_type))
    if not return_reference and not return_unknown:
        conditions.append(F.col("allele_index") > 0)
    gene_list = genes if isinstance(genes, list) else None
    if gene_list is not None or (effect_types is not None and not isinstance(genes, DataFrame)):
        conditions.append(filters.genes_and_effects(gene_list, effect_types))
    return conditions


def summary_query(
    study: Study, *, regions: list[filters.Region] | DataFrame | None = None,
    genes: list[str] | DataFrame | None = None, effect_types: list[str] | None = None,
    variant_type: str | None = None, real_attr_filter: list[Range] | None = None,
    categorical_attr_filter: list[tuple[str, list | None]] | None = None, ultra_rare: bool = False,
    frequency_filter: list[Range] | None = None, return_reference: bool = False,
    return_unknown: bool = False, study_ids: list[str] | None = None, prune: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Summary alleles satisfying every given filter.

    A long region or gene list comes as a DataFrame.
    """
    if prune:
        study = pruned(study, regions, genes, effect_types, None, ultra_rare, frequency_filter)
    region_table = regions if isinstance(regions, DataFrame) else None
    effects = None if effect_types is None else codes.expand_effects(effect_types)
    conditions = _allele_conditions(
        None if region_table is not None else regions, genes, effects, variant_type,
        real_attr_filter, categorical_attr_filter, ultra_rare, frequency_filter, return_reference,
        return_unknown)
    if study_ids is not None:
        conditions.append(F.col("study_id").isin(list(study_ids)))
    rows = study.summary
    for condition in conditions:
        rows = rows.filter(condition)
    if region_table is not None:
        rows = filters.join_regions(rows, region_table)
    if isinstance(genes, DataFrame):
        rows = filters.by_gene_table(rows, genes, effects)
    return rows if limit is None else rows.limit(limit)


def family_query(
    study: Study, *, family_ids: list[str] | DataFrame | None = None,
    person_ids: list[str] | DataFrame | None = None, inheritance: str | list[str] | None = None,
    roles: str | None = None, sexes: str | None = None, affected_statuses: str | None = None,
    selected_tags: list[str] | None = None, deselected_tags: list[str] | None = None,
    tags_or_mode: bool = False, tags: DataFrame | None = None, return_reference: bool = False,
    return_unknown: bool = False, study_ids: list[str] | None = None, prune: bool = True,
) -> DataFrame:
    """Family alleles satisfying every given filter."""
    if prune:
        study = pruned(study, inheritance=inheritance, family_ids=family_ids)
    rows = study.family
    conditions: list[Column] = []
    if roles is not None:
        conditions.append(flags.roles(roles))
    if inheritance is not None:
        conditions.append(flags.inheritance(inheritance))
    if sexes is not None:
        conditions.append(flags.sexes(sexes))
    if affected_statuses is not None:
        conditions.append(flags.statuses(affected_statuses))
    if isinstance(family_ids, list):
        conditions.append(filters.in_families(family_ids))
    if isinstance(person_ids, list):
        conditions.append(filters.carried_by(person_ids))
    if not return_reference and not return_unknown:
        conditions.append(F.col("allele_index") > 0)  # leaves no family without a known copy
    elif not return_unknown:
        conditions.append(~genotypes.all_unknown(F.col("genotype")))
    if study_ids is not None:
        conditions.append(F.col("study_id").isin(list(study_ids)))
    for condition in conditions:
        rows = rows.filter(condition)
    if isinstance(family_ids, DataFrame):
        rows = rows.join(family_ids.select("family_id").distinct(), "family_id", "left_semi")
    if selected_tags or deselected_tags:
        tag_table = tags if tags is not None else pedigree.family_tags(study.pedigree)
        chosen = pedigree.tagged_family_ids(tag_table, selected_tags, deselected_tags, tags_or_mode)
        rows = rows.join(chosen, "family_id", "left_semi")
    if isinstance(person_ids, DataFrame):
        persons = person_ids
        if "family_id" not in persons.columns:  # a person may be in several families
            persons = study.pedigree.select("family_id", "person_id").join(person_ids, "person_id", "left_semi")
        rows = filters.carried_by_table(rows, persons)
    return rows


SUMMARY_ARGUMENTS = {
    "regions", "genes", "effect_types", "variant_type", "real_attr_filter",
    "categorical_attr_filter", "ultra_rare", "frequency_filter", "return_reference",
}


#: Ranges of keys that a query passes to the scan of the family alleles at most.
KEY_RANGES = 64


def key_ranges(summary: DataFrame, most: int = KEY_RANGES) -> Column:
    """A condition on ``sj_index`` that holds for all rows of ``summary``: at most ``most`` closed ranges.

    The span of the keys is cut into parts of equal length, and each part is narrowed to the keys it has. The driver gets a row
    per part. Statistics of files sorted by the key then tell the scan which row groups to leave out.
    """
    low, high = summary.agg(F.min("sj_index"), F.max("sj_index")).first()
    if low is None:
        return F.lit(False)
    width = (high - low) // most + 1
    parts = summary.groupBy(F.expr(f"(sj_index - {low}) div {width}").alias("part")).agg(F.min("sj_index").alias("a"), F.max("sj_index").alias("b")).collect()
    return reduce(lambda x, y: x | y, [F.col("sj_index").between(r["a"], r["b"]) for r in sorted(parts)])


def query_variants(
    study: Study, *, person_set: tuple[person_sets.Collection, list[str]] | None = None,
    unique: bool = False, limit: int | None = None, summary_variant_ids: list[str] | None = None,
    prune: bool = True, return_unknown: bool = False, study_ids: list[str] | None = None,
    family_of: Callable[[DataFrame], DataFrame] | None = None, **query,
) -> DataFrame:
    """Family alleles joined with their summary alleles; all filters are ANDed.

    Keyword arguments are those of ``summary_query`` and ``family_query``. ``unique`` keeps one
    row per allele of a family over studies; ``limit`` is applied after it. Where files are sorted by the key of the join and
    the summary alleles are filtered, those are read first, and the scan of the family alleles gets the ranges of their keys.
    Where family alleles are not stored, ``family_of`` works out those of given sites (bucket_index, summary_index); with a filter
    of summary alleles it is asked for their sites in place of the study's family alleles.
    """
    for_summary = {k: v for k, v in query.items() if k in SUMMARY_ARGUMENTS}
    for_family = {k: v for k, v in query.items() if k not in SUMMARY_ARGUMENTS}
    for_family["return_reference"] = query.get("return_reference", False)
    study = pruned(study, **query) if prune else study
    sa = summary_query(
        study, prune=False, return_unknown=return_unknown, study_ids=study_ids, **for_summary)
    chosen = any(v is not None and v is not False for k, v in for_summary.items() if k != "return_reference")
    family = study.family
    if prune and chosen and family_of is not None:
        family = family_of(sa.select("bucket_index", "summary_index").distinct())
    if person_set is not None:
        collection, set_ids = person_set
        if set(set_ids) != set(collection.set_ids):
            sets = person_sets.assign(study.pedigree, collection)
            family = filters.carried_by_table(family, person_sets.selected_persons(sets, set_ids))
    if prune and chosen and study.by_key:
        family = family.filter(key_ranges(sa))
    fa = family_query(
        replace(study, family=family), prune=False, return_unknown=return_unknown, study_ids=study_ids, **for_family)
    keys = ["sj_index"] + (["study_id"] if "study_id" in fa.columns and "study_id" in sa.columns else [])
    if isinstance(summary_variant_ids, DataFrame):
        # ids are those of summary alleles: the family variants with one of them are found before the two sides meet
        named = summary_variant_ids.select(F.col(summary_variant_ids.columns[0]).alias("_id")).distinct()
        ids = sa.withColumns({"location": location(), "variant": alleles.short_notation(F.col("variant_desc"))})
        chosen_alleles = ids.withColumn("_id", filters.variant_id()).join(named, "_id", "left_semi").select(*keys).distinct()
        fa = kept_variants(fa, fa.join(chosen_alleles, keys, "left_semi"))
    own = [c for c in sa.columns if c not in fa.columns or c in keys]
    rows = fa.join(sa.select(*own), keys).withColumn("location", location()).withColumn("fvuid", fvuid())
    if summary_variant_ids is not None:
        rows = rows.withColumn("variant", alleles.short_notation(F.col("variant_desc")))
        if not isinstance(summary_variant_ids, DataFrame):
            rows = keep_variants(rows, filters.variant_id().isin(list(summary_variant_ids)))
    if unique:
        rows = first_of_studies(rows)
    return rows if limit is None else rows.limit(limit)


def first_of_studies(rows: DataFrame) -> DataFrame:
    """One row per allele of a family: of several studies that of the smallest study id, and then of the smallest key.

    Rows are counted in the order of their window and not picked whole by an aggregate: Catalyst then shuffles only the columns
    that are used afterwards. A row number would have every task sort its rows before the shuffle as well, where few are equal.
    """
    allele = alleles.fvuid(F.col("family_id"), F.col("location"), F.col("reference"), F.col("alternative"))
    rank = [F.col("study_id")] if "study_id" in rows.columns else []
    before = W.partitionBy(allele).orderBy(*rank, "sj_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("_place", F.count("*").over(before)).filter("_place = 1").drop("_place")


def keep_variants(rows: DataFrame, condition: Column) -> DataFrame:
    """All alleles of the family variants with any allele satisfying the condition."""
    return kept_variants(rows, rows.filter(condition))


def kept_variants(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """All alleles of the family variants with any allele among the ``chosen`` rows."""
    keys = ["bucket_index", "summary_index", "family_id"]
    keys += ["study_id"] if "study_id" in rows.columns else []
    return rows.join(chosen.select(*keys).distinct(), keys, "left_semi")


def location() -> Column:
    return alleles.location(
        F.col("chromosome"), F.col("position"), F.col("end_position"), F.col("variant_type"))


def fvuid() -> Column:
    """Identity of a family variant: all alternatives of its site."""
    return alleles.fvuid(F.col("family_id"), location(), F.col("reference"), F.col("site_alternative"))


def svuid() -> Column:
    return alleles.svuid(location(), F.col("reference"), F.col("alternative"), F.col("transmission_type"))


def variant_preview(rows: DataFrame, most: int) -> DataFrame:
    """Rows for a preview page: one more than the page size tells whether there are more."""
    return rows.limit(most + 1)
