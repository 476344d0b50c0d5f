"""Gene sets: standard collections and sets of genes hit by de-novo events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import codes

# ---- fixed values: recurrency criteria, [start, end) distinct families; -1 is unbounded -----
RECURRENCY = {"Single": (1, 2), "Recurrent": (2, -1), "Triple": (3, -1)}
SEX_CRITERIA = {"Female": ["F"], "Male": ["M"], "Unspecified": ["U"]}


def denovo_cache(
    denovo: DataFrame, sets: DataFrame, effects: dict[str, list[str]],
    sexes: dict[str, list[str]] = SEX_CRITERIA,
) -> DataFrame:
    """Distinct ``(psc_id, set_id, effect_criteria, sex_criteria, gene, family_id)``.

    Only persons who are themselves de-novo carriers count. ``effects`` maps a criterion to effect
    groups or types.
    """
    hit = F.filter(
        F.arrays_zip("member_ids", "inheritance_by_member"),
        lambda z: z["inheritance_by_member"].bitwiseAND(codes.INHERITANCE["denovo"]) != 0)

    def labels(values: dict[str, list[str]], column: Column, expand) -> Column:
        return F.array_compact(F.array(*[
            F.when(column.isin(expand(v)), F.lit(name)) for name, v in values.items()]))

    genes = denovo.select(
        "family_id", F.transform(hit, lambda z: z["member_ids"]).alias("persons"),
        F.explode("effect_gene").alias("g"))
    genes = genes.select(
        "family_id", "persons", F.col("g.effect_gene_symbols").alias("gene"),
        labels(effects, F.col("g.effect_types"), codes.expand_effects).alias("effect_criteria")
    ).filter("gene IS NOT NULL AND size(effect_criteria) > 0")
    persons = genes.withColumn("person_id", F.explode("persons")).join(
        sets.select("psc_id", "set_id", "family_id", "person_id", "sex"), ["family_id", "person_id"])
    sex_label = labels(sexes, codes.decode(codes.SEXES, F.col("sex")), list)
    return (
        persons.withColumn("effect_criteria", F.explode("effect_criteria"))
        .withColumn("sex_criteria", F.explode(sex_label))
        .select("psc_id", "set_id", "effect_criteria", "sex_criteria", "gene", "family_id").distinct())


def recurrent(families: Column, criterion: str | None) -> Column:
    if criterion is None:
        return F.lit(True)
    start, end = RECURRENCY[criterion]
    return families >= start if end < 0 else (families >= start) & (families < end)


def denovo_gene_set(
    cache: DataFrame, psc_id: str, set_ids: list[str], effects: list[str] | None = None,
    sexes: list[str] | None = None, recurrency: str | None = None,
) -> DataFrame:
    """Genes satisfying the criteria with the number of distinct families."""
    rows = cache.filter((F.col("psc_id") == psc_id) & F.col("set_id").isin(list(set_ids)))
    if effects is not None:
        rows = rows.filter(F.col("effect_criteria").isin(list(effects)))
    if sexes is not None:
        rows = rows.filter(F.col("sex_criteria").isin(list(sexes)))
    counted = rows.groupBy("gene").agg(F.count_distinct("family_id").alias("families"))
    return counted.filter(recurrent(F.col("families"), recurrency))


def all_denovo_gene_sets(
    caches: dict[str, DataFrame], spec: dict[str, dict[str, list[str]]], names: list[str],
) -> DataFrame:
    """Every named set, such as ``LGDs.Male.Recurrent``, over the studies of the specification.

    Families are united over studies before recurrency applies. All sets come from one grouping:
    each cache row is labelled with the sets it belongs to.
    """
    parts = []
    for study_id, collections in spec.items():
        for psc_id, set_ids in collections.items():
            parts.append(caches[study_id].filter(
                (F.col("psc_id") == psc_id) & F.col("set_id").isin(list(set_ids))))
    rows = reduce(DataFrame.unionByName, parts)

    def member(name: str) -> Column:
        wanted = [c for c in name.split(".") if c not in RECURRENCY]
        tests = [(F.col("effect_criteria") == c) | (F.col("sex_criteria") == c) for c in wanted]
        return F.when(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(name))

    counted = (
        rows.withColumn("name", F.explode(F.array_compact(F.array(*[member(n) for n in names]))))
        .groupBy("name", "gene").agg(F.count_distinct("family_id").alias("families")))
    keep = F.lit(False)
    for name in names:
        criterion = next((c for c in name.split(".") if c in RECURRENCY), None)
        keep = keep | ((F.col("name") == name) & recurrent(F.col("families"), criterion))
    return counted.filter(keep)


def set_sizes(gene_sets: DataFrame, keys: list[str]) -> DataFrame:
    return gene_sets.groupBy(*keys).agg(F.count_distinct("gene").alias("count"))


def listing(
    gene_sets: DataFrame, collection_id: str, text: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Sets of a collection whose id or description contains a text, with their sizes."""
    rows = gene_sets.filter(F.col("collection_id") == collection_id)
    if text:
        rows = rows.filter(
            F.lower("set_id").contains(text.lower()) | F.lower("desc").contains(text.lower()))
    counted = set_sizes(rows, ["collection_id", "set_id", "desc"])
    return counted if limit is None else counted.orderBy("set_id").limit(limit)


def lookup(gene_sets: DataFrame, collection_id: str, set_id: str) -> DataFrame:
    """Genes of one standard set."""
    return gene_sets.filter(
        (F.col("collection_id") == collection_id) & (F.col("set_id") == set_id)).select("gene").distinct()


def members_of(genes: DataFrame, gene_set: DataFrame) -> DataFrame:
    """Gene rows belonging to a set."""
    return genes.join(gene_set.select("gene"), "gene", "left_semi")


def by_score(scores: DataFrame, score_id: str, low: float | None = None, high: float | None = None,
             values: list[float] | None = None) -> DataFrame:
    """Genes with a score in a closed range, or equal to one of the values."""
    rows = scores.filter(F.col("score_id") == score_id)
    if values is not None:
        rows = rows.filter(F.col("value").isin(list(values)))
    if low is not None:
        rows = rows.filter(F.col("value") >= low)
    if high is not None:
        rows = rows.filter(F.col("value") <= high)
    return rows.select("gene").distinct()
