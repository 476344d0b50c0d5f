"""Browser requests: translation to study filters, and the columns of the answer rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import alleles, codes, flags, genotypes
from kinfold.operators import filters, gene_sets

# ---- fixed values: request words ------------------------------------------------------------
PRESENT_IN_CHILD = {
    "proband only": "prb and not sib",
    "sibling only": "sib and not prb",
    "proband and sibling": "prb and sib",
}
PRESENT_IN_PARENT = {
    "mother only": "mom and not dad",
    "father only": "dad and not mom",
    "mother and father": "mom and dad",
}
STATUS_CHOICES = {
    "affected only": "(affected and not unaffected)",
    "unaffected only": "(unaffected and not affected)",
    "affected and unaffected": "(affected and unaffected)",
}
GUARD = "not possible_denovo and not possible_omission"


def _choices(chosen: set[str], words: dict[str, str], neither: str, zygosity: str | None, keep_all: bool) -> str | None:
    texts = [text for word, text in words.items() if word in chosen]
    if zygosity is not None:
        texts = [flags.with_zygosity(t, zygosity) for t in texts]
    if "neither" in chosen:
        texts.append(neither)
    if not texts or (len(texts) == 4 and not keep_all):
        return None
    return texts[0] if len(texts) == 1 else " or ".join(f"({t})" for t in texts)


def present_in_child(chosen: set[str], zygosity: str | None = None) -> str | None:
    """Roles expression of a child selection; all four choices filter nothing."""
    return _choices(chosen, PRESENT_IN_CHILD, "not prb and not sib", zygosity, keep_all=False)


def present_in_parent(chosen: set[str], zygosity: str | None = None) -> str | None:
    """Roles expression of a parent selection; with a zygosity all four choices still filter."""
    return _choices(chosen, PRESENT_IN_PARENT, "not mom and not dad", zygosity, keep_all=zygosity is not None)


def both(first: str | None, second: str | None) -> str | None:
    """Two optional expressions that must both hold."""
    if first and second:
        return f"({first}) and ({second})"
    return first or second


def present_inheritance(child: set[str], parent: set[str]) -> str:
    """Inheritance classes implied by where the allele must be present."""
    if child == {"neither"} and parent != {"neither"}:
        names = ["mendelian", "missing"]
    elif child != {"neither"} and parent == {"neither"}:
        names = ["denovo"]
    else:
        names = ["denovo", "mendelian", "missing", "omission", "unknown"]
    return f"any([{','.join(names)}])"


def rarity(ultra_rare: bool = False, low: float | None = None, high: float | None = None) -> dict:
    """Frequency argument of a rarity selection (percent)."""
    if ultra_rare:
        return {"ultra_rare": True}
    if low is not None or high is not None:
        return {"frequency_filter": [("af_allele_freq", low, high)]}
    return {}


def affected_status(choices: list[str]) -> str | None:
    texts = [text for word, text in STATUS_CHOICES.items() if word in [c.lower() for c in choices]]
    return " or ".join(texts) if texts else None


def inheritance_types(chosen: list[str]) -> str:
    """A selection of classes; mendelian or missing also admit unknown."""
    names = list(dict.fromkeys([*chosen, *(["unknown"] if {"mendelian", "missing"} & set(chosen) else [])]))
    return f"any([{','.join(names)}])"


def score_filters(scores: list[dict]) -> dict:
    """Genomic scores split into ranges and categories."""
    ranges = [(s["score"], s.get("rangeStart"), s.get("rangeEnd")) for s in scores if s.get("values") is None]
    categories = [(s["score"], s["values"]) for s in scores if s.get("values") is not None]
    return {
        **({"real_attr_filter": ranges} if ranges else {}),
        **({"categorical_attr_filter": categories} if categories else {})}


def merged_roles(in_parent: str | None, in_child: str | None, roles: str | None = None) -> str | None:
    """Older requests name parent and child roles apart; all parts must hold."""
    return both(both(in_parent, in_child), roles)


@dataclass(frozen=True)
class Scores:
    """Gene-score side of a request: genes whose score is in a range or among values."""

    table: DataFrame
    score_id: str
    low: float | None = None
    high: float | None = None
    values: list[float] | None = None

    def genes(self) -> DataFrame:
        return gene_sets.by_score(self.table, self.score_id, self.low, self.high, self.values)


def translate(request: dict) -> dict:
    """Keyword arguments of ``study.query_variants`` for a browser request.

    Understood keys: ``regions`` (texts), ``genes``, ``geneScores`` (``Scores``), ``effectTypes``,
    ``variantTypes``, ``genders``, ``affectedStatus``, ``presentInChild``, ``zygosityInChild``,
    ``presentInParent``, ``zygosityInParent``, ``rarity``, ``inheritanceTypeFilter``,
    ``genomicScores``, ``frequencyScores``, ``familyIds``, ``personIds``, ``selectedFamilyTags``,
    ``deselectedFamilyTags``, ``tagsOrMode``, ``studyFilters``, ``allowedStudies``,
    ``summaryVariantIds``, ``uniqueFamilyVariants``.
    """
    child = set(request.get("presentInChild", []))
    parent = set(request.get("presentInParent", []))
    query: dict = {"inheritance": [GUARD]}
    if request.get("inheritanceTypeFilter"):
        query["inheritance"].append(inheritance_types(request["inheritanceTypeFilter"]))
    else:
        query["inheritance"].append(present_inheritance(child, parent))
    roles = both(
        present_in_child(child, request.get("zygosityInChild")),
        present_in_parent(parent, request.get("zygosityInParent")))
    if roles:
        query["roles"] = roles
    if parent != {"neither"} and request.get("rarity"):
        query.update(rarity(**request["rarity"]))
    if request.get("regions"):
        query["regions"] = filters.repair_chromosomes(
            [filters.Region.parse(r) for r in request["regions"]],
            request.get("chromosomes", []), request.get("chromPrefix", "chr"))
    for source, target in (
            ("genes", "genes"), ("effectTypes", "effect_types"), ("familyIds", "family_ids"),
            ("personIds", "person_ids"), ("selectedFamilyTags", "selected_tags"),
            ("deselectedFamilyTags", "deselected_tags"), ("tagsOrMode", "tags_or_mode"),
            ("summaryVariantIds", "summary_variant_ids"), ("uniqueFamilyVariants", "unique")):
        if request.get(source) is not None:
            query[target] = request[source]
    if request.get("geneScores") is not None:
        query["genes"] = request["geneScores"].genes()
    if request.get("genders") and set(request["genders"]) != {"female", "male", "unspecified"}:
        query["sexes"] = f"any([{','.join(request['genders'])}])"
    if request.get("variantTypes"):
        types = [t.lower() for t in request["variantTypes"]]
        if set(types) != {"sub", "ins", "del", "comp", "cnv"}:
            query["variant_type"] = " or ".join(t for word in types for t in (["cnv+", "cnv-"] if word == "cnv" else [word]))
    status = affected_status(request.get("affectedStatus", []))
    if status:
        query["affected_statuses"] = status
    query.update(score_filters(request.get("genomicScores", [])))
    if request.get("frequencyScores"):
        query["frequency_filter"] = query.get("frequency_filter", []) + [
            (s["score"], s.get("rangeStart"), s.get("rangeEnd")) for s in request["frequencyScores"]]
    studies = request.get("allowedStudies")
    if request.get("studyFilters"):
        wanted = request["studyFilters"]
        studies = wanted if studies is None else [s for s in wanted if s in studies]
    if studies is not None:
        query["study_ids"] = list(studies)
    return query


# ---- answer rows ----------------------------------------------------------------------------

def _seen(status: int) -> Column:
    """Seen in carriers of one status; alleles seen in unspecified persons count for neither."""
    return F.col("seen_in_status").isin(status, 3)


def _alternatives() -> Column:
    """Number of alternatives of the row's site; a copy-number site has one."""
    return F.when(F.col("site_alternative").isNull(), 1).otherwise(F.size(F.split("site_alternative", ",")))


def columns() -> dict[str, Column]:
    """Named answer columns over ``query_variants`` rows."""
    inheritance = F.col("inheritance_in_members")
    inh = codes.INHERITANCE
    # fields by name, so that Catalyst shuffles no other field of the members
    described = F.arrays_zip(*[F.col("genotype")[f].alias(f) for f in ("role", "sex", "status", "a1", "a2")])
    return {
        "family": F.col("family_id"),
        "location": F.col("location"),
        "variant": alleles.full_notation(F.col("variant_desc")),
        "position": F.col("position"),
        "reference": F.col("reference"),
        "alternative": F.col("alternative"),
        "genotype": genotypes.genotype_text(F.col("genotype")),
        "best_st": genotypes.best_state_text(genotypes.best_state(F.col("genotype"), _alternatives()), _alternatives()),
        "family_person_ids": F.array_join("member_ids", ";"),
        "carrier_person_ids": F.array_join("allele_in_members", ";"),
        "family_person_attributes": person_attributes(described),
        "carrier_person_attributes": person_attributes(genotypes.carriers(described, F.col("allele_index"))),
        "inheritance_type": F.when(inheritance.bitwiseAND(inh["denovo"]) != 0, "denovo").when(
            inheritance.bitwiseAND(inh["possible_denovo"] | inh["possible_omission"]) != 0, "-").otherwise("mendelian"),
        "is_denovo": inheritance.bitwiseAND(inh["denovo"]) != 0,
        "effects": effects_text(),
        "worst_effect": alleles.worst_effect(F.col("effect_gene")),
        "genes": alleles.genes_of_worst(F.col("effect_gene")),
        "seen_in_affected": _seen(2),
        "seen_in_unaffected": _seen(1),
    }


def person_attributes(members: Column) -> Column:
    """``role:sex:status`` of the persons, joined with ``;``."""
    return F.array_join(F.transform(members, lambda m: F.concat_ws(
        ":", codes.decode(codes.ROLES, m["role"], "unknown"), codes.decode(codes.SEXES, m["sex"]),
        codes.decode(codes.STATUSES, m["status"]))), ";")


def effects_text() -> Column:
    """``gene:effect`` pairs joined with ``|``."""
    return F.array_join(F.transform("effect_gene", lambda g: F.concat_ws(
        ":", g["effect_gene_symbols"], g["effect_types"])), "|")


def _cell(name: str, formats: dict[str, str] | None) -> Column:
    known = columns()
    value = known[name] if name in known else F.col(f"`{name}`")
    text = F.format_string(formats[name], value) if formats and name in formats else value.cast("string")
    return F.when(value.isNull(), "-").otherwise(text).alias(name)


def answer(rows: DataFrame, names: list[str], formats: dict[str, str] | None = None) -> DataFrame:
    """Chosen columns as text, one row per allele.

    Missing values show ``-`` and numbers follow their printf format.
    """
    return rows.select(*[_cell(n, formats) for n in names])


def variant_rows(rows: DataFrame, names: list[str], formats: dict[str, str] | None = None) -> DataFrame:
    """One row per family variant; each column lists its alleles, collapsed when all agree."""
    keys = ["bucket_index", "summary_index", "family_id"]
    packed = rows.select(
        *keys, F.struct("allele_index", *[_cell(n, formats) for n in names]).alias("_r"))
    grouped = packed.groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("_rows"))

    def collapsed(name: str) -> Column:
        listed = F.transform("_rows", lambda x: x[name])
        return F.when(F.size(F.array_distinct(listed)) == 1, F.slice(listed, 1, 1)).otherwise(listed).alias(name)

    return grouped.select(*keys, *[collapsed(n) for n in names])


def with_gene_scores(rows: DataFrame, scores: DataFrame, score_ids: list[str]) -> DataFrame:
    """Score columns of each allele's first gene.

    Alleles without a gene share no key, so they do not meet in one task of the join.
    """
    wide = scores.groupBy("gene").agg(*[
        F.max(F.when(F.col("score_id") == s, F.col("value"))).alias(s) for s in score_ids])
    first = F.get(alleles.genes(F.col("effect_gene")), F.lit(0))
    named = rows.withColumn("_gene", first)
    scored = named.filter(F.col("_gene").isNotNull()).join(wide.withColumnRenamed("gene", "_gene"), "_gene", "left").drop("_gene")
    return scored.unionByName(named.filter(F.col("_gene").isNull()).drop("_gene"), allowMissingColumns=True)


def with_family_measures(rows: DataFrame, measures: DataFrame) -> DataFrame:
    """Family-level phenotype columns."""
    return rows.join(measures, "family_id", "left")


def with_phenotypes(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Person-set names of the family members and of the carriers, joined with ``:``.

    The members' sets are looked up as one map per family.
    """
    by_family = sets.groupBy("family_id").agg(
        F.map_from_entries(F.collect_list(F.struct("person_id", "set_id"))).alias("_sets"))

    def names(ids: str) -> Column:
        return F.array_join(F.transform(ids, lambda p: F.try_element_at(F.col("_sets"), p)), ":")

    return rows.join(by_family, "family_id", "left").withColumn(
        "family_phenotypes", names("member_ids")).withColumn(
        "carrier_phenotypes", names("allele_in_members")).drop("_sets")


def gene_view(summary: DataFrame, frequency: str) -> DataFrame:
    """Summary alleles as shown by the gene browser."""
    from kinfold.plans.study import location, svuid
    return summary.select(
        svuid().alias("svuid"), location().alias("location"), "position", "end_position",
        F.col("chromosome").alias("chrom"), F.col(frequency).alias("frequency"),
        alleles.worst_effect(F.col("effect_gene")).alias("effect"),
        alleles.short_notation(F.col("variant_desc")).alias("variant"),
        "family_variants_count", F.col("seen_as_denovo").alias("is_denovo"),
        _seen(2).alias("seen_in_affected"), _seen(1).alias("seen_in_unaffected"))


def gene_view_selected(view: DataFrame, variant_ids: list[str]) -> DataFrame:
    """Rows of a gene view picked by ``location:variant``."""
    return view.filter(filters.variant_id().isin(list(variant_ids)))
