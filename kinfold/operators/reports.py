"""Study reports: people, families, de-novo events, headline counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import codes
from kinfold.operators import pedigree

PEOPLE_ROWS = ["people_male", "people_female", "people_unspecified", "people_total"]


def people_counters(sets: DataFrame) -> DataFrame:
    """Persons of each set by sex; empty sets do not occur."""
    def count(code: int) -> Column:
        return F.count(F.when(F.col("sex") == code, 1))
    return sets.groupBy("psc_id", "set_id").agg(
        count(1).alias("people_male"), count(2).alias("people_female"),
        count(4).alias("people_unspecified"), F.count("*").alias("people_total"))


def people_counter_rows(counters: DataFrame) -> DataFrame:
    """Counters in long form without the rows that are zero in every set."""
    pairs = ", ".join(f"'{r}', {r}" for r in PEOPLE_ROWS)
    long = counters.selectExpr("psc_id", "set_id", f"stack({len(PEOPLE_ROWS)}, {pairs}) AS (counter, people)")
    over_sets = F.sum("people").over(W.partitionBy("psc_id", "counter"))  # one row per set
    return long.withColumn("_n", over_sets).filter("_n > 0").drop("_n")


def family_types(ped: DataFrame, sets: DataFrame) -> DataFrame:
    """The type of each family: size, then ``set.role.sex.status`` of its members.

    Members are ordered by sex and role. One row per family, so a type held by most families stays
    spread over tasks.
    """
    people = pedigree.members(ped).join(sets.select("family_id", "person_id", "set_id"), ["family_id", "person_id"])
    order = F.struct(
        codes.decode(codes.SEXES, F.col("sex")).alias("s"),
        codes.decode(codes.ROLES, F.col("role"), "unknown").alias("r"),
        F.col("member_index").alias("i"), pedigree.member_type(F.col("set_id")).alias("t"))
    return people.groupBy("family_id").agg(F.array_sort(F.collect_list(order)).alias("m")).select(
        "family_id", F.concat_ws(
            ":", F.size("m").cast("string"), F.array_join(F.transform("m", lambda x: x["t"]), ":")).alias("family_type"))


def family_type_counters(types: DataFrame) -> DataFrame:
    """Families per type, the most frequent first."""
    return (
        types.groupBy("family_type").agg(
            F.count("*").alias("pedigrees_count"), F.min("family_id").alias("example_family"))
        .orderBy(F.desc("pedigrees_count"), "family_type"))


def family_counters(ped: DataFrame, sets: DataFrame, tags: DataFrame) -> DataFrame:
    """One counter per family with its type and tags."""
    return family_types(ped, sets).join(tags, "family_id")


def headline(ped: DataFrame) -> DataFrame:
    """Families, probands and siblings; only children with both parents count as either."""
    flagged = pedigree.with_parent_flags(ped)

    def children(role: str) -> Column:
        return F.count(F.when(F.col("is_child") & (F.col("role") == codes.ROLES[role]), 1))

    return flagged.agg(
        F.count_distinct("family_id").alias("families"), children("prb").alias("number_of_probands"),
        children("sib").alias("number_of_siblings"))


def label_array(labels: list[str], effect_types: Column) -> Column:
    """The labels (effect groups or types) any of whose effects occur in ``effect_types``."""
    def test(label: str) -> Column:
        members = F.array(*[F.lit(e) for e in codes.expand_effects(label)])
        return F.when(F.arrays_overlap(effect_types, members), F.lit(label))
    return F.array_compact(F.array(*[test(label) for label in labels]))


def denovo_report(denovo: DataFrame, sets: DataFrame, labels: list[str]) -> DataFrame:
    """Cells of the de-novo report: events and children with events per person set and effect.

    ``denovo`` holds family alleles of de-novo variants. A set without children uses all its
    persons. Rows and columns without any event are dropped, other cells show zeros.
    """
    kids = sets.groupBy("psc_id", "set_id").agg(F.bool_or("is_child").alias("has_children"))
    chosen = sets.join(kids, ["psc_id", "set_id"]).filter(F.col("is_child") | ~F.col("has_children"))
    sizes = chosen.groupBy("psc_id", "set_id").agg(F.count_distinct("person_id").alias("children"))
    effects = F.transform("effect_gene", lambda g: g["effect_types"])
    events = (
        denovo.select("family_id", "fvuid", "allele_in_members", label_array(labels, effects).alias("labels"))
        .filter(F.size("labels") > 0)
        .select("family_id", "fvuid", "labels", F.explode("allele_in_members").alias("person_id"))
        .join(chosen.select("psc_id", "set_id", "family_id", "person_id"), ["family_id", "person_id"])
        .select("psc_id", "set_id", "fvuid", "family_id", "person_id", F.explode("labels").alias("effect")))
    counted = events.groupBy("psc_id", "set_id", "effect").agg(
        F.count_distinct("fvuid").alias("events"), F.count_distinct("person_id").alias("with_event"))
    events_n, kids_n = F.coalesce("events", F.lit(0)), F.coalesce("with_event", F.lit(0))
    grid = sizes.withColumn("effect", F.explode(F.array(*[F.lit(label) for label in labels]))).join(
        counted, ["psc_id", "set_id", "effect"], "left").select(
        "psc_id", "set_id", "effect", "children", events_n.alias("number_of_observed_events"),
        kids_n.alias("number_of_children_with_event"))
    # the grid has one row per set and label, both from the configuration
    seen = F.sum("number_of_observed_events")
    used = grid.withColumn("_column", seen.over(W.partitionBy("psc_id", "set_id"))).withColumn(
        "_row", seen.over(W.partitionBy("psc_id", "effect"))).filter("_column > 0 AND _row > 0").drop("_column", "_row")
    return used.withColumn(
        "observed_rate_per_child", F.col("number_of_observed_events") / F.col("children")).withColumn(
        "percent_of_children_with_events", F.col("number_of_children_with_event") / F.col("children"))


def as_json(report: DataFrame) -> DataFrame:
    """Report rows as JSON documents."""
    return report.select(F.to_json(F.struct("*")).alias("json"))
