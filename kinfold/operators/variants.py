"""From called family genotypes to stored alleles.

``sites``: one row per variant with ``bucket_index, summary_index, chromosome, position,
end_position, reference, alternatives`` (array), optional ``variant_type`` for copy-number rows.
``calls``: one row per family and variant with ``bucket_index, summary_index, family_id, members``
(see ``functions.genotypes``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import alleles, codes, genotypes

KEY = ["bucket_index", "summary_index"]
DENOVO = codes.INHERITANCE["denovo"]


def sj_index() -> Column:
    """One join key per allele: ((bucket * 10^9) + summary_index) * 10^4 + allele_index; numbers beyond these are an error."""
    key = (
        (F.col("bucket_index").cast("long") * 1_000_000_000 + F.col("summary_index")) * 10_000
        + F.col("allele_index"))
    beyond = (F.col("summary_index") >= 1_000_000_000) | (F.col("allele_index") >= 10_000)
    return F.when(beyond, F.raise_error("a summary or allele index is too large for sj_index").cast("long")).otherwise(key)


def running_index(df: DataFrame, bucket: str, position: str, order: list[str], name: str, block: int = 10_000) -> DataFrame:
    """Consecutive numbers from 0 inside each bucket, ordered by position and ``order``.

    A bucket may hold a third of all sites, so rows are numbered inside blocks of positions and
    the block offsets come from a window over the block counts only.
    """
    blocked = df.withColumn("_blk", F.floor(F.col(position) / block))
    counts = blocked.groupBy(bucket, "_blk").agg(F.count("*").alias("_n"))
    before = W.partitionBy(bucket).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(bucket, "_blk").orderBy(position, *order)
    return (
        blocked.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [bucket, "_blk"])
        .withColumn(name, (F.col("_off") + F.col("_rn")).cast("int"))
        .drop("_blk", "_rn", "_off"))


MEMBER_FIELDS = [
    "person_id", "sex", "status", "role", "role_bit", "sex_bit", "status_bit", "mom_ix", "dad_ix",
    "founder",
]

#: Fields of a member that its family's alleles are made of.
FAMILY_FIELDS = [f for f in MEMBER_FIELDS if f != "founder"] + ["a1", "a2"]


def persons_of(layout: DataFrame) -> DataFrame:
    """The layout in long form, one row per member with its place in the family."""
    return layout.select("family_id", F.posexplode("members").alias("place", "m")).select(
        "family_id", "place", "m.*")


def family_calls(person_calls: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Person calls ``(…keys, family_id, place, member fields, a1, a2)`` grouped to member arrays.

    One group is one family at one site, so its size is the family's.
    """
    member = F.struct("place", *MEMBER_FIELDS, "a1", "a2")
    grouped = person_calls.groupBy(*keys, "family_id").agg(
        F.array_sort(F.collect_list(member)).alias("members"))
    return grouped.withColumn("members", F.transform("members", lambda m: F.struct(
        *[m[f].alias(f) for f in [*MEMBER_FIELDS, "a1", "a2"]])))


def _classes(members: genotypes.Members, denovo_mode: str, omission_mode: str, denovo_source: bool) -> Column:
    classes = genotypes.inheritance_by_copies(members, F.col("_n"))
    if denovo_source:
        return genotypes.denovo_source_override(members.zipped("role", "a1", "a2"), classes, F.col("allele_index"))
    return genotypes.apply_omission_mode(genotypes.apply_denovo_mode(classes, denovo_mode), omission_mode)


def _ignored(denovo_mode: str, omission_mode: str) -> Column:
    """A de-novo or omission class in any allele, the reference included, whose mode is ``ignore``."""
    unwanted = [
        code for code, mode in (
            (codes.INHERITANCE["denovo"], denovo_mode), (codes.INHERITANCE["omission"], omission_mode))
        if mode == "ignore"]
    if not unwanted:
        return F.lit(False)
    every = F.array_union(F.array(F.lit(0)), genotypes.alleles_present(F.col("members")))
    return F.exists(every, lambda a: F.exists(
        genotypes.inheritance_by_member(F.col("members"), a), lambda c: c.isin(unwanted)))


def family_alleles(
    calls: DataFrame, include_reference: bool = False, denovo_mode: str = "possible_denovo",
    omission_mode: str = "possible_omission", denovo_source: bool = False,
    include_unknown_families: bool = True, include_unknown_persons: bool = True,
) -> DataFrame:
    """One row per allele of each family variant with its carrier columns.

    Families that are all reference are skipped unless ``include_reference``. The reference allele
    gets a row when a copy is unknown or its own class is de novo. With a mode of ``ignore`` family
    variants having that class in any allele are left out.

    Skipped families have no alleles to unfold, so no filter sits on the member array: Catalyst
    would push it below the projection that built the array and compute the array twice. The alleles
    are listed before they are unfolded, since Spark interprets what it unfolds; the condition there
    keeps Catalyst from filtering by the list.
    """
    members, allele = genotypes.Members(), F.col("allele_index")
    split = calls.select("*", *genotypes.Members.columns(F.col("members"), FAMILY_FIELDS))
    skipped = _ignored(denovo_mode, omission_mode)
    if not include_unknown_persons:
        skipped = skipped | genotypes.any_unknown(members)
    if not include_unknown_families:
        skipped = skipped | genotypes.all_unknown(members)
    if not include_reference:
        skipped = skipped | genotypes.all_reference(members)
    # only a member without any reference copy can make the reference allele de novo in a child
    alone = lambda m: (m["a1"] > 0) & (m["a2"] != 0)
    without_reference = F.when(F.array_max(members["a1"]) > 0, F.when(
        genotypes.is_small(members["a1"]), genotypes.any_of([F.coalesce(alone(members.at(i)), F.lit(False)) for i in range(genotypes.PLACES)])
    ).otherwise(F.exists(members.zipped("a1", "a2"), alone)))
    reference_denovo = F.when(
        without_reference, F.array_contains(genotypes.inheritance_by_copies(members, F.col("_n")), DENOVO)).otherwise(False)
    with_reference = F.lit(True) if include_reference else (
        genotypes.any_unknown(members) | genotypes.all_reference(members) | reference_denovo)
    nothing = F.array().cast("array<int>")
    listed = F.when(skipped, nothing).otherwise(F.concat(
        F.when(with_reference, F.array(F.lit(0))).otherwise(nothing), genotypes.alleles_present(members)))
    unfolded = (
        split.withColumn("_n", F.when(without_reference, genotypes.copies(members, F.lit(0)))).withColumn("_listed", listed).drop("_n")
        .withColumn("allele_index", F.explode(F.when(F.size("_listed") > 0, F.col("_listed")))))
    classed = unfolded.withColumns({
        "_n": genotypes.copies(members, allele), "_k": genotypes.carrier_places(members, allele),
    }).withColumn("_classes", _classes(members, denovo_mode, omission_mode, denovo_source))
    # one row each: a filter by inheritance then stays above the classes, which Catalyst would else write out in it many times over
    classed = classed.withColumn("inheritance_by_member", F.explode(F.array("_classes"))).drop("_classes")
    carrier = genotypes.Carriers(members, F.col("_k"), allele)
    mask = genotypes.bit_or_of(F.col("inheritance_by_member"))
    return classed.select(
        *[c for c in calls.columns if c != "members"], "allele_index", sj_index().alias("sj_index"),
        members["person_id"].alias("member_ids"), carrier.person_ids().alias("allele_in_members"),
        carrier.mask("role").alias("allele_in_roles"),
        carrier.mask("sex").alias("allele_in_sexes"),
        carrier.mask("status").alias("allele_in_statuses"),
        mask.alias("inheritance_in_members"),
        F.array_contains("inheritance_by_member", DENOVO).alias("is_denovo"),
        carrier.zygosity("role_bit").alias("zygosity_in_roles"),
        carrier.zygosity("sex_bit").cast("int").alias("zygosity_in_sexes"),
        carrier.zygosity("status_bit", skip_unspecified=True).cast("int").alias("zygosity_in_status"),
        "inheritance_by_member", F.col("members").alias("genotype"))


def allele_frequencies(calls: DataFrame, n_founders: DataFrame, absent_are_reference: bool = False) -> DataFrame:
    """Founder allele counts and frequencies (percent) per variant and allele.

    Only families without an unknown copy count. ``n_founders`` is a one-row table with the number
    of founders of the pedigree in column ``founders``. With ``absent_are_reference`` the founders
    of families without a row at a variant count as called with two reference copies.
    """
    members, allele = genotypes.Members(), F.col("allele_index")
    small, places = genotypes.is_small(members["a1"]), [members.at(i) for i in range(genotypes.PLACES)]
    founders = F.filter(members.zipped("founder", "a1", "a2"), lambda m: m["founder"])  # of larger families
    copies = F.flatten(F.array(founders["a1"], founders["a2"]))  # concat is slow where it is interpreted
    of_places = F.array(*[F.when(m["founder"], m[side]) for side in ("a1", "a2") for m in places])

    def total_of(each: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in each])

    # the reference allele, which also carries the number of founders, and every other allele seen
    others = F.array(*[F.lit(c).cast("int") for c in (0, codes.UNKNOWN_CALL, codes.HAPLOID_FILLER, None)])
    seen = F.when(small, F.array_except(of_places, others)).otherwise(F.filter(copies, lambda a: a > 0))
    known = ~genotypes.any_unknown(members)
    nothing = F.array().cast("array<int>")
    listed = F.when(known, F.array_union(F.array(F.lit(0)), seen)).otherwise(F.array(F.lit(0)) if absent_are_reference else nothing)
    present = F.when(small, total_of([m["founder"] for m in places])).otherwise(F.size(founders))
    n = F.when(small, total_of([m["founder"] & (m[side] == allele) for side in ("a1", "a2") for m in places])).otherwise(
        F.size(F.filter(copies, lambda c: c == allele)))
    # listed apart and unfolded under a condition, as in family_alleles
    rows = calls.select(*KEY, *genotypes.Members.columns(F.col("members"), ["founder", "a1", "a2"])).withColumn("_listed", listed).withColumn(
        "allele_index", F.explode(F.when(F.size("_listed") > 0, F.col("_listed")))).select(
        *KEY, "allele_index", F.when(known, n).otherwise(0).alias("n"), F.when(allele == 0, present).otherwise(0).alias("present"),
        F.when(known & (allele == 0), present).otherwise(0).alias("called"))
    per_allele = rows.groupBy(*KEY, "allele_index").agg(
        F.sum("n").alias("af_allele_count"), F.sum("called").alias("called"), F.sum("present").alias("present"))
    total = n_founders.select("founders").scalar()
    if absent_are_reference:  # the reference allele's row has all families of the variant
        absent = F.when(F.col("allele_index") == 0, total - F.col("present")).otherwise(0)
        per_allele = per_allele.withColumn("af_allele_count", F.col("af_allele_count") + 2 * absent).withColumn(
            "called", F.col("called") + absent)
    return per_allele.groupBy(*KEY).agg(
        F.sum("called").alias("af_parents_called_count"),
        F.map_from_entries(F.collect_list(F.struct("allele_index", "af_allele_count"))).alias("_counts")).select(
        *KEY, "af_parents_called_count",
        F.when(total > 0, 100.0 * F.col("af_parents_called_count") / total).otherwise(0.0).alias("af_parents_called_percent"),
        "_counts")


def with_frequency(alleles_df: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Frequency columns of each allele, with the reference allele beside it; NULL-free."""
    def count(index: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("_counts"), index), F.lit(0))

    called = F.col("af_parents_called_count")

    def freq(n: Column) -> Column:
        return F.when(called > 0, 100.0 * n / (2.0 * called)).otherwise(0.0)

    joined = alleles_df.join(frequencies, KEY, "left").withColumn(
        "af_parents_called_count", F.coalesce(called, F.lit(0))).withColumn(
        "af_parents_called_percent", F.coalesce("af_parents_called_percent", F.lit(0.0)))
    alt, ref = count(F.col("allele_index")), count(F.lit(0))
    return (
        joined.withColumn("af_allele_count", alt).withColumn("af_allele_freq", freq(alt))
        .withColumn("af_ref_allele_count", ref).withColumn("af_ref_allele_freq", freq(ref))
        .drop("_counts"))


def summary_alleles(sites: DataFrame, include_reference: bool = False) -> DataFrame:
    """One row per alternative allele of every site with type, end and notation."""
    has_type = "variant_type" in sites.columns
    start = 0 if include_reference else 1
    indexed = sites.withColumn(
        "allele_index", F.explode(F.sequence(F.lit(start), F.size("alternatives"))))
    alt = F.when(F.col("allele_index") > 0, F.get("alternatives", F.col("allele_index") - 1))
    rows = indexed.withColumn("alternative", alt).withColumn(
        "site_alternative", F.nullif(F.array_join("alternatives", ","), F.lit("")))
    given = F.col("variant_type") if has_type else F.lit(None).cast("int")
    desc = alleles.variant_description(
        F.col("position"), F.col("reference"), F.col("alternative"), given)
    kind = F.coalesce(
        given, F.when(F.col("allele_index") == 0, 0).otherwise(
            alleles.allele_type(F.col("reference"), F.col("alternative"))))
    end = F.coalesce(F.col("end_position"), alleles.end_position(
        F.col("position"), F.col("reference"), F.col("alternative")))
    return (
        rows.withColumn("end_position", end).withColumn("variant_type", kind.cast("int"))
        .withColumn("variant_desc", desc).withColumn("sj_index", sj_index())
        .drop("alternatives"))


def allele_counters(fa: DataFrame) -> DataFrame:
    """Per allele: carriers' statuses, de-novo flag, number of family variants."""
    return fa.groupBy(*KEY, "allele_index").agg(
        F.bit_or("allele_in_statuses").alias("seen_in_status"),
        F.bool_or("is_denovo").alias("seen_as_denovo"),
        F.count("*").alias("family_variants_count")
    ).withColumn("family_alleles_count", F.col("family_variants_count"))


def stored_summary(alleles_df: DataFrame, fa: DataFrame) -> DataFrame:
    """Summary alleles of the variants that have any family allele, with their counters."""
    counters = allele_counters(fa)
    seen = counters.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct(
        "allele_index", F.struct(
            "seen_in_status", "seen_as_denovo", "family_variants_count", "family_alleles_count")))).alias("_c"))
    own = F.try_element_at(F.col("_c"), F.col("allele_index"))
    return (
        alleles_df.join(seen, KEY)
        .withColumn("seen_in_status", F.coalesce(own["seen_in_status"], F.lit(0)))
        .withColumn("seen_as_denovo", F.coalesce(own["seen_as_denovo"], F.lit(False)))
        .withColumn("family_variants_count", F.coalesce(own["family_variants_count"], F.lit(0)))
        .withColumn("family_alleles_count", F.coalesce(own["family_alleles_count"], F.lit(0)))
        .drop("_c"))


def merge_summaries(summary: DataFrame) -> DataFrame:
    """One row per summary variant identity over studies.

    Counters are aggregated; other attributes come from the smallest ``study_id``.
    """
    rest = [c for c in summary.columns if c not in (
        "svuid", "study_id", "seen_in_status", "seen_as_denovo", "family_variants_count")]
    merged = summary.groupBy("svuid").agg(
        F.sum("family_variants_count").alias("family_variants_count"),
        F.bit_or("seen_in_status").alias("seen_in_status"),
        F.bool_or("seen_as_denovo").alias("seen_as_denovo"),
        F.min_by(F.struct("study_id", *rest), "study_id").alias("_first"))
    return merged.select(
        "svuid", "family_variants_count", "seen_in_status", "seen_as_denovo",
        "_first.study_id", *[f"_first.{c}" for c in rest])


def summary_from_family(fa: DataFrame, ped: DataFrame, keys: list[str], others: list[str]) -> DataFrame:
    """Summary rows rebuilt from family alleles of confirmed classes.

    Classes mendelian, de novo or missing count; possible de novo or omission rows do not.
    """
    inheritance = F.col("inheritance_in_members")
    confirmed = (
        (F.col("allele_index") > 0) & (inheritance.bitwiseAND(134) != 0)
        & (inheritance.bitwiseAND(8) == 0) & (inheritance.bitwiseAND(32) == 0))
    statuses = ped.select(F.col("person_id").alias("_p"), F.col("status").alias("_st"))
    rows = fa.filter(confirmed).withColumn("_carrier", F.explode("allele_in_members"))
    return rows.join(statuses, F.col("_carrier") == F.col("_p")).groupBy(*keys).agg(
        F.count_distinct("family_id").alias("family_variants_count"),
        F.bit_or("_st").alias("seen_in_status"),
        F.bool_or(inheritance.bitwiseAND(DENOVO) != 0).alias("seen_as_denovo"),
        *[F.min(c).alias(c) for c in others])


def matched_alleles(fa: DataFrame) -> DataFrame:
    """Alleles of each family variant that satisfied a filter already applied to ``fa``."""
    return fa.groupBy(*KEY, "family_id").agg(
        F.array_sort(F.collect_set("allele_index")).alias("matched_alleles"))


def annotate(summary: DataFrame, annotations: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """Add annotation columns by site and allele; drop old ones first.

    Copy-number alleles have no sequence, so missing references match each other; their
    annotations should also bring ``end_position`` and ``variant_type``.
    """
    old = summary.drop(*(drop or []))
    keys = ["chromosome", "position", "reference", "alternative"]
    keys += [k for k in ("end_position", "variant_type") if k in annotations.columns]
    right = annotations.withColumnsRenamed({k: f"_a_{k}" for k in keys})
    strict = F.lit(True)
    for k in keys:
        same = F.col(k) == F.col(f"_a_{k}") if k in ("chromosome", "position") else F.col(k).eqNullSafe(F.col(f"_a_{k}"))
        strict = strict & same
    return old.join(right, strict, "left").drop(*[f"_a_{k}" for k in keys])
