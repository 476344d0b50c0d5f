"""Pedigree operators.

A pedigree DataFrame has ``family_id, person_id, mom_id, dad_id, sex, status, role, sample_id,
generated, not_sequenced, member_index`` (flags as in ``functions.codes``). Pedigrees grow with the
cohort, so nothing here broadcasts by hand: joins are equi-joins on the family and person ids and
the optimizer picks the strategy from sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import codes

ROLE = codes.ROLES
PEDIGREE_COLUMNS = [
    "family_id", "person_id", "mom_id", "dad_id", "sex", "status", "role", "sample_id",
    "generated", "not_sequenced", "member_index",
]


def is_missing() -> Column:
    """Generated or not sequenced persons are no members."""
    return F.coalesce(F.col("generated"), F.lit(False)) | F.coalesce(F.col("not_sequenced"), F.lit(False))


def members(ped: DataFrame) -> DataFrame:
    """Persons taking part in genotypes."""
    return ped.filter(~is_missing())


def with_parent_flags(ped: DataFrame) -> DataFrame:
    """Adds ``missing, has_mom, has_dad, is_child, is_founder, has_parent``.

    A parent counts only when it is a member; a child has both parents, a founder neither.
    """
    known = members(ped).select(
        F.col("family_id").alias("_f"), F.col("person_id").alias("_p")).distinct()
    moms = known.select(F.col("_f").alias("_mf"), F.col("_p").alias("_m"))
    dads = known.select(F.col("_f").alias("_df"), F.col("_p").alias("_d"))
    joined = (
        ped.withColumn("missing", is_missing())
        .join(moms, (F.col("family_id") == F.col("_mf")) & (F.col("mom_id") == F.col("_m")), "left")
        .join(dads, (F.col("family_id") == F.col("_df")) & (F.col("dad_id") == F.col("_d")), "left"))
    return (
        joined.withColumn("has_mom", F.col("_m").isNotNull())
        .withColumn("has_dad", F.col("_d").isNotNull())
        .withColumn("has_parent", F.col("has_mom") | F.col("has_dad"))
        .withColumn("is_child", ~F.col("missing") & F.col("has_mom") & F.col("has_dad"))
        .withColumn("is_founder", ~F.col("missing") & ~F.col("has_parent"))
        .drop("_mf", "_m", "_df", "_d"))


def trios(ped: DataFrame) -> DataFrame:
    """``(family_id, child, mom, dad)`` with both parents present as members."""
    flagged = with_parent_flags(ped).filter("is_child")
    return flagged.select(
        "family_id", F.col("person_id").alias("child"),
        F.col("mom_id").alias("mom"), F.col("dad_id").alias("dad"))


def layout(ped: DataFrame) -> DataFrame:
    """One row per family with its ordered member array, without genotypes.

    The array is the width of one family. Parent positions are resolved here once, so trio checks
    need no join later.
    """
    def bit(name: str) -> Column:
        return F.round(F.log2(F.col(name))).cast("int").alias(f"{name}_bit")

    member = F.struct(
        "member_index", "person_id", "mom_id", "dad_id", "sex", "status", "role", "sample_id",
        bit("role"), bit("sex"), bit("status"))
    grouped = members(ped).groupBy("family_id").agg(F.array_sort(F.collect_list(member)).alias("m"))
    ids = F.transform("m", lambda x: x["person_id"])

    def place(parent: Column) -> Column:
        return F.coalesce(F.array_position(ids, parent), F.lit(0)).cast("int")

    return grouped.select("family_id", F.transform("m", lambda x: F.struct(
        x["person_id"].alias("person_id"), x["sample_id"].alias("sample_id"),
        x["sex"].alias("sex"), x["status"].alias("status"), x["role"].alias("role"),
        x["role_bit"].alias("role_bit"), x["sex_bit"].alias("sex_bit"),
        x["status_bit"].alias("status_bit"),
        place(x["mom_id"]).alias("mom_ix"), place(x["dad_id"]).alias("dad_ix"),
        ((place(x["mom_id"]) == 0) & (place(x["dad_id"]) == 0)).alias("founder"))).alias("members"))


# ---- tags -----------------------------------------------------------------------------------

TAGS = [
    "nuclear", "quad", "trio", "simplex", "multiplex", "control",
    "affected_dad", "affected_mom", "affected_prb", "affected_sib",
    "unaffected_dad", "unaffected_mom", "unaffected_prb", "unaffected_sib",
    "male_prb", "female_prb", "missing_mom", "missing_dad",
]
TAG_COLUMNS = [f"tag_{name}_family" for name in TAGS]


def family_tags(ped: DataFrame) -> DataFrame:
    """One row per family: 18 boolean tags and the full family type text."""
    flagged = with_parent_flags(ped)
    member = ~F.col("missing")

    def first(role: str) -> Column:
        holder = F.struct("member_index", "person_id", "sex", "status")
        return F.min(F.when(member & (F.col("role") == ROLE[role]), holder)).alias(role)

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    per_family = flagged.groupBy("family_id").agg(
        first("mom"), first("dad"), first("prb"),
        count(member).alias("size"),
        count(F.col("status") == 2).alias("affected"),
        count(F.col("is_child")).alias("children"),
        count(member & F.col("role").isin(ROLE["prb"], ROLE["sib"])).alias("offspring"),
        count(member & (F.col("role") == ROLE["sib"]) & (F.col("status") == 2)).alias("sib_aff"),
        count(member & (F.col("role") == ROLE["sib"]) & (F.col("status") == 1)).alias("sib_unaff"),
        family_type_text(member).alias("tag_family_type_full"))
    strangers = (
        flagged.join(per_family.select("family_id", "mom", "dad"), "family_id")
        .groupBy("family_id").agg(F.bool_or(
            ~F.coalesce(F.col("person_id").isin(F.col("mom.person_id"), F.col("dad.person_id")), F.lit(False))
            & ~F.coalesce(
                F.col("has_mom") & F.col("has_dad")
                & (F.col("mom_id") == F.col("mom.person_id"))
                & (F.col("dad_id") == F.col("dad.person_id")), F.lit(False))).alias("stranger")))
    joined = per_family.join(strangers, "family_id")
    nuclear = (
        (F.col("size") >= 3) & F.col("mom").isNotNull() & F.col("dad").isNotNull()
        & (F.col("children") > 0) & (F.col("offspring") > 0) & ~F.col("stranger"))

    def holder_is(role: str, field: str, code: int) -> Column:
        return F.coalesce(F.col(f"{role}.{field}") == code, F.lit(False))

    tags = {
        "nuclear": nuclear,
        "quad": nuclear & (F.col("size") == 4),
        "trio": nuclear & (F.col("size") == 3),
        "simplex": F.col("affected") == 1,
        "multiplex": F.col("affected") > 1,
        "control": F.col("affected") == 0,
        "affected_dad": holder_is("dad", "status", 2),
        "affected_mom": holder_is("mom", "status", 2),
        "affected_prb": holder_is("prb", "status", 2),
        "affected_sib": F.col("sib_aff") > 0,
        "unaffected_dad": holder_is("dad", "status", 1),
        "unaffected_mom": holder_is("mom", "status", 1),
        "unaffected_prb": holder_is("prb", "status", 1),
        "unaffected_sib": F.col("sib_unaff") > 0,
        "male_prb": holder_is("prb", "sex", 1),
        "female_prb": holder_is("prb", "sex", 2),
        "missing_mom": F.col("mom").isNull(),
        "missing_dad": F.col("dad").isNull(),
    }
    return joined.select(
        "family_id", *[tags[name].alias(f"tag_{name}_family") for name in TAGS], "tag_family_type_full")


def member_type(set_id: Column | None = None) -> Column:
    """``[set.]role.sex.status`` of one person."""
    parts = [] if set_id is None else [set_id]
    parts += [
        codes.decode(codes.ROLES, F.col("role"), "unknown"),
        codes.decode(codes.SEXES, F.col("sex")), codes.decode(codes.STATUSES, F.col("status"))]
    return F.concat_ws(".", *parts)


def family_type_text(member: Column, separator: str = ":") -> Column:
    """Aggregate: family size and its members' types ordered by role and sex."""
    order = F.concat_ws(
        ".", codes.decode(codes.ROLES, F.col("role"), "unknown"), codes.decode(codes.SEXES, F.col("sex")))
    item = F.struct(order.alias("k"), F.col("member_index").alias("i"), member_type().alias("t"))
    items = F.array_sort(F.collect_list(F.when(member, item)))
    return F.concat_ws(
        separator, F.size(items).cast("string"), F.array_join(F.transform(items, lambda x: x["t"]), separator))


def tag_condition(
    selected: list[str] | None, deselected: list[str] | None, or_mode: bool = False,
) -> Column | None:
    """Selected tags must be set and deselected ones unset; ``or_mode`` needs only one of all."""
    wanted = [F.col(t) for t in selected or []] + [~F.col(t) for t in deselected or []]
    if not wanted:
        return None
    return reduce((lambda a, b: a | b) if or_mode else (lambda a, b: a & b), wanted)


def tagged_family_ids(
    tags: DataFrame, selected: list[str] | None, deselected: list[str] | None, or_mode: bool = False,
) -> DataFrame:
    """Ids of the families that satisfy a tag selection."""
    condition = tag_condition(selected, deselected, or_mode)
    return (tags if condition is None else tags.filter(condition)).select("family_id").distinct()


# ---- roles ----------------------------------------------------------------------------------

def _parent_known(base: DataFrame) -> DataFrame:
    """Adds ``with_parent``: a parent is listed in the family, as member or not."""
    listed = base.select(F.col("family_id").alias("_f"), F.col("person_id").alias("_p"))
    for parent in ("mom_id", "dad_id"):
        base = base.join(
            listed.select(F.col("_f").alias(f"_f_{parent}"), F.col("_p").alias(f"_p_{parent}")),
            (F.col("family_id") == F.col(f"_f_{parent}")) & (F.col(parent) == F.col(f"_p_{parent}")), "left")
    known = F.col("_p_mom_id").isNotNull() | F.col("_p_dad_id").isNotNull()
    return base.withColumn("with_parent", known).drop(
        *[f"_{k}_{p}" for k in ("f", "p") for p in ("mom_id", "dad_id")])


def _proband_context(people: DataFrame) -> DataFrame:
    """Per family: the proband, its parents and their parents.

    The proband is the first member with that role, else the first flagged person, else the first
    affected member with a parent.
    """
    who = F.struct("member_index", "person_id", "mom_id", "dad_id", "with_parent")
    chosen = people.groupBy("family_id").agg(F.coalesce(
        F.min(F.when(~F.col("missing") & (F.col("role") == ROLE["prb"]), who)),
        F.min(F.when(F.col("flagged"), who)),
        F.min(F.when(
            ~F.col("missing") & (F.col("status") == 2) & F.col("with_parent"), who))).alias("b"))
    proband = chosen.filter("b IS NOT NULL").select(
        "family_id", F.col("b.person_id").alias("pb"), F.col("b.mom_id").alias("pb_mom"),
        F.col("b.dad_id").alias("pb_dad"), F.col("b.with_parent").alias("pb_has_parent"))
    # both parents' own parents from one grouping over the family's persons
    parent = F.struct("person_id", "mom_id", "dad_id", "sex", "with_parent")
    joined = people.join(proband, "family_id")
    parents = joined.groupBy("family_id").agg(
        F.min(F.when(F.col("person_id") == F.col("pb_mom"), parent)).alias("pm"),
        F.min(F.when(F.col("person_id") == F.col("pb_dad"), parent)).alias("pd"))
    return proband.join(parents, "family_id")


def _children_of(people: DataFrame, parents: DataFrame, name: str) -> DataFrame:
    """Marks persons with a parent in ``parents(family_id, person_id)``."""
    for i, parent in enumerate(("mom_id", "dad_id")):
        keys = parents.select(F.col("family_id").alias(f"_kf{i}"), F.col("person_id").alias(f"_kp{i}"))
        people = people.join(
            keys, (F.col("family_id") == F.col(f"_kf{i}")) & (F.col(parent) == F.col(f"_kp{i}")), "left")
    marked = people.withColumn(name, F.col("_kp0").isNotNull() | F.col("_kp1").isNotNull())
    return marked.drop("_kf0", "_kp0", "_kf1", "_kp1")


def infer_roles(ped: DataFrame) -> DataFrame:
    """Adds ``inferred_role``, the relation of each person to the family's proband.

    Relations carry an order and the latest one of a person wins. Relations that follow from the
    proband's own parent ids are assigned in one pass over the persons; uncles and aunts, who must
    have no earlier role, and then their children follow. ``proband`` may be an optional boolean
    column.
    """
    flag = F.col("proband") if "proband" in ped.columns else F.lit(False)
    base = _parent_known(ped.select(
        "family_id", "person_id", "mom_id", "dad_id", "sex", "status", "role", "member_index",
        is_missing().alias("missing"), F.coalesce(flag, F.lit(False)).alias("flagged")))
    people = base.join(_proband_context(base), "family_id")
    person, mom, dad, pb = F.col("person_id"), F.col("mom_id"), F.col("dad_id"), F.col("pb")
    pm, pd = F.col("pm"), F.col("pd")
    pm_parent, pd_parent = F.coalesce(pm["with_parent"], F.lit(False)), F.coalesce(pd["with_parent"], F.lit(False))
    pb_parent = F.col("pb_has_parent")

    def same_parents(m: Column, d: Column) -> Column:
        return F.col("with_parent") & mom.eqNullSafe(m) & dad.eqNullSafe(d)

    def half(parent: Column, other: Column, proband_other: Column) -> Column:
        """Child of the proband's parent with somebody else."""
        own = F.when(parent["sex"] == 1, dad).otherwise(mom)
        return (
            pb_parent & F.col("with_parent") & (own == parent["person_id"])
            & other.isNotNull() & ~other.eqNullSafe(proband_other))

    def assign(condition: Column, target: Column, order: int, role: str) -> Column:
        return F.when(condition & target.isNotNull(), F.struct(
            target.alias("target"), F.lit(order).alias("ord"), F.lit(ROLE[role]).alias("role")))

    proband_child = F.col("with_parent") & (mom.eqNullSafe(pb) | dad.eqNullSafe(pb))
    spouse = F.when(dad.isNotNull() & (dad != pb), dad).when(mom.isNotNull() & (mom != pb), mom)
    maternal_half = half(pm, dad, F.col("pb_dad"))
    paternal_half = half(pd, mom, F.col("pb_mom"))
    assigned = F.array_compact(F.array(
        assign(person == pb, person, 0, "prb"),
        assign(proband_child, person, 1, "child"),
        assign(proband_child, spouse, 2, "spouse"),
        assign(pb_parent & (person == F.col("pb_mom")), person, 3, "mom"),
        assign(pb_parent & (person == F.col("pb_dad")), person, 3, "dad"),
        assign(pb_parent & (person != pb) & same_parents(F.col("pb_mom"), F.col("pb_dad")), person, 4, "sib"),
        assign(pd_parent & (person == pd["dad_id"]), person, 5, "paternal_grandfather"),
        assign(pd_parent & (person == pd["mom_id"]), person, 5, "paternal_grandmother"),
        assign(pm_parent & (person == pm["dad_id"]), person, 8, "maternal_grandfather"),
        assign(pm_parent & (person == pm["mom_id"]), person, 8, "maternal_grandmother"),
        assign(maternal_half, dad, 11, "step_dad"),
        assign(maternal_half, person, 12, "maternal_half_sibling"),
        assign(paternal_half, mom, 13, "step_mom"),
        assign(paternal_half, person, 14, "paternal_half_sibling")))
    direct = (
        people.select("family_id", F.explode(assigned).alias("a"))
        .groupBy("family_id", F.col("a.target").alias("person_id"))
        .agg(F.min("a.ord").alias("first_ord"), F.max(F.struct("a.ord", "a.role")).alias("last")))
    unset = F.col("role").isNull() | (F.col("role") == ROLE["unknown"])
    related = people.select(
        "family_id", "person_id", "mom_id", "dad_id", "sex", unset.alias("unset"),
        (pd_parent & same_parents(pd["mom_id"], pd["dad_id"])).alias("pat_sib"),
        (pm_parent & same_parents(pm["mom_id"], pm["dad_id"])).alias("mat_sib"),
    ).join(direct, ["family_id", "person_id"], "left")

    def taken(order: int) -> Column:
        return F.coalesce(F.col("first_ord") <= order, F.lit(False))

    related = related.withColumn("pat_uncle", F.col("pat_sib") & F.col("unset") & ~taken(5))
    related = _children_of(related, related.filter("pat_uncle").select("family_id", "person_id"), "pat_cousin")
    named = F.col("pat_uncle") & F.col("sex").isin(1, 2)
    related = related.withColumn(
        "mat_uncle", F.col("mat_sib") & F.col("unset") & ~taken(8) & ~named & ~F.col("pat_cousin"))
    related = _children_of(related, related.filter("mat_uncle").select("family_id", "person_id"), "mat_cousin")

    def relation(condition: str, order: int, role: Column) -> Column:
        return F.when(F.col(condition) & role.isNotNull(), F.struct(F.lit(order).alias("ord"), role.alias("role")))

    def by_sex(word: str) -> Column:
        return F.when(F.col("sex") == 1, ROLE[f"{word}_uncle"]).when(F.col("sex") == 2, ROLE[f"{word}_aunt"])

    latest = F.array_max(F.array_compact(F.array(
        F.col("last"),
        relation("pat_uncle", 6, by_sex("paternal")), relation("pat_cousin", 7, F.lit(ROLE["paternal_cousin"])),
        relation("mat_uncle", 9, by_sex("maternal")), relation("mat_cousin", 10, F.lit(ROLE["maternal_cousin"])))))
    final = related.select("family_id", "person_id", latest["role"].alias("assigned"))
    return ped.join(final, ["family_id", "person_id"], "left").withColumn(
        "inferred_role", F.coalesce("assigned", "role", F.lit(ROLE["unknown"]))).drop("assigned")


# ---- merging and quality --------------------------------------------------------------------

def combine_families(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two pedigrees; conflicting persons are settled by specificity.

    Missing persons yield to the other side, then unspecified sex, status and role do; any
    remaining disagreement is won by the second pedigree.
    """
    fields = [c for c in first.columns if c in second.columns and c not in ("family_id", "person_id")]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "family_id", "person_id", F.struct(is_missing().alias("missing"), *fields).alias(name))

    l, r = F.col("l"), F.col("r")

    def agree(field: str, vague: int) -> Column:
        return (l[field] == r[field]) | (l[field] == vague) | (r[field] == vague)

    unknown = ROLE["unknown"]
    match = agree("sex", 4) & agree("status", 4) & agree("role", unknown)
    take_right = (
        F.when(l.isNull(), True).when(r.isNull(), False)
        .when(l["missing"], True).when(r["missing"], False)
        .when(~match, True)
        .when(l["sex"] == 4, True).when(r["sex"] == 4, False)
        .when(l["status"] == 4, True).when(r["status"] == 4, False)
        .when(l["role"] == unknown, True).when(r["role"] == unknown, False)
        .otherwise(True))
    merged = side(first, "l").join(side(second, "r"), ["family_id", "person_id"], "full")
    return merged.withColumn("w", F.when(take_right, r).otherwise(l)).select(
        "family_id", "person_id", *[F.col(f"w.{f}").alias(f) for f in fields])


def conflicting_definitions(ped: DataFrame) -> DataFrame:
    """Persons defined more than once in a family with different attributes."""
    definition = F.struct("mom_id", "dad_id", "sex", "status", "role")
    return (
        members(ped).groupBy("family_id", "person_id")
        .agg(F.count_distinct(definition).alias("definitions"))
        .filter("definitions > 1"))


def broken_families(ped: DataFrame) -> DataFrame:
    """Families without any member."""
    return (
        ped.groupBy("family_id").agg(F.bool_and(is_missing()).alias("empty"))
        .filter("empty").select("family_id"))


def persons_in_several_families(ped: DataFrame) -> DataFrame:
    return (
        ped.groupBy("person_id").agg(F.count_distinct("family_id").alias("families"))
        .filter("families > 1"))


def families_of_persons(ped: DataFrame, person_ids: DataFrame) -> DataFrame:
    return ped.join(person_ids, "person_id", "left_semi").select("family_id").distinct()


def match_samples(ped: DataFrame, samples: DataFrame, fixed: bool = True) -> DataFrame:
    """Mark pedigree persons without a sample as not sequenced, unless the pedigree is fixed."""
    if fixed:
        return ped
    found = samples.select(F.col("sample_id").alias("_s")).distinct()
    unmatched = F.col("_s").isNull() & ~F.coalesce(F.col("generated"), F.lit(False))
    return (
        ped.join(found, F.col("sample_id") == F.col("_s"), "left")
        .withColumn("not_sequenced", F.coalesce(F.col("not_sequenced"), F.lit(False)) | unmatched)
        .drop("_s"))


def combine_not_sequenced(batches: list[DataFrame], union: bool = False) -> DataFrame:
    """``not_sequenced`` over pedigrees of several batches.

    The intersection keeps a person not sequenced only when every batch misses it; the union when
    any batch does.
    """
    stacked = reduce(DataFrame.unionByName, batches)
    rest = [c for c in stacked.columns if c not in ("family_id", "person_id", "not_sequenced")]
    flag = F.coalesce(F.col("not_sequenced"), F.lit(False))
    return stacked.groupBy("family_id", "person_id").agg(
        (F.bool_or(flag) if union else F.bool_and(flag)).alias("not_sequenced"),
        *[F.min(c).alias(c) for c in rest])


def without_families(df: DataFrame, family_ids: DataFrame) -> DataFrame:
    """Rows of withdrawn families removed; any table with a ``family_id``."""
    return df.join(family_ids.select("family_id"), "family_id", "left_anti")


def without_persons(df: DataFrame, ped: DataFrame, family_ids: DataFrame) -> DataFrame:
    """Instrument rows of persons of withdrawn families removed; persons kept in another family stay."""
    gone = ped.join(family_ids, "family_id", "left_semi").select("person_id")
    kept = ped.join(family_ids, "family_id", "left_anti").select("person_id")
    return df.join(gone.join(kept, "person_id", "left_anti"), "person_id", "left_anti")


def persons_in_scope(
    ped: DataFrame, roles: list[str] | None = None, family_ids: DataFrame | None = None,
) -> DataFrame:
    """Member person ids with one of the roles (probands by default)."""
    rows = members(ped).filter(F.col("role").isin([ROLE[r] for r in roles or ["prb"]]))
    if family_ids is not None:
        rows = rows.join(family_ids, "family_id", "left_semi")
    return rows.select("person_id").distinct()


def family_details(ped: DataFrame) -> DataFrame:
    """One row per family with its members' details."""
    return ped.groupBy("family_id").agg(F.array_sort(F.collect_list(F.struct(
        "member_index", "person_id", "mom_id", "dad_id", "sex", "status", "role"))).alias("members"))
