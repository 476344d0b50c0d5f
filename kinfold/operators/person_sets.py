"""Person sets: a categorical partition of persons, such as by diagnosis."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import codes
from kinfold.operators import pedigree


@dataclass(frozen=True)
class PersonSet:
    id: str
    name: str
    values: tuple[str, ...]
    color: str = "#ffffff"


@dataclass(frozen=True)
class Collection:
    """``sources`` are ``(from, column)`` pairs, ``from`` being ``pedigree`` or ``phenotype``."""

    id: str
    name: str
    sources: tuple[tuple[str, str], ...]
    domain: tuple[PersonSet, ...]
    default: PersonSet

    @property
    def set_ids(self) -> list[str]:
        return [s.id for s in self.domain] + [self.default.id]


def _source_text(source: tuple[str, str]) -> Column:
    """Source value as the text used in collection configurations."""
    origin, name = source
    if origin == "phenotype":
        return F.col(f"`{name}`").cast("string")
    decoders = {"sex": codes.SEXES, "status": codes.STATUSES, "role": codes.ROLES}
    if name in decoders:
        return codes.decode(decoders[name], F.col(name))
    return F.col(name).cast("string")


def assign(ped: DataFrame, collection: Collection, measures: DataFrame | None = None) -> DataFrame:
    """Long table ``(psc_id, set_id, family_id, person_id, sex, status, role, is_child)``.

    Every real person falls into exactly one set; the domain is a short configuration, so the
    choice is a CASE expression and not a join.
    """
    real = pedigree.with_parent_flags(ped).filter("NOT missing")
    if measures is not None:
        real = real.join(measures, "person_id", "left")
    values = [_source_text(s) for s in collection.sources]
    chosen = F.lit(collection.default.id)
    for person_set in reversed(collection.domain):
        hit = reduce(lambda a, b: a & b, [v.eqNullSafe(F.lit(w)) for v, w in zip(values, person_set.values)])
        chosen = F.when(hit, F.lit(person_set.id)).otherwise(chosen)
    return real.select(
        F.lit(collection.id).alias("psc_id"), chosen.alias("set_id"),
        "family_id", "person_id", "sex", "status", "role", "is_child")


def combine(collections: list[DataFrame], ped: DataFrame, psc_id: str, default_id: str) -> DataFrame:
    """Sets over several studies: the first study that knows a person decides."""
    ranked = reduce(DataFrame.unionByName, [
        df.select("set_id", "family_id", "person_id", F.lit(i).alias("ord"))
        for i, df in enumerate(collections)])
    first = ranked.groupBy("family_id", "person_id").agg(F.min(F.struct("ord", "set_id")).alias("w"))
    real = pedigree.members(ped).select("family_id", "person_id")
    return (
        real.join(first, ["family_id", "person_id"], "left")
        .select(
            F.lit(psc_id).alias("psc_id"),
            F.coalesce("w.set_id", F.lit(default_id)).alias("set_id"), "family_id", "person_id"))


def children_by_sex(sets: DataFrame) -> DataFrame:
    """Children of each set by sex, with the total; sets without children show zeros."""
    def count(code: int) -> Column:
        return F.count(F.when(F.col("is_child") & (F.col("sex") == code), 1))
    return sets.groupBy("psc_id", "set_id").agg(
        count(1).alias("male"), count(2).alias("female"), count(4).alias("unspecified"),
        F.count(F.when(F.col("is_child"), 1)).alias("total"))


def stats(sets: DataFrame) -> DataFrame:
    """Parents (always 0) and children of each set."""
    return sets.groupBy("psc_id", "set_id").agg(
        F.lit(0).cast("long").alias("parents"), F.count(F.when(F.col("is_child"), 1)).alias("children"))


def selected_persons(sets: DataFrame, set_ids: list[str]) -> DataFrame:
    """Persons of the selected sets."""
    return sets.filter(F.col("set_id").isin(list(set_ids))).select("family_id", "person_id").distinct()


def attribute_queries(
    collection: Collection, set_ids: list[str], default_empty: bool = False,
) -> dict[str, str] | None:
    """Selection over sex, role or status as flag expressions; None when it needs person ids.

    ``default_empty`` tells that the default set holds nobody, so selecting the whole domain
    filters nothing.
    """
    arguments = {"sex": "sexes", "role": "roles", "status": "affected_statuses"}
    if any(origin != "pedigree" or name not in arguments for origin, name in collection.sources):
        return None
    if collection.default.id in set_ids:
        return None
    chosen = [s for s in collection.domain if s.id in set_ids]
    if not chosen:
        raise ValueError("no selected set belongs to the collection")
    if len(chosen) == len(collection.domain) and default_empty:
        return {}
    by_field: dict[str, set[str]] = {}
    for person_set in chosen:
        for (_, name), value in zip(collection.sources, person_set.values):
            by_field.setdefault(name, set()).add(value)
    if len(by_field) > 1 and sum(len(v) > 1 for v in by_field.values()) > 1:
        return None
    return {arguments[n]: f"any([{','.join(sorted(v))}])" for n, v in by_field.items()}
