"""Genotype algebra on the member array of a family.

A family genotype is ``array<struct<person_id, sex, status, role, role_bit, sex_bit, status_bit,
mom_ix, dad_ix, founder, a1, a2>>`` ordered by member index. ``a1``/``a2`` are allele indexes, -1
unknown, -2 the filler of a haploid call. ``mom_ix``/``dad_ix`` are 1-based positions in the same
array, 0 when the parent is not a member. Everything stays in one row, so no operator here
shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions import codes

MENDELIAN = codes.INHERITANCE["mendelian"]
DENOVO = codes.INHERITANCE["denovo"]
POSSIBLE_DENOVO = codes.INHERITANCE["possible_denovo"]
OMISSION = codes.INHERITANCE["omission"]
POSSIBLE_OMISSION = codes.INHERITANCE["possible_omission"]
OTHER = codes.INHERITANCE["other"]
MISSING = codes.INHERITANCE["missing"]
UNKNOWN = codes.INHERITANCE["unknown"]
#: Families of up to so many members are worked out place by place, which Spark compiles. Functions over the array are interpreted
#: and are left to larger families.
PLACES = 4


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def carries(call: Column, allele: Column | int) -> Column:
    """The call has the allele on either copy."""
    return (call["a1"] == allele) | (call["a2"] == allele)


def is_unknown(call: Column) -> Column:
    return (call["a1"] == codes.UNKNOWN_CALL) | (call["a2"] == codes.UNKNOWN_CALL)


def mendelian_trio(child: Column, mom: Column, dad: Column, allele: Column | int) -> Column:
    """The child's allele is present in a parent."""
    return carries(child, allele) & (carries(mom, allele) | carries(dad, allele))


def denovo_trio(child: Column, mom: Column, dad: Column, allele: Column | int) -> Column:
    """The child's allele is present in neither parent."""
    return carries(child, allele) & ~carries(mom, allele) & ~carries(dad, allele)


def omission_trio(child: Column, mom: Column, dad: Column, allele: Column | int) -> Column:
    """A parent is homozygous for the allele and the child lacks it."""
    def homozygous(call: Column) -> Column:
        return (call["a1"] == allele) & (call["a2"] == allele)
    return ~carries(child, allele) & (homozygous(mom) | homozygous(dad))


def trio_inheritance(child: Column, mom: Column, dad: Column, allele: Column | int) -> Column:
    """First of mendelian, de novo, omission, other."""
    return (
        F.when(mendelian_trio(child, mom, dad, allele), MENDELIAN)
        .when(denovo_trio(child, mom, dad, allele), DENOVO)
        .when(omission_trio(child, mom, dad, allele), OMISSION)
        .otherwise(OTHER))


def member_inheritance(child: Column, mom: Column, dad: Column, allele: Column | int) -> Column:
    """Inheritance class of one member; parents that are no members are NULL structs.

    A member without the allele is an omission when a parent is homozygous for it, else missing.
    """
    return (
        F.when(mom.isNull() | dad.isNull(), UNKNOWN)
        .when(is_unknown(child) | is_unknown(mom) | is_unknown(dad), UNKNOWN)
        .when(mendelian_trio(child, mom, dad, allele), MENDELIAN)
        .when(carries(child, allele), DENOVO)
        .when(omission_trio(child, mom, dad, allele), OMISSION)
        .otherwise(MISSING))


class Members:
    """The member fields of a family as columns of their own, so that Catalyst reads and carries only those that are used.

    Takes the place of a member array where fields, members at a place or ``zipped`` fields are asked for.
    """

    PREFIX = "_member_"

    @classmethod
    def columns(cls, members: Column, names: Sequence[str]) -> list[Column]:
        return [members[name].alias(cls.PREFIX + name) for name in names]

    def __getitem__(self, name: str) -> Column:
        return F.col(self.PREFIX + name)

    def at(self, place: int) -> _Place:
        return _Place(self, place)

    def zipped(self, *names: str) -> Column:
        return F.arrays_zip(*[self[name].alias(name) for name in names])


@dataclass(frozen=True)
class _Place:
    """The member at a place, all fields NULL beyond the family."""

    members: Members
    place: int

    def __getitem__(self, name: str) -> Column:
        return F.get(self.members[name], F.lit(self.place))


def is_small(values: Column) -> Column:
    return F.size(values).between(0, PLACES)


def _copies(call: Column, allele: Column | int) -> Column:
    return F.when(~is_unknown(call), (call["a1"] == allele).cast("int") + (call["a2"] == allele).cast("int"))


def copies(members: Members, allele: Column | int) -> Column:
    """0, 1 or 2 copies of the allele by member, NULL when a copy is unknown and at the places beyond a small family."""
    return F.when(is_small(members["a1"]), F.array(*[_copies(members.at(i), allele) for i in range(PLACES)])).otherwise(
        F.transform(members.zipped("a1", "a2"), lambda m: _copies(m, allele)))


def _class(m: Column, own: Column, n: Column) -> Column:
    """Class of a member by its own copies and those of all members."""
    mom, dad = F.get(n, m["mom_ix"] - 1), F.get(n, m["dad_ix"] - 1)
    most = F.greatest(mom, dad)
    return (
        F.when((m["mom_ix"] == 0) | (m["dad_ix"] == 0), UNKNOWN)
        .when((own + mom + dad).isNull(), UNKNOWN)
        .when(own > 0, F.when(most > 0, MENDELIAN).otherwise(DENOVO))
        .when(most == 2, OMISSION)
        .otherwise(MISSING))


def inheritance_by_copies(members: Members, n: Column) -> Column:
    """Inheritance class of every member, in member order, from the column ``n`` of their ``copies``."""
    small = F.slice(F.array(*[_class(members.at(i), F.get(n, F.lit(i)), n) for i in range(PLACES)]), F.lit(1), F.size(members["mom_ix"]))
    return F.when(is_small(members["mom_ix"]), small).otherwise(
        F.transform(members.zipped("mom_ix", "dad_ix"), lambda m, i: _class(m, F.get(n, i), n)))


def inheritance_by_member(members: Column, allele: Column | int) -> Column:
    """Inheritance class of every member, in member order.

    The copy counts of all members (0, 1 or 2 copies of the allele, NULL when a copy is unknown)
    are computed once; each member then looks up its own and its parents' counts.
    """
    counts = F.transform(members, lambda m: _copies(m, allele))
    holder = F.array(F.struct(counts.alias("n")))
    classified = F.transform(holder, lambda h: F.transform(members, lambda m, i: _class(m, F.get(h["n"], i), h["n"])))
    return F.get(classified, F.lit(0))


def apply_denovo_mode(classes: Column, mode: str) -> Column:
    """Rename de-novo classes of transmitted sources; ``ignore`` rows are dropped by the caller."""
    if mode == "denovo" or mode == "ignore":
        return classes
    return F.transform(classes, lambda c: F.when(c == DENOVO, POSSIBLE_DENOVO).otherwise(c))


def apply_omission_mode(classes: Column, mode: str) -> Column:
    if mode == "omission" or mode == "ignore":
        return classes
    return F.transform(classes, lambda c: F.when(c == OMISSION, POSSIBLE_OMISSION).otherwise(c))


def denovo_source_override(members: Column, classes: Column, allele: Column) -> Column:
    """De-novo call sets: carriers with role prb, sib or unknown become de novo."""
    eligible = [codes.ROLES["prb"], codes.ROLES["sib"], codes.ROLES["unknown"]]
    return F.zip_with(members, classes, lambda m, c: F.when(
        carries(m, allele) & m["role"].isin(eligible)
        & c.isin(UNKNOWN, POSSIBLE_DENOVO, POSSIBLE_OMISSION), DENOVO).otherwise(c))


def carriers(members: Column, allele: Column) -> Column:
    """Member structs carrying the allele."""
    return F.filter(members, lambda m: carries(m, allele))


def _either(masks: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), masks)


def bit_or_of(values: Column, kind: str = "int") -> Column:
    """OR of an integer array without NULLs."""
    zero = F.lit(0).cast(kind)
    small = _either([F.coalesce(F.get(values, F.lit(i)).cast(kind), zero) for i in range(PLACES)])
    return F.when(is_small(values), small).otherwise(F.aggregate(values, zero, lambda acc, v: acc.bitwiseOR(v.cast(kind))))


def attribute_mask(carrier_structs: Column, field: str) -> Column:
    """OR of a flag field over the carriers."""
    return F.aggregate(carrier_structs, F.lit(0), lambda acc, m: acc.bitwiseOR(m[field]))


def _zygosity(m: Column, bit_field: str, skip_unspecified: bool) -> Column:
    zygosity = F.when(m["a1"] == m["a2"], F.lit(1)).otherwise(F.lit(2)).cast("long")
    shifted = F.call_function("shiftleft", zygosity, (m[bit_field] * 2).cast("int"))
    if skip_unspecified:
        return F.when(m["status"] == 4, F.lit(0).cast("long")).otherwise(shifted)
    return shifted


def zygosity_by(carrier_structs: Column, bit_field: str, skip_unspecified: bool = False) -> Column:
    """Packed zygosity: two bits per flag value, homozygous 1 and heterozygous 2."""
    return F.aggregate(
        carrier_structs, F.lit(0).cast("long"), lambda acc, m: acc.bitwiseOR(_zygosity(m, bit_field, skip_unspecified)))


def carrier_places(members: Members, allele: Column) -> Column:
    """The carriers of a small family as a mask, one bit per place."""
    return _either([F.when(carries(members.at(i), allele), 1 << i).otherwise(0) for i in range(PLACES)])


@dataclass(frozen=True)
class Carriers:
    """The carriers of an allele: by the column ``places`` of ``carrier_places`` in small families, else by their structs."""

    members: Members
    places: Column
    allele: Column

    def _values(self, field: str, small: Callable[[list[Column]], Column], value: Callable, none: Column, large: Callable[[Column], Column], *others: str) -> Column:
        at = [F.when(self.places.bitwiseAND(1 << i) != 0, value(self.members.at(i))).otherwise(none) for i in range(PLACES)]
        structs = carriers(self.members.zipped("a1", "a2", field, *others), self.allele)
        return F.when(is_small(self.members[field]), small(at)).otherwise(large(structs))

    def person_ids(self) -> Column:
        nobody = F.array().cast("array<string>")
        return self._values("person_id", lambda at: F.concat(*at), lambda m: F.array(m["person_id"]), nobody, lambda structs: structs["person_id"])

    def mask(self, field: str) -> Column:
        """``attribute_mask`` of the carriers."""
        return self._values(field, _either, lambda m: m[field], F.lit(0), lambda structs: attribute_mask(structs, field))

    def zygosity(self, bit_field: str, skip_unspecified: bool = False) -> Column:
        """``zygosity_by`` of the carriers."""
        return self._values(
            bit_field, _either, lambda m: _zygosity(m, bit_field, skip_unspecified), F.lit(0).cast("long"),
            lambda structs: zygosity_by(structs, bit_field, skip_unspecified), *(["status"] if skip_unspecified else []))


def _within(members: Column, low: int, high: int) -> Column:
    """Every copy of every member lies in a range; true for no members."""
    sides = [members["a1"], members["a2"]]
    tests = [(F.array_min(x) >= low) & (F.array_max(x) <= high) for x in sides]
    return F.coalesce(tests[0] & tests[1], F.lit(True))


def _contains(members: Column, code: int) -> Column:
    return F.array_contains(members["a1"], code) | F.array_contains(members["a2"], code)


def all_reference(members: Column) -> Column:
    return _within(members, 0, 0)


def reference_or_unknown(members: Column) -> Column:
    """No copy other than reference or unknown, with a reference copy somewhere."""
    return _within(members, -1, 0) & _contains(members, 0)


def any_unknown(members: Column) -> Column:
    return _contains(members, codes.UNKNOWN_CALL)


def all_unknown(members: Column) -> Column:
    return _within(members, -1, -1)


def alleles_present(members: Column) -> Column:
    """Alternative allele indexes seen in the family, ascending."""
    # set functions are compiled, a filter with its whole argument is interpreted
    others = F.array(*[F.lit(c).cast("int") for c in (0, codes.UNKNOWN_CALL, codes.HAPLOID_FILLER, None)])
    return F.sort_array(F.array_except(F.array_union(members["a1"], members["a2"]), others))


# ---- ploidy and best state ------------------------------------------------------------------

def in_intervals(chrom: Column, pos: Column, intervals: list[tuple[str, int, int]]) -> Column:
    """Membership in a short fixed interval list (pseudo-autosomal regions)."""
    if not intervals:
        return F.lit(False)
    return any_of([(chrom == c) & pos.between(start, stop) for c, start, stop in intervals])


def locus_ploidy(chrom: Column, pos: Column, sex: Column, par: list[tuple[str, int, int]]) -> Column:
    """0, 1 or 2 copies expected at a locus."""
    return (
        F.when((chrom == "Y") & (sex == 2), 0)
        .when(chrom.isin(codes.SEX_CHROMOSOMES) & sex.isin(1, 4) & ~in_intervals(chrom, pos, par), 1)
        .otherwise(2))


def interval_ploidy(
    chrom: Column, start: Column, stop: Column, sex: Column, par: list[tuple[str, int, int]],
) -> Column:
    return F.greatest(locus_ploidy(chrom, start, sex, par), locus_ploidy(chrom, stop, sex, par))


def best_state(members: Column, n_alts: Column, haploid_x: Column | None = None) -> Column:
    """Per member: copies of allele 0, 1, …, n; all -1 when a copy is unknown.

    ``haploid_x`` marks loci where males have one X copy; there a male loses one reference copy,
    or one copy of the allele counted twice.
    """
    def counts(m: Column) -> Column:
        alts = F.transform(
            F.sequence(F.lit(1), n_alts),
            lambda a: (m["a1"] == a).cast("int") + (m["a2"] == a).cast("int"))
        ref = F.lit(2) - F.aggregate(alts, F.lit(0), lambda acc, v: acc + v)
        state = F.concat(F.array(ref), alts)
        if haploid_x is not None:
            first = F.get(state, F.lit(0))
            reduced = F.transform(state, lambda c, i: F.when(
                first.isin(1, 2), F.when(i == 0, c - 1).otherwise(c),
            ).otherwise(F.when(c == 2, c - 1).otherwise(c)))
            state = F.when(haploid_x & (m["sex"] == 1), reduced).otherwise(state)
        return F.when(is_unknown(m), F.transform(state, lambda c: F.lit(-1))).otherwise(state)
    return F.transform(members, counts)


def best_state_text(states: Column, n_alts: Column) -> Column:
    """Rows per allele, columns per member: ``2121/0101``; unknown copies print ``?``."""
    def row(allele: Column) -> Column:
        return F.array_join(F.transform(states, lambda s: F.when(
            F.get(s, allele) < 0, F.lit("?")).otherwise(F.get(s, allele).cast("string"))), "")
    return F.array_join(F.transform(F.sequence(F.lit(0), n_alts), row), "/")


def genotype_text(members: Column) -> Column:
    """``0/1;0/0;./.`` in member order."""
    def copy(value: Column) -> Column:
        return F.when(value < 0, F.lit(".")).otherwise(value.cast("string"))
    # only the two sides are named, so Catalyst shuffles no other field of the members for it
    return F.array_join(F.zip_with(members["a1"], members["a2"], lambda a, b: F.concat(copy(a), F.lit("/"), copy(b))), ";")


def genotype_from_best_state(state: Column) -> Column:
    """Two allele indexes from the copy counts of one member, reference first; a single copy leaves the second side empty.

    Each alternative allele is listed once per copy. The first two of the list are the sides, and reference copies fill the rest.
    """
    listed = F.flatten(F.transform(F.slice(state, F.lit(2), F.size(state)), lambda n, i: F.array_repeat(i + 1, F.greatest(n, F.lit(0)))))
    side = lambda i: F.coalesce(F.get(listed, F.lit(i)), F.lit(0)).cast("int")
    single = F.aggregate(state, F.lit(0), lambda total, n: total + n) == 1
    return F.when(state.isNotNull(), F.struct(
        side(0).alias("a1"), F.when(single, F.lit(codes.HAPLOID_FILLER)).otherwise(side(1)).cast("int").alias("a2")))


def genetic_model(
    chrom: Column, pos: Column, members: Column, par: list[tuple[str, int, int]],
) -> Column:
    """Model of a called family genotype from the diploidy of its males."""
    males = F.filter(members, lambda m: m["sex"] == 1)
    pseudo = in_intervals(chrom, pos, par)
    return (
        F.when(~chrom.isin(codes.X_CHROMOSOMES), codes.GENETIC_MODELS["autosomal"])
        .when(pseudo & F.forall(males, lambda m: m["a2"] != -2), codes.GENETIC_MODELS["pseudo_autosomal"])
        .when(pseudo, codes.GENETIC_MODELS["X_broken"])
        .when(F.exists(males, lambda m: m["a2"] != -2), codes.GENETIC_MODELS["X_broken"])
        .otherwise(codes.GENETIC_MODELS["X"]))


def genetic_model_of_state(
    chrom: Column, pos: Column, members: Column, states: Column, par: list[tuple[str, int, int]],
) -> Column:
    """Model of a family given by best state: compares copy sums with the expected male ploidy."""
    ploidies = F.transform(states, lambda s: F.aggregate(s, F.lit(0), lambda acc, v: acc + v))
    expected = F.when(in_intervals(chrom, pos, par), 2).otherwise(1)
    broken_male = F.exists(
        F.zip_with(members, ploidies, lambda m, p: (m["sex"] == 1) & (p != expected)), lambda b: b)
    return (
        F.when(chrom.isin(codes.X_CHROMOSOMES) & broken_male, codes.GENETIC_MODELS["X_broken"])
        .when(chrom.isin(codes.X_CHROMOSOMES) & (expected == 2), codes.GENETIC_MODELS["pseudo_autosomal"])
        .when(chrom.isin(codes.X_CHROMOSOMES), codes.GENETIC_MODELS["X"])
        .when(F.exists(ploidies, lambda p: p == 1), codes.GENETIC_MODELS["autosomal_broken"])
        .otherwise(codes.GENETIC_MODELS["autosomal"]))


def cnv_state_from_observed(observed: Column, expected: Column, variant_type: Column) -> Column:
    """Copies ``[ref, alt]`` of one member from its observed ploidy."""
    alt = F.when(variant_type == 32, observed - expected).otherwise(expected - observed)
    return F.array((expected - alt).cast("int"), alt.cast("int"))
