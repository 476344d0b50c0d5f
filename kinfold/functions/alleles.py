"""Allele columns: type, short notation, tandem repeats, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions import codes

SUB, INS, DEL, COMP = 1, 2, 4, 8
CNV_DEL, CNV_DUP, REPEAT = 16, 32, 64


def common_prefix(left: Column, right: Column, limit: Column) -> Column:
    """Length of the longest shared prefix, at most ``limit``."""
    steps = F.sequence(F.lit(0), F.greatest(limit, F.lit(0)))
    return F.size(F.filter(
        steps,
        lambda n: (n > 0) & (F.substring(left, F.lit(1), n) == F.substring(right, F.lit(1), n))))


def common_suffix(left: Column, right: Column, limit: Column) -> Column:
    return common_prefix(F.reverse(left), F.reverse(right), limit)


def _trimmed(ref: Column, alt: Column, keep: int, use) -> Column:
    """``use(struct(shift, ref, alt))`` after the shared suffix and then the shared prefix are cut.

    ``keep`` bases always stay.
    """
    tail = common_suffix(ref, alt, F.least(F.length(ref), F.length(alt)) - keep)

    def cut_head(cut: Column) -> Column:
        head = common_prefix(cut["r"], cut["a"], F.least(F.length(cut["r"]), F.length(cut["a"])) - keep)
        return codes.bind(head, lambda h: F.struct(
            h.alias("shift"), F.substring(cut["r"], h + 1, F.length(cut["r"])).alias("ref"),
            F.substring(cut["a"], h + 1, F.length(cut["a"])).alias("alt")))

    without_tail = codes.bind(tail, lambda t: F.struct(
        F.substring(ref, F.lit(1), F.length(ref) - t).alias("r"),
        F.substring(alt, F.lit(1), F.length(alt) - t).alias("a")))
    return codes.bind(codes.bind(without_tail, cut_head), use)


def allele_type(ref: Column, alt: Column) -> Column:
    """Type flag of an allele after trimming both sides down to one base at least."""
    def kind(t: Column) -> Column:
        r, a = t["ref"], t["alt"]
        same_start = F.substring(r, 1, 1) == F.substring(a, 1, 1)
        return (
            F.when((F.length(r) == 1) & (F.length(a) == 1), SUB)
            .when((F.length(r) == 1) & (F.length(a) > 1) & same_start, INS)
            .when((F.length(r) > 1) & (F.length(a) == 1) & same_start, DEL)
            .otherwise(COMP))
    return F.when(F.coalesce(F.length(alt), F.lit(0)) == 0, 0).otherwise(_trimmed(ref, alt, 1, kind))


def end_position(pos: Column, ref: Column, alt: Column) -> Column:
    return F.when(F.coalesce(F.length(alt), F.lit(0)) == 0, pos).otherwise(pos + F.length(ref) - 1)


def tandem_repeat(ref: Column, alt: Column, min_mono_reference: int = 8) -> Column:
    """``struct(unit, ref_repeats, alt_repeats)`` or NULL when the pair is no tandem repeat."""
    n_ref, n_alt = F.length(ref), F.length(alt)

    def fits(period: Column) -> Column:
        unit = F.substring(ref, F.lit(1), period)
        return (
            (period * 2 <= n_ref) & (n_ref % period == 0) & (n_alt % period == 0)
            & (F.repeat(unit, (n_ref / period).cast("int")) == ref)
            & (F.repeat(unit, (n_alt / period).cast("int")) == alt))

    periods = F.sequence(F.lit(1), F.greatest(F.lit(1), (n_ref / 2).cast("int")))
    return codes.bind(F.get(F.filter(periods, fits), F.lit(0)), lambda period: F.when(
        period.isNotNull() & ~((period == 1) & (n_ref < min_mono_reference)),
        F.struct(
            F.substring(ref, F.lit(1), period).alias("unit"),
            (n_ref / period).cast("int").alias("ref_repeats"),
            (n_alt / period).cast("int").alias("alt_repeats"))))


def variant_description(pos: Column, ref: Column, alt: Column, cnv_type: Column | None = None) -> Column:
    """Short notation of an allele with its parts.

    Fields: ``variant_type, position, ref, alt, length, tr_unit, tr_ref, tr_alt``. ``cnv_type`` is
    the type flag of copy-number rows, which carry no sequence.
    """
    is_cnv = F.lit(False) if cnv_type is None else F.coalesce(
        cnv_type.bitwiseAND(CNV_DEL | CNV_DUP) != 0, F.lit(False))
    given = F.lit(0) if cnv_type is None else cnv_type

    def describe(t: Column) -> Column:
        r, a, repeat = t["t"]["ref"], t["t"]["alt"], t["repeat"]
        n_r, n_a = F.length(r), F.length(a)
        kind = (
            F.when((n_r == 0) & (n_a == 0), COMP)
            .when((n_r == 1) & (n_a == 1), SUB)
            .when((n_r > 0) & (n_a == 0), DEL)
            .when((n_r == 0) & (n_a > 0), INS)
            .otherwise(COMP))
        flagged = kind.bitwiseOR(F.when(repeat.isNotNull(), F.lit(REPEAT)).otherwise(F.lit(0)))
        return F.struct(
            F.when(is_cnv, given).otherwise(flagged).alias("variant_type"),
            F.when(is_cnv, pos).otherwise(pos + t["t"]["shift"]).alias("position"),
            F.when(kind.isin(SUB, COMP), r).alias("ref"),
            F.when(kind.isin(SUB, COMP, INS), a).alias("alt"),
            F.greatest(n_r, n_a).alias("length"),
            repeat["unit"].alias("tr_unit"),
            repeat["ref_repeats"].alias("tr_ref"),
            repeat["alt_repeats"].alias("tr_alt"))

    parts = F.struct(
        _trimmed(ref, alt, 0, lambda t: t).alias("t"), tandem_repeat(ref, alt).alias("repeat"))
    return codes.bind(parts, describe)


def short_notation(desc: Column) -> Column:
    """``sub(A->C)``, ``ins(X)``, ``del(n)``, ``comp(..)``, ``CNV+`` or ``CNV-``."""
    kind = desc["variant_type"]

    def has(flag: int) -> Column:
        return kind.bitwiseAND(flag) != 0

    arrow = F.concat(desc["ref"], F.lit("->"), desc["alt"], F.lit(")"))
    return (
        F.when(has(SUB), F.concat(F.lit("sub("), arrow))
        .when(has(INS), F.concat(F.lit("ins("), desc["alt"], F.lit(")")))
        .when(has(DEL), F.concat(F.lit("del("), desc["length"].cast("string"), F.lit(")")))
        .when(has(COMP), F.concat(F.lit("comp("), arrow))
        .when(has(CNV_DUP), "CNV+")
        .when(has(CNV_DEL), "CNV-"))


def full_notation(desc: Column) -> Column:
    """Short notation with tandem repeats written as ``TR(3xAC->4)``."""
    return F.when(
        desc["variant_type"].bitwiseAND(REPEAT) != 0,
        F.concat(
            F.lit("TR("), desc["tr_ref"].cast("string"), F.lit("x"), desc["tr_unit"], F.lit("->"),
            desc["tr_alt"].cast("string"), F.lit(")")),
    ).otherwise(short_notation(desc))


def combined_notation(descs: Column) -> Column:
    """Array of notations for the alleles of one variant, merged where the alleles agree in type.

    ``descs`` is an array of descriptions ordered by allele index.
    """
    first, last = F.get(descs, F.lit(0)), F.element_at(descs, -1)
    all_repeats = F.forall(descs, lambda d: d["variant_type"].bitwiseAND(REPEAT) != 0)
    all_same = F.forall(descs, lambda d: d["variant_type"] == first["variant_type"])
    repeat_text = F.concat(
        F.lit("TR("), first["tr_ref"].cast("string"), F.lit("x"), first["tr_unit"], F.lit("->"),
        F.array_join(F.transform(descs, lambda d: d["tr_alt"].cast("string")), ","), F.lit(")"))
    merged = F.struct(
        first["variant_type"].bitwiseAND(~REPEAT).alias("variant_type"),
        first["ref"].alias("ref"),
        F.array_join(F.transform(descs, lambda d: d["alt"]), ",").alias("alt"),
        last["length"].alias("length"))
    return (
        F.when(all_repeats, F.array(repeat_text))
        .when(all_same, F.array(short_notation(merged)))
        .otherwise(F.transform(descs, short_notation)))


def type_from_name(name: Column) -> Column:
    """Type flag of a type word; unknown words give NULL."""
    return codes.lookup(codes.ALLELE_TYPE_WORDS, name, None)


def type_from_notation(text: Column) -> Column:
    """Type flag of a short notation. ``CNV-`` is a deletion."""
    start = F.substring(text, 1, 2)
    return (
        F.when(start == "su", SUB).when(start == "in", INS).when(start == "de", DEL)
        .when(start == "co", COMP).when(start == "TR", REPEAT)
        .when(text == "CNV+", CNV_DUP).when(text == "CNV-", CNV_DEL))


def location(chrom: Column, pos: Column, end: Column | None = None, variant_type: Column | None = None) -> Column:
    """``chrom:pos``, or ``chrom:pos-end`` for copy-number alleles."""
    point = F.concat(chrom, F.lit(":"), pos.cast("string"))
    if end is None or variant_type is None:
        return point
    is_cnv = F.coalesce(variant_type.bitwiseAND(CNV_DEL | CNV_DUP) != 0, F.lit(False))
    return F.when(is_cnv, F.concat(point, F.lit("-"), end.cast("string"))).otherwise(point)


def svuid(where: Column, ref: Column, alt: Column, transmission: Column) -> Column:
    """Identity of a summary variant over studies."""
    none = F.lit("None")
    return F.concat_ws(
        ".", where, F.coalesce(ref, none), F.coalesce(alt, none), transmission.cast("string"))


def fvuid(family: Column, where: Column, ref: Column, alt: Column) -> Column:
    """Identity of a family variant over studies."""
    none = F.lit("None")
    return F.concat_ws(".", family, where, F.coalesce(ref, none), F.coalesce(alt, none))


def notation_to_vcf(pos: Column, text: Column, base_before: Column | None = None) -> Column:
    """``struct(position, reference, alternative)`` of a short notation.

    Insertions and deletions need the base before the event; it comes from ``base_before`` (a
    column of the site, normally joined from a reference-sequence table). Deletions also need the
    deleted bases, so ``base_before`` then holds the whole ``1 + n`` base stretch.
    """
    sub = F.regexp_extract(text, r"^(?:sub|comp)\(([ACGTNacgtn]*)->([ACGTNacgtn]*)\)$", 1)
    sub_alt = F.regexp_extract(text, r"^(?:sub|comp)\(([ACGTNacgtn]*)->([ACGTNacgtn]*)\)$", 2)
    inserted = F.regexp_extract(text, r"^ins\(([ACGTNacgtn]+)\)$", 1)
    deleted = F.regexp_extract(text, r"^del\((\d+)\)$", 1).try_cast("int")
    before = base_before if base_before is not None else F.lit(None).cast("string")
    first = F.substring(before, 1, 1)
    return (
        F.when(sub != "", F.struct(
            pos.cast("int").alias("position"), sub.alias("reference"), sub_alt.alias("alternative")))
        .when((inserted != "") & before.isNotNull(), F.struct(
            (pos - 1).cast("int").alias("position"), first.alias("reference"),
            F.concat(first, inserted).alias("alternative")))
        .when(deleted.isNotNull() & (F.length(before) == deleted + 1), F.struct(
            (pos - 1).cast("int").alias("position"), before.alias("reference"),
            first.alias("alternative"))))


def worst_effect(effect_gene: Column) -> Column:
    """Most severe effect type of an allele."""
    ranks = F.array(*[F.lit(e) for e in codes.EFFECT_SEVERITY])
    present = F.transform(effect_gene, lambda g: g["effect_types"])
    return F.coalesce(
        F.get(F.filter(ranks, lambda e: F.array_contains(present, e)), F.lit(0)),
        F.get(present, F.lit(0)))


def genes_of_worst(effect_gene: Column) -> Column:
    """Genes hit by the most severe effect, joined with ``;``."""
    worst = worst_effect(effect_gene)
    hits = F.filter(effect_gene, lambda g: g["effect_types"] == worst)
    return F.array_join(F.array_distinct(F.transform(hits, lambda g: g["effect_gene_symbols"])), ";")


def genes(effect_gene: Column) -> Column:
    """All genes of an allele, distinct, in order."""
    return F.array_distinct(F.filter(
        F.transform(effect_gene, lambda g: g["effect_gene_symbols"]), lambda s: s.isNotNull()))
