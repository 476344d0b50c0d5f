"""Delimited variant tables: de-novo calls, transmitted summaries and copy-number calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import alleles, genotypes
from kinfold.operators import pedigree, variants
from kinfold.sources.vcf import adjusted_chrom

SITE = ["chromosome", "position", "reference", "alternative"]


def read_table(spark: SparkSession, path: str, sep: str = "\t", columns: list[str] | None = None) -> DataFrame:
    """All columns as text."""
    df = spark.read.csv(path, sep=sep, header=columns is None, comment="#" if columns is None else None, enforceSchema=False)
    return df if columns is None else df.toDF(*columns)


def _bucketed(sites: DataFrame, order: list[str], bucket_index: int, transmission: int) -> DataFrame:
    with_bucket = sites.withColumn("bucket_index", F.lit(bucket_index))
    return variants.running_index(with_bucket, "bucket_index", "position", order, "summary_index").withColumn(
        "transmission_type", F.lit(transmission))


def _members_with(
    calls: DataFrame, keys: list[str], ped: DataFrame, par: list[tuple[str, int, int]],
) -> DataFrame:
    """Family genotypes where ``carriers`` holds the persons with the variant.

    Other members are reference; haploid loci put the copy on the first side.
    """
    joined = _with_members(calls, ped)
    has = F.array_contains("carriers", F.col("person_id")).cast("int")
    haploid = genotypes.locus_ploidy(F.col("chromosome"), F.col("position"), F.col("sex"), par) != 2
    return variants.family_calls(
        joined.withColumn("a1", F.when(haploid, has).otherwise(0)).withColumn("a2", F.when(haploid, -2).otherwise(has)), keys)


# ---- de-novo calls --------------------------------------------------------------------------

def judged_rows(
    raw: DataFrame, chrom: str = "chrom", pos: str = "pos", ref: str = "ref", alt: str = "alt",
    location: str | None = None, variant: str | None = None, base_before: DataFrame | None = None,
    prefix: str | None = None, add_prefix: bool = True,
) -> DataFrame:
    """Site columns of a de-novo table next to its other columns.

    Locations may be ``chrom:pos``; variants may be short notations. Insertions and deletions in
    short notation need the reference bases from the base before on, given as ``base_before``
    ``(chromosome, start, bases)`` keyed by that position. ``reason`` says why a site cannot be resolved, and is null where it is.
    """
    if location:
        where = F.split(F.col(location), ":")
        chromosome, position = F.get(where, F.lit(0)), F.get(where, F.lit(1))
    else:
        chromosome, position = F.col(chrom), F.col(pos)
    used = [c for c in (chrom, pos, ref, alt, location, variant) if c in raw.columns]
    rows = raw.select(
        adjusted_chrom(chromosome, prefix, add_prefix).alias("chromosome"), position.try_cast("int").alias("position"),
        *([F.col(variant).alias("_variant")] if variant else [F.col(ref).alias("reference"), F.col(alt).alias("alternative")]),
        *[c for c in raw.columns if c not in used])
    if variant:
        text = F.col("_variant")
        if base_before is not None:
            bases = base_before.select(
                F.col("chromosome").alias("_c"), F.col("start").alias("_s"), F.col("bases").alias("_b"))
            deleted = F.coalesce(F.regexp_extract(text, r"^del\((\d+)\)$", 1).try_cast("int"), F.lit(0))
            rows = rows.join(
                bases, (F.col("chromosome") == F.col("_c")) & (F.col("position") - 1 == F.col("_s")), "left"
            ).withColumn("_before", F.substring(F.col("_b"), F.lit(1), deleted + 1)).drop("_c", "_s", "_b")
        else:
            rows = rows.withColumn("_before", F.lit(None).cast("string"))
        resolved = alleles.notation_to_vcf(F.col("position"), text, F.col("_before"))
        rows = rows.withColumn("_r", resolved).withColumn("position", F.col("_r.position")).withColumn(
            "reference", F.col("_r.reference")).withColumn("alternative", F.col("_r.alternative")).drop("_variant", "_before", "_r")
    return rows.withColumn("reason", F.when(F.col("chromosome").isNull() | (F.col("chromosome") == ""), "no chromosome").when(
        F.col("position").isNull(), "no position").when(F.col("reference").isNull() | F.col("alternative").isNull(), "unreadable alleles"))


def denovo_rows(raw: DataFrame, **layout) -> DataFrame:
    """The rows of ``judged_rows`` whose site is resolved; ``denovo_rejects`` has the others."""
    return judged_rows(raw, **layout).filter("reason IS NULL").drop("reason")


def denovo_rejects(raw: DataFrame, **layout) -> DataFrame:
    """The rows of ``judged_rows`` whose site is not resolved, with the reason."""
    return judged_rows(raw, **layout).filter("reason IS NOT NULL")


def listed_persons(cell: Column) -> Column:
    """Person ids of a cell, separated by ``;`` or ``,``."""
    return F.transform(F.split(cell, "[;,]"), lambda p: F.trim(p))


def _with_members(rows: DataFrame, ped: DataFrame) -> DataFrame:
    """Rows of a family repeated for each member, with the member fields and the member's place."""
    people = variants.persons_of(pedigree.layout(ped))
    return rows.drop("place", *variants.MEMBER_FIELDS).join(people, "family_id")


def listed_carriers(rows: DataFrame, ped: DataFrame, person: str = "person_id", family: str | None = None) -> DataFrame:
    """Rows repeated for each person of the ``person`` cell, with the family and the ``reason`` why it has none.

    A person the pedigree does not know, or not in the family given, has no family; a person of several families has one only if
    the table names it.
    """
    split = rows.withColumn("person_id", F.explode(listed_persons(F.col(person))))
    owners = ped.select("family_id", "person_id").distinct()
    if family is not None:
        named = owners.withColumnsRenamed({"family_id": "_family", "person_id": "_person"})
        found = split.join(named, (F.col(family) == F.col("_family")) & (F.col("person_id") == F.col("_person")), "left")
        return found.withColumn("reason", F.when(F.col("_family").isNull(), "unknown person")).withColumn("family_id", F.col("_family")).drop("_family", "_person")
    one = owners.groupBy("person_id").agg(F.count("*").alias("_families"), F.min("family_id").alias("_family"))
    found = split.drop("family_id").join(one, "person_id", "left")
    return found.withColumn("reason", F.when(F.col("_families").isNull(), "unknown person").when(F.col("_families") > 1, "person of several families")).withColumn(
        "family_id", F.when(F.col("_families") == 1, F.col("_family"))).drop("_families", "_family")


def denovo_by_person(
    rows: DataFrame, ped: DataFrame, person: str = "person_id", family: str | None = None, extra: list[str] = (), unknown: str = "apart",
) -> DataFrame:
    """One row per site and family with the carriers; person cells may list several ids.

    Separate lines of one family at one site become one family row, with the ``extra`` columns of each in ``lines``. A person of
    several families is an error when the row is computed. Unknown persons are one too if ``unknown`` is ``"error"``;
    else ``rejected_carriers`` has them.
    """
    listed = listed_carriers(rows, ped, person, family)
    fatal = F.col("reason").isNotNull() if unknown == "error" else F.col("reason") == "person of several families"
    checked = listed.withColumn("family_id", F.when(
        fatal, F.raise_error(F.concat_ws(": ", "reason", "person_id")).cast("string")).otherwise(F.col("family_id"))).filter("family_id IS NOT NULL")
    lines = [F.array_sort(F.collect_set(F.struct(*extra))).alias("lines")] if extra else []
    return checked.groupBy(*SITE, "family_id").agg(F.array_sort(F.collect_set("person_id")).alias("carriers"), *lines)


def rejected_carriers(rows: DataFrame, ped: DataFrame, person: str = "person_id", family: str | None = None) -> DataFrame:
    """Listed persons without one family, with the columns of their line and the reason."""
    return listed_carriers(rows, ped, person, family).filter("reason IS NOT NULL")


def ambiguous_persons(rows: DataFrame, ped: DataFrame, person: str = "person_id") -> DataFrame:
    """Carriers listed in a de-novo table that belong to several families."""
    listed = rows.select(F.explode(listed_persons(F.col(person))).alias("person_id")).distinct()
    return pedigree.persons_in_several_families(ped).join(listed, "person_id", "left_semi")


def _matrix(text: Column) -> Column:
    """``2 1/0 1`` or ``21/01`` as an array of rows."""
    return F.transform(F.split(F.trim(text), "/"), lambda r: F.when(
        r.contains(" "), F.split(F.trim(r), " +")).otherwise(F.split(r, "")).cast("array<int>"))


def _columns_of(matrix: Column) -> Column:
    """Per member: the copies of every allele."""
    width = F.size(F.get(matrix, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(matrix, lambda r: F.get(r, i)))


def calls_from_states(rows: DataFrame, keys: list[str], ped: DataFrame, states: Column) -> DataFrame:
    """Family genotypes from best states listed in member order; members beyond a short list are unknown."""
    joined = _with_members(rows.withColumn("_st", states), ped)
    pair = genotypes.genotype_from_best_state(F.get("_st", F.col("place")))
    side = lambda name: F.coalesce(F.col(f"_g.{name}"), F.lit(-1))
    return variants.family_calls(joined.withColumn("_g", pair).withColumn("a1", side("a1")).withColumn("a2", side("a2")), keys)


def denovo_study_inputs(
    rows: DataFrame, ped: DataFrame, par: list[tuple[str, int, int]] = (), best_state: str | None = None,
    genotype: str | None = None, bucket_index: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """``(sites, calls)`` of a de-novo table; comma-separated alternatives are alleles 1, 2, ….

    ``rows`` have site columns and ``family_id`` with one of ``carriers``, a best-state column or a
    genotype column (``0/0,0/1`` in member order).
    """
    sites = rows.select(*SITE).distinct().withColumn("alternatives", F.split("alternative", ",")).withColumn(
        "end_position", F.lit(None).cast("int"))
    sites = _bucketed(sites, ["chromosome", "reference", "alternative"], bucket_index, 2)
    keyed = rows.join(sites.select(*SITE, *variants.KEY), SITE)
    if best_state is not None:
        calls = calls_from_states(keyed, variants.KEY, ped, _columns_of(_matrix(F.col(best_state))))
    elif genotype is not None:
        joined = _with_members(keyed.withColumn("_gt", F.split(F.col(genotype), ",")), ped)
        sides = F.split(F.get("_gt", F.col("place")), "/")
        side = lambda i: F.coalesce(F.get(sides, F.lit(i)).try_cast("int"), F.lit(-1))
        calls = variants.family_calls(joined.withColumn("a1", side(0)).withColumn("a2", side(1)))
    else:
        calls = _members_with(keyed, variants.KEY, ped, list(par))
    return sites.drop("alternative"), calls


# ---- transmitted summaries ------------------------------------------------------------------

def transmitted_rows(summary: DataFrame, overflow: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(readable, quarantined)`` lines of a transmitted summary table.

    Lines whose family list is ``TOOMANY`` take it from the overflow table by site. Lines with
    unreadable numbers or an unreadable or missing family list go to quarantine.
    """
    renamed = {"#chr": "chrom", "chr": "chrom"}
    rows = summary.withColumnsRenamed({k: v for k, v in renamed.items() if k in summary.columns})
    if overflow is not None:
        side = overflow.withColumnsRenamed({k: v for k, v in renamed.items() if k in overflow.columns})
        side = side.select("chrom", "position", "variant", F.col("familyData").alias("_more"))
        rows = rows.join(side, ["chrom", "position", "variant"], "left").withColumn(
            "familyData", F.when(F.col("familyData") == "TOOMANY", F.col("_more")).otherwise(F.col("familyData"))).drop("_more")
    numbers = {
        "position": "int", "all.nParCalled": "int", "all.nAltAlls": "int",
        "all.prcntParCalled": "double", "all.altFreq": "double"}
    readable = F.coalesce(F.col("familyData").rlike(r"^[^:;]+:[0-9/]+:[^;]*(;[^:;]+:[0-9/]+:[^;]*)*$"), F.lit(False))
    for name, kind in numbers.items():
        readable = readable & F.col(f"`{name}`").try_cast(kind).isNotNull()
    readable = readable & alleles.type_from_notation(F.col("variant")).isNotNull()
    flagged = rows.withColumn("_ok", readable)
    return flagged.filter("_ok").drop("_ok"), flagged.filter("NOT _ok").drop("_ok")


def transmitted_alleles(readable: DataFrame) -> DataFrame:
    """Reference and alternative rows with their stored frequencies.

    As in the files, the reference frequency is a fraction and the alternative one a percentage.
    """
    called, alt = F.col("`all.nParCalled`").cast("int"), F.col("`all.nAltAlls`").cast("int")
    ref_count = 2 * called - alt
    ref_freq = F.when(called > 0, ref_count / 2.0 / called).otherwise(0.0)
    alt_freq = F.col("`all.altFreq`").cast("double")
    pair = F.explode(F.array(
        F.struct(F.lit(0).alias("i"), ref_count.cast("int").alias("n"), ref_freq.alias("f")),
        F.struct(F.lit(1).alias("i"), alt.alias("n"), alt_freq.alias("f"))))
    return readable.select(
        "chrom", F.col("position").cast("int").alias("position"), "variant", called.alias("af_parents_called_count"),
        F.col("`all.prcntParCalled`").cast("double").alias("af_parents_called_percent"), pair.alias("p")
    ).select(
        "chrom", "position", "variant", F.col("p.i").alias("allele_index"), "af_parents_called_count",
        "af_parents_called_percent", F.col("p.n").alias("af_allele_count"), F.col("p.f").alias("af_allele_freq"))


def transmitted_families(readable: DataFrame) -> DataFrame:
    """One row per family of a line: ``family_id, states`` (copies per member) and read counts."""
    each = readable.withColumn("_f", F.explode(F.split("familyData", ";"))).withColumn("_f", F.split("_f", ":"))
    return each.select(
        "chrom", F.col("position").cast("int").alias("position"), "variant", F.get("_f", F.lit(0)).alias("family_id"),
        _columns_of(_matrix(F.get("_f", F.lit(1)))).alias("states"), F.get("_f", F.lit(2)).alias("read_counts"))


# ---- copy-number calls ------------------------------------------------------------------------

def cnv_rows(
    raw: DataFrame, location: str | None = "location", chrom: str | None = None, start: str | None = None,
    end: str | None = None, variant: str = "variant", plus: list[str] = ("CNV+",), minus: list[str] = ("CNV-",),
) -> DataFrame:
    """``chromosome, position, end_position, variant_type`` next to the other columns.

    The type is 32 for duplication words and 16 for deletion words; other words give NULL.
    """
    if chrom is not None:
        c, a, b = F.col(chrom), F.col(start).try_cast("int"), F.col(end).try_cast("int")
        used = [chrom, start, end, variant]
    else:
        c = F.regexp_extract(location, r"^([^:]+):", 1)
        a = F.regexp_extract(location, r":(\d+)-", 1).try_cast("int")
        b = F.regexp_extract(location, r"-(\d+)$", 1).try_cast("int")
        used = [location, variant]
    kind = F.when(F.col(variant).isin(list(plus)), 32).when(F.col(variant).isin(list(minus)), 16)
    return raw.select(
        c.alias("chromosome"), a.alias("position"), b.alias("end_position"), kind.alias("variant_type"),
        *[x for x in raw.columns if x not in used])


def cnv_rejects(rows: DataFrame) -> DataFrame:
    """Rows of ``cnv_rows`` without a place or with an unknown type word, with the ``reason``."""
    return rows.withColumn("reason", F.when(F.col("chromosome").isNull() | (F.col("chromosome") == ""), "no chromosome").when(
        F.col("position").isNull() | F.col("end_position").isNull(), "no interval").when(F.col("variant_type").isNull(), "unknown type")).filter("reason IS NOT NULL")


CNV_KEY = ["chromosome", "position", "end_position", "variant_type"]


def cnv_states_by_person(rows: DataFrame, ped: DataFrame, par: list[tuple[str, int, int]] = (), person: str = "person_id") -> DataFrame:
    """Copies ``[ref, alt]`` of every member of a carrier's family; ``place`` is the member order.

    Rows that ``cnv_rejects`` returns have none; a person of several families is an error, and ``rejected_carriers`` has unknown ones.
    """
    placed = rows.dropna(subset=CNV_KEY)
    listed = listed_carriers(placed.select(*CNV_KEY, F.col(person).alias("person_id")), ped)
    checked = listed.withColumn("family_id", F.when(
        F.col("reason") == "person of several families", F.raise_error(F.concat_ws(": ", "reason", "person_id")).cast("string")).otherwise(F.col("family_id")))
    carriers = checked.filter("family_id IS NOT NULL").groupBy(*CNV_KEY, "family_id").agg(F.array_sort(F.collect_set("person_id")).alias("carriers"))
    expected = genotypes.interval_ploidy(
        F.col("chromosome"), F.col("position"), F.col("end_position"), F.col("sex"), list(par))
    alt = F.array_contains("carriers", F.col("person_id")).cast("int")
    return _with_members(carriers, ped).withColumn("state", F.array((expected - alt).cast("int"), alt))


def cnv_states_by_family(rows: DataFrame, ped: DataFrame, par: list[tuple[str, int, int]] = (), best_state: str = "best_state") -> DataFrame:
    """Copies ``[ref, alt]`` from observed ploidies listed in member order (``2 2 3 2``)."""
    joined = _with_members(rows.withColumn("_o", F.split(F.trim(F.col(best_state)), " +")), ped)
    expected = genotypes.interval_ploidy(
        F.col("chromosome"), F.col("position"), F.col("end_position"), F.col("sex"), list(par))
    observed = F.get("_o", F.col("place")).cast("int")
    return joined.withColumn("state", genotypes.cnv_state_from_observed(observed, expected, F.col("variant_type"))).drop("_o")


def cnv_study_inputs(states: DataFrame, bucket_index: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(sites, calls)`` of copy-number states of members."""
    sites = states.select(*CNV_KEY).distinct().withColumn(
        "reference", F.lit(None).cast("string")).withColumn("alternatives", F.array(F.lit(None).cast("string")))
    sites = _bucketed(sites, ["chromosome", "end_position", "variant_type"], bucket_index, 2)
    keyed = states.join(sites.select(*CNV_KEY, *variants.KEY), CNV_KEY)
    pair = genotypes.genotype_from_best_state(F.col("state"))
    return sites, variants.family_calls(
        keyed.withColumn("_g", pair).withColumn("a1", F.col("_g.a1")).withColumn("a2", F.col("_g.a2")))
