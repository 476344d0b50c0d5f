"""Pedigree text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import codes
from kinfold.operators import pedigree

# ---- fixed values: standard pedigree column names -------------------------------------------
STANDARD = {
    "familyId": "family_id", "personId": "person_id", "momId": "mom_id", "dadId": "dad_id",
    "sex": "sex", "status": "status", "role": "role", "proband": "proband", "layout": "layout",
    "generated": "generated", "not_sequenced": "not_sequenced", "sample_id": "sample_id",
}
REQUIRED = ["family_id", "person_id", "mom_id", "dad_id", "sex", "status"]


def _text(column: Column) -> Column:
    """Trimmed text; empty cells are NULL."""
    trimmed = F.trim(column)
    return F.when(trimmed != "", trimmed)


def _numbered(df: DataFrame) -> DataFrame:
    """Line order inside a family as ``member_index``.

    Pedigree files are small next to genotypes; the order of lines is kept by file and position.
    """
    from pyspark.sql import Window as W
    line = W.partitionBy("family_id").orderBy("_line")
    return df.withColumn("member_index", F.row_number().over(line) - 1).drop("_line")


def _read(spark: SparkSession, path: str, sep: str, header: bool) -> DataFrame:
    raw = spark.read.csv(path, sep=sep, header=header, comment="#", ignoreLeadingWhiteSpace=True, enforceSchema=False)
    return raw.withColumn("_line", F.monotonically_increasing_id())


def read(
    spark: SparkSession, path: str, sep: str = "\t", columns: dict[str, str | int] | None = None,
    header: bool = True, with_role: bool = True,
) -> DataFrame:
    """A pedigree with configurable column names.

    ``columns`` maps our names (``family_id``, …) to the file's names, or to positions when the
    file has no header. A missing sample id is the person id, or NULL for generated and not
    sequenced persons.
    """
    raw = _read(spark, path, sep, header)
    names = {ours: theirs for theirs, ours in STANDARD.items()}
    names.update(columns or {})
    found = {}
    for ours, theirs in names.items():
        name = f"_c{theirs}" if isinstance(theirs, int) else theirs
        if name in raw.columns:
            found[ours] = name
    missing = [c for c in REQUIRED if c not in found]
    if missing:
        raise ValueError(f"pedigree misses columns {missing}")
    extra = [c for c in raw.columns if c not in found.values() and c != "_line"] if header else []

    def cell(name: str) -> Column:
        return _text(F.col(f"`{found[name]}`")) if name in found else F.lit(None).cast("string")

    def parent(name: str) -> Column:
        return F.when(cell(name) != "0", cell(name))

    generated, not_sequenced = codes.boolean_word(cell("generated")), codes.boolean_word(cell("not_sequenced"))
    role = codes.role_code(cell("role")) if with_role and "role" in found else F.lit(None).cast("int")
    sample = F.coalesce(cell("sample_id"), F.when(~generated & ~not_sequenced, cell("person_id")))
    rows = raw.select(
        cell("family_id").alias("family_id"), cell("person_id").alias("person_id"),
        parent("mom_id").alias("mom_id"), parent("dad_id").alias("dad_id"),
        codes.sex_code(cell("sex")).alias("sex"), codes.status_code(cell("status")).alias("status"),
        role.alias("role"), sample.alias("sample_id"), generated.alias("generated"),
        not_sequenced.alias("not_sequenced"), codes.boolean_word(cell("proband")).alias("proband"),
        cell("layout").alias("layout"), *[_text(F.col(f"`{c}`")).alias(c) for c in extra], "_line")
    return _numbered(rows)


def read_simple(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Short nuclear-family files with family, person, role and sex (or gender).

    Parents follow from the roles of a family; probands are affected and everybody else is not.
    """
    raw = _read(spark, path, sep, True)
    sex = "sex" if "sex" in raw.columns else "gender"
    sample = _text(F.col("sample_id")) if "sample_id" in raw.columns else F.lit(None).cast("string")
    people = raw.select(
        _text(F.col("familyId")).alias("family_id"), _text(F.col("personId")).alias("person_id"),
        codes.sex_code(_text(F.col(sex))).alias("sex"), codes.role_code(_text(F.col("role"))).alias("role"),
        F.coalesce(sample, _text(F.col("personId"))).alias("sample_id"), "_line")
    holder = lambda r: F.max(F.when(F.col("role") == codes.ROLES[r], F.col("person_id")))
    parents = people.groupBy("family_id").agg(holder("mom").alias("_mom"), holder("dad").alias("_dad"))
    child = F.col("role").isin(codes.ROLES["prb"], codes.ROLES["sib"])
    rows = people.join(parents, "family_id").select(
        "family_id", "person_id", F.when(child, F.col("_mom")).alias("mom_id"), F.when(child, F.col("_dad")).alias("dad_id"),
        "sex", F.when(F.col("role") == codes.ROLES["prb"], 2).otherwise(1).alias("status"), "role", "sample_id",
        F.lit(False).alias("generated"), F.lit(False).alias("not_sequenced"), "_line")
    return _numbered(rows)


def as_text(ped: DataFrame) -> DataFrame:
    """Pedigree with words instead of codes under the standard column names."""
    words = ped.select(
        F.col("family_id").alias("familyId"), F.col("person_id").alias("personId"),
        F.coalesce("mom_id", F.lit("0")).alias("momId"), F.coalesce("dad_id", F.lit("0")).alias("dadId"),
        codes.decode(codes.SEXES, F.col("sex")).alias("sex"),
        codes.decode(codes.STATUSES, F.col("status")).alias("status"),
        codes.decode(codes.ROLES, F.col("role"), "unknown").alias("role"), "sample_id", "generated", "not_sequenced",
        *[c for c in ped.columns if c not in pedigree.PEDIGREE_COLUMNS])
    return words


def write_text(ped: DataFrame, path: str, families: DataFrame | None = None) -> None:
    """Tab-separated pedigree, optionally of some families only."""
    rows = ped if families is None else ped.join(families.select("family_id"), "family_id", "left_semi")
    as_text(rows).write.mode("errorifexists").csv(path, sep="\t", header=True)


def stored(ped: DataFrame, family_bins: int = 0) -> DataFrame:
    """Stored form: unspecified sex and status as 0, and the family bin when used."""
    from kinfold.functions import bins
    rows = ped.withColumn("sex", codes.external(F.col("sex")).cast("tinyint")).withColumn(
        "status", codes.external(F.col("status")).cast("tinyint"))
    return rows.withColumn("family_bin", bins.family_bin(F.col("family_id"), family_bins)) if family_bins else rows


def loaded(ped: DataFrame) -> DataFrame:
    """In-memory form of a stored pedigree."""
    return ped.withColumn("sex", codes.internal(F.col("sex")).cast("int")).withColumn(
        "status", codes.internal(F.col("status")).cast("int"))
