"""VCF text files as Spark rows.

Lines are read as text and split by Spark, so a file is one distributed job over its splits. The
header of a file says at which place of a line each family member is; this layout joins the
records of the file, and a record unfolds to its families with the calls picked by place. Sample
calls are never rows of their own: what is shuffled is a record once, for its number, and the
families that several batches share.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import codes
from kinfold.operators import pedigree, variants
from kinfold.session import written

FIXED_COLUMNS = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
FIRST_SAMPLE = len(FIXED_COLUMNS)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tab-split lines; ``##`` lines are dropped.

    ``line`` orders the lines of a file: by the start of their part of the file, then by the order
    in which the part is read. The number alone would follow the packing of parts into tasks.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.struct(
            F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("place")).alias("line"))
    return lines.filter(~F.col("value").startswith("##") & (F.length("value") > 0)).select(
        "file", "line", F.split("value", "\t").alias("f"))


def samples(lines: DataFrame) -> DataFrame:
    """``(file, place, sample_id)`` from the header line of each file."""
    header = lines.filter(F.get("f", F.lit(0)) == "#CHROM")
    listed = F.slice("f", FIRST_SAMPLE + 1, F.greatest(F.size("f") - FIRST_SAMPLE, F.lit(0)))
    return header.select("file", F.posexplode(listed).alias("place", "sample_id"))


def adjusted_chrom(chrom: Column, prefix: str | None = None, add: bool = True) -> Column:
    """Add or remove a chromosome prefix."""
    if not prefix:
        return chrom
    if add:
        return F.concat(F.lit(prefix), chrom)
    return F.when(chrom.startswith(prefix), F.substring(chrom, len(prefix) + 1, F.length(chrom))).otherwise(chrom)


def records(lines: DataFrame, prefix: str | None = None, add_prefix: bool = True, skip_contigs: str | None = None) -> DataFrame:
    """Site columns and the raw sample fields, one row per record.

    ``skip_contigs`` leaves out contigs whose name contains it.
    """
    field = lambda i: F.get("f", F.lit(i))
    body = lines.filter(field(0) != "#CHROM")
    if skip_contigs is not None:
        body = body.filter(~field(0).contains(skip_contigs))
    gt_place = F.array_position(F.split(field(8), ":"), "GT").cast("int")
    return body.select(
        "file", "line", adjusted_chrom(field(0), prefix, add_prefix).alias("chromosome"),
        field(1).try_cast("int").alias("position"), field(3).alias("reference"),
        F.split(field(4), ",").alias("alternatives"), gt_place.alias("gt_place"),
        F.slice("f", FIRST_SAMPLE + 1, F.greatest(F.size("f") - FIRST_SAMPLE, F.lit(0))).alias("fields"))


def call_text(field: Column, gt_place: Column) -> Column:
    """The GT part of a sample field; it comes first unless the format says otherwise."""
    return F.when(gt_place == 1, F.substring_index(field, ":", 1)).otherwise(F.try_element_at(F.split(field, ":"), gt_place))


def allele_of(text: Column) -> Column:
    """One side of a GT field; ``.`` is unknown."""
    return F.coalesce(text.try_cast("int"), F.lit(-1))


def _of_record(use) -> Column:
    """``use`` of a record's fields and GT place.

    Both are bound first: a filter that is pushed below the projection that makes them would
    otherwise cut the line again for every sample.
    """
    return codes.bind(F.struct("fields", "gt_place"), lambda r: use(r["fields"], r["gt_place"]))


def calls() -> Column:
    """``struct(a1, a2)`` of all samples of a record; a single side is haploid."""
    def call(field: Column, gt_place: Column) -> Column:
        text = F.translate(call_text(field, gt_place), "|", "/")
        return F.struct(
            allele_of(F.substring_index(text, "/", 1)).alias("a1"),
            F.when(F.instr(text, "/") == 0, F.lit(-2)).otherwise(allele_of(F.substring_index(text, "/", -1))).alias("a2"))
    return _of_record(lambda fields, gt_place: F.transform(fields, lambda f: call(f, gt_place)))


def unreadable() -> Column:
    """Whether a record has a call of more than two sides, or no position."""
    def sides(field: Column, gt_place: Column) -> Column:
        text = F.coalesce(call_text(field, gt_place), F.lit(""))
        return F.length(text) - F.length(F.translate(text, "/|", "")) + 1
    return F.col("position").isNull() | _of_record(lambda fields, gt_place: F.exists(fields, lambda f: sides(f, gt_place) > 2))


SITE = ["chromosome", "position", "occurrence"]


class Tables(NamedTuple):
    """What is read from VCF files; ``quarantine`` has the records that could not be."""

    sites: DataFrame
    calls: DataFrame
    pedigree: DataFrame
    quarantine: DataFrame


def numbered(recs: DataFrame) -> DataFrame:
    """Records without their calls, with ``occurrence``: 0 for the first at a position of a batch, 1 for the second, …."""
    order = W.partitionBy("chromosome", "position").orderBy("file", "line")
    return recs.select("file", "line", "chromosome", "position", "reference", "alternatives").withColumn(
        "occurrence", F.row_number().over(order) - 1)


def merged_sites(batches: list[DataFrame]) -> DataFrame:
    """Sites of several batches aligned by ``SITE``, shaped as in the first batch that has them."""
    shapes = [b.select(*SITE, "reference", "alternatives") for b in batches]
    if len(shapes) == 1:
        return shapes[0]
    ranked = reduce(DataFrame.unionByName, [b.withColumn("_ord", F.lit(i)) for i, b in enumerate(shapes)])
    return ranked.groupBy(*SITE).agg(F.min_by(F.struct("reference", "alternatives"), "_ord").alias("w")).select(*SITE, "w.*")


def family_places(batches: list[DataFrame], ped: DataFrame) -> DataFrame:
    """``(file, shared, families)`` of the samples ``(file, place, sample_id)`` of each batch.

    A family has its members with the place of their sample in the file, if they have one, and
    whether other batches have samples of it too.
    """
    layout = pedigree.layout(ped).select("family_id", F.col("members").alias("m"))
    owners = pedigree.members(ped).select("family_id", "person_id", "sample_id")
    placed = reduce(DataFrame.unionByName, [b.withColumn("batch", F.lit(i)) for i, b in enumerate(batches)]).join(owners, "sample_id")
    shared = placed.groupBy("family_id").agg((F.count_distinct("batch") > 1).alias("shared"))
    by_file = placed.groupBy("file", "family_id").agg(
        F.map_from_entries(F.collect_set(F.struct("person_id", "place"))).alias("_at"))
    at = lambda m: F.try_element_at(F.col("_at"), m["person_id"])
    found = by_file.join(layout, "family_id").join(shared, "family_id").select("file", F.struct(
        "family_id", "shared", F.transform("m", lambda m: F.struct(
            *[m[f].alias(f) for f in variants.MEMBER_FIELDS], at(m).alias("place"))).alias("members")).alias("f"))
    return found.groupBy("file", F.col("f.shared").alias("shared")).agg(F.collect_list("f").alias("families"))


def family_calls(recs: DataFrame, places: DataFrame, fill: int) -> DataFrame:
    """Records ``(…KEY, file, calls)`` unfolded to the families of their file.

    Calls are picked inside the record, so an unfolded row is as wide as its family.
    """
    def with_call(m: Column) -> Column:
        call, known = F.get("calls", m["place"]), m["place"].isNotNull()
        side = lambda name: F.when(known, F.coalesce(call[name], F.lit(-1))).otherwise(fill)
        return F.struct(
            *[m[f].alias(f) for f in variants.MEMBER_FIELDS], side("a1").alias("a1"), side("a2").alias("a2"), known.alias("known"))

    called = F.transform("families", lambda f: F.struct(
        f["family_id"].alias("family_id"), F.transform(f["members"], with_call).alias("members")))
    return recs.join(places, "file").select(*variants.KEY, F.inline(called))


def _plain(members: Column) -> Column:
    return F.transform(members, lambda m: m.dropFields("known"))


def merged_calls(batches: list[DataFrame]) -> DataFrame:
    """Calls of the families that several batches share; of a member with a call in several, the first batch counts."""
    rows = reduce(DataFrame.unionByName, [b.withColumn("_ord", F.lit(i)) for i, b in enumerate(batches)])
    grouped = rows.groupBy(*variants.KEY, "family_id").agg(F.array_sort(F.collect_list(F.struct("_ord", "members"))).alias("b"))
    lists = F.transform("b", lambda x: x["members"])
    first = F.aggregate(F.slice(lists, 2, F.size(lists)), F.get(lists, F.lit(0)), lambda acc, other: F.zip_with(
        acc, other, lambda m, n: F.when(~m["known"] & n["known"], n).otherwise(m)))
    return grouped.select(*variants.KEY, "family_id", _plain(first).alias("members"))


def study_inputs(
    batches: list[DataFrame], ped: DataFrame, fill: int = -1, prefix: str | None = None, add_prefix: bool = True,
    skip_contigs: str | None = None, fixed_pedigree: bool = True, bucket_index: int = 1, transmission_type: int = 1,
    scratch: str | None = None,
) -> Tables:
    """Sites, family calls and the matched pedigree of the lines of several sample batches.

    Members without a sample in any batch that has the site get ``fill``: -1 is unknown and 0 is
    reference. Families without a sample in those batches have no row; when filled as reference,
    ``allele_frequencies`` is told to count them as such. With ``scratch`` the numbered sites are
    written there, as they are needed on both sides.
    """
    recs = [records(lines, prefix, add_prefix, skip_contigs) for lines in batches]
    odd = reduce(DataFrame.unionByName, [r.filter(unreadable()) for r in recs])
    recs = [r.filter(~unreadable()) for r in recs]
    places = [samples(lines) for lines in batches]
    matched = pedigree.match_samples(ped, reduce(DataFrame.unionByName, [p.select("sample_id") for p in places]), fixed_pedigree)
    narrow = [numbered(r) for r in recs]
    sites = variants.running_index(
        merged_sites(narrow).withColumn("bucket_index", F.lit(bucket_index)), "bucket_index", "position", ["chromosome", "occurrence"], "summary_index")
    sites = sites.withColumn("end_position", F.lit(None).cast("int")).withColumn("transmission_type", F.lit(transmission_type))
    if scratch is not None:
        sites = written(sites, f"{scratch}/numbered")
    layouts = family_places(places, matched)
    if scratch is not None:
        layouts = written(layouts, f"{scratch}/layouts")
    keyed = [
        wide.select("file", "line", calls().alias("calls")).join(
            thin.select("file", "line", *SITE).join(sites.select(*SITE, *variants.KEY), SITE).select("file", "line", *variants.KEY), ["file", "line"])
        for wide, thin in zip(recs, narrow)]
    alone = [family_calls(k, layouts.filter(~F.col("shared")), fill).withColumn("members", _plain(F.col("members"))) for k in keyed]
    found = reduce(DataFrame.unionByName, alone)
    if len(batches) > 1:  # only families that several batches share are grouped
        found = found.unionByName(merged_calls([family_calls(k, layouts.filter("shared"), fill) for k in keyed]))
    return Tables(sites.drop("occurrence"), found, matched, odd)


def read(spark: SparkSession, batches: list[list[str]], ped: DataFrame, **options) -> Tables:
    """``study_inputs`` of VCF files.

    A batch is a set of files with the same samples, such as one file per chromosome; batches with
    different samples are merged by position.
    """
    return study_inputs([read_lines(spark, paths) for paths in batches], ped, **options)
