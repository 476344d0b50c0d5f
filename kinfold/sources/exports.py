"""Text exports: VCF, flat variant tables, family selections, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _call_text(a1: Column, a2: Column) -> Column:
    side = lambda a: F.when(a == -1, F.lit(".")).otherwise(a.cast("string"))
    return F.when(a2 == -2, side(a1)).otherwise(F.concat_ws("/", side(a1), side(a2)))


def vcf_lines(sites: DataFrame, calls: DataFrame, samples: list[str] | DataFrame, fill: str = "./.") -> DataFrame:
    """VCF records as ``(chromosome, position, value)`` with the samples in their order.

    ``samples`` is a list of person ids or a table ``(place, person_id)`` with places from 0. Calls
    keep to their family until the line is put together: its calls are sorted by place and every
    gap before one is filled, so a line costs its width. Sort by the first two columns before writing.
    """
    keys = ["bucket_index", "summary_index"]
    if isinstance(samples, list):
        samples = calls.sparkSession.createDataFrame(list(enumerate(samples)), "place int, person_id string")
    families = calls.select("family_id", F.col("members.person_id").alias("ids")).distinct()
    places = families.select("family_id", F.explode("ids").alias("person_id")).join(samples, "person_id").groupBy("family_id").agg(
        F.map_from_entries(F.collect_set(F.struct("person_id", "place"))).alias("_at"))
    entries = F.filter(F.transform("members", lambda m: F.struct(
        F.try_element_at(F.col("_at"), m["person_id"]).alias("place"), _call_text(m["a1"], m["a2"]).alias("text"))), lambda e: e["place"].isNotNull())
    by_site = calls.join(places, "family_id").select(*keys, entries.alias("e")).groupBy(*keys).agg(
        F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    before = F.concat(F.array(F.lit(-1)), F.slice(F.transform("e", lambda e: e["place"]), 1, F.greatest(F.size("e") - 1, F.lit(0))))
    filled = F.zip_with("e", before, lambda e, last: F.concat(F.repeat(F.lit(f"{fill}\t"), e["place"] - last - 1), e["text"]))
    rest = F.col("width") - 1 - F.get("e", F.size("e") - 1)["place"]
    genotypes = F.concat(F.array_join(filled, "\t"), F.repeat(F.lit(f"\t{fill}"), rest))
    width = samples.agg((F.max("place") + 1).alias("width")).scalar()
    alternatives = F.array_join(F.transform("alternatives", lambda a: F.coalesce(a, F.lit("."))), ",")
    return sites.join(by_site.filter(F.size("e") > 0).withColumn("width", width), keys).select("chromosome", "position", F.concat_ws(
        "\t", F.col("chromosome"), F.col("position").cast("string"), F.lit("."), F.coalesce("reference", F.lit(".")),
        alternatives, F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), genotypes).alias("value"))


def vcf_header(samples: list[str], contigs: dict[str, int] | None = None) -> list[str]:
    lines = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    lines += [f"##contig=<ID={c},length={n}>" for c, n in (contigs or {}).items()]
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]
    return [*lines, "\t".join(columns)]


def write_vcf(lines: DataFrame, header: list[str], path: str) -> None:
    """One text file per partition, ordered by position, each with the header.

    Range partitioning keeps the files in genome order, so they can be read one after another or
    as the chromosome-split files of one batch.
    """
    ordered = lines.repartitionByRange("chromosome", "position").sortWithinPartitions("chromosome", "position")
    head = "\n".join(header)

    def with_header(batches):
        import pyarrow as pa
        for i, batch in enumerate(batches):
            if i == 0:
                yield pa.RecordBatch.from_arrays([pa.array([head], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    ordered.select("value").mapInArrow(with_header, "value string").write.mode("errorifexists").text(path)


def variant_table(rows: DataFrame) -> DataFrame:
    """Flat rows: site, family and carriers."""
    return rows.select(
        F.col("chromosome").alias("chrom"), F.col("position").alias("pos"), F.col("reference").alias("ref"),
        F.col("alternative").alias("alt"), F.col("family_id").alias("familyId"),
        F.array_join("allele_in_members", ",").alias("personIds"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, sep="\t", header=True)


def family_vcf_lines(sites: DataFrame, calls: DataFrame) -> DataFrame:
    """``(family_id, chromosome, position, value)`` records of one VCF per family.

    A line has only the family's members, so the output is linear in the calls; the header line of
    a family comes first with position 0.
    """
    keys = ["bucket_index", "summary_index"]
    members = F.col("members")
    alternatives = F.array_join(F.transform("alternatives", lambda a: F.coalesce(a, F.lit("."))), ",")
    body = calls.join(sites.select(*keys, "chromosome", "position", "reference", "alternatives"), keys).select(
        "family_id", "chromosome", "position", F.concat_ws(
            "\t", F.col("chromosome"), F.col("position").cast("string"), F.lit("."), F.coalesce("reference", F.lit(".")),
            alternatives, F.lit("."), F.lit("."), F.lit("."), F.lit("GT"),
            F.array_join(F.transform(members, lambda m: _call_text(m["a1"], m["a2"])), "\t")).alias("value"))
    names = F.array_join(F.transform(members, lambda m: m["person_id"]), "\t")
    columns = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"])
    header = calls.groupBy("family_id").agg(F.first(names).alias("_n")).select(
        "family_id", F.lit("").alias("chromosome"), F.lit(0).alias("position"),
        F.concat_ws("\t", F.lit(columns), F.col("_n")).alias("value"))
    return header.unionByName(body)
