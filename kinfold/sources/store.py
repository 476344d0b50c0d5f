"""Stored studies: partitioned Parquet, metadata, withdrawal, compaction, verification."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import bins
from kinfold.operators import filters, pedigree
from kinfold.plans.study import Study
from kinfold.session import scratch_dir, written
from kinfold.sources import pedigree_files, snapshots

ROWS_PER_FILE = 5_000_000
#: Directories of one table at most; a file costs about as much as thousands of rows.
MOST_DIRECTORIES = 3_000


def with_summary_bins(summary: DataFrame, part: bins.Partitioning) -> DataFrame:
    """Bin columns of summary alleles."""
    if "region_bin" in part.summary_columns:
        summary = summary.withColumn("region_bin", bins.row_region_bin(
            F.col("chromosome"), F.col("position"), F.col("end_position"), part))
    if "frequency_bin" in part.summary_columns:
        summary = summary.withColumn("frequency_bin", bins.frequency_bin(
            F.col("af_allele_count"), F.col("af_allele_freq"), F.col("seen_as_denovo"), part.rare_boundary))
    if "coding_bin" in part.summary_columns:
        summary = summary.withColumn("coding_bin", bins.coding_bin(
            F.col("effect_gene"), F.col("allele_index"), part.coding_effects))
    return summary


def site_facts(summary: DataFrame, part: bins.Partitioning) -> DataFrame:
    """What the bins of family alleles are made of, by site: ``facts`` has an entry for each row of ``summary`` (with its bins)."""
    of_bin = {"region_bin": ["region_bin"], "frequency_bin": ["af_allele_count", "af_allele_freq"], "coding_bin": ["coding_bin"]}
    needed = [c for b in part.summary_columns for c in of_bin[b]]
    return summary.filter("allele_index > 0").groupBy("bucket_index", "summary_index").agg(
        F.collect_list(F.struct("allele_index", *needed)).alias("facts"))


def with_family_bins(family: DataFrame, summary: DataFrame, part: bins.Partitioning) -> DataFrame:
    """Bin columns of family alleles.

    The frequency bin of a family row follows that family's own de-novo flag, so a family that
    inherited an allele is not binned as de novo because another family has the event. Reference
    rows are placed by their variant's site. Rows that bring the ``facts`` of their site (``site_facts``)
    are not shuffled to meet the summary.
    """
    if part.summary_columns and "facts" in family.columns:
        own = F.filter("facts", lambda f: f["allele_index"] == F.greatest("allele_index", F.lit(1)))
        family = family.withColumn("_own", F.explode(own)).drop("facts")
        if "region_bin" in part.summary_columns:
            family = family.withColumn("region_bin", F.col("_own.region_bin"))
        if "frequency_bin" in part.summary_columns:
            family = family.withColumn("frequency_bin", bins.frequency_bin(
                F.col("_own.af_allele_count"), F.col("_own.af_allele_freq"), F.col("is_denovo"), part.rare_boundary))
        if "coding_bin" in part.summary_columns:
            family = family.withColumn("coding_bin", F.when(F.col("allele_index") > 0, F.col("_own.coding_bin")).otherwise(0))
        family = family.drop("_own")
    elif part.summary_columns:
        wanted = ["bucket_index", "summary_index", "allele_index"]
        facts = {"region_bin": ["chromosome", "position", "end_position"], "frequency_bin": ["af_allele_count", "af_allele_freq"], "coding_bin": ["effect_gene"]}
        needed = [c for b in part.summary_columns for c in facts[b]]
        own = summary.select(*wanted, *needed)
        # the reference allele has no summary row of its own: borrow the first alternative's site
        borrowed = own.filter("allele_index = 1").withColumn("allele_index", F.lit(0))
        family = family.join(own.filter("allele_index > 0").unionByName(borrowed), wanted)
        if "region_bin" in part.summary_columns:
            family = family.withColumn("region_bin", bins.row_region_bin(
                F.col("chromosome"), F.col("position"), F.col("end_position"), part))
        if "frequency_bin" in part.summary_columns:
            family = family.withColumn("frequency_bin", bins.frequency_bin(
                F.col("af_allele_count"), F.col("af_allele_freq"), F.col("is_denovo"), part.rare_boundary))
        if "coding_bin" in part.summary_columns:
            family = family.withColumn("coding_bin", bins.coding_bin(
                F.col("effect_gene"), F.col("allele_index"), part.coding_effects))
        family = family.drop(*needed)
    if part.family_bins > 0:
        family = family.withColumn("family_bin", bins.family_bin(F.col("family_id"), part.family_bins))
    return family


def directory_columns(columns: list[str], values: dict[str, int], most: int | None = None) -> list[str]:
    """The bins that become directories: those with the fewest ``values``, as many as make no more than ``most`` directories.

    Region bins and families grow with the study, and a directory for each of their combinations would hold a few rows in the end.
    The other bins are columns of the files, which are sorted by them.
    """
    kept, made = set(), 1
    for name in sorted(columns, key=lambda c: values[c]):
        made *= max(values[name], 1)
        if made > (MOST_DIRECTORIES if most is None else most):
            break
        kept.add(name)
    return [c for c in columns if c in kept]


def _values(rows: DataFrame, columns: list[str]) -> dict[str, int]:
    """Number of distinct values of each bin."""
    return rows.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]).first().asDict() if columns else {}


def _write(df: DataFrame, path: str, columns: list[str], directories: list[str]) -> None:
    """Partitioned write with few files per directory.

    Rows are rebalanced by directory: adaptive execution merges small directories into one task
    and splits a directory holding a third of the study over many. Files are cut by row count and
    sorted by the bins that are no directories and by key, so that the statistics of their row groups tell alleles apart.
    """
    rows = df.hint("rebalance", *directories) if directories else df
    inside = [c for c in columns if c not in directories]
    if "sj_index" in df.columns:
        rows = rows.sortWithinPartitions(*directories, *inside, "sj_index")
    out = rows.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE)
    (out.partitionBy(*directories) if directories else out).parquet(path)


def write_study(
    study: Study, path: str, metadata: dict[str, str] | None = None, family_of: Callable[[DataFrame], DataFrame] | None = None,
    binned: bool = False,
) -> None:
    """Pedigree, summary, family and metadata tables, the partitioning and the bins of genes under one directory.

    Family rows are wide, so where it can be avoided they are shuffled by their directories only. ``family_of`` takes the place of
    the study's family alleles: it gets the facts of the sites (``site_facts``) and gives the family alleles with them, which meet
    the sites while they are narrow. ``binned`` says that family rows come from a stored study of the same summary alleles and
    partitioning with their bins; these stay, unless a summary allele comes twice.
    """
    spark = study.pedigree.sparkSession
    part = study.partitioning
    pedigree_files.stored(study.pedigree, part.family_bins).write.mode("errorifexists").parquet(f"{path}/pedigree")
    # the number of bins, the bins of family rows and those of genes need the summary: it is computed once
    summary = written(with_summary_bins(study.summary, part), scratch_dir(spark))
    values = _values(summary, part.summary_columns)
    # a family row has its own frequency bin, and a reference row is never coding
    most_values = values | {"frequency_bin": 4, "coding_bin": 2, "family_bin": part.family_bins}
    directories = {"summary": directory_columns(part.summary_columns, values), "family": directory_columns(part.family_columns, most_values)}
    _write(summary, f"{path}/summary", part.summary_columns, directories["summary"])
    family = study.family if family_of is None else family_of(site_facts(summary, part))
    if not binned or _repeated(summary):
        family = with_family_bins(family.drop(*part.family_columns), summary, part)
    _write(family, f"{path}/family", part.family_columns, directories["family"])
    if "region_bin" in part.summary_columns:
        genes = summary.select(F.explode("effect_gene.effect_gene_symbols").alias("gene"), F.col("region_bin").cast("string").alias("region_bin"))
        genes.filter("gene IS NOT NULL").distinct().write.mode("errorifexists").parquet(f"{path}/gene_bins")
    spark.createDataFrame([(json.dumps(asdict(part)),)], "partitioning string").write.mode("errorifexists").parquet(f"{path}/partitioning")
    write_metadata(spark, f"{path}/meta", metadata or {})
    snapshots.commit(spark, path, snapshots.FIRST | {"directories": directories}, 0)


def _repeated(summary: DataFrame) -> bool:
    """Whether a summary allele comes twice."""
    return not summary.groupBy("bucket_index", "summary_index", "allele_index").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _directories(state: dict, part: bins.Partitioning, table: str) -> list[str]:
    """The bins that are directories of a stored table."""
    columns = part.summary_columns if table == "summary" else part.family_columns
    return state.get("directories", {}).get(table, columns)


def write_metadata(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """Key/value rows, appended; the latest value of a key counts."""
    stamped = spark.createDataFrame(list(values.items()), "key string, value string").withColumn(
        "written", F.current_timestamp())
    stamped.write.mode("append").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("key").agg(F.max_by("value", "written").alias("value"))


def _partitioning(spark: SparkSession, path: str) -> bins.Partitioning:
    text = spark.read.parquet(f"{path}/partitioning").first()["partitioning"]
    return bins.Partitioning(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})


def read_study(spark: SparkSession, path: str, number: int | None = None) -> Study:
    """A stored study with the partitioning it was written by, in its latest state or an earlier one; partition columns come back from the directory names."""
    part = _partitioning(spark, path)
    _, state = snapshots.state_of(spark, path, number)
    gene_bins = spark.read.parquet(f"{path}/gene_bins") if "region_bin" in part.summary_columns else None
    return Study(
        pedigree_files.loaded(spark.read.parquet(f"{path}/{state['pedigree']}")),
        snapshots.rows_of(spark, path, state["summary"]), snapshots.rows_of(spark, path, state["family"]), part, gene_bins, by_key=True)


def withdraw_families(spark: SparkSession, path: str, family_ids: DataFrame) -> int:
    """Families deleted from the pedigree and the family alleles of a stored study; returns the number of its new state.

    Only the family bins that hold one of the families (at most as many values as there are bins) are written anew, without a family
    bin all family alleles; other files stay as they are. Summary alleles and their counters stay. A study that has none of the
    families keeps its state.
    """
    part = _partitioning(spark, path)
    number, state = snapshots.state_of(spark, path)
    people = spark.read.parquet(f"{path}/{state['pedigree']}")
    gone = people.join(family_ids.select("family_id"), "family_id", "left_semi").select("family_id").distinct()
    if gone.isEmpty():
        return number
    column, values = None, []
    if part.family_bins > 0:
        column = "family_bin"
        values = [str(r[0]) for r in gone.select(bins.family_bin(F.col("family_id"), part.family_bins)).distinct().collect()]
    family = snapshots.replaced(
        spark, path, state["family"], column, values, lambda rows: pedigree.without_families(rows, gone),
        lambda rows, target: _write(rows, target, part.family_columns, _directories(state, part, "family")), "family")
    renewed = f"pedigree-{uuid4().hex}"
    pedigree.without_families(people, gone).write.mode("errorifexists").parquet(f"{path}/{renewed}")
    snapshots.commit(spark, path, state | {"pedigree": renewed, "family": family}, number + 1)
    return number + 1


def compact_study(spark: SparkSession, path: str, table: str, small_bytes: int = 32 << 20) -> int:
    """Region bins (or values of the first directory column) in which a directory holds several files under ``small_bytes`` written anew; returns the number of the latest state.

    ``table`` is summary or family. Directories are chosen by the sizes of their files; other region bins are left alone, and so are
    the files of the earlier state. Without region bins, one such directory has the whole table written anew.
    """
    part = _partitioning(spark, path)
    columns = part.summary_columns if table == "summary" else part.family_columns
    number, state = snapshots.state_of(spark, path)
    directories = _directories(state, part, table)
    small = table_files(spark, path, table).filter(F.col("bytes") < small_bytes).groupBy(*directories).agg(F.count("*").alias("n")).filter("n > 1")
    column, values = None, []
    if directories:
        column = "region_bin" if "region_bin" in directories else directories[0]
        values = [str(r[0]) if r[0] is not None else "" for r in small.select(column).distinct().collect()]
    elif small.isEmpty():
        return number
    parts = snapshots.replaced(
        spark, path, state[table], column, values, lambda rows: rows, lambda rows, target: _write(rows, target, columns, directories), table)
    if parts != state[table]:
        number += 1
        snapshots.commit(spark, path, state | {table: parts}, number)
    return number


def table_files(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(columns of the directories, file, bytes) of the files that count for ``table`` in the latest state."""
    _, state = snapshots.state_of(spark, path)
    columns = _directories(state, _partitioning(spark, path), table)
    listed = [
        snapshots.rows_of(spark, path, [p]).select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        for p in state[table]]
    return reduce(DataFrame.unionByName, listed).distinct()


def read_region(study: Study, region: filters.Region) -> Study:
    """Summary and family alleles of one region, read from its region bins only."""
    bin_filter = filters.region_bin_filter(study.partitioning, [region])
    summary = study.summary if bin_filter is None else study.summary.filter(bin_filter)
    family = study.family if bin_filter is None else study.family.filter(bin_filter)
    summary = summary.filter(filters.in_regions([region]))
    sites = summary.select("bucket_index", "summary_index").distinct()
    return Study(
        study.pedigree, summary, family.join(sites, ["bucket_index", "summary_index"], "left_semi"),
        study.partitioning, study.gene_bins)


def compact(spark: SparkSession, source: str, target: str, columns: list[str]) -> None:
    """Small files of every directory merged, at a new path."""
    rows = spark.read.parquet(source)
    _write(rows, target, columns, directory_columns(columns, _values(rows, columns)))


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows read from every file; unreadable files raise instead of being skipped."""
    df = spark.read.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").parquet(path)
    # a checksum over every column makes Spark decode all pages, not only the footers
    return df.withColumn("_file", F.col("_metadata.file_name")).groupBy("_file").agg(
        F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*[F.to_json(F.struct(*df.columns))])).alias("checksum"))


def reannotate(study: Study, annotations: DataFrame, path: str, drop: list[str] | None = None, metadata: dict[str, str] | None = None) -> None:
    """A stored study rewritten at a new path with other annotation columns."""
    from dataclasses import replace

    from kinfold.operators.variants import annotate
    bins_used = study.partitioning.family_columns
    touched = {*(drop or []), *annotations.columns} & {"af_allele_count", "af_allele_freq", "effect_gene"}
    family = study.family.drop(*bins_used) if touched else study.family
    fresh = replace(study, summary=annotate(study.summary.drop(*bins_used), annotations, drop), family=family)
    write_study(fresh, path, metadata, binned=not touched)


def compare(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Rows on one side only and differing values per column, as ``(item, differences)``.

    Real numbers may differ by ``tolerance``.
    """
    values = [c for c in left.columns if c not in keys and c in right.columns]
    l = left.select(*keys, F.struct(F.lit(True).alias("there"), *values).alias("l"))
    r = right.select(*keys, F.struct(F.lit(True).alias("there"), *values).alias("r"))
    joined = l.join(r, keys, "full")
    types = dict(left.dtypes)
    both = F.col("l").isNotNull() & F.col("r").isNotNull()

    def differs(name: str):
        a, b = F.col(f"l.`{name}`"), F.col(f"r.`{name}`")
        if types[name] in ("double", "float"):
            same = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
        else:
            same = a.eqNullSafe(b)
        return F.count(F.when(both & ~same, 1))

    items = {"only left": F.count(F.when(F.col("r").isNull(), 1)), "only right": F.count(F.when(F.col("l").isNull(), 1))}
    items.update({name: differs(name) for name in values})
    counted = joined.agg(F.array(*[
        F.struct(F.lit(n).alias("item"), c.alias("differences")) for n, c in items.items()]).alias("x"))
    return counted.select(F.explode("x").alias("x")).select("x.item", "x.differences")
