"""Coordinates moved to another assembly through chain blocks.

``chain`` rows are ``(chrom, start, stop, target_chrom, target_start, strand)`` and perhaps ``score``: positions
``start..stop`` map linearly; on strand ``-`` the target runs backwards from ``target_start``. ``read_chain`` reads them from
chain text. The blocks of a bin of positions are one row, so positions find theirs by an equi join on ``(chrom, bin)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import alleles

BIN = 100_000
OVERFLOW_FAMILIES = 20
COMPLEMENT = ("ACGTacgt", "TGCAtgca")


def read_chain(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Blocks ``(chrom, start, stop, target_chrom, target_start, strand, score)`` of chain text files.

    A chain is a header line ``chain score chrom size strand start end target size strand start end id`` and lines ``size gap gap``,
    and ends with an empty line. Its blocks begin where the sizes and gaps before them add up to; a reverse target is counted
    from its end. Lines that begin with ``#`` are left out; what is no chain is returned by ``unreadable_chains``.
    """
    return _blocks_of(_chains(spark, paths).filter("_ok"))


def unreadable_chains(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text of the chains that ``read_chain`` cannot read."""
    return _chains(spark, paths).filter("NOT _ok").select("file", F.array_join("_lines", "\n").alias("value"))


def _chains(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Chains as their header fields and lines; the empty line after a chain is what parts the text."""
    text = spark.read.text(paths, lineSep="\n\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), "value")
    lines = F.filter(F.split(F.translate("value", "\r", ""), "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    cut = text.withColumn("_lines", lines).filter(F.size("_lines") > 0).withColumn("_head", F.split(F.trim(F.get("_lines", F.lit(0))), r"\s+"))
    numbers = [F.get("_head", F.lit(k)).try_cast("long").isNotNull() for k in (3, 5, 6, 8, 10, 11)]
    rest = F.slice("_lines", F.lit(2), F.size("_lines"))
    ok = (F.get("_head", F.lit(0)) == "chain") & F.get("_head", F.lit(1)).try_cast("double").isNotNull() & F.get("_head", F.lit(9)).isin("+", "-")
    for number in numbers:
        ok = ok & number
    return cut.withColumn("_ok", F.coalesce(ok, F.lit(False)) & F.forall(rest, lambda x: x.rlike(r"^\s*\d+(\s+\d+\s+\d+)?\s*$"))).withColumn("_lines", F.when(
        F.col("_ok"), rest).otherwise(F.col("_lines")))


def _blocks_of(chains: DataFrame) -> DataFrame:
    field = lambda k: F.get("_head", F.lit(k))
    each = chains.select(
        "file", "part", F.array_join("_head", " ").alias("_chain"), field(2).alias("chrom"), field(5).cast("long").alias("_from"), field(7).alias("target_chrom"),
        field(8).cast("long").alias("_size"), field(9).alias("strand"), field(10).cast("long").alias("_to"), field(1).cast("double").alias("score"),
        F.posexplode("_lines").alias("_nth", "_line")).withColumn("_n", F.split(F.trim("_line"), r"\s+"))
    number = lambda k: F.coalesce(F.get("_n", F.lit(k)).cast("long"), F.lit(0))
    before = W.partitionBy("file", "part", "_chain").orderBy("_nth").rowsBetween(W.unboundedPreceding, -1)
    ahead = lambda k: F.coalesce(F.sum(number(0) + number(k)).over(before), F.lit(0))
    placed = each.withColumn("_start", F.col("_from") + ahead(1)).withColumn("_target", F.col("_to") + ahead(2))
    return placed.filter(number(0) > 0).select(
        "chrom", (F.col("_start") + 1).alias("start"), (F.col("_start") + number(0)).alias("stop"), "target_chrom",
        F.when(F.col("strand") == "-", F.col("_size") - F.col("_target")).otherwise(F.col("_target") + 1).alias("target_start"), "strand", "score")


BLOCK = ["start", "stop", "target_chrom", "target_start", "strand"]


def _blocks(chain: DataFrame, tag: str) -> DataFrame:
    """The blocks that reach into each bin in one row, those of the highest score first, so that no position meets two."""
    bins = F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("stop") / BIN))
    score = F.col("score") if "score" in chain.columns else F.lit(0.0)
    listed = F.array_sort(F.collect_list(F.struct((-score).alias("rank"), *BLOCK)))
    return chain.withColumn("_bin", F.explode(bins)).groupBy(F.col("chrom").alias(f"_{tag}_chrom"), F.col("_bin").alias(f"_{tag}_bin")).agg(listed.alias(f"_{tag}_blocks"))


def _attach(df: DataFrame, chain: DataFrame, tag: str, chrom: str, pos: Column) -> DataFrame:
    """Every row with the first block that covers its position, or nulls."""
    hit = df.withColumn(f"_{tag}_here", F.floor(pos / BIN)).join(
        _blocks(chain, tag), (F.col(chrom) == F.col(f"_{tag}_chrom")) & (F.col(f"_{tag}_here") == F.col(f"_{tag}_bin")), "left")
    block = F.get(F.filter(f"_{tag}_blocks", lambda b: (pos >= b["start"]) & (pos <= b["stop"])), F.lit(0))
    found = hit.withColumn(f"_{tag}", block)
    offset = pos - F.col(f"_{tag}.start")
    target = F.when(F.col(f"_{tag}.strand") == "-", F.col(f"_{tag}.target_start") - offset).otherwise(F.col(f"_{tag}.target_start") + offset)
    return found.withColumn(f"_{tag}_stop", F.col(f"_{tag}.stop")).withColumn(f"{tag}_target", target.cast("int")).withColumn(
        f"{tag}_target_chrom", F.col(f"_{tag}.target_chrom")).withColumn(f"{tag}_strand", F.col(f"_{tag}.strand"))


def _clean(df: DataFrame, *extra: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")], *extra)


def reverse_complement(text: Column) -> Column:
    return F.reverse(F.translate(text, *COMPLEMENT))


def lift_sites(df: DataFrame, chain: DataFrame, whole_allele: bool = True) -> DataFrame:
    """The rows of ``lift_sites_apart`` that have a place in the target assembly."""
    return lift_sites_apart(df, chain, whole_allele)[0]


def lift_sites_apart(df: DataFrame, chain: DataFrame, whole_allele: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(lifted, rejected)`` variant rows with ``chromosome, position, reference, alternative``.

    The source site of lifted rows stays in ``*_src`` columns. On the reverse strand alleles are reverse complemented. Of blocks that
    overlap, the one of the highest score counts. ``whole_allele`` also requires the last reference base to lie in the same
    block as the first; without it only the first base must map. Rejected rows are as they came, with the ``reason``.
    """
    mapped = _attach(df, chain, "a", "chromosome", F.col("position"))
    last = F.col("position") + F.greatest(F.length("reference"), F.lit(1)) - 1
    reason = F.when(F.col("a_target").isNull(), "no block covers the position")
    if whole_allele:
        reason = reason.when(last > F.col("_a_stop"), "the allele leaves its block")
    judged = mapped.withColumn("reason", reason)
    rejected = judged.filter("reason IS NOT NULL").select(*df.columns, "reason")
    mapped = judged.filter("reason IS NULL").drop("reason")
    backwards = F.col("a_strand") == "-"
    for name in ("chromosome", "position", "reference", "alternative"):
        mapped = mapped.withColumn(f"{name}_src", F.col(name))
    lifted = mapped.withColumn("position", F.when(
        backwards, F.col("a_target") - (last - F.col("position_src"))).otherwise(F.col("a_target")).cast("int"))
    lifted = lifted.withColumn("chromosome", F.col("a_target_chrom"))
    for name in ("reference", "alternative"):
        lifted = lifted.withColumn(name, F.when(backwards, reverse_complement(F.col(name))).otherwise(F.col(name)))
    return _clean(lifted, "a_target", "a_target_chrom", "a_strand"), rejected


def lift_intervals(df: DataFrame, chain: DataFrame) -> DataFrame:
    """The rows of ``lift_intervals_apart`` that have a place in the target assembly."""
    return lift_intervals_apart(df, chain)[0]


def lift_intervals_apart(df: DataFrame, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lifted, rejected)`` copy-number rows with both ends moved, and the size change in percent of the source size.

    ``large_change`` marks changes of 50 percent and more. Rows with an end that no block covers, or ends on different target
    chromosomes or strands, are rejected with the ``reason``.
    """
    mapped = _attach(_attach(df, chain, "a", "chromosome", F.col("position")), chain, "b", "chromosome", F.col("end_position"))
    judged = mapped.withColumn("reason", F.when(F.col("a_target").isNull(), "no block covers the start")
        .when(F.col("b_target").isNull(), "no block covers the end")
        .when(F.col("a_target_chrom") != F.col("b_target_chrom"), "the ends are on two chromosomes")
        .when(F.col("a_strand") != F.col("b_strand"), "the ends are on two strands"))
    same = judged.filter("reason IS NULL").drop("reason")
    old = (F.col("end_position") - F.col("position") + 1).cast("double")
    lo, hi = F.least("a_target", "b_target"), F.greatest("a_target", "b_target")
    change = 100.0 * F.abs(old - (hi - lo + 1)) / old
    where = lambda c, a, b: F.concat(c, F.lit(":"), a.cast("string"), F.lit("-"), b.cast("string"))
    lifted = same.withColumn("size_change", change).withColumn(
        "location_src", where(F.col("chromosome"), F.col("position"), F.col("end_position"))).withColumn(
        "_lo", lo).withColumn("_hi", hi)
    lifted = lifted.withColumn("chromosome", F.col("a_target_chrom")).withColumn("position", F.col("_lo")).withColumn(
        "end_position", F.col("_hi")).withColumn("location", where(F.col("chromosome"), F.col("position"), F.col("end_position")))
    lifted = lifted.withColumn("large_change", F.col("size_change") >= 50)
    cleaned = _clean(lifted, "a_target", "a_target_chrom", "a_strand", "b_target", "b_target_chrom", "b_strand")
    return cleaned, judged.filter("reason IS NOT NULL").select(*df.columns, "reason")


def transmitted_output(lifted: DataFrame, families: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(summary, overflow)`` lines of lifted transmitted variants.

    ``families`` rows ``(…keys, family_id, best_state, read_counts)`` are packed per variant; lists of
    20 and more families are long, so the summary says ``TOOMANY`` and the list goes to the
    overflow lines.
    """
    packed = families.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "family_id", "best_state", "read_counts"))), ";").alias("_list"))
    desc = alleles.variant_description(F.col("position"), F.col("reference"), F.col("alternative"))
    rows = lifted.join(packed, keys).withColumn("_d", desc)
    base = [
        F.col("chromosome").alias("#chr"), F.col("_d.position").alias("position"),
        alleles.full_notation(F.col("_d")).alias("variant")]
    many = F.col("_n") >= OVERFLOW_FAMILIES
    summary = rows.select(
        *base, F.when(many, "TOOMANY").otherwise(F.col("_list")).alias("familyData"),
        F.col("af_parents_called_count").alias("all.nParCalled"), F.col("af_parents_called_percent").alias("all.prcntParCalled"),
        F.col("af_allele_count").alias("all.nAltAlls"), F.col("af_allele_freq").alias("all.altFreq"))
    return summary, rows.filter(many).select(*base, F.col("_list").alias("familyData"))
