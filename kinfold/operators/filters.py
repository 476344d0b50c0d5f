"""Variant filters as boolean Columns, and the id filters that need a join.

Short argument lists become Column predicates, which Catalyst pushes into the Parquet scan. Id
collections that grow with the data come as DataFrames and become semi joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import bins, codes, flags

GENE_REGION_PAD = 20_000


@dataclass(frozen=True)
class Region:
    """Closed interval; open ends are None."""

    chrom: str
    start: int | None = None
    stop: int | None = None

    @staticmethod
    def parse(text: str) -> "Region":
        chrom, _, span = text.replace(",", "").partition(":")
        start, dash, stop = span.partition("-")
        if not span:
            return Region(chrom)
        return Region(chrom, int(start), int(stop) if dash else int(start))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def repair_chromosomes(regions: list[Region], chromosomes: list[str], prefix: str) -> list[Region]:
    """Add or drop the ``chr`` prefix of regions whose chromosome the study does not know."""
    repaired = []
    for region in regions:
        chrom = region.chrom
        if chrom not in chromosomes:
            if prefix == "chr":
                chrom = f"chr{chrom}"
            elif prefix == "" and chrom.startswith("chr"):
                chrom = chrom[3:]
        repaired.append(Region(chrom, region.start, region.stop))
    return repaired


def in_regions(regions: list[Region]) -> Column:
    """Overlap with any region; an empty list matches nothing."""
    end = F.coalesce(F.col("end_position"), F.col("position"))

    def overlap(region: Region) -> Column:
        conditions = [F.col("chromosome") == region.chrom]
        if region.start is not None:
            conditions.append(end >= region.start)
        if region.stop is not None:
            conditions.append(F.col("position") <= region.stop)
        return _all(conditions)

    return _any([overlap(r) for r in regions])


def join_regions(variants: DataFrame, regions: DataFrame, bin_length: int = 100_000) -> DataFrame:
    """Rows overlapping any region of a long region table ``(chrom, start, stop)``.

    Regions are cut at bin borders and variants are put into every bin they touch, so the overlap
    test runs on an equi join over ``(chromosome, bin)``; the semi join keeps each row once.
    Regions that overlap or touch each other are merged first.
    """
    merged = merge_intervals(regions.select(
        F.col("chrom").alias("key"), F.col("start").alias("begin"), F.col("stop").alias("finish")))
    pieces = merged.withColumn("bin", F.explode(F.sequence(
        F.floor(F.col("begin") / bin_length), F.floor(F.col("finish") / bin_length))))
    pieces = pieces.select(F.col("key").alias("_c"), F.col("bin").alias("_b"), "begin", "finish")
    end = F.coalesce(F.col("end_position"), F.col("position"))
    names = variants.columns
    touched = F.sequence(F.floor(F.col("position") / bin_length), F.floor(end / bin_length))
    short = variants.filter(F.size(touched) == 1).withColumn("_bin", F.get(touched, F.lit(0)))
    long = variants.filter(F.size(touched) > 1)
    overlap = (F.col("begin") <= end) & (F.col("finish") >= F.col("position"))
    hit_short = short.join(
        pieces, (F.col("chromosome") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & overlap,
        "left_semi").select(names)
    tagged = long.withColumn("_row", F.xxhash64("chromosome", "position", end)).withColumn("_bin", F.explode(touched))
    hits = tagged.join(
        pieces, (F.col("chromosome") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & overlap,
        "left_semi")
    spans = hits.select("chromosome", "position", end.alias("_end")).distinct()
    hit_long = long.alias("v").join(
        spans.alias("h"),
        (F.col("v.chromosome") == F.col("h.chromosome")) & (F.col("v.position") == F.col("h.position"))
        & (F.coalesce(F.col("v.end_position"), F.col("v.position")) == F.col("h._end")), "left_semi")
    return hit_short.unionByName(hit_long.select(names))


def merge_intervals(intervals: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Union of the closed intervals ``(key, begin, finish)`` per key.

    A key may hold a large share of all rows, so no window runs over a whole key. Intervals are cut
    at block borders and merged inside each ``(key, block)``, and the few merged pieces that touch
    a border are then chained over the blocks of the key.
    """
    from pyspark.sql import Window as W

    first = F.floor(F.col("begin") / block)
    last = F.floor(F.col("finish") / block)
    cut = (
        intervals.select("key", F.col("begin").cast("long"), F.col("finish").cast("long"))
        .withColumn("blk", F.explode(F.sequence(first, last)))
        .withColumn("begin", F.greatest("begin", F.col("blk") * block))
        .withColumn("finish", F.least("finish", F.col("blk") * block + block - 1)))
    # map-side reduction: of the pieces with the same begin only the longest matters
    cut = cut.groupBy("key", "blk", "begin").agg(F.max("finish").alias("finish"))

    def chain(df: DataFrame, keys: list[str]) -> DataFrame:
        order = W.partitionBy(*keys).orderBy("begin", "finish")
        reach = F.max("finish").over(order.rowsBetween(W.unboundedPreceding, -1))
        starts = F.coalesce((F.col("begin") > reach + 1).cast("int"), F.lit(1))
        grouped = df.withColumn("_s", starts).withColumn(
            "_g", F.sum("_s").over(order.rowsBetween(W.unboundedPreceding, 0)))
        return grouped.groupBy(*keys, "_g").agg(
            F.min("begin").alias("begin"), F.max("finish").alias("finish")).drop("_g")

    local = chain(cut, ["key", "blk"])
    at_border = (F.col("begin") == F.col("blk") * block) | (F.col("finish") == F.col("blk") * block + block - 1)
    inner = local.filter(~at_border).select("key", "begin", "finish")
    bridged = chain(local.filter(at_border).select("key", "begin", "finish"), ["key"])
    return inner.unionByName(bridged)


def gene_regions(gene_models: DataFrame, genes: list[str] | DataFrame, pad: int = GENE_REGION_PAD) -> DataFrame:
    """Padded extents ``(chrom, start, stop)`` of any number of genes, one per gene and chromosome.

    Genes come as a list or in a DataFrame column ``gene``; those without a model have no region.
    """
    if isinstance(genes, list):
        genes = gene_models.sparkSession.createDataFrame([(g,) for g in genes], "gene string")
    return (
        gene_models.join(genes.select("gene").distinct(), "gene", "left_semi").groupBy("gene", "chrom")
        .agg(F.min("cds_start").alias("start"), F.max("cds_end").alias("stop"))
        .select("chrom", F.greatest(F.col("start") - pad, F.lit(1)).alias("start"), (F.col("stop") + pad).alias("stop")))


def genes_and_effects(genes: list[str] | None, effect_types: list[str] | None) -> Column:
    """Both conditions hold on the same gene/effect pair; empty lists match missing values."""
    def pair(g: Column) -> Column:
        conditions = []
        if genes is not None:
            symbol = g["effect_gene_symbols"]
            conditions.append(symbol.isin(list(genes)) if genes else symbol.isNull())
        if effect_types is not None:
            effect = g["effect_types"]
            conditions.append(effect.isin(list(effect_types)) if effect_types else effect.isNull())
        return _all(conditions)
    return F.exists("effect_gene", pair)


def by_gene_table(alleles: DataFrame, genes: DataFrame, effect_types: list[str] | None = None) -> DataFrame:
    """As ``genes_and_effects`` with the genes in a DataFrame column ``gene``."""
    pairs = alleles.select("sj_index", F.explode("effect_gene").alias("g"))
    if effect_types is not None:
        pairs = pairs.filter(F.col("g.effect_types").isin(list(effect_types)))
    hits = pairs.join(
        genes.select("gene"), F.col("g.effect_gene_symbols") == F.col("gene"), "left_semi")
    return alleles.join(hits.select("sj_index"), "sj_index", "left_semi")


def real_attribute(name: str, low: float | None, high: float | None) -> Column:
    """Closed range; without bounds the value must exist."""
    column = F.col(name)
    if low is None and high is None:
        return column.isNotNull()
    return _all([column >= low] * (low is not None) + [column <= high] * (high is not None))


def frequency(name: str, low: float | None, high: float | None) -> Column:
    """Closed range; a missing value passes when there is no lower bound."""
    if low is None and high is None:
        return F.lit(True)
    if low is None:
        return (F.col(name) <= high) | F.col(name).isNull()
    return real_attribute(name, low, high)


def ultra_rare() -> Column:
    return frequency("af_allele_count", None, 1)


def categorical_attribute(name: str, values: list | None) -> Column:
    """None matches missing values, an empty list present ones."""
    column = F.col(name)
    if values is None:
        return column.isNull()
    if not values:
        return column.isNotNull()
    if len({str if isinstance(v, str) else int if isinstance(v, int) else object for v in values}) != 1 or not all(
            isinstance(v, (str, int)) for v in values):
        raise TypeError(f"values must be all text or all integers: {values}")
    return column.isin(list(values))


def in_families(ids: list[str]) -> Column:
    return F.col("family_id").isin(list(ids)) if ids else F.lit(False)


def carried_by(ids: list[str]) -> Column:
    """Any carrier among the listed persons."""
    return F.arrays_overlap("allele_in_members", F.array(*[F.lit(i) for i in ids])) if ids else F.lit(False)


def carried_by_table(alleles: DataFrame, persons: DataFrame) -> DataFrame:
    """Any carrier among the persons ``(family_id, person_id)``.

    The wanted persons of a family become one array, so the family rows are joined once on the
    family and compared in place; nothing is unfolded.
    """
    wanted = persons.groupBy("family_id").agg(F.collect_set("person_id").alias("_wanted"))
    return alleles.join(wanted, "family_id").filter(
        F.arrays_overlap("allele_in_members", "_wanted")).drop("_wanted")


def pedigree_matches(
    ped: DataFrame, positive: list[dict[str, object]], negative: list[dict[str, object]] = (),
) -> DataFrame:
    """Persons matching any positive description and no negative one.

    A description lists pedigree fields that must all be equal.
    """
    def same(fields: dict[str, object]) -> list[Column]:
        return [F.col(name) == value for name, value in fields.items()]

    wanted = _any([_all(same(d)) for d in positive]) if positive else F.lit(True)
    unwanted = _all([_any([~c for c in same(d)]) for d in negative])
    return ped.filter(wanted & unwanted).select("family_id", "person_id")


def variant_id() -> Column:
    """``location:variant`` of an allele with its short notation in ``variant``."""
    return F.concat_ws(":", F.col("location"), F.col("variant"))


# ---- partition pruning ----------------------------------------------------------------------

def region_bin_filter(partitioning: bins.Partitioning, regions: list[Region] | None) -> Column | None:
    """Bins that can hold rows of the regions, as bounds on the number of the bin.

    Rows are binned by their start and those in numbered bins are no longer than a bin, so the one before a region counts
    too, and so do the chromosome's long rows.
    """
    if "region_bin" not in partitioning.summary_columns or regions is None:
        return None
    name = F.col("region_bin").cast("string")
    length = partitioning.region_length

    def touched(region: Region) -> Column:
        first = max(((region.start or 1) - 1) // length - 1, 0)
        last = None if region.stop is None else (max(region.stop, 1) - 1) // length
        if partitioning.integer_region_bins:
            base = int(partitioning.bin_name(region.chrom, 0))
            top = bins.INTEGER_BIN_STRIDE - 2 if region.chrom in partitioning.chromosomes else None
            number = name.cast("long") - base
        else:
            prefix, top = partitioning.bin_name(region.chrom, 0)[:-1], None
            number = F.when(F.startswith(name, F.lit(prefix)), F.expr(f"try_cast(substring(CAST(region_bin AS STRING), {len(prefix) + 1}) AS BIGINT)"))
        last = top if last is None else last if top is None else min(last, top)
        inside = (number >= first) & (F.lit(True) if last is None else number <= last)
        return F.coalesce(inside, F.lit(False)) | (name == partitioning.long_bin_name(region.chrom))

    return _any([touched(r) for r in regions])


def bins_of_genes(gene_bins: DataFrame, genes: list[str] | DataFrame) -> DataFrame:
    """Region bins that hold rows of the genes, a list or a DataFrame column ``gene``."""
    rows = (
        gene_bins.filter(F.col("gene").isin(list(genes))) if isinstance(genes, list)
        else gene_bins.join(genes.select("gene"), "gene", "left_semi"))
    return rows.select("region_bin").distinct()


def coding_bin_filter(partitioning: bins.Partitioning, effect_types: list[str] | None) -> Column | None:
    """Only coding effects requested: only the coding bin can match."""
    if not partitioning.coding_effects or not effect_types:
        return None
    return F.col("coding_bin") == 1 if set(effect_types) <= set(partitioning.coding_effects) else None


def frequency_bin_filter(
    partitioning: bins.Partitioning, inheritance: list[str] | None, is_ultra_rare: bool,
    frequencies: list[tuple[str, float | None, float | None]] | None,
) -> Column | None:
    """De-novo-only queries read bin 0; upper frequency bounds read the bins up to that bound."""
    if "frequency_bin" not in partitioning.family_columns:
        return None
    if inheritance and flags.denovo_only_inheritance(inheritance):
        return F.col("frequency_bin") == 0
    highest = 1 if is_ultra_rare else None
    for name, _, high in frequencies or []:
        if name != "af_allele_freq":
            continue
        if high is None or high > partitioning.rare_boundary:
            continue
        highest = 2 if highest is None else min(highest, 2)
    return None if highest is None else F.col("frequency_bin") <= highest


def family_bin_filter(partitioning: bins.Partitioning, family_ids: list[str] | None) -> Column | None:
    """The bins of the requested families."""
    if partitioning.family_bins <= 0 or family_ids is None:
        return None
    return F.col("family_bin").isin(sorted({bins.family_bin_of(f, partitioning.family_bins) for f in family_ids}))


# ---- person filters -------------------------------------------------------------------------

def persons_with_value(
    ped: DataFrame, criterion: str, values: list[str], roles: list[str] | None = None,
) -> DataFrame:
    """Persons whose pedigree field, read as text, is one of the values."""
    decoders = {"sex": codes.SEXES, "status": codes.STATUSES, "role": codes.ROLES}
    column = F.col(criterion)
    text = codes.decode(decoders[criterion], column) if criterion in decoders else column.cast("string")
    rows = ped.filter(text.isin(list(values)))
    return _with_roles(rows, roles).select("person_id").distinct()


def persons_in_range(
    ped: DataFrame, criterion: str, low: float | None, high: float | None, roles: list[str] | None = None,
) -> DataFrame:
    return _with_roles(ped.filter(real_attribute(criterion, low, high)), roles).select("person_id").distinct()


def _with_roles(rows: DataFrame, roles: list[str] | None) -> DataFrame:
    return rows if roles is None else rows.filter(F.col("role").isin([codes.ROLES[r] for r in roles]))


def persons_by_measure(
    ped: DataFrame, measures: DataFrame, measure: str, values: list | None = None,
    low: float | None = None, high: float | None = None, roles: list[str] | None = None,
) -> DataFrame:
    """Pedigree persons whose measure is one of the values, or lies in a closed range."""
    condition = (
        F.col(f"`{measure}`").isin(list(values)) if values is not None
        else real_attribute(f"`{measure}`", low, high))
    ids = measures.filter(condition).select("person_id")
    return _with_roles(ped, roles).join(ids, "person_id", "left_semi").select("person_id").distinct()


def families_of(ped: DataFrame, persons: DataFrame) -> DataFrame:
    return ped.join(persons, "person_id", "left_semi").select("family_id").distinct()


def intersect_ids(id_tables: list[DataFrame]) -> DataFrame:
    """Ids present in every table."""
    return reduce(DataFrame.intersect, id_tables)
