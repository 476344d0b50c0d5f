"""Family, variant and phenotype tables derived from the provided tables.

Every rule here is plain arithmetic on whole tables and is repeated in ``checks.base_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import bins
from kinfold.operators import pedigree, variants
from kinfold.operators.person_sets import Collection, PersonSet
from kinfold.plans.study import Study

PAR = [("chrX", 1, 40_000)]
PARTITIONING = bins.Partitioning(
    region_length=100_000, chromosomes=("chr1", "chr2", "chr3"), rare_boundary=5.0,
    coding_effects=bins.coding_effects(["coding"]), family_bins=8)
EFFECT_OF_TYPE = {
    "STANDARD": "missense", "PROMO": "synonymous", "SMALL": "nonsense",
    "MEDIUM": "frame-shift", "ECONOMY": "splice-site", "LARGE": "intergenic",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four customers form a family: mom, dad, proband, sibling."""
    c = table(spark, sf_dir, "customer")
    idx = F.col("c_custkey") % 4
    fam = F.floor(F.col("c_custkey") / 4).cast("long")
    parent = lambda i: F.when(idx >= 2, F.concat(F.lit("P"), (fam * 4 + i).cast("string")))
    sex = (
        F.when(idx == 0, 2).when(idx == 1, 1)
        .when((idx == 3) & (F.col("c_mktsegment") == "HOUSEHOLD"), 4)
        .otherwise(1 + F.col("c_nationkey") % 2))
    status = (
        F.when(idx == 2, 2).when((idx == 3) & (F.col("c_nationkey") % 5 == 0), 2)
        .when((idx == 0) & (F.col("c_mktsegment") == "MACHINERY"), 4).otherwise(1))
    role = F.when(idx == 0, 16).when(idx == 1, 32).when(idx == 2, 128).otherwise(256)
    return c.select(
        F.concat(F.lit("F"), fam.cast("string")).alias("family_id"),
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("person_id"),
        parent(0).alias("mom_id"), parent(1).alias("dad_id"),
        sex.cast("int").alias("sex"), status.cast("int").alias("status"), role.cast("int").alias("role"),
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("sample_id"),
        F.lit(False).alias("generated"), (F.col("c_acctbal") < -900).alias("not_sequenced"),
        idx.cast("int").alias("member_index"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a site with one or two alternatives, a copy-number event or a repeat."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    cnv = size % 10 == 7
    kind = size % 4
    pos = (1 + key * 100).cast("int")
    repeat = size % 10 == 5
    ref = (
        F.when(cnv, F.lit(None)).when(repeat, "ACACAC")
        .when(kind == 0, "A").when(kind == 1, "A").when(kind == 2, "ACT").otherwise("ACT"))
    alt = (
        F.when(repeat, "ACACACAC").when(kind == 0, "C").when(kind == 1, "AGT")
        .when(kind == 2, "A").otherwise("GG"))
    two = (size % 3 == 0) & ~cnv
    alternatives = F.when(cnv, F.array(F.lit(None).cast("string"))).when(
        two, F.array(alt, F.concat(alt, F.lit("T")))).otherwise(F.array(alt))
    effect = F.lit(None)
    for word, name in EFFECT_OF_TYPE.items():
        effect = F.when(F.col("p_type") == word, name).otherwise(effect)
    main = F.struct(F.col("p_brand").alias("effect_gene_symbols"), effect.alias("effect_types"))
    second = F.struct(
        F.concat(F.lit("Brand#"), (1 + size % 25).cast("string")).alias("effect_gene_symbols"),
        F.lit("intron").alias("effect_types"))
    return p.select(
        F.lit(1).alias("bucket_index"), key.cast("int").alias("summary_index"),
        F.when(key % 5 == 4, "chrX").otherwise(F.concat(F.lit("chr"), (1 + key % 5).cast("string"))).alias("chromosome"),
        pos.alias("position"),
        F.when(cnv, pos + size * 100).otherwise(pos + F.length(ref) - 1).cast("int").alias("end_position"),
        ref.cast("string").alias("reference"), alternatives.alias("alternatives"),
        F.when(cnv, F.when(size > 25, 32).otherwise(16)).cast("int").alias("variant_type"),
        F.lit(1).alias("transmission_type"),
        F.when(size % 5 == 0, F.array(main, second)).otherwise(F.array(main)).alias("effect_gene"),
        (size % 9 == 0).alias("rare"),
        F.when(size % 7 != 0, F.col("p_retailprice")).alias("score"),
        F.when(size % 6 != 0, F.col("p_name")).alias("label"))


FLAGS = ("A", "N", "R")


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order line of a family for a part, as ``(summary_index, family, w)``.

    Order key, line number, quantity and flag are packed into one number, so the first line is a plain minimum.
    """
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    flags = F.array(*[F.lit(f) for f in FLAGS])
    packed = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + F.col("l_quantity").cast("long")) * 4 + (
        F.array_position(flags, F.col("l_returnflag")) - 1)
    # Lines are narrow when they are shuffled. Partitioned by site, they meet both their families' other lines and the site there.
    lines = li.filter("l_partkey IS NOT NULL").select("l_orderkey", F.col("l_partkey").cast("int").alias("summary_index"), packed.alias("packed"))
    of_family = o.filter("o_custkey IS NOT NULL").select("o_orderkey", F.floor(F.col("o_custkey") / 4).cast("long").alias("family"))
    return (
        lines.join(of_family, F.col("l_orderkey") == F.col("o_orderkey")).repartition("summary_index")
        .groupBy("summary_index", "family").agg(F.min("packed").alias("w")))


def calls(
    spark: SparkSession, sf_dir: str, extra: list[str] = (), of_sites: DataFrame | None = None, first: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """The first order line of a family for a part is the family's genotype at that site.

    ``extra`` may name ``flag``, the line's return flag. With ``of_sites`` (bucket_index, summary_index), only calls at these sites
    become genotypes. ``first`` are the first lines where they are written already. With ``facts`` (``store.site_facts``), calls at
    the sites that have some bring them.
    """
    flags = F.array(*[F.lit(f) for f in FLAGS])
    first = first_lines(spark, sf_dir) if first is None else first
    s = sites(spark, sf_dir).select(
        "bucket_index", "summary_index", "chromosome", "position", "rare", F.size("alternatives").alias("n_alts"))
    if of_sites is not None:
        s = s.join(of_sites, variants.KEY, "left_semi")
    if facts is not None:
        s, extra = s.join(facts, variants.KEY), [*extra, "facts"]
    layout = _member_columns(pedigree.layout(ped(spark, sf_dir))).withColumn("family", F.substring("family_id", 2, 20).cast("long"))
    joined = first.join(s, "summary_index").join(layout, "family").withColumns({
        "flag": F.get(flags, (F.col("w") % 4).cast("int")), "w": F.floor(F.col("w") / 4)})
    q = (F.col("w") % 64).cast("int")
    ln = (F.floor(F.col("w") / 64) % 8).cast("int")
    n = F.col("n_alts")
    on_x = (F.col("chromosome") == "chrX") & ~F.col("position").between(PAR[0][1], PAR[0][2])
    absent = F.col("rare") & (F.col("q") < 47)

    def side1(idx: int):
        here = F.col("q") + idx
        return F.when(here % 17 == 0, -1).when(absent, 0).when(here % 3 == 0, 1 + (F.col("q") + F.col("ln")) % n).otherwise(0).cast("int")

    def side2(idx: int):
        here = F.col("q") + idx
        return F.when(here % 17 == 0, -1).when(absent, 0).when((here + F.col("ln") + idx) % 4 == 0, 1 + here % n).otherwise(0).cast("int")

    # The sides of every possible member are plain numbers of the line, and a member looks its own up. Both sides are in one column:
    # Catalyst moves a column that is used once into the lookup, which would list the sides again for every member.
    second = [side2(i) for i in range(4)]
    sides = F.array(*[side1(i) for i in range(4)], *second, *[F.when(F.col("on_x"), -2).otherwise(side) for side in second])
    listed = joined.withColumns({"q": q, "ln": ln, "on_x": on_x}).withColumn("sides", sides)
    called = listed.withColumns({
        "a1": F.transform("which", lambda i: F.get("sides", i % 4)), "a2": F.transform("which", lambda i: F.get("sides", i + 4))})
    return called.select(
        "bucket_index", "summary_index", "family_id", *extra, F.arrays_zip(*variants.MEMBER_FIELDS, "a1", "a2").alias("members"))


def _member_columns(layout: DataFrame) -> DataFrame:
    """Families with one array for each member field, and with ``which``: 0 mom, 1 dad, 2 proband, 3 others, 4 more for a single X copy."""
    def which(m):
        idx = F.when(m["role"] == 16, 0).when(m["role"] == 32, 1).when(m["role"] == 128, 2).otherwise(3)
        return idx + F.when(m["sex"].isin(1, 4), 4).otherwise(0)

    return layout.select(
        "family_id", *[F.col("members")[f].alias(f) for f in variants.MEMBER_FIELDS], F.transform("members", which).alias("which"))


def founders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pedigree.with_parent_flags(ped(spark, sf_dir)).filter("is_founder").agg(
        F.count("*").alias("founders"))


def family(spark: SparkSession, sf_dir: str, extra: list[str] = (), called: DataFrame | None = None, **modes) -> DataFrame:
    modes = {"denovo_mode": "denovo", "omission_mode": "omission", **modes}
    return variants.family_alleles(calls(spark, sf_dir, extra) if called is None else called, **modes)


def family_of(spark: SparkSession, sf_dir: str, sites: DataFrame) -> DataFrame:
    """The family alleles of the ``sites`` (bucket_index, summary_index)."""
    return family(spark, sf_dir, called=calls(spark, sf_dir, of_sites=sites))


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.summary_alleles(sites(spark, sf_dir))


def study(spark: SparkSession, sf_dir: str, counters: bool = False, frequencies: bool = False, called: DataFrame | None = None) -> Study:
    """``counters`` and ``frequencies`` add the aggregated summary columns. ``called`` are the calls where they are written already."""
    fa = family(spark, sf_dir, called=called)
    sa = alleles(spark, sf_dir)
    if frequencies:
        freq = variants.allele_frequencies(calls(spark, sf_dir) if called is None else called, founders(spark, sf_dir))
        sa = variants.with_frequency(sa, freq)
    if counters:
        sa = variants.stored_summary(sa, fa)
    return Study(ped(spark, sf_dir), sa, fa)


# ---- side tables ------------------------------------------------------------------------------

def gene_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five neighbouring sites of a chromosome walk are the overlapping transcripts of a gene."""
    gene = F.concat(F.lit("G"), F.floor(F.col("summary_index") / 25).cast("long").cast("string"))
    p = sites(spark, sf_dir).select("chromosome", "position", gene.alias("gene"), "summary_index")
    size = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("summary_index"), "p_size")
    return p.join(size, "summary_index").select(
        "gene", F.col("chromosome").alias("chrom"), F.col("position").cast("long").alias("cds_start"),
        (F.col("position") + F.col("p_size") * 1000).cast("long").alias("cds_end"))


def gene_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.upper("p_brand").alias("gene")).agg(
        F.sum("p_size").cast("double").alias("gene_weight"))


def mutation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").groupBy(F.upper("p_brand").alias("gene")).agg(
        (F.sum(size) / 100000.0).alias("P_LGDS"), (F.sum(size * 2) / 100000.0).alias("P_MISSENSE"),
        (F.sum(size * 3) / 100000.0).alias("P_SYNONYMOUS"), F.lit(1.0).alias("M"), F.lit(1.25).alias("F"))


def gene_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scores: part sizes and counts per gene."""
    per_gene = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gene")).agg(
        F.sum("p_size").cast("double").alias("size_total"), F.count("*").cast("double").alias("sites"))
    return per_gene.selectExpr("gene", "stack(2, 'size_total', size_total, 'sites', sites) AS (score_id, value)")


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gene belongs to the set of every part type it has with a size above 40."""
    return table(spark, sf_dir, "part").filter("p_size > 40").select(
        F.lit("types").alias("collection_id"), F.col("p_type").alias("set_id"),
        F.concat(F.lit("large parts of type "), F.lower("p_type")).alias("desc"), F.col("p_brand").alias("gene")).distinct()


def instruments(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``i1`` covers every customer, ``i2`` only those with orders."""
    c = table(spark, sf_dir, "customer")
    person = F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("person_id")
    i1 = c.select(
        person, F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"))
    o = table(spark, sf_dir, "orders")
    i2 = o.groupBy(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("person_id")).agg(
        F.min("o_totalprice").alias("cheapest"), F.count("*").alias("orders"),
        F.min("o_orderpriority").alias("priority"))
    return {"i1": i1, "i2": i2}


def diagnosis() -> Collection:
    return Collection(
        "status", "Affected Status", (("pedigree", "status"),),
        (PersonSet("affected", "affected", ("affected",), "#e35252"),
         PersonSet("unaffected", "unaffected", ("unaffected",), "#ffffff")),
        PersonSet("unspecified", "unspecified", (), "#aaaaaa"))


def market() -> Collection:
    return Collection(
        "market", "Segment and sex", (("pedigree", "segment"), ("pedigree", "sex")),
        (PersonSet("machine_m", "machinery men", ("MACHINERY", "M")),
         PersonSet("machine_f", "machinery women", ("MACHINERY", "F")),
         PersonSet("building_m", "building men", ("BUILDING", "M"))),
        PersonSet("others", "others", ()))



# ---- stored study -------------------------------------------------------------------------------

_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> Study:
    """The derived study written once per application to the shared folder and read back."""
    from kinfold.session import scratch_dir, written
    from kinfold.sources import store

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_dir(spark)
        # frequencies, counters and family alleles all need the calls, whose lines are joined once and become genotypes where they are used
        first = written(first_lines(spark, sf_dir), scratch_dir(spark))
        full = study(spark, sf_dir, counters=True, frequencies=True, called=calls(spark, sf_dir, first=first))
        store.write_study(
            Study(full.pedigree, full.summary, full.family, PARTITIONING), path, {"source": "derived", "bins": "100000"},
            family_of=lambda facts: family(spark, sf_dir, called=calls(spark, sf_dir, first=first, facts=facts)))
        _STORED[key] = path
    return store.read_study(spark, _STORED[key])


def stored_path(spark: SparkSession, sf_dir: str) -> str:
    stored(spark, sf_dir)
    return _STORED[(spark.sparkContext.applicationId, sf_dir)]
