"""Readers, writers, stored studies with pruning, and liftover, on tables derived by Spark."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import derive
from checks.registry import register
from checks.variant_queries import PICK, RB, ROWS_SQL, folded, rows
from kinfold.functions import alleles, bins, genotypes
from kinfold.operators import filters, pedigree, variants
from kinfold.plans import gene_profiles, imports
from kinfold.plans import study as plan
from kinfold.session import scratch_dir
from kinfold.sources import call_tables, exports, liftover, pedigree_files, side_tables, store, vcf

# ---- stored studies -----------------------------------------------------------------------------

FB = "CASE WHEN (fa.inheritance & 4) <> 0 THEN 0 WHEN f.af_allele_count <= 1 THEN 1 WHEN f.af_allele_freq <= 5 THEN 2 ELSE 3 END"


@register("k01_partitioned_family_table", f"""
SELECT region_bin, frequency_bin, coding_bin, family_bin, count(*) AS alleles FROM (
  SELECT {RB} AS region_bin, {FB}::BIGINT AS frequency_bin, (fa.ai > 0 AND effect <> 'intergenic')::BIGINT AS coding_bin, {folded(8)}::BIGINT AS family_bin
  FROM fa JOIN sa t ON t.s = fa.s AND t.ai = greatest(fa.ai, 1) JOIN freq f ON f.s = fa.s AND f.ai = greatest(fa.ai, 1)) GROUP BY ALL""")
def k01_partitioned_family_table(spark, sf):
    return derive.stored(spark, sf).family.groupBy("region_bin", "frequency_bin", "coding_bin", "family_bin").agg(
        F.count("*").alias("alleles"))


@register("k02_stored_summary_alleles", "SELECT s::BIGINT AS s, ai::BIGINT AS ai, seen_in_status FROM summary")
def k02_stored_summary_alleles(spark, sf):
    return derive.stored(spark, sf).summary.select(
        F.col("summary_index").alias("s"), F.col("allele_index").alias("ai"), "seen_in_status")


@register("k03_stored_pedigree", f"SELECT person_id, sex::BIGINT AS sex, status::BIGINT AS status, {folded(8)}::BIGINT AS family_bin FROM ped")
def k03_stored_pedigree(spark, sf):
    return derive.stored(spark, sf).pedigree.select("person_id", "sex", "status", "family_bin")


@register("k04_study_metadata", base=False, sql="SELECT * FROM (VALUES ('source', 'derived'), ('bins', '100000')) t(key, value) WHERE (SELECT count(*) FROM part) > 0")
def k04_study_metadata(spark, sf):
    return store.read_metadata(spark, f"{derive.stored_path(spark, sf)}/meta")


@register("k05_compacted_summary", "SELECT s::BIGINT AS s, ai::BIGINT AS ai, family_variants_count::BIGINT AS family_variants FROM summary")
def k05_compacted_summary(spark, sf):
    source, target = f"{derive.stored_path(spark, sf)}/summary", scratch_dir(spark)
    store.compact(spark, source, target, derive.PARTITIONING.summary_columns)
    return spark.read.parquet(target).select(
        F.col("summary_index").alias("s"), F.col("allele_index").alias("ai"), F.col("family_variants_count").alias("family_variants"))


def copied_study(spark, sf):
    """Path of a copy of the stored study, to be changed."""
    path, study = scratch_dir(spark), derive.stored(spark, sf)
    store.write_study(replace(study, summary=study.summary.drop(*study.partitioning.family_columns)), path, binned=True)
    return path


@register("j15_withdrawn_from_stored_study", """, gone AS (SELECT family_id FROM ped WHERE segment = 'AUTOMOBILE' AND role = 16)
SELECT family_id, s::BIGINT AS s, ai::BIGINT AS ai, 'allele' AS stored FROM fa WHERE family_id NOT IN (SELECT family_id FROM gone)
UNION ALL SELECT family_id, count(*), NULL, 'persons' FROM ped WHERE family_id NOT IN (SELECT family_id FROM gone) GROUP BY 1""")
def j15_withdrawn_from_stored_study(spark, sf):
    """Alleles and numbers of persons of the families that stay, after two withdrawals from a stored study."""
    path = copied_study(spark, sf)
    gone = derive.ped(spark, sf).filter("segment = 'AUTOMOBILE' AND role = 16").select("family_id")
    odd = F.xxhash64("family_id") % 2 == 0
    store.withdraw_families(spark, path, gone.filter(odd))
    store.withdraw_families(spark, path, gone.filter(~odd))
    left = store.read_study(spark, path)
    found = left.family.select(
        "family_id", F.col("summary_index").cast("long").alias("s"), F.col("allele_index").cast("long").alias("ai"), F.lit("allele").alias("stored"))
    return found.unionByName(left.pedigree.groupBy("family_id").agg(
        F.count("*").alias("s"), F.lit(None).cast("long").alias("ai"), F.lit("persons").alias("stored")))


@register("s12_region_reader", "SELECT family_id, s::BIGINT AS s, ai::BIGINT AS ai FROM fa WHERE s IN (SELECT s FROM summary WHERE chromosome = 'chr2' AND end_position >= 40000 AND position <= 95000)")
def s12_region_reader(spark, sf):
    found = store.read_region(derive.stored(spark, sf), filters.Region("chr2", 40_000, 95_000))
    return found.family.select("family_id", F.col("summary_index").alias("s"), F.col("allele_index").alias("ai"))


def pruned(name, where, **query):
    """A query over the stored study with partition pruning."""
    @register(name, ROWS_SQL.format(where))
    def run(spark, sf):
        return rows(plan.query_variants(derive.stored(spark, sf), **query))


pruned("r01_region_pruning", "chromosome = 'chr1' AND end_position >= 30500 AND position <= 61000",
       regions=[filters.Region("chr1", 30_500, 61_000)])
pruned("r02_coding_pruning", "effect IN ('frame-shift', 'nonsense', 'splice-site')", effect_types=["lgds"])
pruned("r03_denovo_pruning", "(inheritance & 4) <> 0", inheritance="denovo")
pruned("r04_family_pruning", "family_id IN ('F3', 'F11')", family_ids=["F3", "F11"])
pruned("r05_all_bins_at_once", "chromosome = 'chr3' AND end_position >= 10000 AND position <= 90000 AND effect = 'missense' AND (inheritance & 4) <> 0",
       regions=[filters.Region("chr3", 10_000, 90_000)], effect_types=["missense"], inheritance="denovo")


@register("r03_frequency_pruning", f"{PICK} JOIN freq f ON f.s = v.s AND f.ai = v.ai WHERE f.af_allele_freq <= 5")
def r03_frequency_pruning(spark, sf):
    return rows(plan.query_variants(derive.stored(spark, sf), frequency_filter=[("af_allele_freq", None, 5.0)]))


@register("r03_ultra_rare_pruning", f"{PICK} JOIN freq f ON f.s = v.s AND f.ai = v.ai WHERE f.af_allele_count <= 1")
def r03_ultra_rare_pruning(spark, sf):
    return rows(plan.query_variants(derive.stored(spark, sf), ultra_rare=True))


def of_genes(names):
    return "gene IN ({0}) OR gene2 IN ({0})".format(", ".join(f"'{n}'" for n in names))


FEW_GENES, MANY_GENES = ["Brand#3", "Brand#8", "no such gene"], [f"Brand#{i}" for i in range(1, 26)] + ["no such gene"]
# bins come from the genes stored with the study, whatever their number and whether they are stored at all
pruned("r08_gene_region_pruning", of_genes(FEW_GENES), genes=FEW_GENES)
pruned("p05_pruning_by_many_genes", of_genes(MANY_GENES), genes=MANY_GENES)
pruned("p15_pruning_unknown_class", "(inheritance & 256) <> 0", inheritance="unknown")
pruned("p15_pruning_omission", "(inheritance & 16) <> 0", inheritance="omission")
pruned("p42_pruning_denovo_or_other", "(inheritance & 4) <> 0 AND (inheritance & 2) = 0", inheritance=["denovo", "not mendelian"])


def datasets(spark, sf):
    """The stored study, the same alleles in bins of another length, and unpartitioned, as one dataset."""
    stored = derive.stored(spark, sf)
    plain = stored.summary.drop(*derive.PARTITIONING.family_columns), stored.family.drop(*derive.PARTITIONING.family_columns)
    other = bins.Partitioning(region_length=20_000, chromosomes=("chr1", "chr2"), integer_region_bins=True)
    path = scratch_dir(spark)
    store.write_study(plan.Study(stored.pedigree, *plain, other), path)
    return plan.union_studies({"a": stored, "b": store.read_study(spark, path), "c": plan.Study(stored.pedigree, *plain)})


@register("u01_differently_partitioned_studies", "SELECT study_id, r.* FROM (" + ROWS_SQL.format(
    "chromosome = 'chr3' AND end_position >= 10000 AND position <= 90000 AND effect = 'missense'") + ") r CROSS JOIN (VALUES ('a'), ('b'), ('c')) t(study_id)")
def u01_differently_partitioned_studies(spark, sf):
    found = plan.query_variants(datasets(spark, sf), regions=[filters.Region("chr3", 10_000, 90_000)], effect_types=["missense"])
    return rows(found, "study_id")


@register("a07_smallest_study_of_shared_variants", "SELECT 'a' AS study_id, r.* FROM (" + ROWS_SQL.format("effect = 'nonsense'") + ") r")
def a07_smallest_study_of_shared_variants(spark, sf):
    return rows(plan.query_variants(datasets(spark, sf), effect_types=["nonsense"], unique=True), "study_id")


@register("d33_reannotated_study", "SELECT s::BIGINT AS s, ai::BIGINT AS ai, CASE WHEN NOT cnv THEN size::BIGINT * 10 END AS depth FROM summary")
def d33_reannotated_study(spark, sf):
    sizes = derive.table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("summary_index"), (F.col("p_size").cast("long") * 10).alias("depth"))
    notes = derive.alleles(spark, sf).join(sizes, "summary_index").filter("reference IS NOT NULL").select(
        "chromosome", "position", "reference", "alternative", "depth")
    target = scratch_dir(spark)
    store.reannotate(derive.stored(spark, sf), notes, target, drop=["score", "label"])
    return store.read_study(spark, target).summary.select(
        F.col("summary_index").alias("s"), F.col("allele_index").alias("ai"), "depth")


@register("d34_compared_tables", """
SELECT 'only left' AS item, count(*) FILTER (WHERE p_size > 48) AS differences FROM part UNION ALL SELECT 'only right', 0
UNION ALL SELECT 'p_retailprice', count(*) FILTER (WHERE p_size = 7) FROM part UNION ALL SELECT 'p_brand', count(*) FILTER (WHERE p_size = 9) FROM part""", base=False)
def d34_compared_tables(spark, sf):
    """Prices moved by less than the tolerance are equal, those of size 7 are not."""
    left = derive.table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_brand", "p_size")
    right = left.filter("p_size <= 48").withColumn(
        "p_retailprice", F.col("p_retailprice") + F.when(F.col("p_size") == 7, 0.01).otherwise(0.00001)).withColumn(
        "p_brand", F.when(F.col("p_size") == 9, "other").otherwise(F.col("p_brand")))
    return store.compare(left.drop("p_size"), right.drop("p_size"), ["p_partkey"])


@register("d35_verified_files", "SELECT count(*) AS alleles FROM summary")
def d35_verified_files(spark, sf):
    return store.file_counts(spark, f"{derive.stored_path(spark, sf)}/summary").agg(F.sum("rows").alias("alleles"))


# ---- VCF ----------------------------------------------------------------------------------------

_VCF: dict[tuple[str, str], str] = {}
#: Families with an even number are the first sample batch, the others the second.
BATCH = "bat AS (SELECT family_id, CAST(substr(family_id, 2) AS INT) % 2 AS b FROM members GROUP BY 1)"


def vcf_paths(spark, sf):
    """Two batches of compressed VCF text, one file per chromosome, written once per session from the calls.

    A line has a field for every sample, most of them ``./.``, so the text grows with sites times persons and its compressed form with the calls.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VCF:
        path = scratch_dir(spark)
        sites = derive.sites(spark, sf)
        for batch in (0, 1):
            calls = derive.calls(spark, sf).filter(F.substring("family_id", 2, 20).cast("int") % 2 == batch)
            people = calls.select("family_id", F.posexplode("members.person_id").alias("i", "person_id")).distinct().groupBy().agg(
                F.array_sort(F.collect_list(F.struct("family_id", "i", "person_id"))).alias("p"))
            samples = people.select(F.posexplode("p").alias("place", "x")).select("place", "x.person_id")
            lines = exports.vcf_lines(sites, calls, samples)
            columns = "\t".join(vcf.FIXED_COLUMNS)
            header = lines.select("chromosome").distinct().join(people.select(F.array_join("p.person_id", "\t").alias("names")), F.lit(True)).select(
                "chromosome", F.lit(0).alias("position"), F.concat(F.lit(f"#{columns}\t"), "names").alias("value"))
            (lines.unionByName(header).repartition("chromosome").sortWithinPartitions("chromosome", "position")
                .select("chromosome", "value").write.partitionBy("chromosome").text(f"{path}/{batch}", compression="gzip"))
        _VCF[key] = path
    return [[f"{_VCF[key]}/{batch}/*"] for batch in (0, 1)]


@register("k06_family_vcf_lines", """
SELECT family_id, count(*) + 1 AS lines FROM first_call WHERE family_id IN (SELECT family_id FROM members) GROUP BY 1""")
def k06_family_vcf_lines(spark, sf):
    return exports.family_vcf_lines(derive.sites(spark, sf), derive.calls(spark, sf)).groupBy("family_id").agg(
        F.count("*").alias("lines"))


KNOWN = "known AS (SELECT family_id, s FROM gt GROUP BY 1, 2 HAVING bool_or(a1 >= 0 OR a2 >= 0))"


def any_known():
    return F.exists("members", lambda m: (m["a1"] >= 0) | (m["a2"] >= 0))


@register("s03_vcf_sample_calls", f""", {KNOWN}
SELECT t.chromosome, t.position::BIGINT AS position, g.person_id, g.a1::BIGINT AS a1, g.a2::BIGINT AS a2
FROM gt g JOIN known USING (family_id, s) JOIN sites t ON t.s = g.s""")
def s03_vcf_sample_calls(spark, sf):
    """Calls of the families with a known copy, read from the text of two sample batches."""
    read = vcf.read(spark, vcf_paths(spark, sf), derive.ped(spark, sf))
    return read.calls.filter(any_known()).join(read.sites, ["bucket_index", "summary_index"]).select(
        "chromosome", "position", F.inline("members")).select("chromosome", "position", "person_id", "a1", "a2")


def filled_frequencies(name, fill, called, reference):
    @register(name, f""", {BATCH},
nf AS (SELECT family_id, count(*) FILTER (WHERE is_founder) AS founders FROM members GROUP BY 1),
has AS (SELECT DISTINCT g.s, bat.b FROM gt g JOIN bat USING (family_id)),
own AS (SELECT g.s, g.family_id, bool_and(a1 <> -1 AND a2 <> -1) AS good,
  sum(CASE WHEN is_founder THEN (a1 = 0)::INT + (a2 = 0)::INT ELSE 0 END) AS refs, count(*) FILTER (WHERE is_founder) AS founders FROM gt g GROUP BY 1, 2),
counted AS (SELECT s, coalesce(sum(founders) FILTER (WHERE good), 0) AS called, coalesce(sum(refs) FILTER (WHERE good), 0) AS refs FROM own GROUP BY 1),
away AS (SELECT s, sum(founders) AS founders FROM (SELECT DISTINCT s FROM gt) x, bat JOIN nf USING (family_id)
  WHERE NOT EXISTS (SELECT 1 FROM has WHERE has.s = x.s AND has.b = bat.b) GROUP BY 1)
SELECT t.chromosome, t.position::BIGINT AS position, ({called})::BIGINT AS called, ({reference})::BIGINT AS reference_copies
FROM counted c JOIN sites t ON t.s = c.s LEFT JOIN away a ON a.s = c.s""")
    def run(spark, sf):
        ped = derive.ped(spark, sf)
        read = vcf.read(spark, vcf_paths(spark, sf), ped, fill=fill)
        found = variants.allele_frequencies(read.calls, derive.founders(spark, sf), absent_are_reference=fill == 0)
        return read.sites.join(found, ["bucket_index", "summary_index"], "left").select(
            "chromosome", "position", F.coalesce("af_parents_called_count", F.lit(0)).cast("long").alias("called"),
            F.coalesce(F.try_element_at("_counts", F.lit(0)), F.lit(0)).cast("long").alias("reference_copies"))


# a site that a batch lacks is unknown in its families, or reference when filled so
filled_frequencies("s04_vcf_batches_merged", -1, "c.called", "c.refs")
filled_frequencies("s04_vcf_batches_filled_as_reference", 0, "c.called + coalesce(a.founders, 0)", "c.refs + 2 * coalesce(a.founders, 0)")


@register("s05_vcf_study_inputs", f""", {KNOWN}
SELECT family_id, t.chromosome, t.position::BIGINT AS position, string_agg(CASE WHEN a1 < 0 THEN '.' ELSE a1::VARCHAR END || '/'
  || CASE WHEN a2 < 0 THEN '.' ELSE a2::VARCHAR END, ';' ORDER BY idx) AS genotype
FROM gt JOIN known USING (family_id, s) JOIN sites t ON t.s = gt.s GROUP BY 1, 2, 3""")
def s05_vcf_study_inputs(spark, sf):
    read = vcf.read(spark, vcf_paths(spark, sf), derive.ped(spark, sf), fill=0, scratch=scratch_dir(spark))
    in_batch = read.calls.filter(any_known()).join(read.sites, ["bucket_index", "summary_index"])
    return in_batch.select("family_id", "chromosome", "position", genotypes.genotype_text(F.col("members")).alias("genotype"))


@register("k06_multi_sample_vcf_lines", f""", {BATCH},
people AS (SELECT DISTINCT g.person_id, g.family_id, g.idx, bat.b FROM gt g JOIN bat USING (family_id)),
seen AS (SELECT DISTINCT g.s, bat.b FROM gt g JOIN bat USING (family_id)),
cells AS (SELECT seen.s, seen.b, string_agg(CASE WHEN g.s IS NULL THEN './.' ELSE CASE WHEN g.a1 = -1 THEN '.' ELSE g.a1::VARCHAR END
    || CASE g.a2 WHEN -2 THEN '' WHEN -1 THEN '/.' ELSE '/' || g.a2 END END, chr(9) ORDER BY p.family_id, p.idx) AS calls
  FROM seen JOIN people p ON p.b = seen.b LEFT JOIN gt g ON g.s = seen.s AND g.person_id = p.person_id GROUP BY 1, 2)
SELECT b::BIGINT AS batch, t.chromosome, t.position::BIGINT AS position, concat_ws(chr(9), coalesce(t.reference, '.'),
  CASE WHEN t.alt1 IS NULL THEN '.' WHEN t.n_alts = 2 THEN t.alt1 || ',' || t.alt1 || 'T' ELSE t.alt1 END, '.', '.', '.', 'GT', calls) AS line
FROM cells JOIN sites t ON t.s = cells.s""")
def k06_multi_sample_vcf_lines(spark, sf):
    """The written lines as text, read back."""
    lines = None
    for batch, paths in enumerate(vcf_paths(spark, sf)):
        fields = vcf.read_lines(spark, paths).filter(F.get("f", F.lit(0)) != "#CHROM").select(
            F.lit(batch).alias("batch"), F.get("f", F.lit(0)).alias("chromosome"), F.get("f", F.lit(1)).cast("long").alias("position"),
            F.array_join(F.slice("f", 4, F.size("f")), "\t").alias("line"))
        lines = fields if lines is None else lines.unionByName(fields)
    return lines


@register("s07_samples_matched", "SELECT person_id, missing OR person_id NOT IN (SELECT person_id FROM gt) AS not_sequenced FROM ped")
def s07_samples_matched(spark, sf):
    lines = [vcf.read_lines(spark, paths) for paths in vcf_paths(spark, sf)]
    found = vcf.samples(lines[0]).unionByName(vcf.samples(lines[1]))
    return pedigree.match_samples(derive.ped(spark, sf), found, fixed=False).select("person_id", "not_sequenced")


@register("s16_chromosome_prefix", "SELECT s::BIGINT AS s, substr(chromosome, 4) AS plain, 'x_' || chromosome AS longer FROM sites")
def s16_chromosome_prefix(spark, sf):
    chrom = F.col("chromosome")
    return derive.sites(spark, sf).select(
        F.col("summary_index").alias("s"), vcf.adjusted_chrom(chrom, "chr", add=False).alias("plain"),
        vcf.adjusted_chrom(chrom, "x_").alias("longer"))


# ---- de-novo, transmitted and copy-number tables --------------------------------------------------

def denovo_table(spark, sf):
    """De-novo rows of alleles with a sequence, as a text table."""
    found = plan.query_variants(derive.study(spark, sf), inheritance="denovo").filter("reference IS NOT NULL")
    return found.select(
        F.concat_ws(":", "chromosome", F.col("position").cast("string")).alias("location"),
        F.col("reference").alias("ref"), F.col("alternative").alias("alt"),
        F.array_join("allele_in_members", ";").alias("person_id"))


@register("s08_denovo_table", """
SELECT chromosome, position::BIGINT AS position, reference, alternative, family_id, carriers FROM v WHERE (inheritance & 4) <> 0 AND NOT cnv""")
def s08_denovo_table(spark, sf):
    parsed = call_tables.denovo_rows(denovo_table(spark, sf), location="location")
    found = call_tables.denovo_by_person(parsed, derive.ped(spark, sf))
    return found.withColumn("carriers", F.array_join("carriers", ";")).select(
        "chromosome", "position", "reference", "alternative", "family_id", F.col("carriers").alias("carriers"))


@register("s09_denovo_study", """
SELECT d.chromosome, d.position::BIGINT AS position, d.alternative, d.family_id,
  coalesce(bit_or(CASE WHEN hap OR list_contains(string_split(d.carriers, ';'), m.person_id) THEN
    CASE WHEN list_contains(string_split(d.carriers, ';'), m.person_id) THEN m.role END END), 0)::BIGINT AS roles, count(*) FILTER (WHERE hap) AS haploid
FROM (SELECT * FROM v WHERE (inheritance & 4) <> 0 AND NOT cnv) d JOIN (SELECT *, sex IN (1, 4) AS one_x FROM members) m ON m.family_id = d.family_id,
  LATERAL (SELECT m.one_x AND d.chromosome = 'chrX' AND NOT d.position BETWEEN 1 AND 40000 AS hap) GROUP BY 1, 2, 3, 4""")
def s09_denovo_study(spark, sf):
    ped = derive.ped(spark, sf)
    parsed = call_tables.denovo_by_person(call_tables.denovo_rows(denovo_table(spark, sf), location="location"), ped)
    sites, calls = call_tables.denovo_study_inputs(parsed, ped, derive.PAR)
    built = imports.build_study(sites, calls, ped, frequencies=False, denovo_source=True)
    haploid = F.size(F.filter("genotype", lambda m: m["a2"] == -2))
    return plan.query_variants(built).select(
        "chromosome", "position", "alternative", "family_id", F.col("allele_in_roles").alias("roles"), haploid.alias("haploid"))


@register("s10_transmitted_table", """
SELECT s.chromosome AS chrom, (s.s * 3 + a.ai - 1)::BIGINT AS position, a.variant, f.family_id, f.sizes
FROM sites s JOIN sa a ON a.s = s.s AND NOT a.cnv JOIN (
  SELECT g.s, g.family_id, count(*) AS sizes FROM gt g JOIN (SELECT s, min(family_id) AS family_id FROM gt GROUP BY 1) k USING (s, family_id) GROUP BY 1, 2) f ON f.s = s.s""")
def s10_transmitted_table(spark, sf):
    """One line per allele with the first family of its site; chrX lists are in the overflow table."""
    first = derive.calls(spark, sf).groupBy("bucket_index", "summary_index").agg(F.min(F.struct("family_id", F.size("members").alias("n"))).alias("w"))
    zeros = lambda c: F.repeat(F.lit(c), F.col("w.n"))
    lines = derive.alleles(spark, sf).filter("reference IS NOT NULL").join(first, ["bucket_index", "summary_index"]).select(
        F.col("chromosome").alias("#chr"), (F.col("summary_index") * 3 + F.col("allele_index") - 1).cast("string").alias("position"),
        alleles.short_notation(F.col("variant_desc")).alias("variant"),
        F.concat(F.col("w.family_id"), F.lit(":"), zeros("2"), F.lit("/"), zeros("0"), F.lit(":12")).alias("familyData"),
        F.lit("10").alias("all.nParCalled"), F.lit("50.0").alias("all.prcntParCalled"), F.lit("3").alias("all.nAltAlls"), F.lit("15.0").alias("all.altFreq"))
    on_x = F.col("`#chr`") == "chrX"
    overflow = lines.filter(on_x).select(F.col("`#chr`"), "position", "variant", "familyData")
    summary = lines.withColumn("familyData", F.when(on_x, "TOOMANY").otherwise(F.col("familyData")))
    readable, _ = call_tables.transmitted_rows(summary, overflow)
    return call_tables.transmitted_families(readable).select(
        "chrom", "position", "variant", "family_id", F.size("states").alias("sizes"))


@register("s10_quarantined_lines", "SELECT s::BIGINT AS s FROM sites WHERE size % 9 = 0", base=True)
def s10_quarantined_lines(spark, sf):
    """Lines of rare sites lost their family lists."""
    lines = derive.sites(spark, sf).select(
        F.col("chromosome").alias("chrom"), F.col("summary_index").cast("string").alias("position"), F.lit("sub(A->C)").alias("variant"),
        F.when(F.col("rare"), "F1:?:1").otherwise("F1:2222/0000:5").alias("familyData"), F.lit("10").alias("all.nParCalled"),
        F.lit("50").alias("all.prcntParCalled"), F.lit("3").alias("all.nAltAlls"), F.lit("15").alias("all.altFreq"))
    _, quarantined = call_tables.transmitted_rows(lines)
    return quarantined.select(F.col("position").cast("long").alias("s"))


@register("t13_transmitted_frequencies", "SELECT s::BIGINT AS s, ai::BIGINT AS ai, CASE ai WHEN 0 THEN 2 * size - 1 ELSE 1 END::BIGINT AS n, CASE ai WHEN 0 THEN (2 * size - 1) / 2.0::DOUBLE / size ELSE 15.0::DOUBLE END AS freq FROM sites, (SELECT unnest([0, 1]) AS ai)")
def t13_transmitted_frequencies(spark, sf):
    size = derive.table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("summary_index"), "p_size")
    lines = derive.sites(spark, sf).join(size, "summary_index").select(
        F.col("chromosome").alias("chrom"), F.col("summary_index").cast("string").alias("position"), F.lit("sub(A->C)").alias("variant"),
        F.col("p_size").cast("string").alias("all.nParCalled"), F.lit("50").alias("all.prcntParCalled"), F.lit("1").alias("all.nAltAlls"), F.lit("15").alias("all.altFreq"))
    return call_tables.transmitted_alleles(lines).select(
        F.col("position").alias("s"), F.col("allele_index").alias("ai"), F.col("af_allele_count").alias("n"), F.col("af_allele_freq").alias("freq"))


CNV = "(SELECT * FROM v WHERE cnv)"


def cnv_table(spark, sf):
    found = plan.query_variants(derive.study(spark, sf)).filter("reference IS NULL")
    return found.select(
        plan.location().alias("location"), F.when(F.col("variant_type") == 32, "dup").otherwise("del").alias("variant"),
        F.array_join("allele_in_members", ";").alias("person_id"), "family_id")


@register("s11_x34_cnv_table", f"""
SELECT d.location, m.person_id, d.variant_type::BIGINT AS variant_type, (CASE WHEN ploidy = 1 THEN 1 ELSE 2 END - carrier)::BIGINT AS ref, carrier::BIGINT AS alt
FROM (SELECT family_id, location, variant_type, chromosome, position, end_position, carriers FROM {CNV}) d JOIN members m USING (family_id),
  LATERAL (SELECT list_contains(string_split(d.carriers, ';'), m.person_id)::INT AS carrier,
    CASE WHEN d.chromosome = 'chrX' AND m.sex IN (1, 4) AND NOT d.position BETWEEN 1 AND 40000 AND NOT d.end_position BETWEEN 1 AND 40000 THEN 1 ELSE 2 END AS ploidy)""")
def s11_x34_cnv_table(spark, sf):
    parsed = call_tables.cnv_rows(cnv_table(spark, sf).drop("family_id"), plus=["dup"], minus=["del"])
    states = call_tables.cnv_states_by_person(parsed, derive.ped(spark, sf), derive.PAR)
    return states.select(
        alleles.location(F.col("chromosome"), F.col("position"), F.col("end_position"), F.col("variant_type")).alias("location"),
        "person_id", "variant_type", F.col("state")[0].alias("ref"), F.col("state")[1].alias("alt"))


@register("x33_cnv_observed_ploidy", f"""
SELECT d.location, m.person_id, (CASE WHEN variant_type = 32 THEN 3 - ploidy ELSE ploidy - 3 END)::BIGINT AS alt
FROM (SELECT family_id, location, variant_type, chromosome, position, end_position FROM {CNV}) d JOIN members m USING (family_id),
  LATERAL (SELECT CASE WHEN d.chromosome = 'chrX' AND m.sex IN (1, 4) AND NOT d.position BETWEEN 1 AND 40000 AND NOT d.end_position BETWEEN 1 AND 40000 THEN 1 ELSE 2 END AS ploidy)""")
def x33_cnv_observed_ploidy(spark, sf):
    """Every member is observed with three copies."""
    parsed = call_tables.cnv_rows(cnv_table(spark, sf), plus=["dup"], minus=["del"]).withColumn("best_state", F.lit("3 3 3 3"))
    states = call_tables.cnv_states_by_family(parsed, derive.ped(spark, sf), derive.PAR)
    return states.select(
        alleles.location(F.col("chromosome"), F.col("position"), F.col("end_position"), F.col("variant_type")).alias("location"),
        "person_id", F.col("state")[1].alias("alt"))


# ---- files ------------------------------------------------------------------------------------------

@register("s01_k08_pedigree_file", "SELECT family_id, person_id, mom_id, dad_id, sex::BIGINT AS sex, status::BIGINT AS status, role::BIGINT AS role, CASE WHEN NOT missing THEN person_id END AS sample_id, missing AS not_sequenced FROM ped")
def s01_k08_pedigree_file(spark, sf):
    """Written as text with words and read back."""
    path = scratch_dir(spark)
    ped = derive.ped(spark, sf)
    pedigree_files.write_text(ped.withColumn("sample_id", F.when(~F.col("not_sequenced"), F.col("sample_id"))).select(*pedigree.PEDIGREE_COLUMNS), path)
    return pedigree_files.read(spark, path).select(
        "family_id", "person_id", "mom_id", "dad_id", "sex", "status", "role", "sample_id", "not_sequenced")


@register("k08_selected_families_file", "SELECT family_id, count(*) AS persons FROM ped WHERE family_id IN (SELECT family_id FROM ped WHERE segment = 'BUILDING' AND role = 128) GROUP BY 1")
def k08_selected_families_file(spark, sf):
    path = scratch_dir(spark)
    ped = derive.ped(spark, sf).select(*pedigree.PEDIGREE_COLUMNS, "segment")
    pedigree_files.write_text(ped, path, ped.filter("segment = 'BUILDING' AND role = 128").select("family_id"))
    return pedigree_files.read(spark, path).groupBy("family_id").agg(F.count("*").alias("persons"))


@register("s02_simple_families_file", """
SELECT p.person_id, CASE WHEN p.role IN (128, 256) THEN p.mom_id END AS mom_id, CASE WHEN p.role IN (128, 256) THEN p.dad_id END AS dad_id,
  CASE WHEN p.role = 128 THEN 2 ELSE 1 END::BIGINT AS status FROM ped p""")
def s02_simple_families_file(spark, sf):
    path = scratch_dir(spark)
    side_tables.write_table(pedigree_files.as_text(derive.ped(spark, sf)).select("familyId", "personId", "role", F.col("sex").alias("gender")), path)
    return pedigree_files.read_simple(spark, path).select("person_id", "mom_id", "dad_id", "status")


@register("s13_instrument_files", "SELECT person_id, segment, nation::VARCHAR AS nation FROM ped")
def s13_instrument_files(spark, sf):
    """An instrument in two directories of files; later rows replace earlier ones."""
    base = scratch_dir(spark)
    i1 = derive.instruments(spark, sf)["i1"].select(F.col("person_id").alias("personId"), "segment", F.col("nation").cast("string").alias("nation"))
    i1.withColumn("segment", F.lit("old")).write.csv(f"{base}/i1.first.csv", header=True)
    i1.write.csv(f"{base}/i1.second.csv", header=True)
    return side_tables.read_instrument(spark, [f"{base}/i1.first.csv", f"{base}/i1.second.csv"]).select("person_id", "segment", "nation")


@register("s14_background_files", base=False, sql="SELECT upper(p_brand) AS gene, sum(p_size)::DOUBLE AS gene_weight, sum(p_size) / 100000.0::DOUBLE AS p_lgds FROM part GROUP BY 1")
def s14_background_files(spark, sf):
    weights, rates = scratch_dir(spark), scratch_dir(spark)
    side_tables.write_table(derive.gene_weights(spark, sf), weights)
    side_tables.write_table(derive.mutation_rates(spark, sf), rates, sep=",")
    read = side_tables.read_mutation_rates(spark, rates).select("gene", F.col("P_LGDS").alias("p_lgds"))
    return side_tables.read_gene_weights(spark, weights).join(read, "gene")


@register("s15_description_files", base=False, sql="SELECT lower(n_name) || '.' || s_name AS measure_id, 'about ' || s_name AS description FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def s15_description_files(spark, sf):
    path = scratch_dir(spark)
    s = derive.table(spark, sf, "supplier").join(derive.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    side_tables.write_table(s.select(
        F.lower("n_name").alias("instrumentName"), F.col("s_name").alias("measureName"), F.concat(F.lit("about "), "s_name").alias("description")), path)
    return side_tables.read_descriptions(spark, [path])


@register("k07_flat_variant_file", "SELECT chromosome AS chrom, position::BIGINT AS pos, family_id AS \"familyId\", replace(carriers, ';', ',') AS \"personIds\" FROM v")
def k07_flat_variant_file(spark, sf):
    path = scratch_dir(spark)
    exports.write_tsv(exports.variant_table(plan.query_variants(derive.study(spark, sf))), path)
    return spark.read.csv(path, sep="\t", header=True).select("chrom", F.col("pos").cast("long").alias("pos"), "familyId", "personIds")


@register("k10_variant_download", "SELECT family_id AS family, location, CASE WHEN score IS NULL THEN '-' ELSE printf('%.1f', score) END AS score FROM v WHERE (inheritance & 4) <> 0")
def k10_variant_download(spark, sf):
    from kinfold.plans import browser
    path = scratch_dir(spark)
    found = plan.query_variants(derive.study(spark, sf), inheritance="denovo")
    exports.write_tsv(browser.answer(found, ["family", "location", "score"], {"score": "%.1f"}), path)
    return spark.read.csv(path, sep="\t", header=True)


@register("k11_d44_score_downloads", base=False, sql="SELECT p_brand AS gene, sum(p_size)::DOUBLE AS size_total FROM part GROUP BY 1")
def k11_d44_score_downloads(spark, sf):
    path = scratch_dir(spark)
    side_tables.write_table(side_tables.gene_score_table(derive.gene_scores(spark, sf), "size_total"), path)
    return spark.read.csv(path, sep="\t", header=True).select("gene", F.col("size_total").cast("double").alias("size_total"))


@register("k11_gene_profile_file", base=False, sql="SELECT p_brand AS gene, sum(p_size)::DOUBLE AS scores_size_total FROM part GROUP BY 1")
def k11_gene_profile_file(spark, sf):
    path = scratch_dir(spark)
    scores = gene_profiles.score_columns(derive.gene_scores(spark, sf), {"scores": ["size_total"]})
    genes = derive.table(spark, sf, "part").select(F.col("p_brand").alias("gene"))
    side_tables.write_table(gene_profiles.profiles(genes, [], scores), path)
    return spark.read.csv(path, sep="\t", header=True).select("gene", F.col("scores_size_total").cast("double").alias("scores_size_total"))


# ---- liftover ---------------------------------------------------------------------------------------

def chain(spark, sf):
    """Blocks of 50,000 positions with a gap of 100 before the next; odd blocks run backwards."""
    blocks = derive.sites(spark, sf).select(
        F.col("chromosome").alias("chrom"), F.floor(F.col("position") / 50_000).alias("b")).distinct()
    odd = F.col("b") % 2 == 1
    start = F.col("b") * 50_000
    return blocks.select(
        "chrom", start.alias("start"), (start + 49_899).alias("stop"), F.concat(F.lit("t"), "chrom").alias("target_chrom"),
        F.when(odd, start + 49_899 + 1000).otherwise(start + 1000).alias("target_start"), F.when(odd, "-").otherwise("+").alias("strand"))


@register("s08_rejected_lines", """
SELECT location, CASE WHEN position % 7 = 0 THEN 'no position' WHEN position % 7 = 1 THEN 'unreadable alleles' END AS reason, NULL::VARCHAR AS person_id
FROM v WHERE (inheritance & 4) <> 0 AND NOT cnv AND position % 7 IN (0, 1)
UNION ALL
SELECT location, 'unknown person', 'nobody' FROM v WHERE (inheritance & 4) <> 0 AND NOT cnv AND position % 7 = 2""")
def s08_rejected_lines(spark, sf):
    """Lines without a position or alleles, and persons without a family, are returned with the reason."""
    found = plan.query_variants(derive.study(spark, sf), inheritance="denovo").filter("reference IS NOT NULL")
    odd = F.col("position") % 7
    lines = found.select(
        F.concat(F.col("chromosome"), F.lit(":"), F.when(odd == 0, "?").otherwise(F.col("position").cast("string"))).alias("location"),
        F.when(odd != 1, F.col("reference")).alias("ref"), F.col("alternative").alias("alt"),
        F.concat_ws(";", F.array_join("allele_in_members", ";"), F.when(odd == 2, "nobody")).alias("person_id"), F.col("location").alias("named"))
    rejected = call_tables.denovo_rejects(lines, location="location").select("named", "reason", F.lit(None).cast("string").alias("person_id"))
    strangers = call_tables.rejected_carriers(call_tables.denovo_rows(lines, location="location"), derive.ped(spark, sf)).select("named", "reason", "person_id")
    return rejected.unionByName(strangers).withColumnRenamed("named", "location")


def chain_text(spark, sf):
    """Chains of three blocks for every 50,000 positions, odd ones on the reverse strand, and a chain of low score over every third."""
    spans = derive.sites(spark, sf).select("chromosome", F.floor((F.col("position") - 1) / 50_000).alias("b")).distinct()
    at = (F.col("b") * 50_000).cast("string")
    head = lambda score, prefix, strand, start: F.concat_ws(
        " ", F.lit("chain"), F.lit(score), "chromosome", F.lit("90000000"), F.lit("+"), at, (F.col("b") * 50_000 + 49_900).cast("string"),
        F.concat(F.lit(prefix), "chromosome"), F.lit("10000000"), strand, start, F.lit("9000000"), F.col("b").cast("string"))
    strand = F.when(F.col("b") % 2 == 1, "-").otherwise("+")
    main = spans.select(F.concat_ws("\n", F.lit("# made"), head("900", "t", strand, (F.col("b") * 50_000 + 1000).cast("string")), F.lit("20000\t50\t10"), F.lit("10000 0 5"), F.lit("19850")).alias("value"))
    other = spans.filter("b % 3 = 0").select(F.concat_ws("\n", head("1", "u", F.lit("+"), at), F.lit("49900")).alias("value"))
    path = scratch_dir(spark)
    main.unionByName(other).write.option("lineSep", "\n\n").text(path)
    return path


@register("s17_lifted_from_chain_text", """
SELECT chromosome, position, position_src, reference, CASE WHEN kind IS NULL THEN 'no block covers the position' WHEN leaves THEN 'the allele leaves its block' END AS reason
FROM (SELECT
    CASE WHEN kind IS NULL OR leaves THEN c ELSE CASE kind WHEN 3 THEN 'u' ELSE 't' END || c END AS chromosome,
    (CASE WHEN kind IS NULL OR leaves THEN p WHEN kind = 3 THEN p WHEN b % 2 = 0 THEN b * 50000 + 1000 + off - shift + 1
      ELSE 10000000 - (b * 50000 + 1000 + off - shift + n - 1) END)::BIGINT AS position, p::BIGINT AS position_src,
    CASE WHEN kind < 3 AND NOT leaves AND b % 2 = 1 THEN reverse(translate(reference, 'ACGT', 'TGCA')) ELSE reference END AS reference, kind, leaves
  FROM (SELECT *, off + n > (CASE kind WHEN 0 THEN 20000 WHEN 1 THEN 30050 ELSE 49900 END) AS leaves, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 40 ELSE 35 END AS shift
    FROM (SELECT *, CASE WHEN off < 20000 THEN 0 WHEN off >= 20050 AND off < 30050 THEN 1 WHEN off >= 30050 AND off < 49900 THEN 2
        WHEN off < 49900 AND b % 3 = 0 THEN 3 END AS kind
      FROM (SELECT chromosome AS c, position AS p, reference, length(reference) AS n, (position - 1) // 50000 AS b, (position - 1) % 50000 AS off FROM sa WHERE NOT cnv))))""")
def s17_lifted_from_chain_text(spark, sf):
    """Sites through chain text of several blocks, both strands and overlapping chains; those without a place have the reason."""
    sa = derive.alleles(spark, sf).filter("reference IS NOT NULL").select("chromosome", "position", "reference", "alternative")
    lifted, rejected = liftover.lift_sites_apart(sa, liftover.read_chain(spark, chain_text(spark, sf)))
    return lifted.select("chromosome", "position", "position_src", "reference", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("chromosome", "position", F.col("position").alias("position_src"), "reference", "reason"))


@register("s17_lifted_sites", """
SELECT 't' || chromosome AS chromosome, CASE WHEN b % 2 = 0 THEN position + 1000 ELSE b * 50000 + 50899 - (position + length(reference) - 1 - b * 50000) END::BIGINT AS position,
  position::BIGINT AS position_src, CASE WHEN b % 2 = 0 THEN reference ELSE reverse(translate(reference, 'ACGT', 'TGCA')) END AS reference
FROM (SELECT *, position // 50000 AS b FROM sa WHERE NOT cnv) WHERE position + length(reference) - 1 <= b * 50000 + 49899""")
def s17_lifted_sites(spark, sf):
    sa = derive.alleles(spark, sf).filter("reference IS NOT NULL").select("chromosome", "position", "reference", "alternative")
    return liftover.lift_sites(sa, chain(spark, sf)).select("chromosome", "position", "position_src", "reference")


@register("s17_lifted_cnv", """
SELECT 't' || chromosome || ':' || least(x, y) || '-' || greatest(x, y) AS location,
  100.0::DOUBLE * abs(end_position - position + 1 - (greatest(x, y) - least(x, y) + 1)) / (end_position - position + 1) AS size_change
FROM (SELECT *, CASE WHEN a % 2 = 0 THEN position + 1000 ELSE a * 100000 + 50899 - position END AS x,
    CASE WHEN b % 2 = 0 THEN end_position + 1000 ELSE b * 100000 + 50899 - end_position END AS y
  FROM (SELECT *, position // 50000 AS a, end_position // 50000 AS b FROM sa WHERE cnv))
WHERE a % 2 = b % 2 AND position % 50000 <= 49899 AND end_position % 50000 <= 49899
  AND EXISTS (SELECT 1 FROM sites k WHERE k.chromosome = chromosome AND k.position // 50000 = b)""")
def s17_lifted_cnv(spark, sf):
    cnv = derive.alleles(spark, sf).filter("reference IS NULL").select("chromosome", "position", "end_position")
    return liftover.lift_intervals(cnv, chain(spark, sf)).select("location", "size_change")


@register("s17_transmitted_liftover", """
SELECT CASE WHEN count(*) >= 20 THEN 'TOOMANY' ELSE 'listed' END AS kind, s::BIGINT AS s FROM v WHERE ai = 1 AND NOT cnv GROUP BY s""")
def s17_transmitted_liftover(spark, sf):
    """Sites carried in twenty and more families keep their lists in the overflow lines."""
    found = plan.query_variants(derive.study(spark, sf)).filter("allele_index = 1 AND reference IS NOT NULL")
    sites = derive.alleles(spark, sf).filter("allele_index = 1 AND reference IS NOT NULL").withColumn("chromosome", F.col("summary_index").cast("string"))
    for name, value in (("af_parents_called_count", 1), ("af_parents_called_percent", 1.0), ("af_allele_count", 1), ("af_allele_freq", 1.0)):
        sites = sites.withColumn(name, F.lit(value))
    families = found.select("bucket_index", "summary_index", "family_id", F.lit("2222/0000").alias("best_state"), F.lit("7").alias("read_counts"))
    summary, _ = liftover.transmitted_output(sites, families, ["bucket_index", "summary_index"])
    return summary.select(
        F.when(F.col("familyData") == "TOOMANY", "TOOMANY").otherwise("listed").alias("kind"), F.col("`#chr`").cast("long").alias("s"))


