import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import alleles, bins

CASES = [
    # pos, ref, alt, type, end, short, full
    (10, "A", "C", 1, 10, "sub(A->C)", "sub(A->C)"),
    (10, "A", "AGT", 2, 10, "ins(GT)", "ins(GT)"),
    (10, "ACT", "A", 4, 12, "del(2)", "del(2)"),
    (10, "ACT", "GG", 8, 12, "comp(ACT->GG)", "comp(ACT->GG)"),
    (10, "ACG", "TCG", 1, 12, "sub(A->T)", "sub(A->T)"),
    (10, "ACACAC", "ACACACAC", 2, 15, "ins(AC)", "TR(3xAC->4)"),
    (10, "AAAA", "AAAAA", 2, 13, "ins(A)", "ins(A)"),
    (10, "AAAAAAAA", "AAAAAAA", 4, 17, "del(1)", "TR(8xA->7)"),
]


def test_types_and_notations(spark):
    df = spark.createDataFrame(CASES, "pos int, ref string, alt string, kind int, end int, short string, full string")
    desc = alleles.variant_description(F.col("pos"), F.col("ref"), F.col("alt"))
    for r in df.select(
            "*", alleles.allele_type(F.col("ref"), F.col("alt")).alias("k"),
            alleles.end_position(F.col("pos"), F.col("ref"), F.col("alt")).alias("e"),
            alleles.short_notation(desc).alias("s"), alleles.full_notation(desc).alias("f")).collect():
        assert (r.k, r.e, r.s, r.f) == (r.kind, r.end, r.short, r.full)


def plain_tandem(ref, alt):
    for period in range(1, len(ref) // 2 + 1):
        n, rest = divmod(len(ref), period)
        unit = ref[:period]
        if rest == 0 and unit * n == ref and len(alt) % period == 0 and unit * (len(alt) // period) == alt:
            return None if period == 1 and len(ref) < 8 else (unit, n, len(alt) // period)
    return None


def plain_trim(ref, alt, keep):
    while min(len(ref), len(alt)) > keep and ref[-1:] == alt[-1:]:
        ref, alt = ref[:-1], alt[:-1]
    shift = 0
    while min(len(ref), len(alt)) > keep and ref[:1] == alt[:1]:
        ref, alt, shift = ref[1:], alt[1:], shift + 1
    return shift, ref, alt


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("AC", min_size=1, max_size=12), st.text("AC", min_size=1, max_size=12)), min_size=30, max_size=60))
def test_against_plain_python(spark, pairs):
    df = spark.createDataFrame(pairs, "ref string, alt string")
    one = alleles._trimmed(F.col("ref"), F.col("alt"), 1, lambda t: t)
    none = alleles._trimmed(F.col("ref"), F.col("alt"), 0, lambda t: t)
    for r in df.select("ref", "alt", one.alias("one"), none.alias("none"), alleles.tandem_repeat(F.col("ref"), F.col("alt")).alias("tr")).collect():
        assert tuple(r["one"]) == plain_trim(r.ref, r.alt, 1)
        assert tuple(r["none"]) == plain_trim(r.ref, r.alt, 0)
        assert (tuple(r["tr"]) if r["tr"] else None) == plain_tandem(r.ref, r.alt)


def test_notation_to_vcf(spark):
    df = spark.createDataFrame(
        [(10, "sub(A->C)", None), (10, "ins(GT)", "A"), (10, "del(2)", "ACT"), (10, "ins(G)", None), (10, "what", "A")],
        "pos int, text string, before string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(
        alleles.notation_to_vcf(F.col("pos"), F.col("text"), F.col("before"))).collect()]
    assert got == [(10, "A", "C"), (9, "A", "AGT"), (9, "ACT", "A"), None, None]


def test_copy_number_and_type_words(spark):
    df = spark.createDataFrame([(5, 32), (5, 16)], "pos int, kind int")
    empty = F.lit(None).cast("string")
    desc = alleles.variant_description(F.col("pos"), empty, empty, F.col("kind"))
    assert [r[0] for r in df.select(alleles.short_notation(desc)).collect()] == ["CNV+", "CNV-"]
    words = spark.createDataFrame([("CNV-",), ("TR(3xA->4)",), ("comp(A->T)",)], "t string")
    assert [r[0] for r in words.select(alleles.type_from_notation(F.col("t"))).collect()] == [16, 64, 8]


def test_family_bin_is_sha256_modulo(spark):
    ids = [f"family {i}" for i in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "f string")
    for n in (7, 20, 128):
        got = [r[0] for r in df.select(bins.family_bin(F.col("f"), n)).collect()]
        assert got == [int(hashlib.sha256(i.encode()).hexdigest(), 16) % n for i in ids]
        assert got == [bins.family_bin_of(i, n) for i in ids]


def test_region_bins(spark):
    part = bins.Partitioning(region_length=8, chromosomes=("chr1",), chromosome_lengths={"chr1": 20, "chr7": 9, "chr8": 17})
    df = spark.createDataFrame([("chr1", 1), ("chr1", 8), ("chr1", 9), ("chr1", 17), ("chr1", 24), ("chr5", 9)], "c string, p int")
    got = [r[0] for r in df.select(bins.region_bin(F.col("c"), F.col("p"), part)).collect()]
    assert got == ["chr1_0", "chr1_0", "chr1_1", "chr1_2", "chr1_2", "other_1"]
    assert part.region_bins_of("chr1", 7, 18) == ["chr1_0", "chr1_1", "chr1_2"]
    assert part.region_bins_of("chr1", 9, None) == ["chr1_1", "chr1_2"]
    assert part.all_region_bins() == ["chr1_0", "chr1_1", "chr1_2", "other_0", "other_1", "other_2"]
    rows = spark.createDataFrame([("chr1", 5, 12), ("chr1", 5, 13), ("chr7", 9, None), ("chr7", 9, 90)], "c string, p int, e int")
    found = lambda p: [r[0] for r in rows.select(bins.row_region_bin(F.col("c"), F.col("p"), F.col("e"), p)).collect()]
    assert found(part) == ["chr1_0", "chr1_long", "other_1", "other_long"]
    numbers = bins.Partitioning(region_length=8, chromosomes=("chr0", "chr1"), integer_region_bins=True)
    assert found(numbers) == ["10000", "19999", "10000001", "9999999"]
