import itertools

import pytest
from pyspark.sql import functions as F

from kinfold.functions import codes, flags

CASES = [
    ("prb", lambda v: "prb" in v),
    ("not prb", lambda v: "prb" not in v),
    ("prb and not sib", lambda v: "prb" in v and "sib" not in v),
    ("not mom and not dad", lambda v: "mom" not in v and "dad" not in v),
    ("mom or dad and prb", lambda v: "mom" in v or ("dad" in v and "prb" in v)),
    ("(mom or dad) and prb", lambda v: ("mom" in v or "dad" in v) and "prb" in v),
    ("any([mom, dad])", lambda v: "mom" in v or "dad" in v),
    ("all([mom,dad,prb])", lambda v: {"mom", "dad", "prb"} <= set(v)),
    ("not any([mom, not dad])", lambda v: not ("mom" in v or "dad" not in v)),
]


@pytest.mark.parametrize("text,truth", CASES)
def test_expression_truth_table(spark, text, truth):
    names = ["mom", "dad", "prb", "sib"]
    subsets = [c for n in range(5) for c in itertools.combinations(names, n)]
    masks = [sum(codes.ROLES[n] for n in c) for c in subsets]
    df = spark.createDataFrame([(m,) for m in masks], "allele_in_roles int").withColumn("zygosity_in_roles", F.lit(0).cast("long"))
    got = {r[0]: r[1] for r in df.select("allele_in_roles", flags.roles(text)).collect()}
    assert [got[m] for m in masks] == [truth(c) for c in subsets]
    assert [flags.matches(text, m, codes.ROLES) for m in masks] == [truth(c) for c in subsets]


def test_zygosity_compounds(spark):
    hom, het = codes.zygosity_mask(128, 1), codes.zygosity_mask(128, 2)
    df = spark.createDataFrame(
        [(128, hom), (128, het), (128, 0), (256, hom)], "allele_in_roles int, zygosity_in_roles long")
    assert [r[0] for r in df.select(flags.roles("prb~homozygous")).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(flags.roles("not prb~heterozygous")).collect()] == [True, False, True, True]


def test_multi_bit_flags_match_any_bit(spark):
    df = spark.createDataFrame([(2,), (8,), (32,), (66,)], "variant_type int")
    assert [r[0] for r in df.select(flags.variant_type("indel")).collect()] == [True, True, False, True]
    assert [r[0] for r in df.select(flags.variant_type("cnv+ or tandem_repeat")).collect()] == [False, False, True, True]


def test_zygosity_helpers():
    assert flags.with_zygosity("mom and not dad", "homozygous") == "mom~homozygous and not dad~homozygous"
    assert flags.without_zygosity("any([mom~homozygous, dad])") == "any([mom, dad])"
    with pytest.raises(ValueError):
        flags.with_zygosity("mom~homozygous", "heterozygous")


def test_unknown_names_and_injection_are_rejected(spark):
    for text in ("nobody", "prb; drop table x", "prb or 1=1", "prb~sideways"):
        with pytest.raises(ValueError):
            flags.flag_sql(text, "c", codes.ROLES, "z")


def test_denovo_only():
    only = flags.denovo_only_inheritance
    assert only("denovo") and only("denovo and not mendelian") and only(["denovo", "not possible_denovo"])
    assert not any(only(n) for n in codes.INHERITANCE if n != "denovo")
    assert not only("not mendelian") and not only("denovo or unknown") and not only(["denovo or other", "not missing"])
