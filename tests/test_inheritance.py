"""All genotype triples against a plain-Python oracle."""

import itertools

from pyspark.sql import functions as F

from kinfold.functions import genotypes

MEMBER = "struct<person_id:string,sex:int,mom_ix:int,dad_ix:int,a1:int,a2:int>"


def oracle(child, mom, dad, allele):
    if -1 in child + mom + dad:
        return 256
    in_child = allele in child
    if in_child:
        return 2 if allele in mom or allele in dad else 4
    if mom == (allele, allele) or dad == (allele, allele):
        return 16
    return 128


def test_every_trio(spark):
    pairs = list(itertools.product([-1, 0, 1, 2], repeat=2))
    triples = list(itertools.product(pairs, repeat=3))
    assert len(triples) == 4096
    rows = [
        (i, [("m", 2, 0, 0, *m), ("d", 1, 0, 0, *d), ("c", 1, 1, 2, *c)]) for i, (c, m, d) in enumerate(triples)]
    df = spark.createDataFrame(rows, f"i int, members array<{MEMBER}>")
    for allele in (0, 1, 2):
        c, m, d = (F.get("members", F.lit(x)) for x in (2, 0, 1))
        got = df.select(
            "i", genotypes.inheritance_by_member(F.col("members"), F.lit(allele)).alias("all"),
            genotypes.member_inheritance(c, m, d, allele).alias("one")).collect()
        for r in got:
            child, mom, dad = triples[r["i"]]
            assert list(r["all"]) == [256, 256, oracle(child, mom, dad, allele)], (child, mom, dad, allele)
            assert r["one"] == oracle(child, mom, dad, allele)


def test_child_without_parent_is_unknown(spark):
    df = spark.createDataFrame(
        [([("m", 2, 0, 0, 0, 0), ("c", 1, 1, 0, 0, 1)],)], f"members array<{MEMBER}>")
    assert df.select(genotypes.inheritance_by_member(F.col("members"), F.lit(1))).first()[0] == [256, 256]


def test_haploid_male_counts_as_heterozygous(spark):
    full = MEMBER[:-1] + ",role_bit:int,status:int,status_bit:int,sex_bit:int>"
    df = spark.createDataFrame(
        [([("p", 1, 0, 0, 1, -2, 7, 2, 1, 0)],)], f"members array<{full}>")
    carriers = genotypes.carriers(F.col("members"), F.lit(1))
    assert df.select(genotypes.zygosity_by(carriers, "role_bit")).first()[0] == 2 << 14
    state = genotypes.best_state(F.col("members"), F.lit(1), F.lit(True))
    assert df.select(state).first()[0] == [[0, 1]]


def test_best_state_and_back(spark):
    df = spark.createDataFrame(
        [([("a", 2, 0, 0, 0, 1), ("b", 1, 0, 0, 2, 2), ("c", 1, 0, 0, -1, 0), ("d", 2, 0, 0, 1, 2)],)],
        f"members array<{MEMBER}>")
    states = genotypes.best_state(F.col("members"), F.lit(2))
    row = df.select(states.alias("s"), genotypes.best_state_text(states, F.lit(2)).alias("t")).first()
    assert row["s"] == [[1, 1, 0], [0, 0, 2], [-1, -1, -1], [0, 1, 1]]
    assert row["t"] == "10?0/10?1/02?1"
    back = spark.createDataFrame([([1, 1, 0],), ([0, 0, 2],), ([0, 1, 1],), ([0, 1],), ([1, 0],), ([2, 0],)], "s array<int>")
    pairs = [tuple(r[0]) for r in back.select(genotypes.genotype_from_best_state(F.col("s"))).collect()]
    assert pairs == [(1, 0), (2, 2), (1, 2), (1, -2), (0, -2), (0, 0)]


def test_genetic_models(spark):
    par = [("chrX", 1, 100)]
    rows = [
        ("chr1", 5, [("a", 1, 0, 0, 0, 1)], 1), ("chrX", 50, [("a", 1, 0, 0, 0, 1)], 3),
        ("chrX", 50, [("a", 1, 0, 0, 0, -2)], 5), ("chrX", 500, [("a", 1, 0, 0, 0, -2)], 4),
        ("chrX", 500, [("a", 1, 0, 0, 0, 1)], 5)]
    df = spark.createDataFrame(rows, f"chrom string, pos int, members array<{MEMBER}>, want int")
    got = df.select(genotypes.genetic_model(F.col("chrom"), F.col("pos"), F.col("members"), par).alias("g"), "want").collect()
    assert [r["g"] for r in got] == [r["want"] for r in got]
    states = spark.createDataFrame(
        [("chrX", 500, [("a", 1, 0, 0, 0, 0)], [[1, 0]], 4), ("chrX", 500, [("a", 1, 0, 0, 0, 0)], [[2, 0]], 5),
         ("chrX", 50, [("a", 1, 0, 0, 0, 0)], [[2, 0]], 3), ("chr2", 5, [("a", 1, 0, 0, 0, 0)], [[1, 0]], 2),
         ("chr2", 5, [("a", 1, 0, 0, 0, 0)], [[1, 1]], 1)],
        f"chrom string, pos int, members array<{MEMBER}>, st array<array<int>>, want int")
    got = states.select(genotypes.genetic_model_of_state(
        F.col("chrom"), F.col("pos"), F.col("members"), F.col("st"), par).alias("g"), "want").collect()
    assert [r["g"] for r in got] == [r["want"] for r in got]
