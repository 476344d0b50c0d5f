import zlib
from collections import Counter

from pyspark.sql import functions as F

from kinfold.llm import hash_tree, queries
from kinfold.llm.hash_tree import Shard

SF = "/root/testdata/sf0.001"


def placed(spark, n, tree, **more):
    return {r.doc_id: r for r in hash_tree.place(spark.range(n).withColumnRenamed("id", "doc_id"), tree, blocks=8, **more).collect()}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (1, 7, 40):
        rows = placed(spark, 4000, hash_tree.layout(n)).values()
        assert all(r.grown_shard in (r.shard, n) for r in rows) and any(r.grown_shard == n for r in rows)
        counts = Counter(r.shard for r in rows)
        assert set(counts) == set(range(n)) and max(counts.values()) < 1.5 * 4000 / n + 20
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in counts)


def test_a_changed_weight_moves_rows_only_into_its_subtree(spark):
    tree = [Shard(f"r{a}", f"k{b}", 4 * a + 2 * b + c) for a in range(2) for b in range(2) for c in range(2)]
    heavier = [Shard(s.region, s.rack, s.number, 3.0 if s.number == 5 else 1.0) for s in tree]
    before, after = placed(spark, 4000, tree), placed(spark, 4000, heavier)
    moved = [(before[i].shard, after[i].shard) for i in before if before[i].shard != after[i].shard]
    assert moved and all(b // 4 == 1 for _, b in moved) and all(b // 2 == 2 for a, b in moved if a // 4 == 1)
    share = Counter(r.shard for r in after.values())[5] / 4000
    assert abs(share - 3 / 10) < 0.03


def test_nulls_ties_repeats_clashes_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "x", 1), (None, "x", 1), (5, None, 2), (5, None, 2), (5, "y", 2)], "doc_id bigint, text string, SLOT int")
    got = hash_tree.place(rows, hash_tree.layout(3), order=["text"]).collect()
    assert len(got) == 5 and [c.lower() for c in got[0].__fields__].count("slot") == 1
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert hash_tree.place(rows.limit(0), hash_tree.layout(3)).count() == 0
    only = hash_tree.place(rows, [Shard("a", "b", 0, 0.0), Shard("a", "b", 1, 2.0)]).select("shard").distinct().collect()
    assert [r.shard for r in only] == [1]


def test_query(spark):
    rows = queries.op3_hash_tree_shards(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) for r in rows)
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert spark.createDataFrame([(None,)], "t string").select(F.crc32(F.coalesce("t", F.lit("")).cast("binary"))).first()[0] == 0
