import tempfile

from pyspark.sql import functions as F

from kinfold.llm import token_rollup
from kinfold.llm.token_rollup import Rollup

CHANGES = "change string, doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, n_bytes bigint"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_bytes) for r in rollup.totals().collect()}


def test_deltas_revisions_and_replays(spark):
    rollup = Rollup(spark, tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir")))
    assert totals(rollup) == {}
    first = [
        ("insert", 1, "a", "en", "v1", 10, 40), ("insert", 2, "a", "en", "v1", 5, 20), ("insert", 3, None, None, "v1", 7, 30),
        ("insert", 1, "a", "en", "v2", 8, 40), ("insert", None, "b", "de", "v1", None, 4), ("insert", 2, "a", "en", "v1", 5, 20)]
    assert rollup.commit("001", spark.createDataFrame(first, CHANGES))
    want = {("a", "en", "v1"): (2, 15, 60), (None, None, "v1"): (1, 7, 30), ("a", "en", "v2"): (1, 8, 40), ("b", "de", "v1"): (1, 0, 4)}
    assert totals(rollup) == want
    assert not rollup.commit("001", spark.createDataFrame([("delete", 1, None, None, "v1", 0, 0)], CHANGES))
    assert totals(rollup) == want
    second = [
        ("revise", 1, "b", "en", "v1", 12, 44), ("delete", 2, None, None, "v1", None, None), ("delete", 99, None, None, "v1", 0, 0),
        ("delete", None, None, None, "v1", 0, 0), ("revise", 3, None, None, "v1", 1, 1), ("delete", 3, None, None, "v1", 0, 0)]
    assert rollup.commit("002", spark.createDataFrame(second, CHANGES))
    assert totals(rollup) == {("b", "en", "v1"): (1, 12, 44), ("a", "en", "v2"): (1, 8, 40)}
    assert {(r.doc_id, r.tokenizer, r.n_tokens) for r in rollup.current().collect()} == {(1, "v1", 12), (1, "v2", 8)}
    assert rollup.commit("empty", spark.createDataFrame([], CHANGES))
    assert len(totals(rollup)) == 2


def test_a_batch_without_its_marker_is_not_seen_and_written_anew(spark):
    path = tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir"))
    rollup = Rollup(spark, path)
    rows = spark.createDataFrame([("insert", 1, "a", "en", "v1", 10, 40)], CHANGES)
    broken = rows.drop("change").withColumn("sign", F.lit(1))
    broken.write.parquet(f"{path}/signed/batch=x")
    assert totals(rollup) == {} and rollup.commit("x", rows) and totals(rollup) == {("a", "en", "v1"): (1, 10, 40)}


def test_history_over_texts(spark, docs_of):
    texts = [(1, "the cat\nthe cat\nsat", "a"), (2, "same", "a"), (3, "same", "b"), (4, None, "b"), (5, "", "b"), (6, "word " * 5000, None)]
    rollup = Rollup(spark, tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir")))
    got = totals(token_rollup.history(rollup, docs_of(texts)))
    count = lambda t: (len(token_rollup.encoding("byte_bpe_50k").encode_ordinary(t)), len(t))
    standing = {"a": ["the cat\nsat", "same"], "b": [""], None: ["word " * 5000]}
    assert got == {(s, "en", "byte_bpe_50k"): (len(ts), sum(count(t)[0] for t in ts), sum(count(t)[1] for t in ts)) for s, ts in standing.items()}


def test_history_counts_every_text_of_null_and_repeated_ids(spark, docs_of):
    texts = [(None, "one", "a"), (None, "two words", "a"), (None, "two words", "a"), (7, "two words", "b"), (7, "three", "b"), (7, "four\nfour", "b"), (8, "three", "c"), (None, None, "a"), (None, "", "a"), (9, "one", "d")]
    rollup = Rollup(spark, tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir")))
    got = totals(token_rollup.history(rollup, docs_of(texts)))
    count = lambda t: (len(token_rollup.encoding("byte_bpe_50k").encode_ordinary(t)), len(t))
    standing = {"a": [""], "b": ["two words", "three", "four"], "d": ["one"]}
    assert got == {(s, "en", "byte_bpe_50k"): (len(ts), sum(count(t)[0] for t in ts), sum(count(t)[1] for t in ts)) for s, ts in standing.items()}


def test_clashing_columns_and_empty_table(spark, docs_of):
    clash = docs_of([(1, "a b")]).withColumn("Tokenizer", F.lit("x")).withColumn("n_bytes", F.lit(9))
    row = token_rollup.counted(clash).collect()[0]
    assert row.tokenizer == "byte_bpe_50k" and row.n_bytes == 3
    assert token_rollup.counted(docs_of([])).count() == 0
