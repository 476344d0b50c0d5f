import duckdb
import pytest
from test_radix_windows import brute

import corpus_pipeline
from checks import compare
from kinfold.llm import curriculum, queries, simhash_gray

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    want = con.sql(queries.ORACLES[name])
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(repr, (r[c] for c in columns))) for r in rows.collect()) == sorted(tuple(map(repr, (r[i] for i in place))) for r in want.fetchall())


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if name != "pieces":
            assert docs.columns == COLUMNS
        texts = {r.doc_id: r for r in before}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = set(texts) - {r.doc_id for r in after}
            assert all(texts[r.doc_id] == r for r in after)
            assert sum(labels.get(i) == 0 for i in gone) <= 0.01 * len(before)
        elif name == "near_duplicates":
            groups = {r.doc_id: r.component_id for r in simhash_gray.groups(spark.createDataFrame(before)).collect()}
            assert sorted(r.doc_id for r in after) == sorted(set(groups.values())) and all(texts[r.doc_id] == r for r in after)
        elif name == "repeated_passages":
            from tests.llm.test_radix_windows import brute
            ordered = [r for r in before]
            want = {}
            for r, spans in zip(ordered, brute([r.text for r in ordered])):
                data, at, kept = (r.text or "").encode(), 0, b""
                for a, b in [*spans, [len(r.text.encode()), 0]]:
                    kept, at = kept + data[at:a], b
                want[r.doc_id] = kept.decode("utf-8", "ignore")
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        elif name == "mixing":
            assert all(texts[r.doc_id] == r for r in after)
            times = {i: sum(r.doc_id == i for r in after) for i in texts}
            assert max(times.values()) <= curriculum.MOST_EPOCHS
        else:
            assert len(after) == len(before) and all(r.exact and len(r.ids) == r.n_tokens for r in after)
        before = after
