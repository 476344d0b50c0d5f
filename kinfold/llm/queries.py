"""One registered query per operator, over its whole table."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm import (
    curriculum, hash_tree, media_chunks, quality_trees, radix_windows, sentencepiece_trie, simhash_gray, size_aware_join, source_divergence,
    token_rollup, tokenizer_alignment, toxicity_ordinal, url_expressions)
from kinfold.llm.common import table, utf8_size, words_in
from kinfold.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql.strip()
        return query
    return keep


@register()
def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of two regions with four racks of five shards each; grown_shard is with a 41st shard."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", (utf8_size(F.col("text")) + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = hash_tree.place(rows, hash_tree.layout(40), order=["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: Rules (host, path, verdict) of the URL query.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block")]


@register("""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES
    ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'),
    ('net', '/fr/', 'block')),
cuts AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS place
    FROM pages),
parsed AS (
    SELECT place, page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM cuts),
hosts AS (SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parsed),
fits AS (
    SELECT place, rule_host || rule_path AS rule, rule_verdict,
        row_number() OVER (PARTITION BY place ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS nth
    FROM hosts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM hosts LEFT JOIN fits ON hosts.place = fits.place AND nth = 1
""")
def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page; a URL that no rule fits is allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_expressions.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@register(r"""
WITH sized AS (
    SELECT row_number() OVER () AS place, doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sources),
weighed AS (SELECT *, (CASE nth % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS most FROM ranked),
stops AS (SELECT *, most / weight AS stop FROM weighed),
levels AS (
    SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE
            - coalesce(sum(most) OVER (ORDER BY stop, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
        / sum(weight) OVER (ORDER BY stop, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM stops),
goals AS (SELECT *, least((SELECT level FROM levels WHERE level <= stop ORDER BY stop, nth LIMIT 1) * weight, most) AS target FROM levels),
streams AS (
    SELECT doc_id, size, source_size, target, round(target)::BIGINT AS goal, (sum(size) OVER (PARTITION BY s.source
        ORDER BY h, doc_id, size, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS ahead
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (least(size, greatest(goal - ahead, 0)) + least(size, greatest(goal - source_size - ahead, 0))
    + least(size, greatest(goal - 2 * source_size - ahead, 0)))::BIGINT AS taken
FROM streams
""")
def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes from every document, in the order in which the curriculum first asks for them."""
    narrow = curriculum.sized(table(spark, sf_dir, "documents"), words_in(F.col("text")))
    planned = curriculum.plan(narrow).withColumn("first_position", F.try_element_at("occurrences", F.lit(1))["position"])
    ordered = curriculum.in_order(planned, "first_position", "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken")


@register()
def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document; rejected from ``REJECT_AT`` on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_ordinal.graded(docs, table(spark, sf_dir, "labels"), keep_text=False)


@register()
def op7_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_trees.screened(docs, table(spark, sf_dir, "labels"), keep_text=False)


@register()
def op4_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash_gray.groups(table(spark, sf_dir, "documents"), near=False)


def _removal_digest(data: bytes, spans: np.ndarray) -> tuple[Any, ...]:
    kept = radix_windows.rest(data, spans)
    return len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()


@register()
def op10_radix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and spans removed from every document and the digest of the rest."""
    finished = T.StructType([
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType())])
    return radix_windows.strip(table(spark, sf_dir, "documents").select("doc_id", "text"), _removal_digest, finished)


@register()
def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents, revised texts without repeated lines, exact copies deleted."""
    rollup = token_rollup.Rollup(spark, scratch_dir(spark))
    return token_rollup.history(rollup, table(spark, sf_dir, "documents")).totals()


@register()
def op2_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether they decode to its text."""
    return sentencepiece_trie.tokenized(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def _media_digest(data: bytes, recipe: list[tuple[bytes, int]], n_bytes: int) -> tuple[Any, ...]:
    """Digests of the payload and of its stored form (recipe and chunks), and the mean and entropy of its samples."""
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    seen = share[share > 0]
    form = media_chunks.serialized(recipe)
    return (
        n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(form) + len(data),
        hashlib.sha256(form + data).hexdigest(),
        f"chunks={len(recipe)};mean={(share * np.arange(256)).sum():.3f};entropy={-(seen * np.log2(seen)).sum():.3f}")


@register()
def op5_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as chunks, read back and digested."""
    finished = T.StructType.fromDDL(
        "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return media_chunks.read(media_chunks.store(table(spark, sf_dir, "documents").select("doc_id", "text")), _media_digest, finished)


@register(r"""
WITH d AS (
    SELECT row_number() OVER () AS place, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
t AS (SELECT place, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT place) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
cells AS (
    SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
    FROM groups JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (total::HUGEINT + 2 * v) AS p FROM cells JOIN v USING (lang)),
whole AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM n GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n::HUGEINT + 2) // (total::HUGEINT + 2 * v) AS q FROM whole JOIN v USING (lang)),
sums AS (
    SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
parts AS (
    SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b USING (lang) LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
    WHERE a.source <> b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
""")
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that set a source apart from its language."""
    return source_divergence.audit(table(spark, sf_dir, "documents"))


@register()
def op12_window_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    finished = T.StructType([T.StructField("groups_sha256", T.StringType())])
    return tokenizer_alignment.aligned(
        table(spark, sf_dir, "documents").select("doc_id", "text"), lambda groups: (hashlib.sha256(groups).hexdigest() if groups else "",), finished)


@register()
def op13_size_aware_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return size_aware_join.joined(table(spark, sf_dir, "documents"))
