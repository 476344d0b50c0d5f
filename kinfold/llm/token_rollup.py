"""Token counts as rollups that are maintained by deltas.

A batch of changes is turned into signed rows, one for every document count that comes (+1) and one for every count it
replaces (-1). Summed by source, language and tokenizer version they are the batch's delta, and the totals are the sum of the
deltas of all committed batches. A batch counts from the moment its marker is written, which is last: a batch that broke off
is not seen and is written anew, and a batch that is sent again changes nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import column, pieces, without

#: Folder of the public vocabularies, on every executor.
VOCABULARIES = "/opt/tokenizers"
#: Version of the tokenizer: the file of its ranks, without ending.
VERSION = "byte_bpe_50k"
#: How the vocabulary's authors split text before they merge; a fixed value of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GROUP = ("source", "lang", "tokenizer")
COUNTS = "n_tokens bigint, n_bytes bigint"
SIGNED = f"doc_id bigint, text_key string, source string, lang string, tokenizer string, {COUNTS}, sign int, batch string"
DELTAS = f"source string, lang string, tokenizer string, n_docs bigint, {COUNTS}, batch string"


@lru_cache(maxsize=4)
def encoding(version: str, folder: str = VOCABULARIES) -> tiktoken.Encoding:
    with open(f"{folder}/{version}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, version: str = VERSION, folder: str = VOCABULARIES) -> DataFrame:
    """``docs`` (doc_id, source, lang, text) less the text, with tokenizer, n_tokens and n_bytes. A null text is empty."""
    kept = without(docs, "tokenizer", "n_tokens", "n_bytes")
    names = [c for c in kept.columns if c != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(version, folder).encode_ordinary
        for batch in pieces(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *map(batch.column, names), pa.array([version] * len(texts)), pa.array([len(encode(t)) for t in texts], pa.int64()),
                pa.array([len(t.encode()) for t in texts], pa.int64())], names=[*names, "tokenizer", "n_tokens", "n_bytes"])

    added = T.StructType.fromDDL(f"tokenizer string, {COUNTS}")
    return docs.select(*[column(c) for c in kept.columns]).mapInArrow(count, T.StructType([*[kept.schema[c] for c in names], *added]))


class Rollup:
    """Token totals under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self, name: str, schema: str) -> DataFrame:
        """Rows of the committed batches."""
        if not self._there(f"{self.path}/commits"):
            return self.spark.createDataFrame([], schema)
        commits = self.spark.read.schema("batch string").parquet(f"{self.path}/commits")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").join(commits.distinct(), "batch")

    def _there(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def current(self) -> DataFrame:
        """The counts that stand, one row per document and tokenizer version."""
        identity = ["doc_id", "text_key", *GROUP, "n_tokens", "n_bytes"]
        return self._rows("signed", SIGNED).groupBy(*identity).agg(F.sum("sign").alias("sign")).where(F.col("sign") > 0).drop("sign")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens and n_bytes of all that stands; groups without documents are left out."""
        sums = [F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_bytes")]
        return self._rows("deltas", DELTAS).groupBy(*GROUP).agg(*sums).where(F.col("n_docs") != 0)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes (change, doc_id, source, lang, tokenizer, n_tokens, n_bytes; text_key if ids do not name documents); False if it was applied before.

        ``insert`` and ``revise`` put a count in the place of any that stands for the document and tokenizer version;
        ``delete`` takes it away and needs no counts. Of several puts of one document in a batch the one with the largest
        counts stays, and a delete beats a put. Deleting what is not there does nothing. A document is named by its id and text_key, and a
        null of either is a name like any other; null sources and languages are groups of their own; null counts are 0.
        """
        if "/" in batch or not batch:
            raise ValueError("a batch needs a name that can be a folder")
        marker = f"{self.path}/commits/batch={batch}"
        if self._there(f"{marker}/_SUCCESS"):
            return False
        text_key = F.col("text_key") if "text_key" in changes.columns else F.lit(None).cast("string").alias("text_key")
        named = changes.select(
            "doc_id", text_key, "tokenizer", (F.col("change") == "delete").cast("int").alias("gone"),
            F.struct(
                F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"),
                F.col("source").alias("source"), F.col("lang").alias("lang")).alias("put"))
        last = named.groupBy("doc_id", "text_key", "tokenizer").agg(F.max("gone").alias("gone"), F.max("put").alias("put"))
        comes = last.where(F.col("gone") == 0).select("doc_id", "text_key", "put.source", "put.lang", "tokenizer", "put.n_tokens", "put.n_bytes", F.lit(1).alias("sign"))
        stands, touched = self.current(), last.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), F.col("tokenizer").alias("version_"))
        goes = stands.join(
            touched, F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("text_key").eqNullSafe(F.col("key_")) & F.col("tokenizer").eqNullSafe(F.col("version_")), "left_semi").withColumn("sign", F.lit(-1))
        comes.unionByName(goes).write.mode("overwrite").parquet(f"{self.path}/signed/batch={batch}")
        signed = self.spark.read.parquet(f"{self.path}/signed/batch={batch}")
        sums = [F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("n_tokens", "n_bytes")]
        (signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), *sums)
            .write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}"))
        self.spark.range(1).select(F.lit(True).alias("done")).coalesce(1).write.mode("overwrite").parquet(marker)
        return True


def without_repeated_lines(text: str = "text"):
    """The text without lines that repeat an earlier one."""
    return F.array_join(F.array_distinct(F.split(column(text), "\n", -1)), "\n")


def history(rollup: Rollup, docs: DataFrame, version: str = VERSION, folder: str = VOCABULARIES) -> Rollup:
    """Three batches over ``docs``: all are inserted, texts with repeated lines are revised without them, and exact copies but
    the one of the smallest id are deleted. Every batch is sent twice, as after a lost acknowledgement. Documents are named by their
    id and a digest of the text that was inserted, so null and repeated ids leave none uncounted."""
    docs = docs.select("doc_id", "source", "lang", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"))
    shorter = docs.withColumn("text", without_repeated_lines()).where(F.col("text") != docs["text"])
    named = docs.select("doc_id", "text_key")
    first = named.groupBy("text_key").agg(F.min("doc_id").alias("first"))
    copies = named.join(first, "text_key").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    nothing = [F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(version).alias("tokenizer"),
               F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_bytes")]
    batches = {
        "insert": counted(docs, version, folder), "revise": counted(shorter, version, folder),
        "delete": copies.select("doc_id", "text_key", *nothing)}
    for name, rows in batches.items():
        for _ in range(2):
            rollup.commit(name, rows.withColumn("change", F.lit(name)))
    return rollup
