import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm import media_chunks

FINISHED = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("parts", T.IntegerType())])


@pytest.fixture
def finish():
    def finished(data, recipe, n_bytes):
        assert sum(size for _, size in recipe) == len(data)
        return data, n_bytes, len(recipe)
    return finished


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))) for _ in range(n))


def test_cuts_follow_the_content():
    text = prose(20000, 1).encode()
    ends = media_chunks.cuts(text)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(text) and all(media_chunks.LEAST <= s <= media_chunks.MOST for s in sizes[:-1])
    shifted = media_chunks.cuts(b"x" * 777 + text)
    assert len({e - 777 for e in shifted} & set(ends)) > 0.9 * len(ends)
    assert media_chunks.cuts(b"") == [] and media_chunks.cuts(b"a" * 64) == [64]
    assert max(media_chunks.cuts(b"a" * 100000)[:1]) <= media_chunks.MOST


@pytest.mark.parametrize("map_bits", [media_chunks.MAP_BITS, 6])
def test_round_trip_shares_chunks_whatever_the_size_of_the_map(spark, docs_of, finish, monkeypatch, map_bits):
    monkeypatch.setattr(media_chunks, "MAP_BITS", map_bits)
    common = prose(3000, 2)
    rows = [(1, common), (2, common), (2, common), (3, prose(900, 3) + common), (4, common + prose(900, 4)), (5, None), (6, ""), (7, "é"), (8, "a\x00"), (9, "a"), (None, "z" * 70000)]
    docs = docs_of(rows).withColumn("N_BYTES", F.lit(1)).withColumn("row", F.lit("r")).withColumn("recipe", F.lit("q"))
    stored = media_chunks.store(docs)
    got = media_chunks.read(stored, finish, FINISHED).collect()
    assert len(got) == len(rows) and all(r.row == "r" and r.recipe == "q" for r in got)
    want = sorted((str(i), len((t or "").encode()), media_chunks.payload(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.data)) for r in got) == want
    assert all(len(r.data) % 64 == 0 and len(r.data) for r in got)
    digests = [bytes(r.digest) for r in stored.shared.collect()]
    assert len(digests) == len(set(digests)) > 0
    once = sum(len(set(part for _, part in media_chunks.chunks(media_chunks.payload(t)))) for _, t in rows)
    assert len(digests) < once


def test_a_damaged_chunk_is_found(spark, docs_of, finish):
    stored = media_chunks.store(docs_of([(1, prose(2000, 5)), (2, prose(2000, 5))]))
    digest = hashlib.sha256(b"?").digest()
    wrong = media_chunks.Store(stored.recipes.withColumn("recipe", F.transform("recipe", lambda c: c.withField("digest", F.lit(digest)).withField("shared", F.lit(True)))),
                               stored.shared.limit(1).withColumn("digest", F.lit(digest)))
    with pytest.raises(Exception, match="does not agree with its digest"):
        media_chunks.read(wrong, finish, FINISHED).collect()


def test_empty_table(spark, docs_of, finish):
    assert media_chunks.read(media_chunks.store(docs_of([])), finish, FINISHED).count() == 0
