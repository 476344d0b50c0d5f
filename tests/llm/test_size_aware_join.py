import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinfold.llm import queries
from kinfold.llm import size_aware_join as sj


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def alike(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 85 * (len(a) + len(b) - both)


def brute(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), by all pairs that share a shingle."""
    sets = [brute_set(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    candidates = {p for held in holders.values() for p in combinations(held, 2)}
    for i, j in candidates:
        if find(i) != find(j) and alike(sets[i], sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [(doc, len(s), doc if not s else low.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.select("*", F.lit("x").alias("node"), F.lit(1).alias("Member"), F.lit(None).cast("int").alias("n_shingles"), F.lit(2).alias("component_id"))
    found = sj.joined(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(repr, map(tuple, found.collect())))


def edited(words, n, draw):
    words = list(words)
    for _ in range(n):
        at = draw.randrange(len(words))
        words[at:at + draw.randrange(2)] = [f"n{draw.random()}"] * draw.randrange(2)
    return words or ["x"]


@pytest.mark.parametrize("alike_", [(85, 100), (4, 5), (1, 2)])
def test_bounds_of_sizes(alike_):
    top, base = alike_
    for a in range(1, 60):
        partners = [b for b in range(a, 200) if any(base * s >= top * (a + b - s) for s in range(a + 1))]
        assert partners[-1] == sj.largest_partner(a, alike_)
        for b in partners:
            least = min(s for s in range(a + 1) if base * s >= top * (a + b - s))
            assert least == sj.need(a, b, alike_)
            assert a - sj.listed_first(a, alike_) < least and b - sj.listed_first(b, alike_) < least


def test_boundary_follows_the_costs(spark):
    def boundary(scanned, sizes):
        return sj.boundary_of(spark.createDataFrame(scanned, "size long, scanned long"), spark.createDataFrame(sizes, "size long, n long"))
    assert boundary([], []) == 0
    assert boundary([(n, 10 ** 9) for n in range(1, 40)], [(n, 10) for n in range(1, 40)]) == sj.MOST_SMALL
    assert boundary([(5, 500), (9, 500), (18, 500)], [(5, 10), (9, 10), (18, 10)]) == 9


def test_equals_all_pairs(spark):
    draw = random.Random(11)
    texts = [None, "", " \n", "", "One two", "one TWO", "one two three", "a b c d", "A b c d", "a b c d e", "x " * 40]
    for n in [*range(5, 34), 40, 60, 90, 130]:  # around the exact bound, for every small size
        words = [f"s{n}w{i}" for i in range(n + 3)]
        texts += [" ".join(x) for x in (words, words[1:], words[:-2], words[2:-1], [*words, "z"], [*words, "y", "z"], words[:-4], edited(words, 1, draw))]
    passage = [f"p{i}" for i in range(30)]
    for k in range(60):  # a passage that many share; of some it is nearly all
        texts.append(" ".join([*(f"q{k}x{i}" for i in range(draw.choice([0, 1, 2, 6, 30, 90]))), *passage, *(f"r{k}x{i}" for i in range(draw.randrange(3)))]))
    base = [f"b{i}" for i in range(120)]
    texts += [" ".join(edited(base, draw.randrange(8), draw)) for _ in range(150)]  # a large group
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(1, texts[30]), (1, texts[31]), (1, texts[200]), (None, texts[40]), (None, "of its own a b"), (None, texts[41])]
    rows += rows[100:110]
    want = brute(rows)
    assert 100 < len({c for _, _, c in want}) < len(rows) - 200
    assert got(spark, rows) == sorted(map(repr, want))


def test_long_text_and_no_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(5, long), (4, long + " end"), (3, "x" * 300_000), (2, "other")]
    assert got(spark, rows) == sorted(map(repr, [(5, 199_997, 4), (4, 199_998, 4), (3, 1, 3), (2, 1, 2)]))
    assert got(spark, []) == []


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(map(repr, map(tuple, queries.op13_size_aware_jaccard(spark, sf).collect())))
    assert found == sorted(map(repr, brute(rows)))
