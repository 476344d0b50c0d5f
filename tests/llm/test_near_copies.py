import random
from fractions import Fraction
from itertools import combinations

import pytest

from kinfold.llm import components, near_copies, simhash_gray


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    sets, low = [brute_set(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] | sets[j])
        if not both or Fraction(len(sets[i] & sets[j]), both) >= Fraction(4, 5):
            old, new = max(low[i], low[j]), min(low[i], low[j])
            low = [new if x == old else x for x in low]
    return low


def edited(words, n, draw):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"n{draw.random()}"
    return words


@pytest.mark.parametrize("at_once", [1 << 20, 50])
def test_sets_are_linked_exactly_at_the_bound(monkeypatch, at_once):
    monkeypatch.setattr(near_copies, "COMPARED_AT_ONCE", at_once)
    base = " ".join(map(str, range(84)))  # 80 shingles
    texts = [base, base + " a b c d" + " e" * 16, base + " a b c d" + " e" * 17 + " f", "x " * 30, "x y z", "x y", "x y z w v", *map(str, range(3))]
    sets = [near_copies.shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    linked = set(map(frozenset, zip(*near_copies.alike(sets))))
    low = brute_groups(texts)
    assert {tuple(sorted(p)) for p in linked} <= {p for p in combinations(range(len(texts)), 2) if low[p[0]] == low[p[1]]}
    assert len(linked) == len(texts) - len(set(low)) > 0


def test_near_copies_are_found_and_only_they(spark, docs_of):
    draw = random.Random(8)
    texts = [None, "", " \n", "One two", "one TWO", "one two three"]
    for _ in range(25):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.randint(40, 400))]
        texts += [" ".join(edited(words, round(len(words) * part), draw)) for part in (0, 0.01, 0.015, 0.02, 0.03, 0.1)]
    low = brute_groups(texts)
    assert 30 < len(set(low)) < len(texts) - 30
    docs = docs_of(list(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in simhash_gray.groups(docs).collect()}
    assert got == dict(enumerate(low))
    assert sorted(r.doc_id for r in simhash_gray.survivors(docs).collect()) == sorted(set(low))


def test_the_given_tables_lose_every_near_copy_in_the_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    low = brute_groups([r.text for r in rows])
    assert sorted(r.doc_id for r in simhash_gray.survivors(docs).collect()) == sorted(rows[i].doc_id for i in set(low))


def test_nothing_is_broadcast_in_the_stage(spark, docs_of, monkeypatch):
    plans = []
    cut = near_copies.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for module in (near_copies, simhash_gray, components):
        monkeypatch.setattr(module, "cut", seen)
    words = [f"w{i}" for i in range(60)]
    left = simhash_gray.survivors(docs_of([(i, " ".join(words[:40 + i % 3] + ["end"])) for i in range(12)] + [(20, "other words than these"), (21, None)]))
    plans.append(left._jdf.queryExecution().executedPlan().toString())
    assert left.count() > 1 and sum("SortMergeJoin" in p for p in plans) > 5
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
