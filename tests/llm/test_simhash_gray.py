import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kinfold.llm import components, simhash_gray


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups_of(values):
    """Smallest member of the group of each number, linked at two bits or fewer."""
    values, low = sorted(set(values)), {}
    for v in values:
        if v not in low:
            todo, seen = [v], {v}
            while todo:
                x = todo.pop()
                near = [y for y in values if y not in seen and bin(x ^ y).count("1") <= 2]
                seen.update(near)
                todo.extend(near)
            low.update((x, v) for x in seen)
    return low


def test_fingerprints():
    draw = random.Random(1)
    texts = [None, "", " \n", "One", "one TWO", "Ärger ÄRGER a", "a\x0bb\x1cc d\x85e", "the cat sat " * 400]
    texts += [" ".join(draw.choice(["a", "b", "C", "dd", "é"]) for _ in range(draw.randint(1, 40))) for _ in range(40)]
    assert [simhash_gray.fingerprint(t) for t in texts] == [signed(brute_fingerprint(t)) for t in texts]


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(str(i % 91) for i in range(500))
    want = simhash_gray.fingerprint(text)
    monkeypatch.setattr(simhash_gray, "SHINGLES_AT_ONCE", 37)
    assert simhash_gray.fingerprint(text) == want


def clustered(n, seed):
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(6)]
    return sorted({draw.choice(centres) ^ sum({1 << draw.randrange(24) for _ in range(draw.randint(0, 5))}) for _ in range(n)} | {0, 1, (1 << 64) - 1})


def test_links_connect_exactly_the_groups_also_where_nodes_are_crowded(spark):
    values = clustered(500, 3)
    want = groups_of(values)
    frame = spark.createDataFrame([(signed(v),) for v in values], "bits bigint")
    for crowd in (simhash_gray.CROWD, 4):
        found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash_gray.links(frame, crowd).collect()]
        assert all(want[a] == want[b] for a, b in found)
        label = {v: v for v in values}
        for _ in values:
            new = dict(label)
            for a, b in found:
                new[a] = new[b] = min(new[a], new[b])
            if new == label:
                break
            label = new
        assert label == want


def test_search_in_small_blocks(monkeypatch):
    values = np.array(clustered(300, 9), np.uint64)
    rank = values.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    values = values[np.argsort(rank)]
    whole = simhash_gray.search(np.array([0, 40]), values.view(np.int64))
    monkeypatch.setattr(simhash_gray, "PAIRS_AT_ONCE", 500)
    parts = simhash_gray.search(np.array([0, 40]), values.view(np.int64))
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_components_of_a_long_chain(spark):
    chain = list(range(100, 160))
    random.Random(2).shuffle(chain)
    edges = [*zip(chain, chain[1:]), (1, 2), (2, 1), (7, 7)]
    got = {(r.node, r.root) for r in components.stars(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(n, 100) for n in range(101, 160)} | {(2, 1)}
    assert components.stars(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_and_survivors(spark, docs_of):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf " * 6
    rows = [(9, base), (4, base.upper()), (4, base.upper()), (6, "other words here entirely"), (None, None), (12, ""), (13, " \t"), (None, "lonely text of a null id")]
    docs = docs_of(rows).withColumn("component_id", F.lit(0)).withColumn("bits", F.lit(1))
    got = simhash_gray.groups(docs).collect()
    prints = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
    assert len(got) == 8 and prints[9] == prints[4] and prints[4][1] == 4 and prints[12] == ("0" * 16, 12) == prints[13]
    assert {r.component_id for r in got if r.doc_id is None} == {12, None}
    kept = simhash_gray.survivors(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["12", "4", "6", "None"]
    assert simhash_gray.groups(docs.limit(0)).count() == 0 and simhash_gray.survivors(docs.limit(0)).count() == 0


def test_survivors_of_null_and_repeated_ids_are_told_apart_by_their_texts(spark, docs_of):
    draw = random.Random(5)
    texts = [" ".join(str(draw.random()) for _ in range(60)) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3])]
    kept = simhash_gray.survivors(docs_of(rows)).collect()
    assert sorted(r.text for r in kept) == sorted(texts)


def test_survivors_come_through_the_index(spark, docs_of, monkeypatch):
    draw = random.Random(9)
    words = [str(draw.random()) for _ in range(400)]
    rows = [(k, " ".join(words[:200] + [f"w{k}"] + words[200:])) for k in range(6)] + [(9, "a text apart from the others")]
    asked, search = [], simhash_gray.links
    monkeypatch.setattr(simhash_gray, "links", lambda prints, crowd: asked.append(prints.count()) or search(prints, crowd))
    kept = simhash_gray.survivors(docs_of(rows)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 9] and asked and asked[0] >= 2
