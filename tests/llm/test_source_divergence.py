import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.llm import source_divergence as sd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=10, listed=10):
    """Rows (text, lang, source) by the definition, in whole numbers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        found = TERM.findall(text.translate(LOWER))
        groups.add((lang, source))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for k, s in groups if k == lang]

        def share(of):
            whole = sum(of[t] for t in kept)
            return {t: 1 + 10 ** 9 * (of[t] + 2) // (whole + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) * (p - q) // (p + q)

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:listed]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(ranked, 1)}
    return out


def rows_of(df):
    rows = df.collect()
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


def corpus():
    draw = random.Random(3)
    words = [*"the of and in to a is was for ON ÄHM été Straße ΣΊΣΥΦΟΣ 日本 don't x-y e2e".split(), *(f"w{c}" for c in "abcdefghijklmnop")]
    rows = [(None, "en", "a"), ("", "en", "b"), ("...", None, "a"), ("the THE", "", None), ("alone", "xx", "a"), ("alone", "xx", "b"), ("\x00a\x00B\x7f", "en", "a")]
    for _ in range(400):
        source = draw.choice("aaaaabcdé")
        rows.append((" ".join(draw.choices(words, k=draw.randrange(60))) + draw.choice(["", " " + source * 3, "\n1.2"]), draw.choice(["en", "en", "de", None]), draw.choice([source, source, None])))
    return rows + rows[20:60]


@pytest.mark.parametrize("limits", [sd.Limits(), sd.Limits(20, 1 << 20, 7, 13, 9)])
def test_equals_the_definition(spark, limits):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    clashing = docs.select("*", F.lit(1).alias("item"), F.lit("x").alias("value"), F.lit(None).cast("int").alias("n"), F.lit(2).alias("groups"))
    want = brute(rows)
    assert {r[2] for r in want} == {"pair", "term"}
    assert rows_of(sd.audit(clashing, limits=limits)) == want
    assert rows_of(sd.audit(docs, 1, 3, limits)) == brute(rows, 1, 3)


def test_no_rows_no_terms_and_one_long_text(spark):
    schema = "text string, lang string, source string"
    assert rows_of(sd.audit(spark.createDataFrame([], schema))) == set()
    rows = [(None, None, None), (None, None, "b"), ("1 2 3", "en", "a")]
    assert rows_of(sd.audit(spark.createDataFrame(rows, schema))) == brute(rows) == {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}
    rows = [("ab Cd " * 500_000 + "é" * 300_000, "en", s) for s in "xy"] + [("ab", "en", "x")] * 10
    assert rows_of(sd.audit(spark.createDataFrame(rows, schema))) == brute(rows)


def test_long_texts_are_split_between_terms():
    text = "one Two  three,four é日 five".encode() * 3
    assert sd.terms(text, 4) == sd.terms(text) == Counter(t.encode() for t in TERM.findall(text.decode().translate(LOWER)))


def test_shares_do_not_overflow():
    import numpy as np
    counts = np.array([0, 1, 10 ** 12, 8 * 10 ** 15 - 10], np.int64)
    whole, kept = 8 * 10 ** 15, 5
    assert sd.shares(counts, whole, kept).tolist() == [1 + 10 ** 9 * (c + 2) // (whole + 2 * kept) for c in counts.tolist()]
    assert sd.shares(np.array([7]), 7, 1).tolist() == [10 ** 9 + 1]
