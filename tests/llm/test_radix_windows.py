import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import radix_windows


def brute(texts):
    """Spans of bytes under a 200-byte window that starts anywhere else too."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    answers = []
    for d in data:
        spans = []
        for i in range(len(d) - 199):
            if count[d[i:i + 200]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 200
                else:
                    spans.append([i, i + 200])
        answers.append(spans)
    return answers


def prose(n, draw):
    return " ".join("".join(draw.choice("abcdefghé") for _ in range(draw.randint(1, 8))) for _ in range(n))


def corpus(seed):
    draw = random.Random(seed)
    passages = [prose(draw.randint(30, 90), draw) for _ in range(4)] + ["=" * 260, "ab" * 150, "x" * 199, "y" * 200]
    texts = [None, "", "short", "q" * 2500, "q" * 450]
    for _ in range(40):
        parts = [prose(draw.randint(1, 60), draw) for _ in range(draw.randint(1, 3))]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            cut = draw.randint(0, len(p) // 3)
            parts.insert(draw.randint(0, len(parts)), p[cut:] if draw.random() < 0.5 else p)
        texts.append(draw.choice(["", " ", "\n"]).join(parts))
    texts += texts[-3:] + [texts[-4][:300] + "!" + texts[-4][301:], texts[-5] + texts[-5]]
    return texts


def spans_of(spark, docs):
    return [(r.doc_id, [list(s) for s in r.spans], r.kept) for r in radix_windows.strip(docs).collect()]


def test_spans_equal_brute_force(spark, docs_of):
    for seed in (1, 2):
        texts = corpus(seed)
        got = {i: (s, kept) for i, s, kept in spans_of(spark, docs_of(list(enumerate(texts))))}
        for i, (text, spans) in enumerate(zip(texts, brute(texts))):
            assert got[i][0] == spans, (seed, i)
            assert got[i][1] == radix_windows.rest((text or "").encode(), np.array(spans, int).reshape(-1, 2)).decode("utf-8", "ignore")


def test_long_texts_are_read_in_parts(spark, docs_of, monkeypatch):
    draw = random.Random(7)
    long = prose(900, draw)
    texts = [long, "begin " + long[500:2600] + " end", prose(50, draw), long[:1100]]
    want = brute(texts)
    monkeypatch.setattr(radix_windows, "PART", 700)
    seen = []
    for name in ("_families_of", "_blocks_of", "_windows_of"):
        seen.append(getattr(radix_windows, name))
    rows = [(i, 0, t.encode()) for i, t in enumerate(texts)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * 4), pa.array([r[2] for r in rows])], names=["id", "crc", "text"])
    found = [x for b in seen[0]([batch]) for x in b.to_pylist()]
    starts = Counter((x["id"], p) for x in found for p in range(x["first"], x["last"] + 1))
    assert starts == Counter((i, p) for i, _, t in rows for p in range(len(t) - 199))
    got = spans_of(spark, docs_of(list(enumerate(texts))))
    assert {i: s for i, s, _ in got} == dict(enumerate(want))


def test_repeated_rows_null_ids_and_clashes(spark, docs_of):
    draw = random.Random(9)
    a, b, c = prose(80, draw), prose(80, draw), prose(80, draw)
    docs = docs_of([(1, a), (1, a), (None, b), (None, c), (3, "x " + c), (3, None)]).withColumn("SPANS", F.lit(1)).withColumn("id", F.lit("i"))
    got = radix_windows.strip(docs).collect()
    assert len(got) == 6 and all(r.id == "i" for r in got)
    kept = Counter((r.doc_id, r.kept) for r in got)
    assert kept == Counter([(1, ""), (1, ""), (None, b), (None, ""), (3, "x "), (3, "")])
    assert radix_windows.strip(docs.limit(0)).count() == 0


def test_covered_runs():
    assert radix_windows.covered(np.array([[5, 9], [0, 2], [300, 300], [209, 209]])).tolist() == [[0, 500]]
    assert radix_windows.covered(np.array([[0, 0], [201, 201]])).tolist() == [[0, 200], [201, 401]]
    assert radix_windows.covered(np.zeros((0, 2), int)).tolist() == []
