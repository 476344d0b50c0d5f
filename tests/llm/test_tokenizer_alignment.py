import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import queries
from kinfold.llm import tokenizer_alignment as ta

A = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")


def byte_letters():
    """The letters that stand for bytes in vocabulary A: printable Latin-1 letters for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = byte_letters()


def spans(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def brute(texts):
    docs, count = [], Counter()
    for text in texts:
        groups, links, a, b = [], [], [], []
        if text:
            data = f" {text}".encode()
            a, b = A.encode(f" {text}", add_special_tokens=False).ids, B.encode(text)
            bytes_a = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
                a, b = [], []
            else:
                at_a, at_b = spans(map(len, bytes_a)), spans(map(len, bytes_b))
                j = 0
                for i, (s, e) in enumerate(at_a):
                    while at_b[j][1] <= s:
                        j += 1
                    k = j
                    while k < len(b) and at_b[k][0] < e:
                        links.append((a[i], b[k]))
                        k += 1
                ia = ib = 0
                for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
                    ja, jb = ia, ib
                    while ja < len(a) and at_a[ja][1] <= end:
                        ja += 1
                    while jb < len(b) and at_b[jb][1] <= end:
                        jb += 1
                    groups.append(",".join(map(str, a[ia:ja])) + "|" + ",".join(map(str, b[ib:jb])))
                    ia, ib = ja, jb
        docs.append((len(a), len(b), groups, links))
        count.update(links)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(na, nb, len(g), len(l), sum(count[x] == most[x[1]] for x in l), sum(count[x] for x in l), ";".join(g)) for na, nb, g, l in docs]


def corpus():
    draw = random.Random(4)
    texts = [None, "", " ", "  two  spaces ", "a▁b", "▁", "\x00 nul\x00", "tab\tand\nlines\r\n\n end ", "日本語 テスト 😀😀", "<|endoftext|> <s>", "x" * 700, "ab" * 900 + " ab", "é ﬁ",
             "http://example.com/?q=1&z=äöü", "don't  we'll", " 12345 67,89", "naïve naïve naïve", "ÀÉ́ "]
    parts = ["the ", "of ", "tion", "ing ", " a", "Xyz", "é", "\n", "  ", "123", ", ", "日", "anti", "hend", " ", "ß "]
    texts += ["".join(draw.choices(parts, k=draw.randrange(80))) for _ in range(120)]
    return texts + texts[:40]


@pytest.mark.parametrize("limits", [{}, {"book_bytes": 100, "long": 2}])
def test_equals_the_definition(spark, limits):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    clashing = docs.select("*", F.lit("x").alias("n_a"), F.lit(1).alias("KF_BOOK"), F.lit(None).cast("date").alias("day"), F.array(F.lit(1)).alias("a b"))
    found = ta.aligned(clashing, **limits)
    assert found.columns == ["doc_id", "day", "a b", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = {r.doc_id: tuple(r)[3:] for r in found.collect()}
    want = brute(texts)
    assert got == dict(enumerate(want))
    assert sum(w[2] > 3 for w in want) > 50 and sum(w[4] < w[3] for w in want) > 20


def test_ids_may_be_null_or_repeated(spark):
    rows = [(None, "one two"), (None, "three"), (1, "one two"), (1, "one two"), (1, None)]
    got = ta.aligned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute([t for _, t in rows])
    assert sorted((repr(r.doc_id), tuple(r)[1:]) for r in got) == sorted((repr(i), w) for (i, _), w in zip(rows, want))
    assert ta.aligned(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_text_without_anchors_is_one_window(spark):
    texts = ["日本" * 600, "a\n" * 900 + " b", "x" * 3000]
    got = {r.doc_id: tuple(r)[1:] for r in ta.aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_query_digests_the_groups_of_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_window_alignment(spark, sf).collect()}
    for r, w in zip(rows, brute([r.text for r in rows])):
        g = got[r.doc_id]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum) == w[:6]
        assert g.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_a_window_is_one_run_of_both_sides(spark):
    tokenizers = ta.load(ta.VERSION, ta.VOCABULARIES, ta.MODEL)
    _, ids, counts = tokenizers.encode(["one two", "", "one naïvely"])
    keys, firsts = ta.Windows(tokenizers)._cut(ids, counts)
    sides = [[], []]
    for key in keys:
        window = [int.from_bytes(key[i:i + 4], "little") for i in range(0, len(key), 4)]
        first = [i for i in window if i < 1 << 30]
        assert window == first + sorted(window[len(first):], key=lambda i: i < 1 << 30)
        sides[0] += first
        sides[1] += [i - (1 << 30) for i in window[len(first):]]
    assert sides == [x.tolist() for x in ids] and keys[0] == keys[firsts[2]] and firsts[1] == firsts[2]
