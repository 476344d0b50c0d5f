import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from kinfold.llm import sentencepiece_trie as trie

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=trie.MODEL)


def texts():
    draw = random.Random(5)
    made = ["", "  a", "a  ", " ", " " * 100, "日本語 テスト", "smile 😀😀 x\x00y", "\n\n\t\t", "x" * 3000, "ab" * 400, "    def f(x):\n        return x+1", "http://example.com/?q=1&z=äöü", "ÀÉ́  ﬁ"]
    made += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz  äéñ0123.,-") for _ in range(draw.randint(0, 120))) for _ in range(150)]
    made += ["".join(draw.choice(["th", "er", "in", "ing", "tion", " the", "abcabc", "aaa", "zz"]) for _ in range(draw.randint(0, 40))) for _ in range(150)]
    return made


def test_merge_model_equals_the_library_and_round_trips():
    model, made = trie.load(trie.MODEL), texts()
    model.known.clear()
    ids, ends = trie.encode_batch(made, model)
    for i, text in enumerate(made):
        assert ids[ends[i]:ends[i + 1]].tolist() == LIBRARY.encode(text), text
    spelled, at = trie.decode_batch(ids, ends, model)
    assert [spelled[a + 1:b].tobytes().decode() for a, b in zip(at, at[1:])] == made


def as_unigram():
    """The model read as a unigram model: the kind of its trainer is changed, its pieces and scores stay."""
    with open(trie.MODEL, "rb") as file:
        fields = trie._fields(file.read())

    def nested(tag, data):
        size, out = len(data), bytes([tag])
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return out + bytes([size]) + data

    trainer = fields[2][0]
    at = trainer.index(b"\x18\x02")
    trainer = trainer[:at] + b"\x18\x01" + trainer[at + 2:]
    return b"".join(nested(0x0A, p) for p in fields[1]) + nested(0x12, trainer) + nested(0x1A, fields[3][0])


def test_unigram_model_is_never_worse_than_the_library_and_best_by_brute_force():
    serialized = as_unigram()
    model, library = trie.Model(serialized), sentencepiece.SentencePieceProcessor(model_proto=serialized)
    made = [t for t in texts() if len(t) < 300]
    ids, ends = trie.encode_batch(made, model)
    total = lambda found: sum(model.score[i] for i in found)
    for i, text in enumerate(made):
        assert total(ids[ends[i]:ends[i + 1]].tolist()) >= total(library.encode(text)) - 1e-3
    words = sorted({"▁the", "▁there", "▁then", "▁thing", "▁abc", "▁tion"})

    def best(word):
        return max((model.score[model.ids[word[:n]]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in model.ids), default=-1e18) if word else 0.0
    assert [total(found) for found in trie.encode_words(words, model)] == [pytest.approx(best(w)) for w in words]


def test_tables(spark, docs_of):
    docs = docs_of([(1, "hello  world"), (1, "hello  world"), (None, None), (3, ""), (4, "mark▁here"), (5, "long " * 20000)]).withColumn("IDS", F.lit(0))
    rows = trie.tokenized(docs).collect()
    assert len(rows) == 6 and all(r.n_tokens == len(r.ids) for r in rows)
    by_text = {r.text: r for r in rows}
    assert by_text[None].ids == [] and by_text[""].exact and not by_text["mark▁here"].exact and by_text["long " * 20000].exact
    again = {r.text: r.decoded for r in trie.decoded(trie.tokenized(docs)).collect()}
    assert again["hello  world"] == "hello  world" and again["mark▁here"] == "mark here" and again[None] == ""
    assert trie.tokenized(docs_of([])).count() == 0
