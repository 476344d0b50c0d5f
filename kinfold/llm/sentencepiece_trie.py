"""SentencePiece encoding and decoding by a Viterbi search that words share.

A text is cut into marked words, which no piece of the vocabulary crosses. The distinct words of a record batch are sorted, so
that they lie in the order in which a depth-first walk of their trie meets them. A word starts from the forward states that
the word before it left along their common prefix, and computes only those of its own letters.

The forward state of a prefix is the last piece of its best segmentation. In a unigram model that is the one with the highest
sum of scores. A merge (BPE) model admits a step only when merging would leave the two pieces apart; as every prefix of a
merged text is merged by itself, exactly one admitted path reaches each prefix, and it is the merged result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinfold.llm.common import column, pieces, without

#: The public model, on every executor.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MARKED = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
UNIGRAM, MERGES = 1, 2
#: Pairs of pieces of which a task remembers whether merging leaves them apart, and words of which it keeps the pieces.
REMEMBERED, WORDS_KNOWN = 1 << 19, 1 << 18


def _fields(data: bytes) -> dict[int, list]:
    """Fields of a serialized protocol buffer message: numbers, or bytes of nested messages."""
    at, found = 0, {}

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            value, at = data[at:at + size], at + size
        found.setdefault(tag >> 3, []).append(value)
    return found


class Model:
    """Pieces, scores and kind of a SentencePiece model that leaves texts as they are but for the spaces."""

    def __init__(self, serialized: bytes):
        model = _fields(serialized)
        trainer, normalizer = _fields(model.get(2, [b""])[0]), _fields(model.get(3, [b""])[0])
        self.kind = trainer.get(3, [UNIGRAM])[0]
        if self.kind not in (UNIGRAM, MERGES) or normalizer.get(2, [b""])[0] or normalizer.get(4, [1])[0] or not normalizer.get(3, [1])[0]:
            raise ValueError("the model is neither unigram nor BPE, or changes texts by more than a leading space")
        library = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i) or library.is_byte(i))]
        self.ids = {names[i]: i for i in plain}
        self.score = [library.get_score(i) for i in range(size)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if library.is_byte(i)}
        if len(self.bytes) != 256 or any(re.search(f"[^{SPACE}]{SPACE}", n) for n in self.ids):
            raise ValueError("the model has no byte pieces, or pieces that cross marked words")
        self.spelled = [b""] * size
        for name, i in self.ids.items():
            self.spelled[i] = name.replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            self.spelled[i] = bytes([byte])
        self.spelled_sizes = np.array([len(x) for x in self.spelled], np.int64)
        self.spelled_flat = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.names = names
        ending: dict[str, set[int]] = {}
        for name in self.ids:
            if len(name) >= 3:
                ending.setdefault(name[-3:], set()).add(len(name))
        self._ending = {tail: sorted(found, reverse=True) for tail, found in ending.items()}
        self.sizes: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.unknown = min(self.score[i] for i in plain) - 10 if plain else 0.0
        self._courses: dict[int, tuple] = {}
        self._apart: dict[int, bool] = {}

    def sizes_of(self, tail: str) -> tuple[int, ...]:
        """Lengths, longest first, of the pieces that end in the last three letters of a prefix, or in fewer of them."""
        if len(self.sizes) >= REMEMBERED:
            self.sizes.clear()
        short = [n for n in (2, 1) if len(tail) >= n and tail[-n:] in self.ids]
        found = self.sizes[tail] = tuple([*(self._ending.get(tail, ()) if len(tail) == 3 else ()), *short])
        return found

    def _course(self, piece: int) -> tuple[bool, list[tuple[int, float]], list[tuple[int, float]]]:
        """How a piece is merged from its letters: whether it is, and its first and last part before each merge with that merge's score."""
        if piece not in self._courses:
            parts, firsts, lasts = list(self.names[piece]), [], []
            while len(parts) > 1:
                best = max(
                    ((self.score[m], -i) for i in range(len(parts) - 1) if (m := self.ids.get(parts[i] + parts[i + 1])) is not None), default=None)
                if best is None:
                    break
                at = -best[1]
                firsts.append((parts[0], best[0]))
                lasts.append((parts[-1], best[0]))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            end = -float("inf")
            self._courses[piece] = (len(parts) == 1, [*firsts, (parts[0], end)], [*lasts, (parts[-1], end)])
        return self._courses[piece]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the letters of two pieces ends with these two.

        Each side is merged as if alone as long as no merge over the border has a higher score than the next of either side;
        of equal scores the one further left goes first.
        """
        if len(self._apart) >= REMEMBERED:
            self._apart.clear()
        found = self._apart[left << 32 | right] = self._stay_apart(left, right)
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        (whole_left, _, lasts), (whole_right, firsts, _) = self._course(left), self._course(right)
        if not (whole_left and whole_right):
            return False
        i = j = 0
        while True:
            (last, next_left), (first, next_right) = lasts[i], firsts[j]
            over = self.ids.get(last + first)
            if over is not None and self.score[over] > next_left and self.score[over] >= next_right:
                return False
            if i + 1 == len(lasts) and j + 1 == len(firsts):
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1


def encode_words(words: Sequence[str], model: Model) -> list[tuple[int, ...]]:
    """Pieces of sorted distinct words; letters that no piece spells become their bytes.

    The states along the path to the current word are kept as a stack: to go on to the next word it is cut back to the prefix
    both share. Recursion depth and memory follow the longest word, not the number of words.
    """
    ids, sizes, score, checked, merges = model.ids, model.sizes, model.score, model._apart, model.kind == MERGES
    path, last, width, best = "", [-1], [0], [0.0]  # per prefix length: last piece (-1: an unspelled letter or none), its length, score
    found = []
    for word in words:
        shared, most = 0, min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del last[shared + 1:], width[shared + 1:], best[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            top, piece_at, width_at = -float("inf"), -1, 1
            tail = word[max(end - 3, 0):end]
            for size in sizes.get(tail) or model.sizes_of(tail):
                before = end - size
                if before < 0 or (piece := ids.get(word[before:end])) is None:
                    continue
                if merges:
                    left = last[before]
                    if left < 0:
                        stays = model._course(piece)[0]
                    elif (stays := checked.get(left << 32 | piece)) is None:
                        stays = model.apart(left, piece)
                    if stays:
                        top, piece_at, width_at = 0.0, piece, size
                        break
                elif best[before] + score[piece] > top:
                    top, piece_at, width_at = best[before] + score[piece], piece, size
            if piece_at < 0:
                top = best[end - 1] + model.unknown
            last.append(piece_at), width.append(width_at), best.append(top)
        path, end, pieces_ = word, len(word), []
        while end:
            if last[end] >= 0:
                pieces_.append(last[end])
            else:
                pieces_.extend(model.bytes[b] for b in reversed(word[end - 1].encode()))
            end -= width[end]
        found.append(tuple(reversed(pieces_)))
    return found


def marked(text: str) -> list[str]:
    """Marked words of a text: spaces become marks, and a mark leads."""
    return MARKED.findall(SPACE + text.replace(" ", SPACE)) if text else []


def encode_batch(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts end to end, and where each text's begin and the last's end."""
    codes: dict[str, int] = {}
    words, ends = [], [0]
    for text in texts:
        words.extend(codes.setdefault(w, len(codes)) for w in marked(text))
        ends.append(len(words))
    known = model.known
    fresh = sorted(w for w in codes if w not in known)
    if len(known) + len(fresh) > WORDS_KNOWN:
        known.clear()
        fresh = sorted(codes)
    known.update(zip(fresh, encode_words(fresh, model)))
    by_code = [known[w] for w in codes]
    if len(known) > WORDS_KNOWN:
        known.clear()
    sizes = np.fromiter(map(len, by_code), np.int64, len(by_code))
    flat = np.fromiter(chain.from_iterable(by_code), np.int32, int(sizes.sum()))
    return _gathered(flat, sizes, np.asarray(words, np.int64), np.asarray(ends))


def decode_batch(pieces_: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes that the pieces spell, with the leading space, and where each text's begin and the last's end."""
    return _gathered(model.spelled_flat, model.spelled_sizes, pieces_, ends)


def _gathered(flat: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen ones of the parts laid end to end in ``flat``; ``ends`` count parts, the returned ones what the parts hold."""
    starts = np.cumsum(sizes) - sizes
    count = sizes[chosen]
    total = np.append(0, np.cumsum(count))
    at = np.arange(total[-1]) + np.repeat(starts[chosen] - total[:-1], count)
    return flat[at], total[ends]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


def tokenized(docs: DataFrame, model: str = MODEL, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ids (pieces), n_tokens and exact: whether decoding the ids gives the text back.

    A null or empty text has no ids. A text that holds the mark itself decodes to one with spaces in its place and is not
    exact. Columns with the name of a new one are replaced; every row stays.
    """
    kept = without(docs, "ids", "n_tokens", "exact")
    names = [c for c in kept.columns if keep_text or c != text]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = load(model)
        for batch in pieces(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            ids, ends = encode_batch(texts, loaded)
            spelled, at = decode_batch(ids, ends, loaded)
            data = spelled.tobytes()
            exact = [data[a + 1:b] == t.encode() for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), lists, pc.cast(pc.list_value_length(lists), pa.int64()), pa.array(exact)], names=[*names, "ids", "n_tokens", "exact"])

    added = T.StructType.fromDDL("ids array<int>, n_tokens bigint, exact boolean")
    return docs.select(*[column(c) for c in kept.columns]).mapInArrow(encode, T.StructType([*[kept.schema[c] for c in names], *added]))


def decoded(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """``encoded`` with decoded, the text that its ids spell; null ids spell an empty one. A column called decoded is replaced."""
    kept = without(encoded, "decoded")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = load(model)
        for batch in batches:
            lists = batch.column(ids)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            data, at = decode_batch(lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)), loaded)
            whole = data.tobytes()
            texts = [whole[a + 1:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.select(*[column(c) for c in kept.columns]).mapInArrow(decode, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))
