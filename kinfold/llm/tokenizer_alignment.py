"""How the tokens of two tokenizers lie over each other.

A text is tokenised whole by both. Where a token of each ends at the same byte and the next token of each begins with a space, the
text is cut: such anchors leave windows of about a word. A window is its two tuples of token ids, and these alone decide how
its tokens overlap, so a task aligns every distinct window once and remembers it. Inside a window, offsets where both end
cut groups, and every two tokens that share a byte are linked.

The count of an id pair is known only over all documents. A task therefore keeps a book of the pairs it meets, which numbers them,
and closes the book after a fixed amount of text; a document goes on as the numbers of its pairs and how often it holds each.
Books are summed by pair, and the counts go back to the books: what is shuffled is a row per book and pair, and not per link.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import arrow_type, column, cut, pieces, without
from kinfold.llm.sentencepiece_trie import MODEL, SPACE, _gathered
from kinfold.llm.token_rollup import VERSION, VOCABULARIES, encoding

#: A book is closed after so many bytes of text; when a task then remembers so many windows or pairs, it forgets them.
BOOK_BYTES, WINDOWS = 1 << 23, 1 << 19
#: Windows of more tokens than this are aligned each time and not remembered.
LONG = 256
#: In a window, ids of the second tokenizer have this bit beside them.
SECOND = 1 << 30
#: What a document gets from its own tokens, and from the counts of all.
OWN = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
COUNTED = "n_best bigint, count_sum bigint"
_BOOK = "kf_book bigint, kf_pairs array<int>, kf_times array<bigint>, kf_number int, kf_a int, kf_b int, kf_n bigint"


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, version: str, folder: str, model: str):
        self.first: tiktoken.Encoding = encoding(version, folder)
        self.second = sentencepiece.SentencePieceProcessor(model_file=model)
        with open(f"{folder}/{version}.tiktoken", "rb") as lines:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.spelled = [ranks.get(i, b"") for i in range(max(ranks) + 1)], [
            bytes([int(n[3:5], 16)]) if self.second.is_byte(i) else b"" if self.second.is_control(i) or self.second.is_unknown(i)
            else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in self.spelled]
        self.spaced = [np.array([x[:1] == b" " for x in side]) for side in self.spelled]
        self.flat = [np.frombuffer(b"".join(side), np.uint8) for side in self.spelled]
        # ids of both sides as text, before another one of the same side and as the last of it
        self.texts = [f"{i}{end}".encode() for side, last in zip(self.spelled, "|;") for end in (",", last) for i in range(len(side))]
        self.text_sizes = np.array([len(x) for x in self.texts], np.int64)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
        """Bytes of the space and each text, and the ids and the number of tokens of all texts, once for each tokenizer.

        A text that is empty, or that the tokens of either do not spell, has none.
        """
        data = [f" {t}".encode() if t else b"" for t in texts]
        found = [
            [self.first.encode_to_numpy(f" {t}", disallowed_special=()).astype(np.int32) if t else np.zeros(0, np.int32) for t in texts],
            [np.array(ids, np.int32) for ids in self.second.encode(texts, num_threads=1)]]
        good = np.ones(len(texts), bool)
        for sizes, flat, ids in zip(self.sizes, self.flat, found):
            ends = np.append(0, np.cumsum([len(x) for x in ids]))
            spelled, at = _gathered(flat, sizes, np.concatenate([np.zeros(0, np.int32), *ids]), ends)
            whole = spelled.tobytes()
            good &= [whole[a:b] == d for a, b, d in zip(at[:-1].tolist(), at[1:].tolist(), data)]
        none = np.zeros(0, np.int32)
        kept = [[x if g else none for x, g in zip(ids, good)] for ids in found]
        return data, [np.concatenate([none, *ids]) for ids in kept], [np.array([len(x) for x in ids], np.int64) for ids in kept]


@lru_cache(maxsize=2)
def load(version: str, folder: str, model: str) -> Tokenizers:
    return Tokenizers(version, folder, model)


class Windows:
    """Alignments of the windows that a task has met, and numbers of the id pairs in them."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.numbers: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.pairs: dict[int, int] = {}
        # pairs of all windows end to end; where a window's begin, how many they are, and its number of groups
        self.flat, self.starts, self.counts, self.n_groups = array("i"), array("q"), array("q"), array("q")

    def align(self, keys: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Groups of each window as text, their number, the number of links, and the pairs of the links of all.

        The windows are laid end to end. Both sides of a window spell the same bytes, so its last tokens end together, and a link
        begins with each byte at which a token of either side does.
        """
        both = np.frombuffer(b"".join(keys), np.int32)
        of_first = both < SECOND
        sides = [both[of_first], both[~of_first] - np.int32(SECOND)]
        key_ends = np.cumsum([len(k) // 4 for k in keys])
        ends = [np.cumsum(sizes[ids]) for sizes, ids in zip(self.tokenizers.sizes, sides)]
        here = np.zeros((2, int(ends[0][-1]) + 1), bool)
        for flags, at in zip(here, ends):
            flags[at] = True
        stops, shared = np.flatnonzero(here[0] | here[1]), np.flatnonzero(here[0] & here[1])
        a, b = (ids[np.searchsorted(at, stops)] for ids, at in zip(sides, ends))
        codes, places = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        pairs = self.pairs
        links = np.array([pairs.setdefault(c, len(pairs)) for c in codes.tolist()], np.int32)[places]
        window_ends = ends[0][np.cumsum(of_first)[key_ends - 1] - 1]
        n_links, n_groups = (np.diff(np.append(0, np.searchsorted(at, window_ends, side="right"))) for at in (stops, shared))
        # both sides of a group in turn: tokens are sorted by group, side and place
        group = np.concatenate([np.searchsorted(shared, at) * 2 + side for side, at in enumerate(ends)])
        order = np.argsort(group, kind="stable")
        last = np.append(group[order][1:] != group[order][:-1], True)
        half_a, half_b = map(len, self.tokenizers.spelled)
        # where the text of each id is: those of the second side come after both halves of the first
        place = np.concatenate([sides[0], sides[1] + 2 * half_a])[order] + last * np.where(order < len(sides[0]), half_a, half_b)
        text_ends = np.cumsum(self.tokenizers.text_sizes[place])[key_ends - 1]
        whole = b"".join(map(self.tokenizers.texts.__getitem__, place.tolist()))
        groups = [whole[i:j - 1] for i, j in zip([0, *text_ends[:-1].tolist()], text_ends.tolist())]
        return groups, n_groups, n_links, links

    def remember(self, keys: list[bytes]) -> None:
        groups, n_groups, n_links, links = self.align(keys)
        first = len(self.numbers)
        self.numbers.update(zip(keys, range(first, first + len(keys))))
        self.starts.frombytes((np.cumsum(n_links) - n_links + len(self.flat)).tobytes())
        self.flat.frombytes(links.tobytes())
        self.counts.frombytes(n_links.tobytes())
        self.n_groups.frombytes(n_groups.tobytes())
        self.groups.extend(groups)

    def documents(self, data: list[bytes], ids: list[np.ndarray], counts: list[np.ndarray], long: int = LONG) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
        """Groups, links, groups as text, and pairs with their times, of each document."""
        keys, firsts = self._cut(ids, counts)
        numbers = self.numbers
        windows = list(map(numbers.get, keys))
        unseen = [place for place, number in enumerate(windows) if number is None]
        fresh = list(dict.fromkeys([keys[place] for place in unseen]))
        short = [k for k in fresh if len(k) <= 4 * long]
        if short:
            self.remember(short)
        once = {k: self.align([k]) for k in fresh if len(k) > 4 * long}  # long windows, not to be remembered
        for place in unseen:
            windows[place] = numbers.get(keys[place])
        flat, starts = np.frombuffer(self.flat, np.int32).copy(), np.frombuffer(self.starts, np.int64).copy()
        n_links, n_groups = np.frombuffer(self.counts, np.int64).copy(), np.frombuffer(self.n_groups, np.int64).copy()
        texts = self.groups
        place_of = np.array([0 if w is None else w for w in windows] if once else windows, np.int64)
        for begin, end in zip(firsts, firsts[1:]):
            own, known = windows[begin:end], place_of[begin:end]
            if once and None in own:
                apart = {k: once[keys[begin + k]] for k, w in enumerate(own) if w is None}
                spelled = [apart[k][0][0] if w is None else texts[w] for k, w in enumerate(own)]
                known = known[[w is not None for w in own]]
            else:
                apart, spelled = {}, map(texts.__getitem__, own)
            count = n_links[known]
            total = np.cumsum(count)
            at = np.repeat(starts[known] - (total - count), count)
            at += np.arange(len(at))
            every = np.concatenate([flat[at], *(x[3] for x in apart.values())]) if apart else flat[at]
            met, times = np.unique(every, return_counts=True)
            yield int(n_groups[known].sum()) + sum(int(x[1][0]) for x in apart.values()), len(every), b";".join(spelled), met, times

    def _cut(self, ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[bytes], list[int]]:
        """Windows of all documents, and where each document's begin and the last's end.

        A window is the ids of the first side, followed by those of the second with ``SECOND``. A cut is a byte after which both sides begin a document or a token with a space.
        """
        at = []
        starts = [np.cumsum(sizes[x]) - sizes[x] for sizes, x in zip(self.tokenizers.sizes, ids)]
        size = int(max((s[-1] for s in starts if len(s)), default=0)) + 1
        here = np.zeros((2, size), bool)
        new = [np.zeros(len(x), bool) for x in ids]
        for flags, start, spaced, x, n, begins in zip(here, starts, self.tokenizers.spaced, ids, counts, new):
            begins[(np.cumsum(n) - n)[n > 0]] = True
            flags[start[spaced[x] | begins]] = True
        anchors = here[0] & here[1]
        for start, x, spaced, begins in zip(starts, ids, self.tokenizers.spaced, new):
            at.append(np.append(np.flatnonzero(anchors[start] & (spaced[x] | begins)), len(x)))
        # both sides of a window lie together: a token moves on by those of the other side before it
        both = np.empty(sum(map(len, ids)), np.int32)
        both[np.arange(len(ids[0])) + np.repeat(at[1][:-1], np.diff(at[0]))] = ids[0]
        both[np.arange(len(ids[1])) + np.repeat(at[0][1:], np.diff(at[1]))] = ids[1] + np.int32(SECOND)
        spelled, cuts = both.tobytes(), ((at[0] + at[1]) * 4).tolist()
        keys = [spelled[i:j] for i, j in zip(cuts, cuts[1:])]
        firsts = np.searchsorted(at[0], np.append(0, np.cumsum(counts[0])))
        return keys, firsts.tolist()


Finish = Callable[[bytes], tuple[Any, ...]]
GROUPS = T.StructType([T.StructField("groups", T.StringType())])


def _as_text(groups: bytes) -> tuple[str]:
    return (groups.decode(),)


def aligned(
    docs: DataFrame, finish: Finish = _as_text, finished: T.StructType = GROUPS, text: str = "text", version: str = VERSION,
    folder: str = VOCABULARIES, model: str = MODEL, book_bytes: int = BOOK_BYTES, long: int = LONG,
) -> DataFrame:
    """``docs`` less the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and what ``finish`` makes of the groups.

    The first tokenizer reads a space and the text, the second the text, to which it adds the space. n_a and n_b count tokens. The
    groups are ``a1,a2|b1;a3|b2,b3`` with the ids in order. n_best counts links whose pair is the most frequent of its second
    id over all documents, ties included; count_sum adds up the pairs' counts over all links. A null or empty text, or one that a
    tokenizer does not spell (with the mark U+2581), has no tokens: counts are 0 and the groups empty. Columns that are called as new
    ones are replaced; all rows stay, repeated ones too.
    """
    own, counted, book = T.StructType.fromDDL(OWN), T.StructType.fromDDL(COUNTED), T.StructType.fromDDL(_BOOK)
    new = [f.name for f in [*own, *counted, *finished, *book]]
    kept = without(docs, *new)
    names = [c for c in kept.columns if c != text]
    plain = [kept.schema[c] for c in names]
    made = T.StructType([*[T.StructField(f.name, f.dataType) for f in plain], *own, *finished, *book])
    result = T.StructType([*[T.StructField(f.name, f.dataType) for f in plain], *own, *counted, *finished])
    schema, answer = (pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in fields]) for fields in (made, result))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = load(version, folder, model)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        windows, times, held = Windows(tokenizers), np.zeros(1 << 12, np.int64), 0

        def closed() -> Iterator[pa.RecordBatch]:
            met = np.flatnonzero(times)
            n = len(met)
            if n:
                codes = np.fromiter(windows.pairs, np.int64, len(windows.pairs))[met]
                found = {"kf_book": np.full(n, number), "kf_number": met, "kf_a": codes >> 32, "kf_b": codes & 0xFFFFFFFF, "kf_n": times[met]}
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(n, f.type) for f in schema], schema=schema)

        for batch in pieces(batches, text):
            rows = {f.name: [] for f in [*own, *finished, *book]}
            data, ids, counts = tokenizers.encode([t or "" for t in batch.column(text).to_pylist()])
            for n_a, n_b, (n_groups, n_links, whole, met, often) in zip(*(c.tolist() for c in counts), windows.documents(data, ids, counts, long)):
                for name, value in zip(rows, (n_a, n_b, n_groups, n_links, *finish(whole), number, met, often, None, None, None, None)):
                    rows[name].append(value)
                if len(met) and met[-1] >= len(times):
                    times = np.concatenate([times, np.zeros(max(int(met[-1]) + 1, len(times)), np.int64)])
                times[met] += often
            arrays = [batch.column(f.name) if f.name in names else pa.array(rows[f.name], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            held += sum(map(len, data))
            if held >= book_bytes:
                yield from closed()
                number, times, held = number + 1, np.zeros(len(times), np.int64), 0
                if len(windows.numbers) >= WINDOWS or len(windows.pairs) >= WINDOWS:
                    windows = Windows(tokenizers)
        yield from closed()

    rows = cut(docs.select(*[column(c) for c in [*names, text]]).mapInArrow(read, made))
    books = rows.where(F.col("kf_number").isNotNull()).select(F.col("kf_book").alias("kf_of"), "kf_number", "kf_a", "kf_b", "kf_n")
    counts = cut(books.groupBy("kf_a", "kf_b").agg(F.sum("kf_n").alias("kf_count")))
    best = counts.groupBy("kf_b").agg(F.max("kf_count").alias("kf_most"))
    judged = counts.join(best, "kf_b").select("kf_a", "kf_b", "kf_count", (F.col("kf_count") == F.col("kf_most")).alias("kf_best"))
    back = books.join(judged, ["kf_a", "kf_b"]).select("kf_of", "kf_number", "kf_count", "kf_best")
    documents = rows.where(F.col("kf_number").isNull()).drop("kf_number", "kf_a", "kf_b", "kf_n")

    def finish_book(of_book: pa.Table, pairs: pa.Table) -> pa.Table:
        numbers = pairs.column("kf_number").to_numpy()
        count, is_best = np.zeros((2, int(numbers.max(initial=-1)) + 1), np.int64)
        count[numbers], is_best[numbers] = pairs.column("kf_count").to_numpy(), pairs.column("kf_best").to_numpy()
        met, often = (pc.list_flatten(of_book.column(c)).to_numpy() for c in ("kf_pairs", "kf_times"))
        ends = np.append(0, np.cumsum(pc.list_value_length(of_book.column("kf_pairs")).to_numpy()))
        sums = lambda values: np.diff(np.append(0, np.cumsum(values[met] * often))[ends])
        found = {"n_best": sums(is_best), "count_sum": sums(count)}
        return pa.Table.from_arrays([pa.chunked_array([pa.array(found[f.name], f.type)]) if f.name in found else of_book.column(f.name) for f in answer], schema=answer)

    return documents.groupBy("kf_book").cogroup(back.groupBy("kf_of")).applyInArrow(finish_book, result)
