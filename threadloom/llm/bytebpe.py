"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

Each text is cut into the pieces of the tokenizer's pattern with NumPy, the pieces of a batch are made
distinct by Arrow, and each distinct piece is encoded once by *prefix dynamic programming*: for every byte
prefix the table holds the one token that ends the prefix's encoding. A token t may end the prefix i if
it matches there and (last token of the prefix before it, t) is a pair that BPE would leave apart; exactly
one t does. The table of a prefix never changes when bytes follow, so appending is exact, and after an edit
the table is the old one again as soon as it agrees over the length of the longest token.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrowtext import joined_texts
from threadloom.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Code points handled at a time, whatever a batch holds; a longer text goes alone.
SLICE = 1 << 20
#: Distinct pieces remembered by a worker between batches; beyond it the memory starts anew.
MEMORY = 400_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@functools.cache
def char_classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of each code point, as the pattern's \\p{L}, \\p{N} and \\s see it."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = code
    out[0xD800:0xE000] = OTHER
    return out


def piece_starts(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces start. points: code points of texts laid end to end; texts: where each non-empty text starts."""
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[texts] = True
    first[n] = True
    before = np.empty_like(kind)
    before[1:], before[:1] = kind[:-1], OTHER
    space, space_before = kind == SPACE, before == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = points[:-1] == 32
    follows = np.zeros(n, bool)  # a character other than white space follows in the same text
    follows[:-1] = ~space[1:] & ~first[1:n]
    start = np.where(space, ~space_before | follows, np.where(space_before, ~blank_before, kind != before))
    start |= first[:n]
    marks = np.flatnonzero(points == 39)
    if len(marks):
        at_start = start[marks]
        for m in marks[at_start & (kind[marks] == OTHER)]:
            # the pattern tries contractions first, wherever a piece starts at an apostrophe
            tail = "".join(map(chr, points[m : m + 3]))
            for c in CONTRACTIONS:
                if tail.startswith(c) and not first[m + 1 : m + len(c)].any():
                    start[m + 1 : m + len(c)] = False
                    if m + len(c) < n:
                        start[m + len(c)] = True
                    break
    return np.flatnonzero(start)


class Vocabulary:
    """Tokens, merges and the pair test of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = _byte_alphabet()
        self.ids: dict[bytes, int] = {}
        for word, i in model["vocab"].items():
            try:
                self.ids[bytes(shown[c] for c in word)] = i
            except KeyError:
                pass  # special tokens are ordinary text here
        self.left, self.right, self.merged = {}, {}, {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        for a, b in merges:
            a, b = bytes(shown[c] for c in a), bytes(shown[c] for c in b)
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.left[k], self.right[k], self.merged[i, j] = i, j, k
        self.rank = {self.ids[bytes([b])]: -1 for b in range(256)}
        for r, (a, b) in enumerate(merges):
            self.rank[self.merged[self._id(a, shown), self._id(b, shown)]] = r
        self.tails = {w[i:] for w in self.ids for i in range(len(w))}
        self.longest = max(map(len, self.ids))
        self.apart: dict[tuple[int, int], bool] = {}

    def _id(self, word: str, shown: dict[str, int]) -> int:
        return self.ids[bytes(shown[c] for c in word)]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a, b apart: no merge across the seam comes before a's or b's own."""
        known = self.apart.get((a, b))
        if known is None:
            known = self.apart[a, b] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        rank, merged, big = self.rank, self.merged, 1 << 30
        limit = big  # merges at or after this rank come too late to cross the seam
        while True:
            m = merged.get((a, b))
            if m is not None and rank[m] < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            # undo the later of the two merges; on the left a merge is also first where ranks are equal
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> None:
        """last[i] is the token that ends data[: i + 1]; goes on from where last ends."""
        ids, tails, apart, longest = self.ids, self.tails, self.stay_apart, self.longest
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            at = end - 1
            while at >= 0 and end - at <= longest:
                part = data[at:end]
                if part not in tails:
                    at = -1
                    break
                token = ids.get(part)
                if token is not None and (at == 0 or apart(last[at - 1], token)):
                    break
                at -= 1
            else:
                at = -1
            if at < 0:
                raise ValueError("no token ends here: the vocabulary lacks a byte")
            last.append(token)

    def lengths(self) -> dict[int, int]:
        return {i: len(w) for w, i in self.ids.items()}

    @functools.cached_property
    def size_of(self) -> dict[int, int]:
        return self.lengths()

    def walk_back(self, last: list[int]) -> list[int]:
        out, at, size = [], len(last), self.size_of
        while at:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of the pattern."""
        last: list[int] = []
        self.extend(data, last)
        return self.walk_back(last)


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level tokenizer files show bytes: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PieceEncoder:
    """A piece with its table: exact appends, and edits that recompute only near the change."""

    def __init__(self, path: str = TOKENIZER, data: bytes = b""):
        self.v, self.data, self.last, self.computed = vocabulary(path), b"", [], 0
        self.append(data)

    def append(self, data: bytes) -> PieceEncoder:
        self.data += data
        self.computed += len(data)
        self.v.extend(self.data, self.last)
        return self

    def replace(self, start: int, end: int, new: bytes) -> PieceEncoder:
        """data[start:end] becomes new."""
        old, shift = self.last, len(new) - (end - start)
        data = self.data[:start] + new + self.data[end:]
        last, agreed = old[:start], 0
        while len(last) < len(data):
            self.v.extend(data, last, len(last) + 1)
            self.computed += 1
            at = len(last)
            # from the edit's end on: as often as the longest token is long, the old token again
            agreed = agreed + 1 if at > start + len(new) and last[-1] == old[at - 1 - shift] else 0
            if agreed >= self.v.longest:
                last += old[at - shift :]
                break
        self.data, self.last = data, last
        return self

    def ids(self) -> list[int]:
        return self.v.walk_back(self.last)


class TextEncoder:
    """A text that grows: appending encodes only the pieces that the new end can change."""

    def __init__(self, path: str = TOKENIZER, text: str = ""):
        self.v, self.pieces = vocabulary(path), []
        self.append(text)

    def append(self, text: str) -> TextEncoder:
        # a contraction reaches two pieces back; white space and runs one
        again = "".join(p for p, _ in self.pieces[-2:]) + text
        self.pieces = self.pieces[:-2] + [(p, self.v.piece(p.encode())) for p in split_pieces(again)]
        return self

    def ids(self) -> list[int]:
        return [i for _, x in self.pieces for i in x]


def split_pieces(text: str) -> list[str]:
    """The pieces of one text."""
    if not text:
        return []
    starts = piece_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0]))
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


class BatchEncoder:
    """Encodes Arrow string columns; remembers pieces between batches of a worker."""

    def __init__(self, path: str):
        self.v, self.known = vocabulary(path), {}

    def slices(self, texts: pa.Array) -> Iterator[pa.Array]:
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
        begin, total = 0, 0
        for i, s in enumerate(size):
            if total and total + s > SLICE:
                yield texts.slice(begin, i - begin)
                begin, total = i, 0
            total += s
        if begin < len(texts):
            yield texts.slice(begin)

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Index of each piece into the distinct pieces, these, and the number of pieces of each text."""
        joined, sizes = joined_texts(texts)
        points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(len(sizes), np.int64)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offset[1:])
        ends = np.cumsum(sizes)
        text_starts = np.searchsorted(offset, (ends - sizes)[sizes > 0])
        starts = offset[piece_starts(points, text_starts)]
        offsets = np.append(starts, offset[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
        coded = words.dictionary_encode()
        counts = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - sizes)
        return np.asarray(coded.indices), coded.dictionary, counts

    def encode_distinct(self, words: pa.Array) -> list[list[int]]:
        known, piece = self.known, self.v.piece
        if len(known) > MEMORY:
            known.clear()
        out = []
        for w in words.to_pylist():
            ids = known.get(w)
            if ids is None:
                ids = piece(w)
                if len(w) <= 64:
                    known[w] = ids
            out.append(ids)
        return out

    def ids(self, texts: pa.Array) -> pa.Array:
        parts = []
        for part in self.slices(texts):
            index, words, counts = self.pieces(part)
            coded = self.encode_distinct(words)
            size = np.array([len(x) for x in coded], np.int64)
            flat = np.fromiter((i for x in coded for i in x), np.int32, int(size.sum()))
            begin = np.cumsum(size) - size
            each = size[index]
            total = int(each.sum())
            to = np.cumsum(each) - each
            source = np.repeat(begin[index] - to, each) + np.arange(total)
            at = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
            parts.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat[source])))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def counts(self, texts: pa.Array) -> np.ndarray:
        parts = [np.zeros(0, np.int64)]
        for part in self.slices(texts):
            index, words, counts = self.pieces(part)
            size = np.array([len(x) for x in self.encode_distinct(words)], np.int64)
            upto = np.concatenate([[0], np.cumsum(size[index])])
            at = np.concatenate([[0], np.cumsum(counts)])
            parts.append(upto[at[1:]] - upto[at[:-1]])
        return np.concatenate(parts)


@functools.lru_cache(maxsize=4)
def batch_encoder(path: str) -> BatchEncoder:
    return BatchEncoder(path)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """key and `ids` (array of int) of each row, without special tokens.

    An empty or null text has an empty list, never null; special tokens' strings are ordinary text; a null
    key stays; repeated rows stay repeated; other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), batch_encoder(path).ids(b.column(1))], [key, "ids"])

    rows = spread(docs.select(F.col(key), F.col(text).cast("string").alias("_text")), key)
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The columns `keep` and `tokens` (bigint) of each row; 0 for an empty or null text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(batch_encoder(path).counts(b.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*keep, "tokens"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return spread(docs.select(*keep, F.col(text).cast("string").alias("_text")), keep[0]).mapInArrow(run, f"{schema}, tokens bigint")
