"""Words of many texts at once: cut with NumPy, made distinct by Arrow."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from threadloom.llm.arrowtext import joined_texts
from threadloom.llm.bytebpe import LETTER, NUMBER, SPACE, char_classes

#: Bytes of text handled at a time; a longer text goes alone.
SLICE = 1 << 20
#: Code points that belong to the word around them: combining marks, soft hyphen, joiners, apostrophes.
INSIDE = [*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF]
MARK = 4


@functools.cache
def classes() -> np.ndarray:
    out = char_classes().copy()
    out[INSIDE] = MARK
    return out


def fold(word: str) -> str:
    """Lower case without accents, in plain letters."""
    if word.isascii():
        return word.lower()
    plain = unicodedata.normalize("NFKD", word)
    return "".join(c for c in plain if not unicodedata.combining(c) and c not in "­​‌‍﻿").lower()


class Slice:
    """Some texts end to end.

    points: code points; kind: their classes; texts, text_end: where each text begins and ends; words, word_end: spans
    of words (runs of letters, digits and marks); index: each word's place in `distinct` (Arrow binary); of: each word's text.
    """

    def __init__(self, texts: pa.Array):
        joined, sizes = joined_texts(texts)
        self.points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        n = len(self.points)
        width = 1 + (self.points >= 0x80) + (self.points >= 0x800) + (self.points >= 0x10000)
        self.offset = np.zeros(n + 1, np.int64)
        np.cumsum(width, out=self.offset[1:])
        ends = np.cumsum(sizes)
        self.texts = np.searchsorted(self.offset, ends - sizes)
        self.text_end = np.searchsorted(self.offset, ends)
        self.kind = classes()[self.points] if n else np.zeros(0, np.uint8)
        inside = (self.kind == LETTER) | (self.kind == NUMBER) | (self.kind == MARK)
        edge = np.zeros(n + 1, bool)
        edge[self.texts[self.texts < n]] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        self.words = np.flatnonzero(begin)
        stop = np.zeros(n + 1, bool)
        stop[1:] = inside
        stop[1:n] &= ~inside[1:] | edge[1:n]
        self.word_end = np.flatnonzero(stop)
        # words and the gaps between them alternate, so one offset buffer holds both; gaps are dropped after
        cuts = np.empty(2 * len(self.words) + 1, np.int64)
        cuts[0:-1:2], cuts[1::2] = self.offset[self.words], self.offset[self.word_end]
        cuts[-1] = self.offset[n]
        spans = pa.Array.from_buffers(pa.binary(), 2 * len(self.words), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(joined)])
        coded = spans.take(pa.array(np.arange(0, 2 * len(self.words), 2))).dictionary_encode()
        self.index, self.distinct = np.asarray(coded.indices), coded.dictionary
        self.of = np.searchsorted(self.texts, self.words, side="right") - 1
        self.joined = joined

    def text_words(self) -> np.ndarray:
        """Number of the first word of each text, and at the end the number of words."""
        return np.append(np.searchsorted(self.words, self.texts), len(self.words))


def slices(texts: pa.Array) -> Iterator[tuple[int, Slice]]:
    """(first row, Slice) of runs of rows of about SLICE bytes."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    begin, total = 0, 0
    for i, s in enumerate(size):
        if total and total + s > SLICE:
            yield begin, Slice(texts.slice(begin, i - begin))
            begin, total = i, 0
        total += s
    if begin < len(texts):
        yield begin, Slice(texts.slice(begin))
