"""Pages of keywords, links and product tags (problem 9).

Each text is read word by word. A word stands in prose if the words around it hold function words, as
sentences of any of the corpus's languages do; figures and unbroken codes are neither prose nor list. What
is left is *listed*, and its share of the page is the page's list density. Phrases (shingles of two words, with
figures as one word and words run together known by the first) are exploded from every page outside its prose, and their
distinct hosts counted over all documents; a phrase on several hosts is *replicated*. A listed word is evidence if its
phrase is replicated, or if the page itself tells (it repeats there, or is part of a link or tag). A page is found if
listed words make more than half of it and its evidence does.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.words import LETTER, NUMBER, SPACE, Slice, fold, slices
from threadloom.session import spread, written

#: Common function words of English, German, French, Italian, Spanish and Portuguese, without accents.
FUNCTION_WORDS = frozenset(
    """a an the of to in on at for from by with and or but not no is are was were be been has had have will would could that which who this it its as
    der die das den dem des ein eine und oder nicht ist war sei im am zu zur mit von vor nach bei fur auf um dass ob sich wie wird habe
    le la les du une et ou dans sur pour par avec sans que qui ne pas est etait au aux ce cette se il elle
    lo gli di da con su per non che del della nel si ha e un una sono
    el los las y en por para sin al no os um uma o do dos das na nao foi ao em ate""".split()
)
#: Words that begin a link.
LINK_WORDS = frozenset(("http", "https", "www"))
#: Words on each side that tell prose from lists, and how many of all these must be function words.
AROUND, LEAST = 8, 2
#: A word or unbroken chunk of more code points is a code.
LONGEST_WORD, LONGEST_CHUNK = 40, 80
#: Times a word must stand in a page to be repeated.
REPEATED = 3
#: Phrases of most uses are few: no more than so many have this share of all uses, and are broadcast.
MOST_HOT = 10_000


@functools.lru_cache(maxsize=1 << 18)
def word_flags(word: bytes) -> int:
    """1: function word, 2: begins a link."""
    w = fold(word.decode())
    return (w in FUNCTION_WORDS) + 2 * (w in LINK_WORDS)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of per-word values by text."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[first[1:]] - upto[first[:-1]]


class Pages:
    """What the words of a Slice are: arrays over words, and `first`, each text's first word."""

    def __init__(self, s: Slice):
        n, points = len(s.words), s.points
        self.first = first = s.text_words()
        flags = np.fromiter(map(word_flags, s.distinct.to_pylist()), np.int8, len(s.distinct))[s.index]
        size = s.word_end - s.words
        # the characters that a word stands for reach to the next word
        self.span = np.where(np.append(s.of[1:] != s.of[:-1], True) if n else np.zeros(0, bool), s.text_end[s.of], np.append(s.words[1:], 0)) - s.words
        before, after = np.maximum(s.words - 1, 0), np.minimum(s.word_end, max(len(points) - 1, 0))
        hyphened = ((points[before] == 45) & (s.words > 0)) | ((points[after] == 45) & (s.word_end < len(points)))
        functional = (flags & 1).astype(bool) & ~hyphened
        upto = np.concatenate([[0], np.cumsum(functional)])
        at = np.arange(n)
        low, high = np.maximum(at - AROUND, first[s.of]), np.minimum(at + AROUND + 1, first[s.of + 1])
        self.prose = upto[high] - upto[low] >= np.where(high - low <= AROUND, 1, LEAST)
        # unbroken chunks between white space
        space = s.kind == SPACE
        chunk_begin = ~space
        chunk_begin[1:] &= space[:-1]
        starts = np.zeros(len(points), bool)
        starts[s.texts[s.texts < len(points)]] = True
        chunk = np.cumsum(chunk_begin | starts)
        m = int(chunk[-1]) + 1 if len(chunk) else 1
        length = np.bincount(chunk, ~space, m)
        letters = np.bincount(chunk, s.kind == LETTER, m) > 0
        own = chunk[s.words] if n else np.zeros(0, np.int64)
        linked = np.zeros(m, bool)
        linked[own[(flags & 2) > 0]] = True
        linked |= (np.bincount(chunk, points == 47, m) > 0) & (np.bincount(chunk, points == 46, m) > 0)
        link = linked[own]
        figure = ~letters[own]
        dense = length > LONGEST_WORD / 2 * np.maximum(1, np.bincount(own, minlength=m))
        code = ((size > LONGEST_WORD) | (dense & (length > LONGEST_CHUNK))[own]) & ~link
        self.figure = figure & ~self.prose
        self.listed = ~figure & ~code & (~self.prose | link)
        key = s.of.astype(np.int64) * max(1, len(s.distinct)) + s.index
        _, where, times = np.unique(key[self.listed], return_inverse=True, return_counts=True)
        repeated = np.zeros(n, bool)
        repeated[self.listed] = times[where] >= REPEATED
        # a hash tag, or a chunk of letters and figures as product numbers are
        mixed = letters & (np.bincount(chunk, s.kind == NUMBER, m) > 0)
        tag = ((points[before] == 35) & (s.words > 0)) | mixed[own]
        self.direct = self.listed & (link | tag | repeated)


#: Where words are run together.
JOINED = re.compile(r"(?<=[^\W\d_A-ZÀ-Þ])(?=[A-ZÀ-Þ])")
_folded: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A stable 64-bit hash of each word, folded, with figures alike and without what is run together with it."""
    import xxhash

    if len(_folded) > 1 << 18:
        _folded.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = _folded.get(w)
        if h is None:
            h = _folded[w] = xxhash.xxh64_intdigest(re.sub(r"\d+", "0", fold(JOINED.split(w.decode(), maxsplit=1)[0])))
        out[i] = h
    return out


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, host, chars, listed, direct (characters), and the phrases outside prose with the characters of listed words
    that they make evidence (w) and those that nothing else would (d). The host of a document is its origin, or else its source, or itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, s in slices(b.column(2)):
                p = Pages(s)
                texts = len(s.texts)
                hashes = word_hashes(s.distinct.to_pylist())[s.index] if len(s.words) else np.zeros(0, np.uint64)
                pair = p.listed | p.figure
                pair[1:] &= pair[:-1] & (s.of[1:] == s.of[:-1])
                pair[:1] = False
                with np.errstate(over="ignore"):
                    shingle = np.zeros(len(hashes), np.uint64)
                    shingle[1:] = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
                which = np.flatnonzero(pair)
                # a phrase stands for its second word, and at the beginning of a run for the first as well
                opens = which[~pair[which - 1]] - 1 if len(which) else which
                weights = []
                for kind in (p.listed, p.listed & ~p.direct):
                    own = np.where(kind, p.span, 0)
                    w = own.copy()
                    w[opens + 1] += own[opens]
                    weights.append(pa.array(w[which].astype(np.int32)))
                counts = per_text(pair.astype(np.int64), p.first)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                phrases = pa.StructArray.from_arrays([pa.array(shingle[which].view(np.int64)), *weights], ["h", "w", "d"])
                sums = [per_text(np.where(x, p.span, 0), p.first) for x in (p.listed, p.direct)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, texts), b.column(1).slice(at, texts), pa.array((s.text_end - s.texts).astype(np.int64)), *map(pa.array, sums), pa.ListArray.from_arrays(offsets, phrases)],
                    ["doc_id", "host", "chars", "listed", "direct", "phrases"],
                )

    host = F.coalesce(F.col("origin"), F.col("source"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spread(docs.select("doc_id", host.alias("host"), F.col("text").cast("string").alias("_text")), "doc_id")
    return rows.mapInArrow(
        run, f"doc_id {kind}, host string, chars bigint, listed bigint, direct bigint, phrases array<struct<h: bigint, w: int, d: int>>"
    )


def list_pages(docs: DataFrame, least_hosts: int = 2) -> DataFrame:
    """doc_id and the characters of each page that is a case: chars, listed, replicated (listed, and in phrases of
    least_hosts hosts or more) and evidence (replicated, or told by the page itself).

    Null, empty and blank texts are none. Repeated rows of a doc_id give repeated rows. Columns other than
    doc_id, text, origin and source are not read. Lists within prose are none as long as they are half at most.
    """
    read = written(pages(docs).filter(F.col("listed") > 0).withColumn("row", F.expr("uuid()")), "pages")
    # two steps: first the uses of a phrase are combined with their host on the map side, so no phrase is hot
    shown = read.select("host", F.explode("phrases.h").alias("h")).groupBy("h", "host").agg(F.count(F.lit(1)).alias("times"))
    shared = written(shown.groupBy("h").agg(F.count(F.lit(1)).alias("hosts"), F.sum("times").alias("times")).filter(F.col("hosts") >= least_hosts), "phrases")
    likely = read.filter(F.col("listed") * 2 > F.col("chars"))
    uses = likely.select("row", F.explode("phrases").alias("p")).groupBy("row", F.col("p.h").alias("h")).agg(F.sum("p.w").alias("w"), F.sum("p.d").alias("d"))
    # phrases of many pages are few, by their share of all uses; they don't move, and the rest holds no hot one
    every = shared.agg(F.sum("times")).first()[0] or 0
    least = F.lit(max(1000, -(-every // MOST_HOT)))
    hot = F.broadcast(shared.filter(F.col("times") >= least).select("h"))
    rest = uses.join(hot, "h", "left_anti").join(shared.filter(F.col("times") < least).select("h"), "h")
    stitched = uses.join(hot, "h").unionByName(rest).groupBy("row").agg(F.sum("w").alias("replicated"), F.sum("d").alias("further"))
    return (
        likely.drop("phrases")
        .join(stitched, "row", "left")
        .select("doc_id", "chars", "listed", F.coalesce("replicated", F.lit(0)).alias("replicated"), (F.col("direct") + F.coalesce("further", F.lit(0))).alias("evidence"))
        .filter(F.col("evidence") * 2 > F.col("chars"))
    )
