"""Languages of documents and of the segments of mixed ones (problem 5).

Error-correcting output codes: each language has a codeword of 15 bits, any two of which differ in about
half of them. For each bit a binary classifier over hashed n-grams of words (2 to 4 bytes, and the whole
word) says how strongly a sentence speaks for a 1; the language is the codeword with the least logistic
loss over all bits, so unsure bits count little. The softmax of the losses is the confidence, and a
sentence whose two nearest codewords are close is ambiguous.

The classifiers are fitted on a bounded sample of labelled rows (SAMPLE_PER_LANGUAGE documents of at most
SAMPLE_CHARS characters of each language), in two rounds, the second on what the first agrees with, since
labels may be wrong. Everything else reads every document whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.spam import LONGEST_WORD, Pages, per_text, word_flags
from threadloom.llm.words import Slice, fold, slices
from threadloom.session import spread

LANGUAGES = ("en", "de", "fr", "it", "es", "pt")
#: Other notations of the languages, without region and in lower case.
NOTATIONS = {
    "en": "en eng english anglais englisch inglese ingles",
    "de": "de deu ger german deutsch allemand tedesco aleman alemao",
    "fr": "fr fra fre french francais franzosisch francese frances",
    "it": "it ita italian italiano italienisch italien",
    "es": "es spa spanish espanol spanisch espagnol spagnolo castellano",
    "pt": "pt por portuguese portugues portugiesisch portugais portoghese",
}
#: Words that usually end in a stop within a sentence: titles, and shortenings of kinds of bodies and of references.
SHORTENED = frozenset("prof dr min amb hr fr mr mrs ms mme mlle st sr sra dott ing hon rev gen col capt lt comm assn univ inst soc off dept bd nat int intl gov art nr no vol ed".split())
#: Short words that always have a capital in English or German, and are no names.
CAPITALISED = frozenset("march april may june july marz mai juni juli".split())
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 250, 20_000
BUCKETS = 1 << 15
#: Words that a sentence has at least; shorter scraps belong to the sentence that follows.
LEAST_WORDS = 4
#: A language counts in a mixed document if so many sentences are in it.
LEAST_SENTENCES = 2
#: Of two codewords nearer to each other in confidence than this, either may be meant.
CLOSE = 0.3


def codewords() -> np.ndarray:
    """languages x bits of +1 and -1: the even columns of the exhaustive code, in which each pair of rows differs in about half."""
    n = len(LANGUAGES)
    every = [[1 if (c >> i) & 1 else -1 for i in range(n)] for c in range(1, 1 << (n - 1))]
    return np.array(every[::2][:15], np.float32).T


CODE = codewords()


def named_language(lang: Column) -> Column:
    """The language that a label names: one of LANGUAGES, `other` for another one's code, or null where it names none."""
    base = F.regexp_extract(F.lower(F.trim(lang)), r"^([\p{L}]+)", 1)
    plain = F.translate(base, "áàâãäéèêëíìîïóòôõöúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    out = F.when(plain == "", F.lit(None))
    for code, names in NOTATIONS.items():
        out = out.when(plain.isin(*names.split()), F.lit(code))
    return out.when(plain.isin("xx", "zxx", "und", "unknown", "mis", "mul", "null", "none", "nan", "na"), F.lit(None)).otherwise(F.lit("other"))


class Features:
    """Hashed n-grams of the distinct words of a Slice: buckets, and where each word's begin."""

    def __init__(self, s: Slice):
        words = [fold(w.decode()) for w in s.distinct.to_pylist()]
        self.words = words
        data = np.frombuffer("".join(f"^{w}$" for w in words).encode(), np.uint8).astype(np.uint64)
        size = np.fromiter((len(w.encode()) + 2 for w in words), np.int64, len(words))
        self.begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(words)), size)
        parts, owners = [], []
        with np.errstate(over="ignore"):
            gram = data.copy()
            for n in (2, 3, 4):
                gram = gram[: len(data) - n + 1] | (data[n - 1 :] << np.uint64(8 * (n - 1))) if n > 1 else gram
                whole = owner[: len(gram)] == owner[n - 1 :] if n > 1 else slice(None)
                h = (gram[whole] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
                parts.append((h >> np.uint64(49)).astype(np.int32))
                owners.append(owner[: len(gram)][whole])
            # the whole word, by a polynomial over its bytes
            power = np.cumprod(np.full(int(size.max(initial=1)), 0x100000001B3, np.uint64))
            place = np.arange(len(data)) - np.repeat(self.begin, size)
            total = np.add.reduceat(data * power[place], self.begin) if len(words) else np.zeros(0, np.uint64)
            parts.append(((total * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int32))
            owners.append(np.arange(len(words)))
        bucket, of = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(of, kind="stable")
        self.bucket, self.of = bucket[order], of[order]
        self.first = np.searchsorted(self.of, np.arange(len(words)))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Of each distinct word: the sum of its n-grams' weights, for each bit; in the last column their number."""
        if not len(self.words):
            return np.zeros((0, weights.shape[1] + 1), np.float32)
        sums = np.add.reduceat(weights[self.bucket], self.first, axis=0)
        return np.hstack([sums, np.diff(np.append(self.first, len(self.bucket)))[:, None].astype(np.float32)])


class Sentences:
    """Spans of words of a Slice: first word of each sentence, its text, and whether it is prose."""

    def __init__(self, s: Slice, pages: Pages):
        n, points = len(s.words), s.points
        if not n:
            self.first, self.text, self.words, self.prose = (np.zeros(0, np.int64) for _ in range(4))
            return
        text_first = np.zeros(n, bool)
        starts = pages.first[:-1]
        text_first[starts[starts < n]] = True
        # the gap before a word: an end mark and white space, or an empty line
        gap = np.append(0, s.word_end[:-1])
        mark = np.zeros(len(points) + 1, np.int64)
        np.cumsum((points == 46) | (points == 33) | (points == 63) | (points == 0x2026), out=mark[1:])
        line = np.zeros(len(points) + 1, np.int64)
        np.cumsum((points == 10) | (points == 0x2029), out=line[1:])
        space = np.zeros(len(points) + 1, np.int64)
        np.cumsum(s.kind == 3, out=space[1:])
        ended = (mark[s.words] > mark[gap]) & (space[s.words] > space[gap])
        blank = line[s.words] - line[gap] >= 2
        head = points[s.words]
        upper = (head >= 65) & (head <= 90) | (head >= 0xC0) & (head <= 0xDE) | (head < 58)
        folded = [fold(w.decode()) for w in s.distinct.to_pylist()]
        short = np.fromiter((len(w) <= 1 or w in SHORTENED or (w.isdigit() and len(w) < 3) for w in folded), bool, len(folded))
        seen = {w for w, raw in zip(folded, s.distinct.to_pylist()) if raw[:1].islower()}
        common = np.fromiter((w in seen for w in folded), bool, len(folded))
        sure = np.fromiter((w in CAPITALISED for w in folded), bool, len(folded))
        before = np.append(0, s.index[:-1])
        head_before = points[np.append(0, s.words[:-1])]
        # a short word with a capital may be a name cut short; in capitals throughout nothing can be told by them
        second = points[np.minimum(np.append(0, s.words[:-1]) + 1, len(points) - 1)]
        doubtful = ((head_before >= 65) & (head_before <= 90)) & ~((second >= 65) & (second <= 90)) & (np.append(0, (s.word_end - s.words)[:-1]) <= 5) & ~sure[before]
        twice = mark[s.words] - mark[gap] >= 2  # a shortened word at the end of a sentence
        start = text_first | blank | (ended & upper & (twice | (~short[before] & ~(doubtful & ~common[s.index]))))
        at = np.flatnonzero(start)
        # scraps join the sentence after them, the last of a text the one before
        size = np.diff(np.append(at, n))
        last = np.append(text_first[at[1:]], True)
        keep = np.ones(len(at), bool)
        small = size < LEAST_WORDS
        keep[1:] &= ~(small[:-1] & ~last[:-1])
        keep &= ~(small & last & ~text_first[at])
        keep |= text_first[at]
        self.first = at[keep]
        self.text = s.of[self.first]
        ends = np.append(self.first[1:], n)
        self.words = ends - self.first
        listed = np.concatenate([[0], np.cumsum(~pages.prose)])
        flags = np.fromiter((word_flags(w) & 1 for w in s.distinct.to_pylist()), np.int64, len(s.distinct))[s.index]
        functional = np.concatenate([[0], np.cumsum(flags)])
        self.prose = (self.words >= LEAST_WORDS) & ((listed[ends] - listed[self.first]) * 2 <= self.words) & (functional[ends] > functional[self.first])
        # headings don't end with a mark; what doesn't is a sentence only in a text where nothing does
        final = s.word_end[ends - 1]
        after = np.where(ends < n, np.append(s.words, 0)[np.minimum(ends, n)], len(points))
        after = np.minimum(after, s.text_end[self.text])
        marked = (mark[after] > mark[final]) & self.prose
        any_marked = np.bincount(self.text[marked], minlength=len(s.texts)) > 0
        self.prose = np.where(any_marked[self.text], marked, self.prose)


def decode(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword by logistic loss, and the confidences of all."""
    loss = np.logaddexp(0, -margins[:, None, :] * CODE[None]).sum(axis=2)
    shifted = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return loss.argmin(axis=1), shifted / shifted.sum(axis=1, keepdims=True)


def sentence_margins(s: Slice, sentences: Sentences, weights: np.ndarray) -> np.ndarray:
    """sentences x bits: the mean weight of the n-grams, scaled by the root of their number."""
    if not len(sentences.first):
        return np.zeros((0, weights.shape[1]), np.float32)
    scores = Features(s).scores(weights)
    scores[np.asarray(pa.compute.binary_length(s.distinct)) > LONGEST_WORD] = 0  # codes speak no language
    sums = np.add.reduceat(scores[s.index], sentences.first, axis=0)
    return np.clip(sums[:, :-1] / np.sqrt(np.maximum(1, sums[:, -1:])), -8, 8)


def fit(texts: list[str], langs: list[str]) -> np.ndarray:
    """buckets x bits of weights. Each language counts alike, however many rows it has."""
    label = np.array([LANGUAGES.index(x) for x in langs])
    weights: np.ndarray | None = None
    for _ in range(2):
        counts = np.full((len(LANGUAGES), BUCKETS), 0.3)
        for at, s in slices(pa.array(texts, pa.string())):
            pages = Pages(s)
            sentences = Sentences(s, pages)
            if not len(sentences.first):
                continue
            said = label[at + sentences.text]
            good = sentences.prose.astype(bool)
            if weights is not None:
                good &= decode(sentence_margins(s, sentences, weights))[0] == said
            features = Features(s)
            of_word = np.repeat(np.where(good, said, -1), sentences.words)
            for i in range(len(LANGUAGES)):
                times = np.bincount(s.index[of_word == i], minlength=len(s.distinct))
                counts[i] += np.bincount(features.bucket, times[features.of], BUCKETS)
        share = counts / counts.sum(axis=1, keepdims=True)
        one = (CODE > 0).astype(float)
        zero = 1 - one
        weights = (np.log(one.T @ share / one.sum(axis=0)[:, None]) - np.log(zero.T @ share / zero.sum(axis=0)[:, None])).T.astype(np.float32)
    return weights


def fitted(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> np.ndarray:
    """Weights from at most per_language labelled documents of each language, chosen by the hash of their id."""
    labelled = docs.select("doc_id", named_language(F.col("lang")).alias("named"), F.length("text").alias("n"))
    order = Window.partitionBy("named").orderBy(F.xxhash64(F.col("doc_id").cast("string")))
    chosen = labelled.filter(F.col("named").isin(*LANGUAGES) & (F.col("n") <= chars) & (F.col("n") > 0)).withColumn("i", F.row_number().over(order))
    ids = [r[0] for r in chosen.filter(F.col("i") <= per_language).select("doc_id").distinct().collect()]
    if not ids:
        return np.zeros((BUCKETS, CODE.shape[1]), np.float32)
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]))
    sample = docs.join(F.broadcast(few), "doc_id", "left_semi").select("doc_id", named_language(F.col("lang")).alias("named"), "text")
    kept = sample.filter(F.col("named").isin(*LANGUAGES) & (F.length("text") <= chars))
    # one row an id, the same one whenever it is read, in order: repeated rows don't change the fit
    rows = sorted((r[0], r[1].text, r[1].named) for r in kept.groupBy("doc_id").agg(F.min(F.struct("text", "named")).alias("r")).collect())
    return fit([text for _, text, _ in rows], [named for _, _, named in rows])


SEGMENT = "first_char: int, chars: int, lang: string, confidence: double, sentences: int, ambiguous: boolean"


def segments(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, lang, and `segments`: runs of sentences in one language, each with its place and confidence.

    Sentences are counted, scraps, lists, figures and codes are none. A null, empty or wordless text and a page
    of which more than half is listed (problem 9) have an empty list. Repeated rows stay repeated.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, s in slices(b.column(2)):
                p = Pages(s)
                texts = len(s.texts)
                x = Sentences(s, p)
                size = s.text_end - s.texts
                listed, direct = (per_text(np.where(f, p.span, 0), p.first) for f in (p.listed, p.direct))
                page = (listed * 2 > size) & (direct * 8 > size)
                counted = x.prose.astype(bool) & ~page[x.text] if len(x.first) else np.zeros(0, bool)
                best, sure = decode(sentence_margins(s, x, weights))
                # how much nearer the nearest codeword is than the next
                two = np.sort(sure, axis=1)[:, -2:]
                first, text, best, sure, gap = x.first[counted], x.text[counted], best[counted], sure[counted], (two[:, 1] - two[:, 0])[counted]
                fresh = np.ones(len(first), bool)
                fresh[1:] = (text[1:] != text[:-1]) | (best[1:] != best[:-1])
                run_at = np.flatnonzero(fresh)
                if len(run_at):
                    sizes = np.diff(np.append(run_at, len(first)))
                    mean = np.add.reduceat(sure[np.arange(len(first)), best], run_at) / sizes
                    begin = s.words[first[run_at]] - s.texts[text[run_at]]
                    until = np.where(np.append(text[run_at][1:] == text[run_at][:-1], False), np.append(s.words[first[run_at]][1:], 0), s.text_end[text[run_at]]) - s.texts[text[run_at]]
                    columns = [begin, until - begin, np.array(LANGUAGES)[best[run_at]], np.round(mean, 4), sizes, np.add.reduceat(gap, run_at) / sizes < CLOSE]
                else:
                    columns = [[], [], [], [], [], []]
                types = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]
                rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["first_char", "chars", "lang", "confidence", "sentences", "ambiguous"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text[run_at], minlength=texts))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, texts), b.column(1).slice(at, texts), pa.ListArray.from_arrays(pa.array(offsets), rows)], ["doc_id", "lang", "segments"])

    rows = spread(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("_text")), "doc_id")
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, segments array<struct<{SEGMENT}>>")


def per_language(segmented: DataFrame) -> DataFrame:
    """doc_id, lang and `spoken`: array of (lang, sentences, confidence, ambiguous: whether most of these sentences are), most sentences first."""
    def held_by(code: str) -> Column:
        own = F.filter("segments", lambda x: x.lang == code)
        return F.struct(
            F.aggregate(own, F.lit(0), lambda a, x: a + x.sentences).alias("sentences"),
            F.aggregate(own, F.lit(0.0), lambda a, x: a + x.sentences * x.confidence).alias("sum"),
            F.lit(code).alias("lang"),
            F.aggregate(own, F.lit(0), lambda a, x: a + F.when(x.ambiguous, x.sentences).otherwise(0)).alias("unsure"),
        )

    spoken = F.array(*map(held_by, LANGUAGES))
    held = F.filter(F.sort_array(spoken, asc=False), lambda x: x.sentences > 0)
    shown = F.transform(held, lambda x: F.struct(x.lang.alias("lang"), x.sentences.alias("sentences"), F.round(x.sum / x.sentences, 4).alias("confidence"), (x.unsure * 2 > x.sentences).alias("ambiguous")))
    return segmented.select("doc_id", "lang", shown.alias("spoken"))


def document_languages(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, lang, confidence, ambiguous of each document with sentences: its main language, and whether another is about as near."""
    weights = fitted(docs) if weights is None else weights
    main = per_language(segments(docs, weights)).filter(F.size("spoken") > 0).withColumn("main", F.col("spoken")[0])
    return main.select("doc_id", "main.lang", "main.confidence", "main.ambiguous")


def language_segments(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row for each segment of each document: doc_id, first_char, chars, lang, confidence, sentences, ambiguous."""
    weights = fitted(docs) if weights is None else weights
    return segments(docs, weights).select("doc_id", F.inline("segments"))


def faulty_labels(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, lang of each case: a label that names none or not the text's language, or a mixed text.

    A mixed text, with two sentences or more in each of several languages, has one row for each of these.
    """
    weights = fitted(docs) if weights is None else weights
    spoken = per_language(segments(docs, weights)).filter(F.size("spoken") > 0)
    several = F.filter("spoken", lambda x: x.sentences >= LEAST_SENTENCES)
    main = F.slice("spoken", 1, 1)
    right = F.coalesce(named_language(F.col("lang")) == F.col("spoken")[0]["lang"], F.lit(False))
    cases = F.when(F.size(several) >= 2, several).when(~right, main)
    return spoken.select("doc_id", F.explode(cases).alias("c")).select("doc_id", F.col("c.lang").alias("lang"))
