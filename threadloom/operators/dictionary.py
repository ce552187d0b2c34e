"""Linking by a dictionary of titles: greedy, longest first, without overlaps."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import strip

#: Function words; a title of nothing else names nothing.
STOPWORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers
    him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those
    through to too under until up very was we were what when where which while who whom why will with would you your""".split()
)
TOKEN = re.compile(r"\w[\w'-]*")


def dictionary(index: DataFrame, min_chars: int = 6, min_words: int = 2) -> DataFrame:
    """title (lower case), qid of an index (title, qid, pos): of equal titles the first counts.

    A bracket at a title's end is no part of it; short titles and those of function words alone are left out.
    """
    title = strip(F.regexp_replace("title", r"\s*\([^)]*\)$", ""))
    words = F.split(title, r"\s+")
    named = F.exists(words, lambda w: ~F.btrim(F.lower(w), F.lit(".,'-")).isin(*sorted(STOPWORDS)))
    kept = index.select(title.alias("t"), "qid", "pos", words.alias("w"), named.alias("ok")).filter((F.length("t") >= min_chars) & (F.size("w") >= min_words) & F.col("ok"))
    return kept.groupBy(F.lower("t").alias("title")).agg(F.min_by("qid", "pos").alias("qid"))


#: Cells into which the first words of titles are hashed; as many bits are sent to the executors, however many titles there are.
CELLS = 1 << 20


def _cell(word: str) -> int:
    """Cell of a title's first word, the same for spellings that differ in case and marks."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()
    return zlib.crc32(plain[:12].encode("utf-8", "replace")) % CELLS


def title_cells(titles: DataFrame) -> bytes:
    """Which cells hold the first word of a title, one byte each."""

    def cells(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # as it is written, and with its marks taken off, which else end a token
            forms = [x for t in f["title"] for x in (t, "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))]
            found = {_cell(m.group()) for x in forms if (m := TOKEN.match(x))}
            yield pd.DataFrame({"cell": sorted(found)})

    held = bytearray(CELLS)
    for r in titles.select("title").mapInPandas(cells, "cell int").distinct().toLocalIterator():
        held[r.cell] = 1
    return bytes(held)


def phrases(texts: DataFrame, cells: bytes, most: int = 6) -> DataFrame:
    """key, first, words, phrase: the runs of up to `most` tokens of texts (key, text), with the raw text between them, that begin as a title may."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins: dict[str, int] = {}
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for at, text in enumerate(b.column(1).to_pylist()):
                m = [x.span() for x in TOKEN.finditer(text or "")]
                for i, (low, high) in enumerate(m):
                    word = text[low:high]
                    good = begins.get(word)
                    if good is None:
                        if len(begins) > 1 << 18:
                            begins.clear()
                        good = begins[word] = cells[_cell(word)]
                    if good:
                        for n in range(1, min(most, len(m) - i) + 1):
                            for column, x in zip(rows, (at, i, n, text[low : m[i + n - 1][1]])):
                                column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int32())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.string())], ["key", "first", "words", "phrase"])

    return texts.select("key", F.col("text").cast("string").alias("text")).mapInArrow(cut, f"key {texts.schema['key'].dataType.simpleString()}, first int, words int, phrase string")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _greedy(spans: pd.Series) -> pd.Series:
    """Of spans (words, first), longest first and then from the left, those that overlap none taken before; as places in the list."""

    def take(row) -> list[int]:
        taken: set[int] = set()
        out = []
        for i, s in sorted(enumerate(row), key=lambda x: (-x[1]["words"], x[1]["first"])):
            own = range(s["first"], s["first"] + s["words"])
            if taken.isdisjoint(own):
                taken.update(own)
                out.append(i)
        return out

    return spans.map(take)


def match(texts: DataFrame, titles: DataFrame, most: int = 6) -> DataFrame:
    """key, first, words, surface_form, qid of the titles (title, qid) found in texts (key, text).

    Only runs that begin with the first word of a title leave Python; they meet the dictionary by a join, so that it needn't
    fit a task. What overlaps is settled per text.
    """
    met = phrases(texts, title_cells(titles), most).withColumn("title", F.lower("phrase")).join(titles, "title")
    rows = met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "words", "phrase", "qid"))).alias("s"))
    kept = rows.withColumn("i", _greedy(F.transform("s", lambda x: F.struct(x["words"].alias("words"), x["first"].alias("first"))))).select("key", F.explode("i").alias("i"), "s")
    hit = F.element_at("s", F.col("i") + 1)
    return kept.select("key", hit["first"].alias("first"), hit["words"].alias("words"), hit["phrase"].alias("surface_form"), hit["qid"].alias("qid"))


def title_to_qid(spans: DataFrame, mapping: DataFrame) -> DataFrame:
    """spans (title, lang) to qid by mapping (a, b, qid): tries (lang, title), (title, lang), then title alone (b null)."""
    out = spans
    ways = (("lang", "title"), ("title", "lang"), ("title", None))
    for i, (x, y) in enumerate(ways):
        known = mapping.filter(F.col("b").isNotNull() if y else F.col("b").isNull()).groupBy(*(["a", "b"] if y else ["a"])).agg(F.min("qid").alias(f"q{i}"))
        on = (out[x] == known["a"]) & (out[y] == known["b"]) if y else out[x] == known["a"]
        out = out.join(known, on, "left").drop("a", "b")
    qid: Column = F.coalesce(*[F.col(f"q{i}") for i in range(len(ways))])
    return out.select(*spans.columns, F.when(qid.isNotNull(), F.when(qid.startswith("Q"), qid).otherwise(F.concat(F.lit("Q"), qid))).alias("qid"))
