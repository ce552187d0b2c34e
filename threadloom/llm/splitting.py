"""Cutting oversized texts at their own joints, with overlaps (problem 2).

Recursive bisection: a text longer than `limit - overlap` is cut at the strongest joint near its midpoint
(empty line, line end, sentence end, clause, white space; else between two characters), and so are its
halves. The parts are disjoint, cover the text and leave room for the overlap; each but the first is then
extended to the left by exactly `overlap` characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The strongest first.
JOINTS = re.compile(r"(\n[^\S\n]*\n\s*)|(\s*\n\s*)|((?<![.!?…。])[.!?…。]++[\"'»”’)\]]*+\s+)|([,;:–—]\s+)|(\s+)")
#: Every joint ends with these.
SPACE = re.compile(r"\s+")
#: A settings table of more rows isn't one, and is not broadcast.
MOST_SETTINGS = 10_000


def strongest(text: str, begin: int, end: int, low: int, high: int) -> int:
    """The end in low..high of the strongest joint, of its kind the nearest to the middle of begin..end; 0 if there is none."""
    middle = (begin + end) // 2
    best, at = (9, 0), 0
    for m in JOINTS.finditer(text, max(begin, low - 1), high):
        cut = m.end()
        key = (m.lastindex, abs(cut - middle))
        if key < best and max(begin + 1, low) <= cut < end:
            best, at = key, cut
    return at


def around(text: str, begin: int, end: int) -> tuple[int, int]:
    """Ends of the nearest joints on either side of the middle; begin or end where there is none."""
    middle, reach = (begin + end) // 2, 64
    while True:
        low, high = max(begin, middle - reach), min(end, middle + reach)
        cuts = [m.end() for m in SPACE.finditer(text, low, high)]
        left, right = max((c for c in cuts if begin < c <= middle), default=begin), min((c for c in cuts if middle < c < end), default=end)
        if (left > begin or low == begin) and (right < end or high == end):
            return left, right
        reach *= 4


def joint(text: str, begin: int, end: int, most: int) -> int:
    """Where to cut text[begin:end]: after the strongest joint near the middle, the nearest of its kind.

    Without one there, a joint that leaves both halves within `most` is taken; else one beside the run that covers the
    middle, if the run fits a piece or the text is long. Only a run that has to be cut is cut between two characters.
    """
    middle, size = (begin + end) // 2, end - begin
    reach = max(1, min(size // 4, most // 2))
    low, high = max(begin + 1, middle - reach), min(end - 1, middle + reach)
    at = strongest(text, begin, end, low, high)
    if not at and size <= 2 * most:
        at = strongest(text, begin, end, max(begin + 1, end - most), min(end - 1, begin + most))
    if at:
        return at
    left, right = around(text, begin, end)
    if size > 2 * most or right - left <= most:
        cuts = [c for c in (left, right) if begin < c < end]
        if cuts:
            return min(cuts, key=lambda c: abs(c - middle))
    at = middle
    # not before a mark that belongs to the character before it
    while at > low and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at if at > low else middle


def parts(text: str, most: int) -> list[tuple[int, int]]:
    """Disjoint spans of at most `most` characters that cover text."""
    out, stack = [], [(0, len(text))]
    while stack:
        begin, end = stack.pop()
        size = end - begin
        if size <= most:
            out.append((begin, end))
            continue
        cut = joint(text, begin, end, most)
        stack += [(cut, end), (begin, cut)]
    return out


def pieces(text: str, limit: int | None, overlap: int | None) -> list[tuple[int, int]]:
    """Spans of at most `limit` characters; each begins `overlap` characters before the last one's end.

    A text within the limit is one piece; an empty one has none. Without a limit (null or under 1) a text stays
    whole. An overlap of the limit or more counts as limit - 1, a null or negative one as 0.
    """
    if not text:
        return []
    if limit is None or limit < 1 or len(text) <= limit:
        return [(0, len(text))]
    over = min(max(0, overlap or 0), limit - 1)
    return [(max(0, begin - over), end) for begin, end in parts(text, limit - over)]


def with_settings(items: DataFrame, settings: DataFrame, limit: str) -> DataFrame:
    """items (item_table, item_key, source, text) with `limit` and `overlap` of their source, or of the row `*`."""
    rows = settings.select("source", F.col(limit).alias("limit"), F.col("overlap_chars").alias("overlap")).dropDuplicates(["source"])
    if rows.limit(MOST_SETTINGS + 1).count() > MOST_SETTINGS:
        raise ValueError("too many settings to broadcast")
    own = F.broadcast(rows.filter(F.col("source").isNotNull()).select(F.col("source").alias("_s"), F.struct("limit", "overlap").alias("_own")))
    rest = F.broadcast(rows.filter(F.col("source") == "*").select(F.struct("limit", "overlap").alias("_rest"), F.lit("*").alias("_star")))
    joined = items.join(own, F.col("source") == F.col("_s"), "left").join(rest, F.coalesce(F.col("_s"), F.lit("*")) == F.col("_star"), "left")
    chosen = F.coalesce("_own", "_rest")
    return joined.select("item_table", "item_key", "text", chosen["limit"].alias("limit"), chosen["overlap"].alias("overlap"))


def corpus_items(documents: DataFrame, candidates: DataFrame, settings: DataFrame) -> DataFrame:
    """Texts of documents and passages of candidates, with their limits."""
    docs = documents.select(F.lit("documents").alias("item_table"), F.col("doc_id").cast("string").alias("item_key"), "source", "text")
    # the source of a candidate stands in its private_id, before the first colon
    made = candidates.select(F.lit("candidates").alias("item_table"), F.col("item_id").cast("string").alias("item_key"), F.regexp_extract("private_id", "^([^:]*):", 1).alias("source"), F.col("passage").alias("text"))
    return with_settings(docs, settings, "max_chars").unionByName(with_settings(made, settings, "passage_chars"))


def split_items(items: DataFrame, texts: bool = True) -> DataFrame:
    """item_table, item_key, piece (from 1), first_char, chars and, if `texts`, the piece's text of each oversized item.

    Items within their limit, without one, null or empty give no rows: they need no cutting. Repeated rows are cut
    each. Other columns are not read. The length test runs in the JVM, so only oversized texts reach Python.
    """
    long = items.filter(F.length("text") > F.col("limit")).filter(F.col("limit") >= 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, number, first, size, cut, total = [], [], [], [], [], 0
            for i, (text, limit, overlap) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4)))):
                for k, (begin, end) in enumerate(pieces(text, limit, overlap), 1):
                    index.append(i)
                    number.append(k)
                    first.append(begin)
                    size.append(end - begin)
                    if texts:
                        cut.append(text[begin:end])
                total += len(text)
                if total > 1 << 22:
                    yield batch(b, index, number, first, size, cut)
                    index, number, first, size, cut, total = [], [], [], [], [], 0
            yield batch(b, index, number, first, size, cut)

    def batch(b: pa.RecordBatch, index, number, first, size, cut) -> pa.RecordBatch:
        at = pa.array(index, pa.int32())
        columns = [b.column(0).take(at), b.column(1).take(at), pa.array(number, pa.int32()), pa.array(first, pa.int32()), pa.array(size, pa.int32())]
        names = ["item_table", "item_key", "piece", "first_char", "chars"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.string())] if texts else columns, [*names, "text"] if texts else names)

    schema = "item_table string, item_key string, piece int, first_char int, chars int" + ", text string" * texts
    return long.select("item_table", "item_key", "text", "limit", "overlap").mapInArrow(run, schema)


def oversized(items: DataFrame) -> DataFrame:
    """item_table, item_key of each item that had to be cut."""
    return split_items(items, texts=False).filter("piece = 2").select("item_table", "item_key").distinct()
