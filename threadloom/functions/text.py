"""Text functions as Column expressions; only Unicode folding needs a vectorised UDF."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where a cable's narrative begins, markings within it and marking lines.
NARRATIVE_START = r"\n\s*1\.\s*\("
CLASSIFICATION = r"\((?:TS|S|C|U|SBU|LOU|SI|NF)(?://?[A-Z]+)*\)"
MARKER_LINE = r"(?m)^\s*(?:SIPDIS|NOFORN|NODIS|EXDIS|STADIS|CONFIDENTIAL|SECRET|UNCLAS(?:SIFIED)?|LIMITED OFFICIAL USE|E\.O\.\s*\d+.*)\s*$"
#: Header lines of cables.
TAGS_LINE = r"TAGS:[ \t]*([A-Z0-9_,\t -]{3,200})"
SUBJECT_LINE = r"SUBJECT:\s*(.{0,120})"
#: A passage reaches so far before and after its anchor; names under MIN_SURFACE characters are no evidence.
BEFORE, AFTER, MIN_SURFACE = 400, 700, 4
#: Fixed value: what marks a clipped text.
CLIPPED = "\n[... truncated]"


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; other letters split tokens. Null gives null."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


def normalise(c: Column) -> Column:
    """The tokens, joined by single spaces."""
    return F.array_join(tokens(c), " ")


def contains_tokens(whole: Column, part: Column) -> Column:
    """Whether the normalised `part` is a contiguous run of tokens of the normalised `whole`; an empty part never is."""
    return (part != "") & F.contains(F.concat(F.lit(" "), whole, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@F.pandas_udf(T.StringType())
def fold_ascii(s: pd.Series) -> pd.Series:
    """Accents off, then as normalise: for comparing spellings across languages."""
    return s.map(lambda x: None if x is None else " ".join(re.findall(r"[a-z0-9]+", _plain(x))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def name_bag(s: pd.Series) -> pd.Series:
    """The sorted set of a name's words without accents; letters of any alphabet stay."""
    return s.map(lambda x: None if x is None else sorted(set(re.findall(r"\w+", _plain(x)))))


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clip(c: Column, limit: int) -> Column:
    """c as it is within the limit, else its first characters, marked as cut."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(rstrip(F.left(c, F.lit(limit))), F.lit(CLIPPED)))


def tags_in(c: Column) -> Column:
    """Alphabetic tags of the first TAGS line, in order, each once."""
    found = F.transform(F.split(F.regexp_extract(c, TAGS_LINE, 1), ","), lambda x: F.trim(F.regexp_replace(x, "\t", " ")))
    return F.array_distinct(F.filter(found, lambda x: x.rlike("^[A-Za-z]+$")))


def subject_of(c: Column) -> Column:
    return strip(F.regexp_extract(c, SUBJECT_LINE, 1))


def narrative_body(c: Column) -> Column:
    """From the first numbered paragraph on, without markings, blank lines and a short last line (a signature)."""
    at = F.regexp_instr(c, F.lit(NARRATIVE_START))
    body = F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(c)
    marked = F.regexp_replace(F.regexp_replace(body, CLASSIFICATION, ""), MARKER_LINE, "")
    lines = F.filter(F.split(strip(marked), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: strip(x) != "")
    last = strip(F.try_element_at(lines, F.lit(-1)))
    short = (F.size(lines) > 1) & (F.length(last) <= 30) & (F.size(F.split(last, r"\s+")) <= 3)
    return F.array_join(F.when(short, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines), "\n")


def found_at(text: Column, form: Column) -> Column:
    """1-based place of the first case-insensitive hit, 0 if there is none."""
    return F.instr(F.lower(text), F.lower(form))


def written_as(label: Column, text: Column) -> Column:
    """How the text writes the label, or else its last word, in the text's own case; '' if it does not."""
    words = F.split(strip(label), r"\s+")
    family = F.when(F.size(words) > 1, F.element_at(words, -1))

    def hit(form: Column) -> Column:
        return F.when((F.length(form) >= MIN_SURFACE) & (found_at(text, form) > 0), F.substring(text, found_at(text, form), F.length(form)))

    return F.coalesce(hit(label), hit(family), F.lit(""))


def passage_span(text: Column, anchor: Column, before: int = BEFORE, after: int = AFTER) -> Column:
    """(start, end) of the passage around the anchor's first hit, from 0; the opening where it has none."""
    at = F.when(F.coalesce(anchor, F.lit("")) != "", found_at(text, anchor)).otherwise(0) - 1
    near = F.struct(F.greatest(F.lit(0), at - before).alias("start"), F.least(F.length(text), at + after).alias("end"))
    return F.when(at < 0, F.struct(F.lit(0).alias("start"), F.least(F.length(text), F.lit(before + after)).alias("end"))).otherwise(near)


def strip_reasoning(reply: Column) -> Column:
    """The reply without its <think> trace; '' if the trace never ends; what follows the last end if none begins."""
    low = F.lower(reply)
    opened, closed = F.contains(low, F.lit("<think>")), F.contains(low, F.lit("</think>"))
    tail = F.regexp_extract(reply, r"(?is)^.*</think>(.*)$", 1)
    return F.when(opened & ~closed, "").when(closed & ~opened, strip(tail)).otherwise(strip(F.regexp_replace(reply, r"(?is)<think>.*?</think>", "")))


def first_word(reply: Column, allowed: list[str]) -> Column:
    """The first word of the reply that is allowed, in lower case, or ''."""
    words = F.transform(F.regexp_extract_all(reply, F.lit("[A-Za-z_]+"), F.lit(0)), F.lower)
    kept = F.filter(words, lambda x: x.isin(*[a.lower() for a in allowed]))
    return F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit(""))


def json_slice(reply: Column) -> Column:
    """From the first { to the last }, or null."""
    got = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when(got != "", got)


def verdict_of(reply: Column, labels: list[str]) -> Column:
    """The label that the reply is but for case and outer space, in its own spelling, or ''."""
    said = F.lower(strip(reply))
    out = F.lit("")
    for label in reversed(labels):
        out = F.when(said == label.lower(), label).otherwise(out)
    return out


def qid_or_blank(c: Column) -> Column:
    return F.when(c.rlike(r"^Q\d+$"), c).otherwise("")


def ref(source: Column, doc_id: Column) -> Column:
    return F.concat(source, F.lit(":"), doc_id)


def ref_source(c: Column) -> Column:
    return F.substring_index(c, ":", 1)


def ref_id(c: Column) -> Column:
    """All after the first colon; '' without one."""
    return F.regexp_extract(c, r"(?s)^[^:]*:(.*)$", 1)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def record_lines(columns: dict[str, Column]) -> Column:
    """`field: value` lines in alphabetical order of the fields, without null and '' values."""
    made = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(k.replace("_", " ") + ": "), v)) for k, v in sorted(columns.items())]
    return F.array_join(F.filter(F.array(*made), lambda x: x.isNotNull()), "\n")


def windows(text: Column, window: int = 1500, overlap: int = 250) -> Column:
    """Array of (start, piece): windows of a text that overlap, up to the first that reaches its end."""
    step = max(window - overlap, 1)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - window) / step) * step)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), last.cast("int"), F.lit(step)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(window)).alias("piece")))


def marked_span(text: Column, start: Column, end: Column, context: int = 200) -> Column:
    """The span between marks, with so much of its context."""
    low = F.greatest(F.lit(0), start - context)
    return F.concat(F.substring(text, low + 1, start - low), F.lit(" [START] "), F.substring(text, start + 1, end - start), F.lit(" [END] "), F.substring(text, end + 1, F.lit(context)))


def usable_span(word: Column, group: Column, score: Column) -> Column:
    """Whether a recognised span is worth linking."""
    return ~F.contains(word, F.lit("##")) & (F.length(strip(word)) >= 3) & group.isin("PER", "LOC", "ORG") & (F.coalesce(score, F.lit(1.0)) >= 0.85)


def truecased(docs: DataFrame, text: str, case: Callable[[str], str] | None = None) -> DataFrame:
    """docs with the case of a text column restored by an injected function, in Arrow batches; without one it stays as it is."""
    if case is None:
        return docs
    restored = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else case(x)), T.StringType())
    return docs.withColumn(text, restored(F.col(text)))


def prepared(docs: DataFrame, text: str = "text", most: int = 12_000, case: Callable[[str], str] | None = None) -> DataFrame:
    """docs whose text is the narrative to be linked: at most so many characters, in its restored case; null is empty."""
    return truecased(docs.withColumn(text, F.left(narrative_body(F.coalesce(F.col(text), F.lit(""))), F.lit(most))), text, case)


def recognised(docs: DataFrame, recognise: Callable[[str], list[dict]], window: int = 1500, overlap: int = 250) -> DataFrame:
    """doc_id, start, surface, marked of the usable spans that an injected recogniser finds in windows of docs (doc_id, text).

    recognise gives word, start, end, entity_group and score of each span of a window. Windows overlap, so a mention near
    an edge is seen twice: of spans of one place and surface in a document the first window's counts.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, at, piece in zip(f["doc_id"], f["at"], f["piece"]):
                for x in recognise(piece) or []:
                    rows.append((d, int(at), str(x.get("word", "")), int(x["start"]), int(x["end"]), x.get("entity_group", ""), float(x.get("score", 1.0))))
            yield pd.DataFrame(rows, columns=["doc_id", "at", "surface", "low", "high", "group", "score"]).merge(f, on=["doc_id", "at"])[names]

    names = ["doc_id", "at", "surface", "low", "high", "group", "score", "piece"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", F.explode(windows(F.col("text"), window, overlap)).alias("w")).select("doc_id", F.col("w.start").alias("at"), "w.piece")
    found = pieces.mapInPandas(run, f"doc_id {kind}, at int, surface string, low int, high int, group string, score double, piece string")
    usable = found.filter(usable_span(F.col("surface"), F.col("group"), F.col("score")))
    placed = usable.select("doc_id", (F.col("at") + F.col("low")).alias("start"), "surface", "at", marked_span(F.col("piece"), F.col("low"), F.col("high")).alias("marked"))
    return placed.groupBy("doc_id", "start", "surface").agg(F.min_by("marked", "at").alias("marked"))
