"""Sinks: records with a provenance sidecar, gated splits, frozen releases and review pages."""

from __future__ import annotations

import hashlib
import html
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDECAR = "_provenance.json"


def canonical(record: object) -> str:
    """One-line JSON with sorted keys, as records are hashed."""
    return json.dumps(record, ensure_ascii=False, sort_keys=True)


@F.pandas_udf(T.StringType())
def canonical_json(rows: pd.Series) -> pd.Series:
    """Canonical form of JSON text, byte for byte that of `canonical`."""
    return rows.map(lambda x: None if x is None else canonical(json.loads(x)))


def record_hash(df: DataFrame) -> DataFrame:
    """df with `record_hash`, the SHA-256 of each row's canonical JSON, null fields included."""
    whole = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.withColumn("record_hash", F.sha2(canonical_json(whole), 256))


def _hadoop(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), p


def _sidecar(df: DataFrame, path: str, text: str | None) -> None:
    fs, p = _hadoop(df, f"{path}.{SIDECAR}")
    if text is None:
        fs.delete(p, False)
        return
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_records(df: DataFrame, path: str, provenance: dict, rows_in: int | None = None, format: str = "json") -> int:
    """Writes df and then a sidecar beside it; a sidecar of an earlier run is removed first, so that a missing one means a dead run."""
    _sidecar(df, path, None)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format(format).mode("overwrite").save(path)
    rows = seen.get["n"]
    if rows_in is not None and rows > rows_in:
        raise ValueError(f"{rows} rows out of {rows_in}")
    _sidecar(df, path, canonical(provenance | {"output": path, "rows_in": rows_in, "rows_out": rows}) + "\n")
    return rows


def emit(judged: DataFrame, accepted: str, rejected: str, provenance: dict) -> tuple[int, int]:
    """Items with `accepted` to one place and the others to another; (accepted, rejected) counts."""
    total = judged.count()
    return tuple(write_records(judged.filter(F.col("accepted") == keep).drop("accepted"), path, provenance, total) for keep, path in ((True, accepted), (False, rejected)))


def kept_by_verdict(items: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items whose verdict (item_id, verdict) is keep, and counts of kept, dropped and undecided ones."""
    joined = items.join(verdicts.select("item_id", "verdict"), "item_id", "left")
    counts = joined.agg(F.count_if(F.col("verdict") == "keep").alias("kept"), F.count_if(F.col("verdict") != "keep").alias("dropped"), F.count_if(F.col("verdict").isNull()).alias("undecided"))
    return joined.filter(F.col("verdict") == "keep").drop("verdict"), counts


def canonical_lines(items: DataFrame) -> DataFrame:
    """line: each item's canonical JSON, null fields included, in the order of item_id (sorted by ranges)."""
    whole = F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"})
    return items.select("item_id", canonical_json(whole).alias("line")).orderBy("item_id", "line").select("line")


def release_digest(lines: DataFrame) -> str:
    """One SHA-256 over all lines in order: sequential by nature, so they pass the driver one part at a time and none is kept."""
    h = hashlib.sha256()
    for r in lines.toLocalIterator():
        h.update(r.line.encode() + b"\n")
    return h.hexdigest()


def freeze(items: DataFrame, sheet: DataFrame, corpora: dict[str, dict], path: str) -> dict:
    """A release: canonical lines of the items sorted by item_id, and a datasheet with their digest; the order of lines is that of the files.

    sheet (section, name, n) is reports.datasheet(). The digest is that of the lines as written.
    """
    canonical_lines(items).write.mode("overwrite").text(f"{path}/questions")
    spark = items.sparkSession
    names = sorted(f.getPath().toString() for f in _listed(items, f"{path}/questions") if f.getPath().getName().startswith("part-"))
    h = hashlib.sha256()
    for name in names:  # file by file, in order
        for r in spark.read.text(name).toLocalIterator():
            h.update(r.value.encode() + b"\n")
    told: dict = {"corpora": corpora, "sha256": h.hexdigest()}
    for r in sheet.collect():  # one row for each type, gate and outcome
        told.setdefault(r.section, {})[r.name] = r.n
    fs, p = _hadoop(items, f"{path}/datasheet.json")
    out = fs.create(p, True)
    out.write(bytearray((canonical(told) + "\n").encode()))
    out.close()
    return told


def _listed(df: DataFrame, path: str) -> list:
    fs, p = _hadoop(df, path)
    return list(fs.listStatus(p))


CLAIMS = (("grounded", "Do these two documents actually support that answer?"), ("necessary", "Is that the right call about what is needed?"))


def calibration_page(items: DataFrame, texts: DataFrame, title: str, most: int = 500) -> str:
    """HTML on which people check what the pipeline concluded of `most` items by id: is the answer grounded, and are both sides needed.

    items (item_id, question, answer, private_id, public_id, necessity), texts (id, text). A sample for people: its size is the feature.
    """
    rows = items.orderBy("item_id").limit(most)
    for side in ("private", "public"):
        rows = rows.join(texts.select(F.col("id").alias(f"{side}_id"), F.col("text").alias(side)), f"{side}_id", "left")
    body = ""
    for r in rows.orderBy("item_id").collect():
        n = r.necessity
        alone = [name for name, value in (("world knowledge alone", n and n.closed_book), ("the public record alone", n and n.public_only), ("the confidential document alone", n and n.private_only)) if value]
        says = {"grounded": "yes, the judge verified it", "necessary": "answerable from " + " and ".join(alone) if alone else "both documents are needed"}
        safe = lambda x: html.escape(x or "", quote=True)
        claims = "".join(f"<fieldset name='{safe(r.item_id)}:{k}'><legend>{safe(q)}</legend><p>{safe(says[k])}</p><button value='agree'>Agree</button><button value='disagree'>Disagree</button></fieldset>" for k, q in CLAIMS)
        sides = "".join(f"<section><h3>{name}</h3><pre>{safe(t) or '(not available)'}</pre></section>" for name, t in (("Confidential", r.private), ("Public", r.public)))
        body += f"<article id='{safe(r.item_id)}'><h2>{safe(r.question)}</h2><p>{safe(r.answer)}</p>{sides}{claims}</article>"
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}"


def review_page(items: DataFrame, title: str, most: int = 500, context: int = 200) -> str:
    """HTML for reviewers of at most `most` items by id, with question, answer and rationale, all escaped."""
    rows = items.select("item_id", "question", "answer", F.substring(F.coalesce("rationale", F.lit("")), 1, context).alias("why"), (F.length("rationale") > context).alias("cut")).orderBy("item_id").limit(most).collect()
    body = "".join(f"<article id='{html.escape(r.item_id or '', quote=True)}'><h2>{html.escape(r.question or '')}</h2><p>{html.escape(r.answer or '')}</p><blockquote>{html.escape(r.why)}{'…' if r.cut else ''}</blockquote></article>" for r in rows)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}"


def append_transcript(path: str, record: dict) -> None:
    """One line of a model's transcript, on the driver; nothing without a path."""
    if path:
        with Path(path).open("a", encoding="utf-8") as f:
            f.write(canonical(record) + "\n")
