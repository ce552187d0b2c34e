"""Streams: events of an entity near a document's date, as a stream-stream join with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_stream(documents: DataFrame, events: DataFrame, window_days: int = 21, late: str = "1 day") -> DataFrame:
    """documents (doc_id, qid, ts) and events (event_id, qid, event_ts) at most window_days apart, append mode.

    Both sides have a watermark and the condition bounds time both ways, so the state of a row is dropped once no
    partner can come any more.
    """
    a = documents.withWatermark("ts", late).alias("a")
    b = events.withWatermark("event_ts", late).alias("b")
    span = F.expr(f"INTERVAL {window_days} DAYS")
    on = (F.col("a.qid") == F.col("b.qid")) & (F.col("b.event_ts") >= F.col("a.ts") - span) & (F.col("b.event_ts") <= F.col("a.ts") + span)
    return a.join(b, on).select("a.doc_id", "a.qid", "a.ts", "b.event_id", "b.event_ts")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """qid, window, n: events of each entity in tumbling windows, late rows counted up to the watermark."""
    return events.withWatermark("event_ts", late).groupBy("qid", F.window("event_ts", width)).agg(F.count(F.lit(1)).alias("n"))
