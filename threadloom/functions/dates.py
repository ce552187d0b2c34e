"""Dates from text: a strict form for joins and a lenient one for intervals, both null for what they can't read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_date(c: Column) -> Column:
    """The ISO date in the first ten characters; months and days may be of one figure."""
    head = F.left(c, F.lit(10))
    return F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.to_date(F.try_to_timestamp(head, F.lit("yyyy-M-d"))))


def lenient_date(c: Column) -> Column:
    """An ISO date or timestamp, or eight figures."""
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ])"), F.to_date(F.try_to_timestamp(F.left(c, F.lit(10)), F.lit("yyyy-MM-dd"))))
    return F.coalesce(iso, F.when(c.rlike(r"^\d{8}($|T)"), F.to_date(F.try_to_timestamp(F.left(c, F.lit(8)), F.lit("yyyyMMdd")))))


def us_timestamp(c: Column) -> Column:
    """ISO form of M/D/YYYY H:MM, or null."""
    return F.date_format(F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"), F.try_to_timestamp(c, F.lit("M/d/yyyy H:mm"))), "yyyy-MM-dd'T'HH:mm:ss")


def dotted_date(c: Column) -> Column:
    """D.M.YYYY, or YYYY as its first day; no check against the calendar; anything else null."""
    parts = F.split(F.trim(c), r"\.")
    whole = F.trim(c).rlike(r"^\d+\.\d+\.\d+$")
    full = F.format_string("%04d-%02d-%02d", F.try_element_at(parts, F.lit(3)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int"), F.try_element_at(parts, F.lit(1)).try_cast("int"))
    return F.when(whole, full).when(F.trim(c).rlike(r"^\d{4}$"), F.concat(F.trim(c), F.lit("-01-01")))


def odata_date(c: Column) -> Column:
    """/Date(ms+tz)/ as an ISO date in UTC; other text as it is."""
    ms = F.regexp_extract(c, r"^/Date\((-?\d+)(?:\+\d+)?\)/$", 1)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms.try_cast("bigint") / 86_400_000).cast("int"))
    return F.when(ms != "", F.date_format(day, "yyyy-MM-dd")).otherwise(c)


def days_between(private: Column, public: Column) -> Column:
    """Signed days from private to public; null if either is."""
    return F.datediff(public, private)
