"""Reports over finished sets, deterministic samples, fingerprints and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import tokens
from threadloom.operators.gates import measured, needs_both

#: Kinds of derived data.
KINDS = ("corpus", "derived", "acquired")


def opening_share(items: DataFrame, words: int = 5) -> DataFrame:
    """opening, n, share of questions by their first words; a null question is an empty one."""
    counted = items.select(F.array_join(F.slice(tokens(F.coalesce("question", F.lit(""))), 1, words), " ").alias("opening")).groupBy("opening").agg(F.count(F.lit(1)).alias("n"))
    total = items.agg(F.count(F.lit(1)).alias("total"))
    return counted.join(F.broadcast(total), how="inner", on=F.lit(True)).select("opening", "n", (F.col("n") / F.col("total")).alias("share"))


def run_alarms(items: DataFrame, share: float = 0.1, least: int = 20) -> DataFrame:
    """kind, what: openings that hold too large a share, and a set of one type only."""
    openings = opening_share(items).filter(F.col("share") >= share).select(F.lit("opening").alias("kind"), F.col("opening").alias("what"))
    types = items.agg(F.count(F.lit(1)).alias("n"), F.min("question_type").alias("lo"), F.max("question_type").alias("hi")).filter((F.col("n") >= least) & (F.col("lo") == F.col("hi")))
    return openings.unionByName(types.select(F.lit("one_type").alias("kind"), F.col("lo").alias("what")))


def datasheet(items: DataFrame) -> DataFrame:
    """section, name, n: totals, types, necessity outcomes and gates passed."""
    n = F.col("necessity")
    of = measured(n)
    counts = {"measured": of, "needs_both": needs_both(n), "answerable_closed_book": of & n["closed_book"], "answerable_public_only": of & n["public_only"], "answerable_private_only": of & n["private_only"]}
    one = items.agg(F.count(F.lit(1)).alias("questions"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    rows = F.array(F.struct(F.lit("total").alias("section"), F.lit("questions").alias("name"), F.col("questions").alias("n")), *[F.struct(F.lit("necessity").alias("section"), F.lit(k).alias("name"), F.col(k).alias("n")) for k in counts])
    types = items.groupBy(F.col("question_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("types").alias("section"), "name", "n")
    gates = items.select(F.explode("gates").alias("name", "passed")).groupBy("name").agg(F.count_if("passed").alias("n")).select(F.lit("gates").alias("section"), "name", "n")
    return one.select(F.inline(rows)).unionByName(types).unionByName(gates)


def calibration_sample(items: DataFrame, size: int = 12) -> DataFrame:
    """A sample of measured items by id, half of them needing both sides; a shortfall is made up by the other half."""
    kept = items.filter(measured(F.col("necessity"))).withColumn("both", needs_both(F.col("necessity")))
    half = size // 2
    i = F.row_number().over(Window.partitionBy("both").orderBy("item_id"))
    # no stratum gives more than `size`, so what is compared further on is bounded
    few = kept.withColumn("i", i).filter(F.col("i") <= size)
    quota = F.when(F.col("both"), half).otherwise(size - half)
    order = F.row_number().over(Window.orderBy((F.col("i") > quota).cast("int"), "item_id"))
    return few.withColumn("o", order).filter(F.col("o") <= size).drop("i", "o")


def per_type_sample(items: DataFrame, most: int, seed: int) -> DataFrame:
    """At most so many of each type, in the order of a seeded hash of the id."""
    row = F.row_number().over(Window.partitionBy("question_type").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("item_id")), 256), "item_id"))
    return items.withColumn("i", row).filter(F.col("i") <= most)


def hash_asker(c: Column, askers: int = 5) -> Column:
    """A number below `askers` by the first byte of the id's SHA-256."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 2), 16, 10).cast("int") % askers).cast("int")


def strided(rows: DataFrame, order: str, stride: int = 1, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Filter, then every stride-th row in order, then the first `limit`."""
    from threadloom.operators.ordered import numbered

    kept = rows if where is None else rows.filter(where)
    out = numbered(kept, order).filter((F.col("number") - 1) % stride == 0)
    return (out.filter((F.col("number") - 1) / stride < limit) if limit is not None else out).drop("number")


def row_fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the columns as text, in the given order, with marks for null; differs from that of canonical JSON."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def table_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, digest: SHA-256 over the count and four sums of parts of the row digests.

    The order of the rows doesn't matter, repeats count, and sums combine on the map side: nothing is gathered.
    """
    parts = [F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = rows.select(row_fingerprint(columns).alias("d")).agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select("rows", F.sha2(F.concat_ws("-", F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def provenance_problems(kind: Column, fields: Column, kept: Column, dropped: Column, rows_in: Column, rows_out: Column) -> Column:
    """Array of what is wrong with a provenance record: kept and dropped are maps by source field."""
    had, left, named = F.array_except(fields, F.array_union(F.map_keys(kept), F.map_keys(dropped))), F.array_except(F.map_keys(kept), fields), F.map_keys(F.map_filter(dropped, lambda k, v: F.coalesce(F.trim(v), F.lit("")) == ""))
    checks = [F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown kind"), F.when(F.size(had) > 0, "unexplained fields"), F.when(F.size(left) > 0, "kept keys that are no fields"), F.when(F.size(named) > 0, "dropped without a reason"), F.when(rows_out > rows_in, "more rows out than in")]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def unanimous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, agreed: the value that all rows of a key have, '' where they differ or one is null."""
    t = rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("a"), F.count(F.lit(1)).alias("n"))
    return t.select(key, F.when((F.col("lo") == F.col("hi")) & (F.col("a") == F.col("n")), F.col("lo")).otherwise("").alias("agreed"))
