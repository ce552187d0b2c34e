"""Per-key results when a few keys hold most rows: exact offset chunking.

No task ever holds a key. Equal rows are first combined on the map side. The rows are then laid out in order of key and
partner over range partitions of about equal size, whatever their keys are, and written, so that a part keeps its rows if
a task runs again. Keys are counted per part; prefix sums of these counts are the offsets that make numbers within a part
numbers within the key. Equal runs of numbers are the chunks. A chunk (or what a part has of it) leaves an ordered boundary
state (its first and last partner), and these states are merged in order: a partner that straddles two chunks counts once.

A part goes on with at most one key of the part before it, so at most one offset a part is not zero: these are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import parts as parts_of
from threadloom.session import written

MIN_CHUNK_ROWS = 256
#: Chunks of all keys together, but for one that is not full for each key.
MOST_CHUNKS = 10_000


def chunk_size(rows: int, least: int = MIN_CHUNK_ROWS, most_chunks: int = MOST_CHUNKS) -> int:
    """Rows of a chunk: at least `least`, and so many that there are most_chunks full ones at most."""
    return max(least, -(-rows // most_chunks))


def same(a: str, b: str, keys: list[str]):
    """Whether the keys of the aliases a and b are the same, nulls included."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def number_rows(rows: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """rows with `part` and their exact 1-based `number` within the key, in the order of the columns `order`, nulls first.

    Rows equal in keys and order have their numbers in any order. Null keys form a key of their own.
    """
    order = [order] if isinstance(order, str) else order
    laid = rows.repartitionByRange(parts_of(rows.sparkSession), *keys, *order)
    parts = written(laid.withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("part", *keys).agg(F.count(F.lit(1)).alias("_m"))
    offsets = counts.select("part", *keys, F.sum("_m").over(before).alias("_offset")).filter("_offset > 0")
    inside = Window.partitionBy("part", *keys).orderBy(*order)
    p, o = parts.withColumn("_i", F.row_number().over(inside)).alias("p"), F.broadcast(offsets).alias("o")
    columns = [F.col(f"p.{x}") for x in (*rows.columns, "part")]
    return p.join(o, (F.col("p.part") == F.col("o.part")) & same("p", "o", keys), "left").select(*columns, (F.col("p._i") + F.coalesce("o._offset", F.lit(0))).alias("number"))


def number_in_chunks(rows: DataFrame, keys: list[str], order: str | list[str], chunk_rows: int) -> DataFrame:
    """number_rows() with `chunk` = (number - 1) div chunk_rows."""
    return number_rows(rows, keys, order).withColumn("chunk", F.expr(f"(number - 1) div {int(chunk_rows)}"))


def chunk_states(rows: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """rows (keys, partner, days, rows) to one boundary state for each key, chunk and part: pairs, partners, least_days, greatest_days, first_partner, last_partner.

    Everything happens within a part and a key, so the rows move once after they were laid out.
    """
    numbered = number_in_chunks(rows, keys, ["partner", "days"], chunk_rows)
    along = Window.partitionBy("part", *keys, "chunk").orderBy("number")
    new = F.col("partner").isNotNull() & ~F.coalesce(F.lag("partner").over(along) == F.col("partner"), F.lit(False))
    return numbered.withColumn("_new", new.cast("int")).groupBy("part", *keys, "chunk").agg(
        F.sum("rows").alias("pairs"), F.sum("_new").alias("partners"), F.min("days").alias("least_days"), F.max("days").alias("greatest_days"),
        F.min_by("partner", "number").alias("first_partner"), F.max_by("partner", "number").alias("last_partner"),
    )


def merge_boundaries(states: DataFrame, keys: list[str]) -> DataFrame:
    """Boundary states in order to one row a key: a partner that ends one and begins the next counts once."""
    previous = F.lag("last_partner").over(Window.partitionBy(*keys).orderBy("chunk", "part"))
    shared = F.coalesce(previous == F.col("first_partner"), F.lit(False)).cast("int")
    return (
        states.withColumn("_shared", shared)
        .groupBy(*keys)
        .agg(
            F.sum("pairs").alias("pairs"),
            (F.sum("partners") - F.sum("_shared")).alias("partners"),
            F.min("least_days").alias("least_days"),
            F.max("greatest_days").alias("greatest_days"),
            F.count_distinct("chunk").alias("chunks"),
            F.sum("_shared").alias("straddling"),
        )
    )


def key_profiles(pairs: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """For each qid and private_id of pairs: rows, distinct public_ids, least and greatest days_apart.

    Columns key_field, key_text, pairs, partners, least_days, greatest_days, chunks, straddling (bigint, days int).
    A null key gives no row. A null public_id counts in pairs and is no partner; days_apart is null only
    where all are. Repeated rows count. No rows give no rows. Other columns are ignored.
    """
    fields = F.array(
        F.struct(F.lit("qid").alias("key_field"), F.col("qid").alias("key_text")),
        F.struct(F.lit("private_id").alias("key_field"), F.col("private_id").alias("key_text")),
    )
    keys = ["key_field", "key_text"]
    rows = (
        pairs.select(F.col("public_id").alias("partner"), F.col("days_apart").alias("days"), F.explode(fields).alias("k"))
        .select("k.key_field", "k.key_text", "partner", "days")
        .filter(F.col("key_text").isNotNull())
        .groupBy(*keys, "partner", "days")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    rows = written(rows, "key-rows")  # laid out by a sample of it
    return merge_boundaries(chunk_states(rows, keys, chunk_rows or chunk_size(rows.count())), keys)


def heavy_keys(pairs: DataFrame, share: float = 0.02, chunk_rows: int | None = None) -> DataFrame:
    """key_field, key_text of each key that stands in at least `share` of all rows of pairs."""
    total = pairs.count()
    found = key_profiles(pairs, chunk_rows).filter(F.col("pairs") >= F.lit(share) * F.lit(float(total)) - F.lit(1e-6))
    return found.select("key_field", "key_text")
