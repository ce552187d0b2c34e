"""Global order without a global task: rows are numbered by range partitions and their prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import written


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with `number`, the 1-based place in the order of a column without repeats; nulls come first.

    Rows are range-partitioned and written, so that a part keeps its rows if a task runs again; each part is numbered
    on its own, and the count of the parts before it is added.
    """
    from pyspark.sql import Window

    parts = written(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ordered")
    before = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_first(order)))
    return parts.withColumn("_i", inside).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("number", F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


