"""Views that give the tables of a data folder the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.tables import table


def links(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, side, qid, surface_form, confidence, entity_type, pos of the mentions."""
    return table(spark, d, "mentions").select(F.col("doc_ref").alias("doc_id"), "side", "qid", "surface_form", "confidence", "entity_type", F.col("mention_id").alias("pos"))


def dated_documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id (the ref) and date of the documents."""
    return table(spark, d, "documents").select(F.col("ref").alias("doc_id"), F.col("doc_ts").cast("date").alias("date"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("qid", "label")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """qid, predicate, neighbour: the affiliations that the associations tell."""
    a = table(spark, d, "associations")
    both = a.select(F.col("a_qid").alias("qid"), "predicate", F.col("shared_qid").alias("neighbour")).union(a.select("b_qid", "predicate", "shared_qid"))
    return both.dropna().distinct()
