"""Candidates from the graph of entities: shared neighbours, and family names with several bearers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.keychunks import number_rows

#: Predicates that tell an affiliation.
RELATIONAL = ("party", "member_of", "founder", "employer")
#: Words that every dispatch and biography shares.
COMMON = tuple(
    """the and for that with was were has have had not but his her its their who which from this there been also than then government minister president state national
    official officials public political party united states international world new first former during after before would could said says one two years year""".split()
)
MARGIN = 1.25


def degrees(edges: DataFrame) -> DataFrame:
    """neighbour, degree of edges (qid, predicate, neighbour): an entity counts once for each predicate."""
    return edges.distinct().groupBy("neighbour").agg(F.count(F.lit(1)).alias("degree"))


def associations(links: DataFrame, edges: DataFrame, people: DataFrame, floor: float = 0.9, most: int = 6, max_degree: int = 20) -> DataFrame:
    """Two people of one document and the most specific neighbour both point at, if neither points at the other.

    links (doc_id, pos, qid, surface_form, confidence), edges (qid, predicate, neighbour), people (qid). Only the first
    `most` people of a document that are in the graph count, so a document gives a bounded number of pairs.
    doc_id, a_qid, b_qid, shared_qid, predicate (the first by name by which a points at it), degree.
    """
    in_graph = edges.select("qid").distinct().join(people.select("qid").distinct(), "qid", "left_semi")
    first = links.filter(F.col("confidence") >= floor).filter(~F.isnan("confidence")).join(in_graph, "qid", "left_semi").groupBy("doc_id", "qid").agg(F.min("pos").alias("pos"))
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "qid"))
    named = first.withColumn("i", row).filter(F.col("i") <= most)
    a, b = (named.select("doc_id", F.col("qid").alias(f"{x}_qid"), F.col("i").alias(f"{x}_i")) for x in "ab")
    pairs = a.join(b, "doc_id").filter(F.col("a_i") < F.col("b_i"))
    direct = edges.select(F.col("qid").alias("a_qid"), F.col("neighbour").alias("b_qid")).distinct()
    apart = pairs.join(direct, ["a_qid", "b_qid"], "left_anti").join(direct.toDF("b_qid", "a_qid"), ["a_qid", "b_qid"], "left_anti")
    toward = edges.groupBy("qid", "neighbour").agg(F.min("predicate").alias("predicate"))
    near_a = toward.toDF("a_qid", "shared_qid", "predicate")
    near_b = toward.select(F.col("qid").alias("b_qid"), F.col("neighbour").alias("shared_qid"))
    specific = degrees(edges).filter(F.col("degree") <= max_degree).withColumnRenamed("neighbour", "shared_qid")
    met = apart.join(near_a, "a_qid").join(near_b, ["b_qid", "shared_qid"]).join(specific, "shared_qid").filter((F.col("shared_qid") != F.col("a_qid")) & (F.col("shared_qid") != F.col("b_qid")))
    best = met.groupBy("doc_id", "a_qid", "b_qid").agg(F.min(F.struct("degree", "shared_qid", "predicate")).alias("m"))
    return best.select("doc_id", "a_qid", "b_qid", "m.shared_qid", "m.predicate", "m.degree")


def family_names(labels: DataFrame, least: int = 4) -> DataFrame:
    """name, qid of each token after the first of a label (qid, norm) that has so many letters."""
    later = F.expr("slice(split(norm, ' '), 2, greatest(0, size(split(norm, ' ')) - 1))")
    return labels.select("qid", F.explode(F.array_distinct(later)).alias("name")).filter(F.length("name") >= least)


def name_candidates(mentions: DataFrame, labels: DataFrame, people: DataFrame, sizes: DataFrame, floor: float = 0.9, most_bytes: int = 9000) -> DataFrame:
    """Bare family names that a mention (mention_id, norm, qid, confidence) gives, with all their bearers by prominence.

    mention_id, qid, rank (0 is the longest article), bearers. The linked person must be labelled, have an article
    of most_bytes at most and not be the most prominent; there must be two bearers or more.
    """
    bare = mentions.filter((F.col("confidence") >= floor) & ~F.isnan("confidence") & (F.length("norm") >= 4) & ~F.contains("norm", F.lit(" ")))
    good = bare.join(people.select("qid").distinct(), "qid", "left_semi").select("mention_id", "qid", F.col("norm").alias("name"))
    index = family_names(labels)
    bearers = index.join(sizes.select("qid", "bytes"), "qid", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    # names are numbered over range partitions, so a name that a third of all people bear is no task's alone
    ranked = number_rows(bearers.withColumn("_less", -F.col("bytes")), ["name"], ["_less", "qid"]).withColumn("rank", (F.col("number") - 1).cast("int"))
    ranked = ranked.join(bearers.groupBy("name").agg(F.count(F.lit(1)).alias("bearers")), "name")
    return good.join(ranked, ["name", "qid"]).filter((F.col("bearers") >= 2) & (F.col("rank") > 0) & (F.col("bytes") > 0) & (F.col("bytes") <= most_bytes)).select("mention_id", "name", "qid", "rank", "bearers")


def content_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, word, n: counts of content words without the common ones."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z][a-z'-]{2,}"), F.lit(0))
    return docs.select(key, F.explode(words).alias("word")).filter(~F.col("word").isin(*COMMON)).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def first_people(mentions: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, qid, pos of the first `most` mentions (doc_id, qid, pos) of each document."""
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "qid"))
    return mentions.withColumn("_i", row).filter(F.col("_i") <= most).drop("_i")


def echo(passages: DataFrame, articles: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """passage, article, score: how much of the article's vocabulary the passage echoes; both have (key, word, n).

    With pairs (passage, article) only these meet, by passage and then by article and word; without them all that share a word.
    """
    a, b = passages.toDF("passage", "word", "n"), articles.toDF("article", "word", "m")
    met = a.join(b, "word") if pairs is None else a.join(pairs.select("passage", "article").distinct(), "passage").join(b, ["article", "word"])
    term = F.log1p("m") * F.log1p("n") / F.log1p(F.length("word"))
    return met.groupBy("passage", "article").agg(F.sum(term).alias("score"))


def margin_verdict(gold: Column, rival: Column, has_article: Column, margin: float = MARGIN) -> Column:
    """verified if the gold's score beats the best rival's by the margin, unchecked without one, else refuted."""
    score = F.coalesce(gold, F.lit(0.0))
    return F.when(~has_article | (score <= 0), "unchecked").when(score >= margin * F.greatest(F.coalesce(rival, F.lit(0.0)), F.lit(1e-9)), "verified").otherwise("refuted")
