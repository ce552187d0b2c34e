"""Mentions and link sets: filters, merges, inversion to bridges, reconciliation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import strip, tokens

#: An entity of more documents on a side has no array of them; the long form has it.
MOST_LISTED = 100_000
#: Entity types that anchor nothing.
DROPPED_TYPES = ("DATE", "TIME", "CARDINAL", "ORDINAL", "QUANTITY", "PERCENT", "MONEY")


def keep_mentions(mentions: DataFrame, floor: float = 0.5, universe: DataFrame | None = None) -> DataFrame:
    """Mentions at or above the floor, not of a dropped type, and with a qid of the universe (column qid) if given."""
    kept = mentions.filter((F.col("confidence") >= floor) & ~F.isnan("confidence") & ~F.coalesce(F.col("entity_type").isin(*DROPPED_TYPES), F.lit(False)))
    return kept if universe is None else kept.join(universe.select("qid").distinct(), "qid", "left_semi")


def best_mentions(mentions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the mention of highest confidence; of equals the first in `order`."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), *order))
    return mentions.withColumn("_i", row).filter("_i = 1").drop("_i")


def merge_links(first: DataFrame, second: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union of two link sets, the stronger mention per key; on a tie the first set's."""
    both = first.withColumn("_set", F.lit(0)).unionByName(second.withColumn("_set", F.lit(1)))
    return best_mentions(both, keys, ["_set", *order]).drop("_set")


def bridge_sides(links: DataFrame) -> DataFrame:
    """qid, side, doc_id: each document of an entity once; links with a side other than private and public are an error.

    The long form of bridges: an entity may have any number of documents here, none of which meet in a task.
    """
    good = F.col("side").isin("private", "public")
    checked = links.filter(F.col("qid").isNotNull()).withColumn("side", F.when(good, F.col("side")).otherwise(F.raise_error(F.concat(F.lit("unknown side "), F.coalesce("side", F.lit("null"))))))
    return checked.select("qid", "side", "doc_id").distinct()


def bridge_counts(sides: DataFrame) -> DataFrame:
    """qid, private_count, public_count."""
    return sides.groupBy("qid").agg(*[F.count_if(F.col("side") == s).alias(f"{s}_count") for s in ("private", "public")])


def bridging(counts: DataFrame, max_private: int = 200) -> DataFrame:
    """Entities with documents on both sides and at most max_private private ones (0: no cap)."""
    kept = counts.filter((F.col("private_count") > 0) & (F.col("public_count") > 0))
    return kept.filter(F.col("private_count") <= max_private) if max_private else kept


def build_bridges(links: DataFrame, max_private: int | None = None) -> DataFrame:
    """links (doc_id, side, qid, surface_form) inverted to one row an entity: qid, private and public (sorted arrays), private_count, public_count.

    Rows without a qid take no part. With max_private only bridging entities are gathered (bridging()): entities that are
    named nearly everywhere are dropped by their counts before any list is made. More than MOST_LISTED documents on a side
    are an error: such an entity is for the long form, bridge_sides().
    """
    sides = bridge_sides(links)
    counts = bridge_counts(sides)
    if max_private is not None:
        counts = bridging(counts, max_private)
    most = F.greatest("private_count", "public_count")
    counts = counts.filter(F.when(most <= MOST_LISTED, True).otherwise(F.raise_error(F.concat(F.lit("too many documents for an array: "), "qid"))))
    sets = sides.join(counts.select("qid"), "qid", "left_semi").groupBy("qid").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("doc_id")))).alias(s) for s in ("private", "public")])
    return sets.join(counts, "qid").select("qid", "private", "public", "private_count", "public_count")


def surface_counts(links: DataFrame) -> DataFrame:
    """qid, surface_form, times: how often each entity is written how; an empty or null form doesn't count."""
    return links.filter(F.col("qid").isNotNull() & (F.coalesce("surface_form", F.lit("")) != "")).groupBy("qid", "surface_form").agg(F.count(F.lit(1)).alias("times"))


def pair_documents(sides: DataFrame, dates: DataFrame, window_days: int = 90, cap: int = 50, max_private: int = 200) -> DataFrame:
    """Pairs of each bridging entity's private and public documents, the first `cap` in order; dates has doc_id, date.

    qid, private_id, public_id, days_apart (signed) and same_period (within the window; false where a date is missing).
    sides is bridge_sides(). Each side is ranked and cut to the cap before the sides meet: no later document can be among the
    first pairs, so an entity gives cap x cap rows at most, however many documents it has.
    """
    kept = sides.join(bridging(bridge_counts(sides), max_private).select("qid"), "qid", "left_semi")
    row = F.row_number().over(Window.partitionBy("qid", "side").orderBy("doc_id"))
    first = kept.withColumn("_i", row).filter(F.col("_i") <= cap)
    private = first.filter("side = 'private'").select("qid", F.col("doc_id").alias("private_id"))
    public = first.filter("side = 'public'").select("qid", F.col("doc_id").alias("public_id"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("private_id", "public_id"))
    pairs = private.join(public, "qid").withColumn("_i", order).filter(F.col("_i") <= cap)
    a = dates.select(F.col("doc_id").alias("private_id"), F.col("date").alias("_a"))
    b = dates.select(F.col("doc_id").alias("public_id"), F.col("date").alias("_b"))
    days = F.datediff("_b", "_a")
    return pairs.join(a, "private_id", "left").join(b, "public_id", "left").select("qid", "private_id", "public_id", days.alias("days_apart"), F.coalesce(F.abs(days) <= window_days, F.lit(False)).alias("same_period"))


def document_share(links: DataFrame, share: float, total: int) -> DataFrame:
    """qid, documents of the entities named in more than `share` of all documents: too common to anchor anything."""
    return links.filter(F.col("qid").isNotNull()).groupBy("qid").agg(F.countDistinct("doc_id").alias("documents")).filter(F.col("documents") > share * total)


def unique_candidates(names: DataFrame, candidates: DataFrame, universe: DataFrame) -> DataFrame:
    """names (doc_id, name, pos) linked through candidates (name, qid) where exactly one candidate is in the universe.

    doc_id, qid, name: of several names of a document with one qid the first counts.
    """
    known = candidates.join(universe.select("qid").distinct(), "qid", "left_semi")
    single = known.groupBy("name").agg(F.min("qid").alias("qid"), F.max("qid").alias("_other")).filter("qid = _other")
    linked = names.join(single.select("name", "qid"), "name")
    return linked.groupBy("doc_id", "qid").agg(F.min_by("name", F.struct("pos", "name")).alias("name"))


def labels_over_aliases(names: DataFrame, known: DataFrame) -> DataFrame:
    """names (name) to the qids of known (name, qid, predicate label or alias); label matches replace alias matches."""
    met = names.select("name").distinct().join(known, "name")
    best = F.min(F.when(F.col("predicate") == "label", 0).otherwise(1)).over(Window.partitionBy("name"))
    rank = F.when(F.col("predicate") == "label", 0).otherwise(1)
    return met.withColumn("_best", best).filter(rank == F.col("_best")).select("name", "qid").distinct()


def by_code(codes: DataFrame, known: DataFrame) -> DataFrame:
    """codes (code) to qid through known (code, qid, pos): the last row of a code wins."""
    return codes.select("code").distinct().join(known.groupBy("code").agg(F.max_by("qid", "pos").alias("qid")), "code")


def verified_search(names: DataFrame, found: DataFrame) -> DataFrame:
    """names (name, bag, kind, year) to the first of found (name, rank, qid, label_bag, kinds, years) that passes.

    The label's words must be the name's, the kind one of its kinds, and a known birth year the same.
    """
    met = names.join(found, "name")
    good = (F.col("bag") == F.col("label_bag")) & F.array_contains("kinds", F.col("kind")) & (F.col("year").isNull() | (F.size("years") == 0) | F.array_contains("years", F.col("year")))
    return met.filter(good).groupBy("name").agg(F.min_by("qid", "rank").alias("qid"))


def names_in(columns: dict[str, bool], min_words: int = 1) -> Column:
    """Array of the names that a record's columns carry, in their order (name -> whether it is an array): stripped, without blanks and names of fewer words."""
    found = [strip_each(F.col(c) if many else F.array(c)) for c, many in columns.items()]
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in found]))
    return F.filter(every, lambda x: x.isNotNull() & (x != "") & (F.size(F.split(x, r"(?U)\s+")) >= min_words))


def strip_each(c: Column) -> Column:
    return F.transform(c, lambda x: strip(x))


def bag(c: Column) -> Column:
    """The sorted set of a name's tokens."""
    return F.array_sort(F.array_distinct(tokens(c)))


def searchable(variants: Column, most: int = 4) -> Column:
    """The first `most` distinct variants of two tokens or more: a single token is a collision waiting to happen."""
    return F.slice(F.filter(F.array_distinct(variants), lambda x: x.isNotNull() & (F.size(bag_or_empty(x)) >= 2)), 1, most)


def bag_or_empty(c: Column) -> Column:
    return F.coalesce(tokens(c), F.array().cast("array<string>"))


def search_resolved(asked: DataFrame, hits: DataFrame, facts: DataFrame, kinds: dict[str, list[str]], most: int = 4) -> DataFrame:
    """asked (id, variants, kind, years) to the one candidate that agrees on name, kind and birth year.

    hits (variant, rank, qid, label) are what a search gave for each variant, facts (qid, label, classes, births) what is known
    of the candidates. Of an id's first `most` variants of two tokens or more the candidates are tried in order of variant and
    rank; a candidate needs a label (the hit's or its own) with the tokens of a variant, a class of its kind (kinds: kind ->
    classes; another kind asks for none), and no birth year against the years. id, qid; none where no candidate agrees.
    """
    kept = asked.withColumn("variants", searchable(F.col("variants"), most)).withColumn("bags", F.transform("variants", bag))
    each = kept.select("id", "kind", "years", "bags", F.posexplode("variants").alias("pos", "variant"))
    met = each.join(hits.select("variant", "rank", "qid", F.col("label").alias("hit")), "variant").join(facts.select("qid", "label", "classes", "births"), "qid")
    named = F.coalesce(F.array_contains("bags", bag(F.col("hit"))), F.lit(False)) | F.coalesce(F.array_contains("bags", bag(F.col("label"))), F.lit(False))
    fits = F.lit(True)
    for kind, classes in kinds.items():
        fits = fits & ((F.coalesce("kind", F.lit("")) != kind) | F.coalesce(F.arrays_overlap("classes", F.array(*map(F.lit, classes))), F.lit(False)))
    years = F.coalesce("years", F.array().cast("array<string>"))
    born = (F.size(years) == 0) | (F.size(F.coalesce("births", F.array().cast("array<string>"))) == 0) | F.arrays_overlap(years, F.col("births"))
    return met.filter(named & fits & born).groupBy("id").agg(F.min_by("qid", F.struct("pos", "rank", "qid")).alias("qid"))


def restricted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands in keys."""
    return rows.join(keys.select(key), key, "left_semi")


def classes_present(rows: DataFrame, classes: str) -> DataFrame:
    """class: every class that an array column of rows holds."""
    return rows.select(F.explode(classes).alias("class")).filter(F.col("class").isNotNull()).distinct()


def linking_report(documents: DataFrame, links: DataFrame) -> DataFrame:
    """One row: documents, those with an entity, mentions, distinct entities."""
    named = links.filter(F.col("qid").isNotNull())
    return documents.agg(F.count(F.lit(1)).alias("documents")).join(
        F.broadcast(named.agg(F.countDistinct("doc_id").alias("linked"), F.count(F.lit(1)).alias("mentions"), F.countDistinct("qid").alias("entities"))), how="inner", on=F.lit(True)
    )


def classify(classes: Column, parents: Column, blocked: list[str], places: list[str], organisations: list[str], human: str) -> Column:
    """blocked, unknown or bridgeable, by an entity's classes and whether it has parent classes itself."""
    has = F.coalesce(F.size(F.filter(parents, lambda x: x.isNotNull())), F.lit(0)) > 0
    own = F.coalesce(classes, F.array().cast("array<string>"))
    return (
        F.when(has, "blocked").when(F.arrays_overlap(own, F.array(*map(F.lit, [*blocked, *places]))), "blocked").when(F.size(own) == 0, "unknown")
        .when(F.array_contains(own, human), "bridgeable").when(F.arrays_overlap(own, F.array(*map(F.lit, organisations))), "bridgeable").otherwise("blocked")
    )


def verdict_counts(classified: DataFrame) -> DataFrame:
    """verdict, n for all three verdicts, 0 included."""
    every = classified.sparkSession.createDataFrame([("blocked",), ("bridgeable",), ("unknown",)], "verdict string")
    return F.broadcast(every).join(classified.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")), "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))
