"""Joins by topic and by time: both keys are made equi-keys by buckets of the window, and the exact test follows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import contains_tokens
from threadloom.session import parts

#: Subject tags and the categories that they stand for.
CROSSWALK = {
    "PREL": ("Internationale Politik",), "PGOV": ("Staatspolitik",), "PARM": ("Sicherheitspolitik",), "MARR": ("Sicherheitspolitik",), "MNUC": ("Sicherheitspolitik",), "KNNP": ("Sicherheitspolitik",),
    "PTER": ("Sicherheitspolitik",), "MOPS": ("Sicherheitspolitik",), "PHUM": ("Soziale Fragen", "Recht Allgemein"), "PREF": ("Migration",), "SMIG": ("Migration",), "ECON": ("Wirtschaft",),
    "ETRD": ("Wirtschaft",), "EINV": ("Wirtschaft",), "EIND": ("Wirtschaft",), "EFIN": ("Finanzwesen",), "ENRG": ("Energie",), "SENV": ("Umwelt",), "TBIO": ("Gesundheit",), "KFLU": ("Gesundheit",),
    "KIPR": ("Recht Allgemein",), "KCRM": ("Recht Allgemein",), "KJUS": ("Recht Allgemein",), "CVIS": ("Recht Allgemein",), "KPAO": ("Medien und Kommunikation",), "EAGR": ("Landwirtschaft",), "EDUC": ("Bildung",),
}
CATEGORIES = sorted({c for x in CROSSWALK.values() for c in x})
#: Posts whose reports are in scope.
POSTS = ("bern", "geneva")


def reports_on(origin: Column, posts: tuple[str, ...] = POSTS) -> Column:
    return F.coalesce(F.lower(origin).rlike("|".join(posts)), F.lit(False))


def topics_of(tags: Column) -> Column:
    """Sorted categories of an array of tags."""
    # the tags stand in the expression once: it is evaluated as often as it is named
    cross = F.create_map(*[x for k, v in CROSSWALK.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    made = F.filter(F.transform(F.filter(tags, lambda x: x.isNotNull()), lambda x: F.try_element_at(cross, x)), lambda x: x.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(made))), F.array().cast("array<string>"))


def by_windows(left: DataFrame, right: DataFrame, keys: list[str], window: int, tasks: int | None = None) -> DataFrame:
    """left and right (each with keys and a date column `date`) at most `window` days apart.

    Time is cut into buckets as long as the window, and the right side is copied to the two neighbours of its
    bucket: an equi-join for Spark, whatever the window is. Right columns other than the keys get the prefix r_.
    tasks: the join's, where small sides make many rows; else Spark chooses by the sides' size.
    """
    width = max(window, 1)
    day = F.unix_date("date")
    a = left.withColumn("_b", F.floor(day / width))
    renamed = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    b = F.floor(F.unix_date("r_date") / width)
    copies = renamed.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    if tasks:
        a, copies = a.repartition(tasks, *keys, "_b"), copies.repartition(tasks, *keys, "_b")
    return a.join(copies, [*keys, "_b"]).filter(F.abs(F.datediff("r_date", "date")) <= window).drop("_b")


def event_windows(documents: DataFrame, entities: DataFrame, events: DataFrame, labels: DataFrame, window: int = 21, max_share: float = 0.15, most: int = 8) -> DataFrame:
    """private_id, anchor_qid, anchor_label, public_ids: the first `most` events by date of each document and entity.

    documents (doc_id, date), entities (doc_id, qid), events (event_id, date, qid), labels (qid, label). Entities in more
    than max_share of the documents and those without a label are skipped, as are documents and events without a date.
    """
    total = documents.count()
    common = entities.join(documents.select("doc_id"), "doc_id").groupBy("qid").agg(F.countDistinct("doc_id").alias("n")).filter(F.col("n") > max_share * total)
    dated = documents.filter(F.col("date").isNotNull())
    anchors = dated.join(entities.select("doc_id", "qid").distinct(), "doc_id").join(common, "qid", "left_anti").join(labels.select("qid", "label"), "qid")
    met = by_windows(anchors, events.filter(F.col("date").isNotNull()).select("qid", "date", "event_id").distinct(), ["qid"], window)
    row = F.row_number().over(Window.partitionBy("doc_id", "qid").orderBy("r_date", "r_event_id"))
    kept = met.withColumn("_i", row).filter(F.col("_i") <= most)
    return kept.groupBy("doc_id", "qid", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "r_event_id"))), lambda x: x.r_event_id).alias("public_ids")).select(
        F.col("doc_id").alias("private_id"), F.col("qid").alias("anchor_qid"), F.col("label").alias("anchor_label"), "public_ids"
    )


def rendered(shown: dict[str, str]) -> Column:
    """One line of an event: its filled columns (column -> what stands before the value), in order."""
    parts = [F.concat(F.lit(label), F.nullif(F.col(c), F.lit(""))) for c, label in shown.items()]
    return F.concat(F.lit("  - "), F.concat_ws(", ", *parts))


def with_lines(matches: DataFrame, lines: DataFrame) -> DataFrame:
    """matches (public_ids) with `rendered`, the lines (event_id, line) of their events in order; an event delivered twice counts once."""
    each = matches.select("private_id", "anchor_qid", "anchor_label", F.posexplode("public_ids").alias("pos", "event_id"))
    once = lines.groupBy("event_id").agg(F.min("line").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")
    told = each.join(once, "event_id", "left").groupBy("private_id", "anchor_qid", "anchor_label").agg(text.alias("rendered"))
    return matches.join(told, ["private_id", "anchor_qid", "anchor_label"])


def focused(shared: Column, in_title: Column, places: Column) -> Column:
    """Some shared entity is no place, and either the title names one that is none or more than one is shared."""
    first, titled = F.slice(shared, 1, 4), F.slice(in_title, 1, 4)
    return (F.size(F.array_except(first, places)) > 0) & ((F.size(F.array_except(titled, places)) > 0) | (F.size(first) > 1))


def _marked(docs: DataFrame) -> DataFrame:
    """docs with `topics` as bits of the fixed categories, and `others`, the topics that are none."""
    bits = [F.when(F.array_contains("topics", c), 1 << i).otherwise(0) for i, c in enumerate(CATEGORIES)]
    return docs.withColumns({"others": F.array_except("topics", F.array(*map(F.lit, CATEGORIES))), "topics": reduce(Column.bitwiseOR, bits)})


def _told(pairs: DataFrame) -> DataFrame:
    """What topical_pairs() returns, of pairs (private_id, public_id, days_apart, shared, in_title, places), all shared entities in order."""
    shared, titled = F.col("shared"), F.col("in_title")
    # nearly all pairs share one entity: there the rule is short
    alone = ~F.array_contains("places", shared[0]) & (F.size(titled) > 0)
    told = F.when(F.size(shared) == 1, alone).otherwise(focused(shared, titled, F.col("places")))
    return pairs.select("private_id", "public_id", "days_apart", F.slice(shared, 1, 4).alias("shared"), F.slice(titled, 1, 4).alias("in_title"), told.alias("focused"))


def topical_pairs(cables: DataFrame, items: DataFrame, labels: DataFrame, window: int = 90, max_share: float = 0.15, wide: int = 64) -> DataFrame:
    """cables (doc_id, date, topics, qids) and items (doc_id, date, title, topics, qids) that share time, topic and entity.

    labels (qid, label, norm, place): usable are labelled entities of more than three letters that no more than max_share of
    the cables name, in the cable's order. private_id, public_id, days_apart (unsigned), shared, in_title, focused.
    A label that normalises to nothing is in no title. Rows of one doc_id are one document, of the earliest date and with the
    topics, titles and entities of all; rows without a date count for max_share only. The result doesn't depend on `wide`.
    """
    total, widest = cables.select(F.lit(1).alias("c"), F.size("qids").alias("n")).union(items.select(F.lit(0), F.size("qids"))).agg(F.sum("c"), F.max("n")).first()
    every = cables.select("doc_id", F.explode(F.array_distinct("qids")).alias("qid")).groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_share * (total or 0))
    dated, known = F.col("date").isNotNull(), labels.filter(F.length("label") > 3)
    day, topics = F.min("date").alias("date"), F.array_distinct(F.flatten(F.collect_set("topics"))).alias("topics")
    usable = cables.filter(dated & (F.size("topics") > 0)).select("doc_id", "date", "topics", F.posexplode("qids").alias("pos", "qid")).join(every, "qid", "left_anti").join(known, "qid")
    order = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "qid"))), lambda x: x.qid)).alias("qids")
    private = _marked(usable.groupBy("doc_id").agg(day, topics, order, F.collect_set(F.when(F.col("place"), F.col("qid"))).alias("places")))
    named = items.filter(dated).select("doc_id", "date", "topics", "title", F.explode(F.array_distinct("qids")).alias("qid")).join(known, "qid")
    titled = F.when(contains_tokens(F.col("title"), F.col("norm")), F.col("qid"))
    public = _marked(named.groupBy("doc_id").agg(day, topics, F.collect_set("qid").alias("qids"), F.collect_set(titled).alias("titled")))

    def met(items: DataFrame, cables: DataFrame) -> DataFrame:
        # entity and time bucket are the join's keys: far fewer rows meet than by topic and month. Small sides make many pairs
        tasks = max(parts(cables.sparkSession), 4 * cables.sparkSession.sparkContext.defaultParallelism)
        one = F.col("topics").bitwiseAND(F.col("r_topics")) != 0
        return by_windows(items, cables, ["qid"], window, tasks).filter(one | ((F.size("others") > 0) & F.arrays_overlap("others", "r_others")))

    ids = F.col("r_doc_id").alias("private_id"), F.col("doc_id").alias("public_id"), F.abs(F.datediff("date", "r_date")).alias("days_apart")
    # both documents' entities stand in the row: the first that they share makes the pair, once and whole, so no pair is shuffled
    each = private.select("doc_id", "date", "topics", "others", "places", F.size("qids").alias("n"), "qids", F.posexplode("qids").alias("pos", "qid"))
    each = each.select(*[c for c in each.columns if c not in ("qids", "pos")], F.slice("qids", 1, F.col("pos")).alias("before"), F.slice("qids", F.col("pos") + 2, F.col("n")).alias("after"))
    facing = public.select("*", F.explode("qids").alias("qid"))
    narrow = (facing, each) if widest is None or widest <= wide else (facing.filter(F.size("qids") <= wide), each.filter(F.col("n") <= wide))
    more = F.size("qids") > 1
    first = met(*narrow).filter((F.size("r_before") == 0) | ~(more & F.arrays_overlap("r_before", "qids")))
    shared = F.when(more & (F.size("r_after") > 0), F.concat(F.array("qid"), F.array_intersect("r_after", "qids"))).otherwise(F.array("qid"))
    found = _told(first.select(*ids, shared.alias("shared"), "titled", F.col("r_places").alias("places")).withColumn("in_title", F.array_intersect("shared", "titled")))
    if widest is None or widest <= wide:
        return found
    # documents of many entities would be copied whole for each of them: their rows carry one entity, and their pairs are put together
    lone = private.select("doc_id", "date", "topics", "others", F.size("qids").alias("n"), F.posexplode("qids").alias("pos", "qid"), "places").withColumn("place", F.array_contains("places", F.col("qid"))).drop("places")
    faced = public.select("doc_id", "date", "topics", "others", F.size("qids").alias("m"), F.explode("qids").alias("qid"), "titled").withColumn("in_title", F.array_contains("titled", F.col("qid"))).drop("titled")
    some = met(faced.filter(F.col("m") > wide), lone).union(met(faced.filter(F.col("m") <= wide), lone.filter(F.col("n") > wide)))
    all_of = some.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("r_pos", "qid", "in_title", "r_place"))).alias("e"))
    pick = lambda f: F.transform(F.filter("e", f), lambda x: x.qid)
    return found.union(_told(all_of.select("private_id", "public_id", "days_apart", pick(lambda x: F.lit(True)).alias("shared"), pick(lambda x: x.in_title).alias("in_title"), pick(lambda x: x.r_place).alias("places"))))


def chronologies(pairs: DataFrame, most: int = 365) -> DataFrame:
    """private_id, public_id, days, order of pairs (private_date, public_date as dates) that are some days apart, `most` at most."""
    days = F.abs(F.datediff("public_date", "private_date"))
    return pairs.withColumn("days", days).filter((F.col("days") > 0) & (F.col("days") <= most)).withColumn("order", F.when(F.col("private_date") < F.col("public_date"), "private_first").otherwise("public_first"))
