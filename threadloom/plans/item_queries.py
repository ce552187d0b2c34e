"""Registered queries of items: gates, candidates, injected models and reconciliation, each through the operators. The models here are plain functions of the prompt."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadloom import sinks
from threadloom.functions import text
from threadloom.operators import gates, graph, links, reports, temporal, typed
from threadloom.plans import adapters as ad
from threadloom.plans.core_queries import COMMON_SQL, GATES, NORM
from threadloom.session import shared_folder
from threadloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- gates

WITHHELD = f"len(list_filter(string_split(coalesce(w, ''), ';'), lambda n: {NORM('n')} <> '' AND contains(nq, ' ' || {NORM('n')} || ' '))) = 0"
REFERENTIAL = gates.REFERENTIAL.replace("'", "''")
ALL = f"""{GATES.replace("AS polar FROM n)", f"AS polar, {WITHHELD} AS withholds, NOT regexp_matches(q, '{REFERENTIAL}') AS not_referential, md5(q || chr(31) || a) AS said FROM n)")}, v AS (SELECT *,
two_sided AND answer_not_in_question AND no_source_attribution AND not_a_bare_attribute AND answer_is_substantive AND no_foreign_script AND coalesce(polar, false) AND withholds AND not_referential AS accepted FROM g)"""
NAMES = {
    "two_sided": "two_sided", "answer_not_in_question": "answer_not_in_question", "no_source_attribution": "no_source_attribution", "not_a_bare_attribute": "not_a_bare_attribute", "answer_is_substantive": "answer_is_substantive",
    "withholds_what_it_was_told_to": "withholds", "no_foreign_script": "no_foreign_script", "not_referential": "not_referential", "polar_when_the_answer_is_a_verdict": "polar",
}


def _judged(spark, d):
    # each question also stands for one that withholds its first words, and for one that cites a record
    rows = table(spark, d, "items").select("item_id", "question", "answer", "evidence", "provenance")
    return gates.judged(rows).dropDuplicates(["item_id", "question", "answer"])


@query(ALL + " SELECT item_id, said, two_sided, answer_not_in_question, no_source_attribution, not_a_bare_attribute, answer_is_substantive, withholds, no_foreign_script, not_referential, coalesce(polar, false) AS polar, accepted FROM v")
def gate_all(spark, d):
    said = F.md5(F.concat(F.coalesce("question", F.lit("")), F.lit("\x1f"), F.coalesce("answer", F.lit(""))))
    return _judged(spark, d).select("item_id", said.alias("said"), *[F.element_at("gates", k).alias(v) for k, v in NAMES.items()], "accepted")


MADE = f"""SELECT doc_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS t, (CASE doc_id % 4 WHEN 0 THEN 'As described in the diplomatic cable on ' WHEN 1 THEN 'Embassy  reporting says: ' WHEN 2 THEN 'What was reported in the old archive about ' ELSE 'Who spoke of ' END) || title || '?' AS q, CASE WHEN doc_id % 3 = 0 THEN title WHEN doc_id % 3 = 1 THEN 'nobody; ' || split_part(title, ' ', 1) ELSE ' ;;' END AS w FROM documents WHERE title IS NOT NULL"""


@query(f"""WITH m AS ({MADE}), n AS (SELECT *, ' ' || {NORM('q')} || ' ' AS nq FROM m) SELECT doc_id, {WITHHELD} AS withholds, NOT regexp_matches(q, '{REFERENTIAL}') AS not_referential FROM n""")
def gates_of_made_questions(spark, d):
    # questions made of titles, so that names are withheld or given away, and records cited or not
    n, m = F.col("doc_id") % 4, F.col("doc_id") % 3
    opening = F.when(n == 0, "As described in the diplomatic cable on ").when(n == 1, "Embassy  reporting says: ").when(n == 2, "What was reported in the old archive about ").otherwise("Who spoke of ")
    withheld = F.when(m == 0, F.col("title")).when(m == 1, F.concat(F.lit("nobody; "), F.substring_index("title", " ", 1))).otherwise(" ;;")
    docs = table(spark, d, "documents").filter("title is not null").select("doc_id", F.concat(opening, "title", F.lit("?")).alias("q"), withheld.alias("w"))
    side = F.array(F.struct(F.lit("private").alias("side")))
    g = gates.gate_columns(F.col("q"), F.lit("x"), side, F.col("w"))
    return docs.select("doc_id", g["withholds_what_it_was_told_to"].alias("withholds"), g["not_referential"].alias("not_referential"))


@query(ALL + " SELECT 'accepted' AS name, count(*) FILTER (accepted) AS n FROM v UNION ALL SELECT 'rejected', count(*) FILTER (NOT accepted) FROM v")
def gated_split(spark, d):
    folder = f"{shared_folder(spark)}/gated-{uuid.uuid4().hex}"
    told = sinks.emit(_judged(spark, d), f"{folder}/accepted", f"{folder}/rejected", {"kind": "derived", "source": "items"})
    rows = [(k, spark.read.json(f"{folder}/{k}").count() if n else 0) for k, n in zip(("accepted", "rejected"), told)]
    return spark.createDataFrame(rows, "name string, n bigint")


@query("""WITH t AS (SELECT item_id, count(*) AS k, min(question_type) AS q FROM items GROUP BY item_id) SELECT count(*) FILTER (k > 1) AS kept, count(*) FILTER (k = 1 AND q = 'event') AS dropped, count(*) FILTER (k = 1 AND q <> 'event') AS undecided FROM t""")
def verdict_merge(spark, d):
    # an item delivered more than once is kept, a lone one about events dropped, the others have no verdict
    ids = table(spark, d, "items").groupBy("item_id").agg(F.count(F.lit(1)).alias("k"), F.min("question_type").alias("q"))
    verdicts = ids.select("item_id", F.when(F.col("k") > 1, "keep").when(F.col("q") == "event", "drop").alias("verdict")).filter("verdict is not null")
    return sinks.kept_by_verdict(ids.select("item_id"), verdicts)[1]


@query("""WITH t AS (SELECT item_id, count(DISTINCT answer) AS k, count(answer) AS a, count(*) AS n, min(answer) AS v FROM items GROUP BY item_id) SELECT item_id, CASE WHEN k = 1 AND a = n THEN v ELSE '' END AS agreed FROM t""")
def unanimity(spark, d):
    return reports.unanimous(table(spark, d, "items"), "item_id", "answer")


# ---- terms

TERMS = lambda rows, key, c: f"SELECT {key} AS k, word, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({c}), '[a-z][a-z''-]{{2,}}')) AS word FROM {rows}) WHERE word NOT IN {COMMON_SQL} GROUP BY 1, 2"
ECHO = "sum(ln(1 + b.n) * ln(1 + a.n) / ln(1 + length(word)))"


@query(f"""WITH a AS ({TERMS('documents', 'doc_id', 'text')}), b AS ({TERMS('documents', 'doc_id', 'title')}) SELECT a.k AS doc_id, round({ECHO}, 6) AS score FROM a JOIN b USING (k, word) GROUP BY 1""")
def term_overlap(spark, d):
    # each document's text against its own title
    docs = table(spark, d, "documents")
    told = graph.echo(graph.content_words(docs, "doc_id", "text"), graph.content_words(docs, "doc_id", "title"), docs.select(F.col("doc_id").alias("passage"), F.col("doc_id").alias("article")))
    return told.select(F.col("passage").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH f AS (SELECT source, min(doc_id) AS first FROM documents WHERE title IS NOT NULL GROUP BY 1), a AS ({TERMS('documents', 'doc_id', 'text')}), b AS ({TERMS('documents', 'doc_id', 'title')}),
g AS (SELECT a.k AS doc_id, {ECHO} AS s FROM a JOIN b ON a.k = b.k AND a.word = b.word GROUP BY 1), r AS (SELECT d.doc_id, {ECHO} AS s FROM documents d JOIN f ON f.source IS NOT DISTINCT FROM d.source JOIN a ON a.k = d.doc_id JOIN b ON b.k = f.first AND b.word = a.word WHERE f.first <> d.doc_id GROUP BY 1)
SELECT doc_id, CASE WHEN d.title IS NULL OR coalesce(g.s, 0) <= 0 THEN 'unchecked' WHEN g.s >= 1.25 * greatest(coalesce(r.s, 0), 1e-9) THEN 'verified' ELSE 'refuted' END AS verdict FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id)""".replace("length(word)", "length(a.word)"))
def margin_verdicts(spark, d):
    # does a text echo its own title more than the first title of its source?
    docs = table(spark, d, "documents")
    first = docs.filter("title is not null").groupBy("source").agg(F.min("doc_id").alias("first")).withColumnRenamed("source", "s")
    ids = docs.select("doc_id", "source", F.col("title").isNotNull().alias("has")).join(first, F.col("source").eqNullSafe(F.col("s")), "left")
    own = ids.select(F.col("doc_id").alias("passage"), F.col("doc_id").alias("article"))
    rival = ids.filter("first <> doc_id").select(F.col("doc_id").alias("passage"), F.col("first").alias("article"))
    told, named = graph.content_words(docs, "doc_id", "text"), graph.content_words(docs, "doc_id", "title")
    score = lambda pairs, name: graph.echo(told, named, pairs).select(F.col("passage").alias("doc_id"), F.col("score").alias(name))
    both = ids.join(score(own, "gold"), "doc_id", "left").join(score(rival, "rival"), "doc_id", "left")
    return both.select("doc_id", graph.margin_verdict(F.col("gold"), F.col("rival"), F.col("has")).alias("verdict"))


# ---- typed candidates

@query("""WITH c AS (SELECT DISTINCT doc_ref AS doc_id, qid, surface_form FROM mentions WHERE qid IS NOT NULL AND surface_form IS NOT NULL), r AS (SELECT c.*, d.text, e.label FROM c LEFT JOIN documents d ON d.ref = c.doc_id LEFT JOIN entities e USING (qid))
SELECT doc_id, qid, surface_form, label AS answer, CASE WHEN coalesce(text, '') = '' THEN 'no_private_text' WHEN contains(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' '), array_to_string(regexp_extract_all(lower(coalesce(label, '')), '[a-z0-9]+'), ' ')) THEN 'full_name_given' WHEN qid NOT SIMILAR TO '.*[02468]' THEN 'not_verified' END AS reason FROM r""")
def resolution_items(spark, d):
    # entities with an even last figure count as verified
    c = ad.links(spark, d).filter("qid is not null and surface_form is not null").select("doc_id", "qid", "surface_form").distinct()
    verdicts = c.select("doc_id", "qid").distinct().withColumn("verdict", F.when(F.col("qid").rlike("[02468]$"), "verified").otherwise("refuted"))
    texts = table(spark, d, "documents").select(F.col("ref").alias("id"), "text")
    return typed.from_resolution(c, texts, ad.labels(spark, d), verdicts)


@query("SELECT DISTINCT item_id, question_type, 'gold=' || coalesce(answer, '-') || ',question_type=' || question_type || ',withheld=x' AS provenance, len(evidence) AS shown FROM items")
def item_provenance(spark, d):
    rows = table(spark, d, "items").select("item_id", "question_type", F.coalesce("answer", F.lit("-")).alias("answer"), F.size("evidence").alias("n")).distinct()
    extra = F.create_map(F.lit("gold"), F.col("answer"), F.lit("question_type"), F.lit("not this"), F.lit("withheld"), F.lit("x"))
    made = typed.to_item(rows, F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i), extra)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("provenance")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return made.select("item_id", "question_type", told.alias("provenance"), F.size("evidence").alias("shown"))


SOLVED = f"CASE WHEN contains(lower({{}}), 'treaty') THEN 'Yes' ELSE 'No' END"


@query(f"""WITH i AS (SELECT item_id, min(question) AS q, min(answer) AS a FROM items GROUP BY 1), c AS (SELECT item_id, min(passage) AS p FROM candidates GROUP BY 1), j AS (SELECT i.*, coalesce(p, '') AS p, {NORM('a')} AS na FROM i LEFT JOIN c USING (item_id))
SELECT item_id, {NORM(SOLVED.format('q'))} = na AS closed_book, {NORM(SOLVED.format('q'))} = na AS public_only, {NORM(SOLVED.format("p || chr(10) || q"))} = na AS private_only FROM j""")
def necessity_measured(spark, d):
    # the model says Yes where the prompt speaks of a treaty; there is no public text
    i = table(spark, d, "items").groupBy("item_id").agg(F.min("question").alias("question"), F.min("answer").alias("answer"))
    c = table(spark, d, "candidates").groupBy("item_id").agg(F.min("passage").alias("private"))
    told = typed.ablated(i.join(c, "item_id", "left").withColumn("public", F.lit(None).cast("string")), lambda p: "Yes" if "treaty" in p.lower() else "No")
    return told.select("item_id", "necessity.closed_book", "necessity.public_only", "necessity.private_only")


PAIRED = "SELECT DISTINCT private_id, public_id, qid FROM pairs WHERE private_id IS NOT NULL AND public_id IS NOT NULL AND qid IS NOT NULL"


def _phrase(prompt: str) -> str:
    bridge = prompt.rsplit("\n", 1)[-1]
    if len(bridge) % 7 == 0:
        raise TimeoutError("no answer")
    return f'<think>hm</think> so: {{"question": " Who met {bridge}? ", "answer": "{bridge}"}}' if len(bridge) % 3 else "I can't."


DRAFTED = f"""p AS ({PAIRED}), r AS (SELECT p.*, a.text AS ta, b.text AS tb, coalesce(e.label, p.qid) AS bridge FROM p LEFT JOIN documents a ON a.ref = private_id LEFT JOIN documents b ON b.ref = public_id LEFT JOIN entities e ON e.qid = p.qid),
o AS (SELECT *, CASE WHEN coalesce(ta, '') = '' OR coalesce(tb, '') = '' THEN 'no_evidence' WHEN ta = tb THEN 'same_document' WHEN length(bridge) % 7 = 0 THEN 'phraser_error' WHEN length(bridge) % 3 <> 0 THEN 'drafted' ELSE 'unparseable_draft' END AS outcome FROM r)"""


def _drafted(spark, d):
    pairs = table(spark, d, "pairs").select("private_id", "public_id", "qid").dropna()
    texts = table(spark, d, "documents").select(F.col("ref").alias("id"), "text")
    return typed.drafted(pairs, texts, ad.labels(spark, d), "{private}\n{public}\n{bridge}", _phrase)


@query(f"WITH {DRAFTED} SELECT private_id, public_id, qid, outcome, CASE WHEN outcome = 'drafted' THEN 'Who met ' || bridge || '?' END AS question, CASE WHEN outcome = 'drafted' THEN bridge END AS answer FROM o")
def draft_outcomes(spark, d):
    return _drafted(spark, d).select("private_id", "public_id", "qid", "outcome", "question", "answer")


@query(f"WITH {DRAFTED} SELECT private_id, public_id, qid, CASE WHEN length(bridge) % 5 = 0 THEN 'judge_error' WHEN length(bridge) % 2 = 0 THEN 'verified' ELSE 'judge_rejected' END AS outcome FROM o WHERE outcome = 'drafted'")
def supported_outcomes(spark, d):
    def judge(prompt: str) -> str:
        answer = prompt.rsplit("\n", 1)[-1]
        if len(answer) % 5 == 0:
            raise ConnectionError("gone")
        return "Supported, I think" if len(answer) % 2 == 0 else "UNSUPPORTED"

    texts = table(spark, d, "documents").select(F.col("ref").alias("id"), "text")
    made = typed.supported(_drafted(spark, d).filter("outcome = 'drafted'").drop("outcome"), texts, "{private}\n{public}\n{question}\n{answer}", judge)
    return made.select("private_id", "public_id", "qid", "outcome")


SHOWN = {"date_start": "date ", "country": "country ", "side_a": "one side ", "side_b": "the other side "}
LINE = "'  - ' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} <> '' THEN '{x}' || {c} END" for c, x in SHOWN.items()) + "], lambda x: x IS NOT NULL), ', ')"


@query(f"SELECT doc_id, {LINE} AS line FROM event_records")
def event_render(spark, d):
    return table(spark, d, "event_records").select("doc_id", temporal.rendered(SHOWN).alias("line"))


@query(f"""WITH doc AS (SELECT ref AS doc_id, CAST(doc_ts AS DATE) AS day FROM documents), ent AS (SELECT DISTINCT doc_ref AS doc_id, qid FROM mentions WHERE qid IS NOT NULL),
common AS (SELECT qid FROM ent JOIN doc USING (doc_id) GROUP BY qid HAVING count(DISTINCT doc_id) > 0.15 * (SELECT count(*) FROM documents)), lines AS (SELECT doc_id AS event_id, min({LINE}) AS line FROM event_records GROUP BY 1),
ev AS (SELECT DISTINCT doc_id AS event_id, CAST(event_ts AS DATE) AS eday, unnest(qids) AS qid FROM event_records WHERE event_ts IS NOT NULL),
m AS (SELECT doc.doc_id, ent.qid, label, event_id, eday, row_number() OVER (PARTITION BY doc.doc_id, ent.qid, label ORDER BY eday, event_id) AS i FROM doc JOIN ent USING (doc_id) JOIN entities e ON e.qid = ent.qid JOIN ev ON ev.qid = ent.qid
WHERE day IS NOT NULL AND label IS NOT NULL AND abs(datediff('day', day, eday)) <= 21 AND ent.qid NOT IN (SELECT qid FROM common)),
w AS (SELECT doc_id, qid, label, count(*) AS shown, string_agg(event_id, ' ' ORDER BY i) AS ids, min_by(event_id, i) AS first, string_agg(line, chr(10) ORDER BY i) AS rendered FROM m JOIN lines USING (event_id) WHERE i <= 8 GROUP BY 1, 2, 3)
SELECT w.doc_id || '|' || qid || '|event' AS item_id, first AS public_id, ids AS public_ids, rendered AS events, md5(left(text, 6000)) AS private_evidence, CAST(shown AS VARCHAR) AS events_shown, CASE WHEN coalesce(text, '') = '' THEN 'no_evidence' END AS reason FROM w LEFT JOIN documents ON ref = w.doc_id""")
def event_items(spark, d):
    entities = ad.links(spark, d).select("doc_id", "qid").dropna()
    records = table(spark, d, "event_records")
    events = records.select(F.col("doc_id").alias("event_id"), F.col("event_ts").cast("date").alias("date"), F.explode("qids").alias("qid"))
    matches = temporal.event_windows(ad.dated_documents(spark, d), entities, events, ad.labels(spark, d).filter("label is not null"))
    shown = temporal.with_lines(matches, records.select(F.col("doc_id").alias("event_id"), temporal.rendered(SHOWN).alias("line")))
    made = typed.from_events(shown, table(spark, d, "documents").select(F.col("ref").alias("id"), "text"), 21)
    return made.select("item_id", "public_id", F.array_join("public_ids", " ").alias("public_ids"), F.col("facts")["events"].alias("events"), F.md5(F.col("facts")["private_evidence"]).alias("private_evidence"), F.col("provenance")["events_shown"].alias("events_shown"), "reason")


# ---- entities and reconciliation

@query("""SELECT qid, max(label) AS label, max(article_bytes) AS bytes, bool_or(kind = 'person') AS person FROM entities GROUP BY qid""")
def entity_maps(spark, d):
    e = table(spark, d, "entities")
    facts = e.select("qid", "label", F.col("label").alias("pos"), F.create_map(F.lit("instance_of"), F.when(F.col("kind") == "person", F.array(F.lit("Q5"))).otherwise(F.array(F.lit("Q43229")))).alias("statements"))
    sizes = typed.articles_in(e.select("qid", F.col("label").alias("text"), "article_bytes", F.coalesce("article_bytes", F.lit(-1)).alias("pos")))
    people = typed.people_in(facts).withColumn("person", F.lit(True))
    known = e.select("qid").distinct().join(typed.labels_in(facts), "qid", "left").join(sizes.select("qid", "bytes"), "qid", "left").join(people, "qid", "left")
    has = e.groupBy("qid").agg(F.max("article_bytes").alias("raw"))
    return known.join(has, "qid").select("qid", "label", F.when(F.col("raw").isNotNull(), F.col("bytes")).alias("bytes"), F.coalesce("person", F.lit(False)).alias("person"))


@query("""WITH c AS (SELECT private_id, public_id, list_concat([subject], coalesce(shared, []), [order_label]) AS all_ FROM chronologies), t AS (SELECT private_id, public_id, list_filter(list_transform(list_filter(all_, lambda x: x IS NOT NULL), lambda x: regexp_replace(x, '^[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+|[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+$', '', 'g')), lambda x: x <> '' AND len(regexp_split_to_array(x, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+')) >= 2) AS names FROM c)
SELECT private_id, public_id, array_to_string(names, '|') AS names FROM t""")
def names_given(spark, d):
    named = links.names_in({"subject": False, "shared": True, "order_label": False}, 2)
    return table(spark, d, "chronologies").select("private_id", "public_id", F.array_join(named, "|").alias("names"))


BAG = lambda c: f"list_sort(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')))"


@query(f"""WITH a AS (SELECT DISTINCT doc_ref || '|' || coalesce(a_surface, '') || '|' || coalesce(b_surface, '') AS id, list_filter([a_surface, b_surface], lambda x: x IS NOT NULL) AS v FROM associations),
s AS (SELECT id, unnest(v) AS variant, generate_subscripts(v, 1) AS pos FROM a), k AS (SELECT DISTINCT id, variant, min(pos) OVER (PARTITION BY id, variant) AS pos, {BAG('variant')} AS bag FROM s WHERE len(regexp_extract_all(lower(variant), '[a-z0-9]+')) >= 2),
e AS (SELECT qid, {BAG('label')} AS bag, regexp_extract_all(lower(label), '[a-z0-9]+')[-1] AS family, label FROM entities WHERE kind = 'person' AND label IS NOT NULL),
m AS (SELECT k.id, k.pos, e.qid FROM k JOIN e ON list_contains(regexp_extract_all(lower(k.variant), '[a-z0-9]+'), e.family) WHERE EXISTS (SELECT 1 FROM k AS o WHERE o.id = k.id AND o.bag = e.bag)),
r AS (SELECT id, qid, row_number() OVER (PARTITION BY id ORDER BY pos, qid) AS i FROM m) SELECT id, qid FROM r WHERE i = 1""")
def search_resolved(spark, d):
    # a search finds the entities whose last word a variant holds
    a = table(spark, d, "associations").select(F.concat_ws("|", "doc_ref", F.coalesce("a_surface", F.lit("")), F.coalesce("b_surface", F.lit(""))).alias("id"), F.array_compact(F.array("a_surface", "b_surface")).alias("variants"), F.lit("individual").alias("kind"), F.array().cast("array<string>").alias("years")).distinct()
    e = table(spark, d, "entities").filter("label is not null")
    words = a.select(F.explode("variants").alias("variant")).distinct().withColumn("word", F.explode(F.array_distinct(text.tokens(F.col("variant")))))
    hits = words.join(e.select("qid", "label", F.element_at(text.tokens(F.col("label")), -1).alias("word")), "word").select("variant", F.col("qid").alias("rank"), "qid", "label")
    facts = e.select("qid", "label", F.array("kind").alias("classes"), F.array().cast("array<string>").alias("births"))
    return links.search_resolved(a, hits, facts, {"individual": ["person"], "entity": ["organisation"]})


@query("""WITH c AS (SELECT DISTINCT private_id, public_id, qid FROM pairs WHERE private_id IS NOT NULL AND public_id IS NOT NULL AND qid IS NOT NULL), k AS (SELECT qid FROM entities WHERE kind = 'person') SELECT qid, count(*) AS n FROM c WHERE qid IN (SELECT qid FROM k) GROUP BY qid""")
def typed_bridges(spark, d):
    people = table(spark, d, "entities").filter("kind = 'person'")
    return links.restricted(table(spark, d, "pairs").select("private_id", "public_id", "qid").dropna().distinct(), people, "qid").groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT qid, label FROM entities WHERE qid IN (SELECT qid FROM mentions WHERE side = 'public')")
def restrict_to(spark, d):
    return links.restricted(ad.labels(spark, d), ad.links(spark, d).filter("side = 'public'"), "qid").distinct()


@query("SELECT DISTINCT p_type AS class FROM part WHERE p_type IS NOT NULL")
def classes_present(spark, d):
    return links.classes_present(table(spark, d, "part").select(F.array("p_type").alias("classes")), "classes")


@query("""WITH s AS (SELECT doc_ref, qid, mention_id, confidence, row_number() OVER (PARTITION BY doc_ref ORDER BY mention_id, qid) AS i FROM (SELECT DISTINCT doc_ref, qid, mention_id, confidence FROM mentions WHERE entity_type = 'PERSON' AND qid IS NOT NULL)) SELECT doc_ref AS doc_id, qid, mention_id FROM s WHERE i <= 6""")
def first_people(spark, d):
    m = ad.links(spark, d).filter("entity_type = 'PERSON' and qid is not null").select("doc_id", "qid", "pos", "confidence").distinct()
    return graph.first_people(m).select("doc_id", "qid", F.col("pos").alias("mention_id"))


@query("""WITH c AS (SELECT DISTINCT item_id, private_id, public_id FROM candidates) SELECT item_id, private_id, public_id, length(d.text) AS private_chars, length(e.text) AS public_chars FROM c LEFT JOIN documents d ON d.ref = private_id LEFT JOIN documents e ON e.ref = public_id""")
def evidence_lookup(spark, d):
    docs = table(spark, d, "documents").select(F.col("ref").alias("id"), "text")
    rows = typed.with_texts(typed.with_texts(table(spark, d, "candidates").select("item_id", "private_id", "public_id").distinct(), docs, "private_id", "a"), docs, "public_id", "b")
    return rows.select("item_id", "private_id", "public_id", F.length("a").alias("private_chars"), F.length("b").alias("public_chars"))
