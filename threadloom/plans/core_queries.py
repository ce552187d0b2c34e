"""Registered queries of the core, and their SQL. Each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import dates, text
from threadloom.operators import gates, graph, keychunks, links, reports, temporal
from threadloom.plans import adapters as ad
from threadloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


KEYED = """WITH k AS (SELECT 'qid' AS key_field, qid AS key_text, public_id, days_apart FROM pairs WHERE qid IS NOT NULL
UNION ALL SELECT 'private_id', private_id, public_id, days_apart FROM pairs WHERE private_id IS NOT NULL)"""


@query(KEYED + " SELECT key_field, key_text FROM k GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(*) FROM pairs)")
def p1_found(spark, d):
    return keychunks.heavy_keys(table(spark, d, "pairs"))


@query(KEYED + " SELECT key_field, key_text, count(*) AS pairs, count(DISTINCT public_id) AS partners, min(days_apart) AS least_days, max(days_apart) AS greatest_days FROM k GROUP BY 1, 2")
def p1_profile(spark, d):
    return keychunks.key_profiles(table(spark, d, "pairs")).drop("chunks", "straddling")


# ---- mentions, links, bridges

BRIDGES = """WITH l AS (SELECT DISTINCT qid, side, doc_ref FROM mentions WHERE qid IS NOT NULL),
b AS (SELECT qid, coalesce(list(doc_ref ORDER BY doc_ref) FILTER (side = 'private'), []) AS private, coalesce(list(doc_ref ORDER BY doc_ref) FILTER (side = 'public'), []) AS public FROM l GROUP BY qid),
g AS (SELECT *, len(private) AS private_count, len(public) AS public_count FROM b WHERE len(private) > 0 AND len(public) > 0 AND len(private) <= 200)"""


@query(BRIDGES + " SELECT qid, array_to_string(private, ' ') AS private, array_to_string(public, ' ') AS public, private_count, public_count FROM g")
def bridge_build(spark, d):
    made = links.build_bridges(ad.links(spark, d), max_private=200)
    return made.withColumn("private", F.array_join("private", " ")).withColumn("public", F.array_join("public", " "))


@query("SELECT qid, surface_form, count(*) AS times FROM mentions WHERE qid IS NOT NULL AND coalesce(surface_form, '') <> '' GROUP BY 1, 2")
def surface_forms(spark, d):
    return links.surface_counts(ad.links(spark, d))


@query(BRIDGES + """, p AS (SELECT qid, unnest(private) AS private_id, public FROM g), q AS (SELECT qid, private_id, unnest(public) AS public_id FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY private_id, public_id) AS i FROM q), t AS (SELECT ref, CAST(doc_ts AS DATE) AS day FROM documents)
SELECT qid, private_id, public_id, datediff('day', a.day, b.day) AS days_apart, coalesce(abs(datediff('day', a.day, b.day)) <= 90, false) AS same_period
FROM r LEFT JOIN t a ON a.ref = private_id LEFT JOIN t b ON b.ref = public_id WHERE i <= 50""")
def pair_capped(spark, d):
    return links.pair_documents(links.bridge_sides(ad.links(spark, d)), ad.dated_documents(spark, d))


KEPT = "SELECT * FROM mentions WHERE confidence >= 0.5 AND NOT isnan(confidence) AND coalesce(entity_type, '') NOT IN ('DATE', 'TIME', 'CARDINAL', 'ORDINAL', 'QUANTITY', 'PERCENT', 'MONEY') AND qid IN (SELECT qid FROM entities)"


@query(f"WITH k AS ({KEPT}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_ref, qid ORDER BY confidence DESC, mention_id, surface_form) AS i FROM k) SELECT doc_ref AS doc_id, qid, surface_form, confidence FROM r WHERE i = 1")
def mention_filter(spark, d):
    kept = links.keep_mentions(ad.links(spark, d), 0.5, table(spark, d, "entities"))
    return links.best_mentions(kept, ["doc_id", "qid"], ["pos", "surface_form"]).select("doc_id", "qid", "surface_form", "confidence")


@query("""WITH m AS (SELECT *, CASE WHEN entity_type = 'ORG' THEN 1 ELSE 0 END AS s FROM mentions WHERE qid IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_ref, qid ORDER BY confidence DESC, s, mention_id, surface_form) AS i FROM m) SELECT doc_ref AS doc_id, qid, surface_form, confidence FROM r WHERE i = 1""")
def merge_links(spark, d):
    every = ad.links(spark, d).filter(F.col("qid").isNotNull() & F.col("confidence").isNotNull() & ~F.isnan("confidence"))
    org = F.coalesce(F.col("entity_type") == "ORG", F.lit(False))
    return links.merge_links(every.filter(~org), every.filter(org), ["doc_id", "qid"], ["pos", "surface_form"]).select("doc_id", "qid", "surface_form", "confidence")


@query("""WITH c AS (SELECT label AS name, qid FROM entities WHERE label IS NOT NULL), u AS (SELECT DISTINCT qid FROM event_records, unnest(qids) t(qid)), k AS (SELECT * FROM c WHERE qid IN (SELECT qid FROM u)),
s AS (SELECT name, min(qid) AS qid FROM k GROUP BY name HAVING count(DISTINCT qid) = 1),
m AS (SELECT doc_ref AS doc_id, s.qid, name, row_number() OVER (PARTITION BY doc_ref, s.qid ORDER BY mention_id, name) AS i FROM mentions JOIN s ON surface_form = name) SELECT doc_id, qid, name FROM m WHERE i = 1""")
def unique_candidate(spark, d):
    names = ad.links(spark, d).select("doc_id", F.col("surface_form").alias("name"), "pos")
    universe = table(spark, d, "event_records").select(F.explode("qids").alias("qid"))
    return links.unique_candidates(names, ad.labels(spark, d).dropna().select(F.col("label").alias("name"), "qid"), universe)


@query("""WITH k AS (SELECT label AS name, qid, 0 AS r FROM entities WHERE label IS NOT NULL UNION ALL SELECT lower(label), qid, 1 FROM entities WHERE label IS NOT NULL),
n AS (SELECT DISTINCT surface_form AS name FROM mentions), m AS (SELECT n.name, qid, r, min(r) OVER (PARTITION BY n.name) AS b FROM n JOIN k ON n.name = k.name) SELECT DISTINCT name, qid FROM m WHERE r = b""")
def label_reconcile(spark, d):
    known = ad.labels(spark, d).dropna()
    aliases = known.select(F.lower("label").alias("name"), "qid", F.lit("alias").alias("predicate"))
    return links.labels_over_aliases(ad.links(spark, d).select(F.col("surface_form").alias("name")), known.select(F.col("label").alias("name"), "qid", F.lit("label").alias("predicate")).union(aliases))


@query("""WITH k AS (SELECT regexp_extract(ref, '^[^:]*:(.*)$', 1) AS code, ref AS qid, doc_id AS pos FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY pos DESC) AS i FROM k),
c AS (SELECT DISTINCT regexp_extract(doc_ref, '^[^:]*:(.*)$', 1) AS code FROM mentions) SELECT c.code, qid FROM c JOIN r ON r.code = c.code AND i = 1""")
def code_reconcile(spark, d):
    known = table(spark, d, "documents").select(text.ref_id(F.col("ref")).alias("code"), F.col("ref").alias("qid"), F.col("doc_id").alias("pos"))
    return links.by_code(ad.links(spark, d).select(text.ref_id(F.col("doc_id")).alias("code")), known)


@query("SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT doc_ref) AS linked, count(*) AS mentions, count(DISTINCT qid) AS entities FROM mentions WHERE qid IS NOT NULL")
def linking_report(spark, d):
    return links.linking_report(table(spark, d, "documents"), ad.links(spark, d))


@query("SELECT qid, count(DISTINCT doc_ref) AS documents FROM mentions WHERE qid IS NOT NULL GROUP BY qid HAVING count(DISTINCT doc_ref) > 0.01 * (SELECT count(DISTINCT doc_ref) FROM mentions)")
def anchor_share(spark, d):
    made = ad.links(spark, d)
    return links.document_share(made, 0.01, made.select("doc_id").distinct().count())


CLASSIFIED = """WITH c AS (SELECT p_partkey, p_type, CASE WHEN p_size > 45 THEN ['Q1'] ELSE [] END AS parents FROM part)
SELECT p_partkey, CASE WHEN len(parents) > 0 THEN 'blocked' WHEN p_type LIKE 'ECONOMY%' OR p_type LIKE '%TIN' THEN 'blocked' WHEN p_type LIKE 'LARGE%' THEN 'bridgeable' WHEN p_type LIKE 'SMALL%' THEN 'bridgeable' ELSE 'blocked' END AS verdict FROM c"""


def _classified(spark, d):
    # part types stand for classes: economy ones and tin for blocked and places, large for the human class, small for organisations
    kind = F.when(F.col("p_type").like("ECONOMY%"), "Q6256").when(F.col("p_type").like("%TIN"), "Q515").when(F.col("p_type").like("LARGE%"), "Q5").when(F.col("p_type").like("SMALL%"), "Q43229").otherwise("Q9")
    parents = F.when(F.col("p_size") > 45, F.array(F.lit("Q1"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", links.classify(F.array(kind), parents, ["Q6256"], ["Q515"], ["Q43229"], "Q5").alias("verdict"))


@query(CLASSIFIED)
def classify(spark, d):
    return _classified(spark, d)


@query(f"WITH k AS ({CLASSIFIED}), v AS (SELECT unnest(['blocked', 'bridgeable', 'unknown']) AS verdict) SELECT v.verdict, count(k.p_partkey) AS n FROM v LEFT JOIN k USING (verdict) GROUP BY 1")
def classify_summary(spark, d):
    return links.verdict_counts(_classified(spark, d))


# ---- time and topic

@query("""WITH doc AS (SELECT ref AS doc_id, CAST(doc_ts AS DATE) AS day FROM documents), ent AS (SELECT DISTINCT doc_ref AS doc_id, qid FROM mentions WHERE qid IS NOT NULL),
common AS (SELECT qid FROM ent JOIN doc USING (doc_id) GROUP BY qid HAVING count(DISTINCT doc_id) > 0.15 * (SELECT count(*) FROM documents)),
ev AS (SELECT DISTINCT doc_id AS event_id, CAST(event_ts AS DATE) AS eday, unnest(qids) AS qid FROM event_records WHERE event_ts IS NOT NULL),
m AS (SELECT doc.doc_id, ent.qid, label, event_id, eday, row_number() OVER (PARTITION BY doc.doc_id, ent.qid, label ORDER BY eday, event_id) AS i FROM doc JOIN ent USING (doc_id) JOIN entities e ON e.qid = ent.qid JOIN ev ON ev.qid = ent.qid
WHERE day IS NOT NULL AND abs(datediff('day', day, eday)) <= 21 AND ent.qid NOT IN (SELECT qid FROM common))
SELECT doc_id AS private_id, qid AS anchor_qid, label AS anchor_label, string_agg(event_id, ' ' ORDER BY i) AS public_ids FROM m WHERE i <= 8 GROUP BY 1, 2, 3""")
def event_window(spark, d):
    entities = ad.links(spark, d).select("doc_id", "qid").dropna()
    events = table(spark, d, "event_records").select(F.col("doc_id").alias("event_id"), F.col("event_ts").cast("date").alias("date"), F.explode("qids").alias("qid"))
    return temporal.event_windows(ad.dated_documents(spark, d), entities, events, ad.labels(spark, d)).withColumn("public_ids", F.array_join("public_ids", " "))


CROSS_SQL = "(VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in temporal.CROSSWALK.items() for c in cs) + ") AS x(tag, cat)"
TAGGED = "string_split(regexp_extract(text, 'TAGS:[ \\t]*([A-Z0-9_,\\t -]{3,200})', 1), ',')"


def _sides(spark, d):
    """Tagged cables, and other documents with half of the topics by their number: the tables hold no categories of their own."""
    docs = table(spark, d, "documents")
    named = ad.links(spark, d).dropna(subset=["qid"]).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "qid"))), lambda x: x.qid).alias("qids"))
    base = docs.select(F.col("ref").alias("doc_id"), F.col("doc_ts").cast("date").alias("date"), "source", "text", "title", F.col("doc_id").alias("n"))
    # topics are told before the documents meet their entities: no text is shuffled
    cables = base.filter("source = 'cablegate'").select("doc_id", "date", temporal.topics_of(text.tags_in(F.coalesce("text", F.lit("")))).alias("topics"))
    cats = sorted({c for x in temporal.CROSSWALK.values() for c in x})
    half = len(cats) // 2
    halves = F.slice(F.array(*map(F.lit, cats)), F.when(F.col("n") % 2 == 0, 1).otherwise(half + 1), F.lit(half))
    items = base.filter("source <> 'cablegate'").select("doc_id", "date", halves.alias("topics"), text.normalise(F.coalesce("title", F.lit(""))).alias("title"))
    return [x.join(named, "doc_id").withColumn("qids", F.array_distinct("qids")) for x in (cables, items)]


HALF = len({c for x in temporal.CROSSWALK.values() for c in x}) // 2
CATS_SQL = "[" + ", ".join(f"'{c}'" for c in sorted({c for x in temporal.CROSSWALK.values() for c in x})) + "]"


@query(f"""WITH ent AS (SELECT doc_ref, qid, min(mention_id) AS pos FROM mentions WHERE qid IS NOT NULL GROUP BY 1, 2),
cable AS (SELECT ref, CAST(doc_ts AS DATE) AS day, list_distinct(list_transform({TAGGED}, lambda x: trim(x))) AS tags FROM documents WHERE source = 'cablegate' AND ref IN (SELECT doc_ref FROM ent)),
topic AS (SELECT DISTINCT ref, cat FROM (SELECT ref, unnest(tags) AS tag FROM cable) t JOIN {CROSS_SQL} ON x.tag = t.tag),
common AS (SELECT qid FROM ent JOIN cable ON doc_ref = ref GROUP BY qid HAVING count(*) > 0.15 * (SELECT count(*) FROM cable)),
item AS (SELECT ref, CAST(doc_ts AS DATE) AS day, unnest(CASE WHEN doc_id % 2 = 0 THEN {CATS_SQL}[1:{HALF}] ELSE {CATS_SQL}[{HALF} + 1:{2 * HALF}] END) AS cat, array_to_string(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), ' ') AS title FROM documents WHERE source <> 'cablegate'),
lab AS (SELECT qid, label, array_to_string(regexp_extract_all(lower(label), '[a-z0-9]+'), ' ') AS norm, kind = 'organisation' AS place FROM entities WHERE length(label) > 3),
m AS (SELECT DISTINCT c.ref AS private_id, i.ref AS public_id, abs(datediff('day', c.day, i.day)) AS days_apart, e.qid, e.pos, lab.place, norm <> '' AND contains(' ' || i.title || ' ', ' ' || norm || ' ') AS titled
FROM cable c JOIN ent e ON e.doc_ref = c.ref JOIN lab ON lab.qid = e.qid JOIN ent f ON f.qid = e.qid JOIN item i ON i.ref = f.doc_ref JOIN topic t ON t.ref = c.ref AND t.cat = i.cat
WHERE abs(datediff('day', c.day, i.day)) <= 2000 AND e.qid NOT IN (SELECT qid FROM common)),
r AS (SELECT *, row_number() OVER (PARTITION BY private_id, public_id ORDER BY pos, qid) AS k, count(*) FILTER (titled AND NOT place) OVER (PARTITION BY private_id, public_id) AS good FROM m)
SELECT private_id, public_id, max(days_apart) AS days_apart, string_agg(qid, ' ' ORDER BY k) FILTER (k <= 4) AS shared, bool_or(k <= 4 AND NOT place) AND (max(good) > 0 OR count(*) > 1) AS focused FROM r GROUP BY 1, 2""")
def topical_join(spark, d):
    known = table(spark, d, "entities").select("qid", "label", text.normalise(F.col("label")).alias("norm"), (F.col("kind") == "organisation").alias("place"))
    found = temporal.topical_pairs(*_sides(spark, d), known, window=2000)
    return found.select("private_id", "public_id", "days_apart", F.array_join("shared", " ").alias("shared"), "focused")


LENIENT = lambda c: f"coalesce(CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}($|[T ])') THEN try_cast({c}[1:10] AS DATE) END, CASE WHEN regexp_matches({c}, '^\\d{{8}}($|T)') THEN CAST(try_strptime({c}[1:8], '%Y%m%d') AS DATE) END)"
STRICT = lambda c: f"CASE WHEN regexp_matches({c}[1:10], '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN CAST(try_strptime({c}[1:10], '%Y-%m-%d') AS DATE) END"


@query(f"""WITH t AS (SELECT private_date, public_date, {LENIENT('private_date')} AS a, {LENIENT('public_date')} AS b, {STRICT('private_date')} AS s FROM pairs)
SELECT private_date, public_date, CAST(s AS VARCHAR) AS strict_private, datediff('day', a, b) AS days, count(*) AS n FROM t GROUP BY 1, 2, 3, 4""")
def date_intervals(spark, d):
    c = table(spark, d, "pairs").select("private_date", "public_date", dates.strict_date(F.col("private_date")).cast("string").alias("strict_private"), dates.days_between(dates.lenient_date(F.col("private_date")), dates.lenient_date(F.col("public_date"))).alias("days"))
    return c.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT DISTINCT private_id, public_id, {STRICT('private_date')} AS a, {STRICT('public_date')} AS b FROM pairs)
SELECT private_id, public_id, abs(datediff('day', a, b)) AS days, CASE WHEN a < b THEN 'private_first' ELSE 'public_first' END AS "order" FROM t WHERE abs(datediff('day', a, b)) BETWEEN 1 AND 365""")
def chronology(spark, d):
    p = table(spark, d, "pairs").select("private_id", "public_id", *[dates.strict_date(F.col(c)).alias(c) for c in ("private_date", "public_date")]).distinct()
    return temporal.chronologies(p).select("private_id", "public_id", "days", "order")


@query("SELECT doc_id, coalesce(nullif(date_start, ''), strftime(event_ts, '%Y-%m-%d')) AS day FROM event_records")
def date_first_nonempty(spark, d):
    return table(spark, d, "event_records").select("doc_id", text.first_filled(F.col("date_start"), F.date_format("event_ts", "yyyy-MM-dd")).alias("day"))


@query("SELECT ref, coalesce(contains(lower(origin), 'mission') OR contains(lower(origin), 'embassy'), false) AS in_scope FROM documents")
def origin_scope(spark, d):
    return table(spark, d, "documents").select("ref", temporal.reports_on(F.col("origin"), ("mission", "embassy")).alias("in_scope"))


@query("""WITH e AS (SELECT ref, doc_ts FROM documents WHERE doc_ts IS NOT NULL) SELECT DISTINCT doc_ref AS doc_id, strftime(doc_ts, '%Y-%m-%d') AS day FROM mentions JOIN e ON ref = doc_ref WHERE qid IS NOT NULL""")
def dated_linked(spark, d):
    dated = ad.dated_documents(spark, d).filter(F.col("date").isNotNull())
    return dated.join(ad.links(spark, d).filter(F.col("qid").isNotNull()), "doc_id", "left_semi").select("doc_id", F.col("date").cast("string").alias("day")).distinct()


# ---- graph

@query("""WITH e AS (SELECT DISTINCT * FROM (SELECT a_qid AS qid, predicate, shared_qid AS nb FROM associations UNION ALL SELECT b_qid, predicate, shared_qid FROM associations) WHERE qid IS NOT NULL AND predicate IS NOT NULL AND nb IS NOT NULL),
deg AS (SELECT nb, count(*) AS degree FROM e GROUP BY nb), l AS (SELECT doc_ref, qid, min(mention_id) AS pos FROM mentions WHERE qid IN (SELECT qid FROM e) AND confidence >= 0.05 AND NOT isnan(confidence) GROUP BY 1, 2),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_ref ORDER BY pos, qid) AS i FROM l) WHERE i <= 6),
p AS (SELECT a.doc_ref AS doc_id, a.qid AS a_qid, b.qid AS b_qid FROM n a JOIN n b ON a.doc_ref = b.doc_ref AND a.i < b.i),
t AS (SELECT qid, nb, min(predicate) AS predicate FROM e GROUP BY 1, 2),
c AS (SELECT p.*, x.nb AS shared_qid, x.predicate, degree, row_number() OVER (PARTITION BY doc_id, a_qid, b_qid ORDER BY degree, x.nb) AS k FROM p JOIN t x ON x.qid = a_qid JOIN t y ON y.qid = b_qid AND y.nb = x.nb JOIN deg ON deg.nb = x.nb
WHERE degree <= 40 AND x.nb NOT IN (a_qid, b_qid) AND NOT EXISTS (SELECT 1 FROM e WHERE (e.qid = a_qid AND e.nb = b_qid) OR (e.qid = b_qid AND e.nb = a_qid)))
SELECT doc_id, a_qid, b_qid, shared_qid, predicate, degree FROM c WHERE k = 1""")
def association(spark, d):
    edges = ad.edges(spark, d)
    return graph.associations(ad.links(spark, d).dropna(subset=["qid"]), edges, edges.select("qid"), floor=0.05, max_degree=40)


NORM = lambda c: f"array_to_string(regexp_extract_all(lower({c}), '[a-z0-9]+'), ' ')"
INDEX = f"f AS (SELECT DISTINCT qid, unnest(list_distinct(string_split({NORM('label')}, ' ')[2:])) AS name FROM entities), fam AS (SELECT * FROM f WHERE length(name) >= 4)"


@query(f"WITH {INDEX} SELECT qid, name FROM fam")
def family_index(spark, d):
    return graph.family_names(table(spark, d, "entities").select("qid", text.normalise(F.col("label")).alias("norm")))


@query(f"""WITH {INDEX}, r AS (SELECT name, fam.qid, coalesce(article_bytes, 0) AS bytes, row_number() OVER (PARTITION BY name ORDER BY coalesce(article_bytes, 0) DESC, fam.qid) - 1 AS rank, count(*) OVER (PARTITION BY name) AS bearers FROM fam LEFT JOIN entities USING (qid)),
lab AS (SELECT qid, {NORM('label')} AS norm FROM entities WHERE kind = 'person'), m AS (SELECT DISTINCT mention_id, string_split(lab.norm, ' ')[-1] AS name, lab.qid FROM mentions JOIN lab USING (qid) WHERE confidence >= 0.9 AND NOT isnan(confidence))
SELECT mention_id, m.name, m.qid, rank, bearers FROM m JOIN r ON r.name = m.name AND r.qid = m.qid WHERE bearers >= 2 AND rank > 0 AND bytes BETWEEN 1 AND 9000 AND length(m.name) >= 4""")
def resolution_rank(spark, d):
    # the linked entity's family name stands for the bare surname of a mention
    known = table(spark, d, "entities").select("qid", "kind", text.normalise(F.col("label")).alias("norm"), F.col("article_bytes").alias("bytes"))
    people = known.filter("kind = 'person'")
    bare = table(spark, d, "mentions").join(people.select("qid", "norm"), "qid").select("mention_id", F.substring_index("norm", " ", -1).alias("norm"), "qid", "confidence").dropDuplicates(["mention_id", "norm", "qid"])
    return graph.name_candidates(bare, known.select("qid", "norm"), people.select("qid"), known.select("qid", "bytes"))


WORDS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]{2,}')) AS word FROM documents"
COMMON_SQL = "(" + ", ".join(f"'{w}'" for w in graph.COMMON) + ")"


@query(f"WITH w AS ({WORDS}) SELECT word, count(*) AS n, count(DISTINCT doc_id) AS documents FROM w WHERE word NOT IN {COMMON_SQL} GROUP BY word")
def term_counts(spark, d):
    return graph.content_words(table(spark, d, "documents"), "doc_id", "text").groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


# ---- gates and reports

HAS = lambda phrases: " OR ".join(f"contains(lower(q), '{p}')" for p in phrases)
GATES = f"""WITH i AS (SELECT DISTINCT item_id, coalesce(question, '') AS q, coalesce(answer, '') AS a, evidence, provenance['withheld'] AS w FROM items),
n AS (SELECT *, ' ' || {NORM('q')} || ' ' AS nq, {NORM('a')} AS na FROM i), g AS (SELECT item_id,
coalesce(list_contains(list_transform(evidence, lambda e: e.side), 'private') AND list_contains(list_transform(evidence, lambda e: e.side), 'public'), false) AS two_sided,
na <> '' AND NOT contains(nq, ' ' || na || ' ') AS answer_not_in_question, NOT ({HAS(gates.ATTRIBUTION)}) AS no_source_attribution, (coalesce(w, '') <> '' OR NOT ({HAS(gates.ATTRIBUTES)})) AS not_a_bare_attribute,
length(regexp_replace(a, '^[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{85}}\\x{{2028}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{85}}\\x{{2028}}\\x{{3000}}]+$', '', 'g')) >= 2 AS answer_is_substantive, NOT regexp_matches(q, '{gates.FOREIGN}') AS no_foreign_script,
(a NOT IN ('Yes', 'No', 'Mixed', 'Not enough evidence') OR string_split(trim(nq), ' ')[1] IN {gates.POLAR}) AS polar FROM n)"""


@query(GATES + " SELECT * FROM g")
def gate_suite(spark, d):
    made = gates.judged(table(spark, d, "items").select("item_id", "question", "answer", "evidence", "provenance"))
    names = {"two_sided": "two_sided", "answer_not_in_question": "answer_not_in_question", "no_source_attribution": "no_source_attribution", "not_a_bare_attribute": "not_a_bare_attribute", "answer_is_substantive": "answer_is_substantive", "no_foreign_script": "no_foreign_script", "polar": "polar_when_the_answer_is_a_verdict"}
    return made.dropDuplicates(["item_id", "question", "answer"]).select("item_id", *[F.element_at("gates", v).alias(k) for k, v in names.items()])


@query(GATES + """ SELECT 'answered_two_sided' AS name, count(*) FILTER (two_sided AND answer_is_substantive) AS passed, count(*) AS n FROM g""")
def gate_split(spark, d):
    made = gates.judged(table(spark, d, "items").select("item_id", "question", "answer", "evidence", "provenance")).dropDuplicates(["item_id", "question", "answer"])
    good = F.element_at("gates", "two_sided") & F.element_at("gates", "answer_is_substantive")
    return made.agg(F.count_if(good).alias("passed"), F.count(F.lit(1)).alias("n")).select(F.lit("answered_two_sided").alias("name"), "passed", "n")


@query("""WITH o AS (SELECT array_to_string(regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]+')[1:5], ' ') AS opening FROM items)
SELECT opening, count(*) AS n, count(*) / (SELECT count(*) FROM items) AS share FROM o GROUP BY 1""")
def opening_share(spark, d):
    return reports.opening_share(table(spark, d, "items"))


@query("""WITH o AS (SELECT array_to_string(regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]+')[1:5], ' ') AS opening FROM items)
SELECT 'opening' AS kind, opening AS what FROM o GROUP BY opening HAVING count(*) / (SELECT count(*) FROM items) >= 0.05
UNION ALL SELECT 'one_type', min(question_type) FROM items HAVING count(*) >= 20 AND count(DISTINCT question_type) = 1""")
def run_alarms(spark, d):
    return reports.run_alarms(table(spark, d, "items"), share=0.05)


MEASURED = "necessity.closed_book IS NOT NULL AND necessity.public_only IS NOT NULL AND necessity.private_only IS NOT NULL"
BOTH = "coalesce(NOT (necessity.closed_book OR necessity.public_only OR necessity.private_only), false)"


@query(f"""SELECT 'total' AS section, 'questions' AS name, count(*) AS n FROM items UNION ALL SELECT 'necessity', 'measured', count(*) FILTER ({MEASURED}) FROM items
UNION ALL SELECT 'necessity', 'needs_both', count(*) FILTER ({BOTH}) FROM items UNION ALL SELECT 'necessity', 'answerable_closed_book', count(*) FILTER ({MEASURED} AND necessity.closed_book) FROM items
UNION ALL SELECT 'necessity', 'answerable_public_only', count(*) FILTER ({MEASURED} AND necessity.public_only) FROM items UNION ALL SELECT 'necessity', 'answerable_private_only', count(*) FILTER ({MEASURED} AND necessity.private_only) FROM items
UNION ALL SELECT 'types', question_type, count(*) FROM items GROUP BY question_type
UNION ALL SELECT 'gates', e.key, count(*) FILTER (e.value) FROM (SELECT unnest(map_entries(gates)) AS e FROM items) GROUP BY e.key""")
def datasheet(spark, d):
    return reports.datasheet(table(spark, d, "items"))


@query(f"""WITH k AS (SELECT item_id, any_value({BOTH}) AS both_ FROM items WHERE {MEASURED} GROUP BY item_id), r AS (SELECT *, row_number() OVER (PARTITION BY both_ ORDER BY item_id) AS i FROM k),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN i > 6 THEN 1 ELSE 0 END, item_id) AS k FROM r WHERE i <= 12) SELECT item_id, both_ AS needs_both FROM o WHERE k <= 12""")
def calibration_sample(spark, d):
    return reports.calibration_sample(table(spark, d, "items").dropDuplicates(["item_id"])).select("item_id", F.col("both").alias("needs_both"))


@query("""WITH u AS (SELECT DISTINCT item_id, question_type FROM items), r AS (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY sha256('0:' || item_id), item_id) AS i FROM u) SELECT item_id, question_type, i FROM r WHERE i <= 20""")
def per_type_sample(spark, d):
    return reports.per_type_sample(table(spark, d, "items").select("item_id", "question_type").distinct(), 20, 0)


@query("SELECT DISTINCT item_id, CAST(('0x' || sha256(item_id)[1:2])::INT % 5 AS INT) AS asker FROM items")
def hash_asker(spark, d):
    return table(spark, d, "items").select("item_id", reports.hash_asker(F.col("item_id")).alias("asker")).distinct()


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE contains(lower(origin), 'embassy')) SELECT doc_id FROM r WHERE (i - 1) % 11 = 0 AND (i - 1) / 11 < 500""")
def stride_select(spark, d):
    return reports.strided(table(spark, d, "documents").select("doc_id", "origin"), "doc_id", 11, 500, F.contains(F.lower("origin"), F.lit("embassy"))).select("doc_id")


@query("""WITH h AS (SELECT sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), coalesce(ref, chr(0)), coalesce(text, chr(0)))) AS x FROM documents)
SELECT count(*) AS rows, sha256(concat_ws('-', CAST(count(*) AS VARCHAR), CAST(sum(CAST('0x' || x[1:15] AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x' || x[16:30] AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x' || x[31:45] AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x' || x[46:60] AS HUGEINT)) AS VARCHAR))) AS digest FROM h""")
def fingerprint(spark, d):
    return reports.table_fingerprint(table(spark, d, "documents"), ["doc_id", "ref", "text"])


@query("""SELECT source, CASE WHEN source = '*' THEN 'unknown kind' ELSE '' END || CASE WHEN max_chars > 3000 THEN 'unexplained fields' ELSE '' END AS problems FROM link_settings""")
def provenance_check(spark, d):
    s = table(spark, d, "link_settings")
    fields = F.when(F.col("max_chars") > 3000, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    kind = F.when(F.col("source") == "*", "other").otherwise("corpus")
    found = reports.provenance_problems(kind, fields, F.create_map(F.lit("a"), F.lit("x")), F.create_map(F.lit("b"), F.lit("no use")), F.lit(5), F.lit(4))
    return s.select("source", F.array_join(found, "").alias("problems"))


# ---- text

@query(f"SELECT doc_id, array_to_string(list_distinct(list_transform({TAGGED}, lambda x: trim(x))), ' ') IS NOT NULL AS tagged, trim(regexp_extract(text, 'SUBJECT:\\s*(.{{0,120}})', 1)) AS subject FROM documents WHERE text IS NOT NULL AND source = 'cablegate'")
def subject_lines(spark, d):
    docs = table(spark, d, "documents").filter("text is not null and source = 'cablegate'")
    return docs.select("doc_id", text.tags_in(F.col("text")).isNotNull().alias("tagged"), text.subject_of(F.col("text")).alias("subject"))


@query("SELECT tag, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(list_transform(string_split(regexp_extract(text, 'TAGS:[ \\t]*([A-Z0-9_,\\t -]{3,200})', 1), ','), lambda x: trim(x)))) AS tag FROM documents) WHERE regexp_full_match(tag, '[A-Za-z]+') GROUP BY tag")
def tag_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(text.tags_in(F.col("text"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


ANCHOR = "SELECT doc_id, text, anchor_label AS anchor FROM documents JOIN (SELECT private_id, min(anchor_label) AS anchor_label FROM matches GROUP BY 1) ON private_id = ref WHERE text IS NOT NULL AND anchor_label IS NOT NULL"


def _anchored(spark, d):
    anchors = table(spark, d, "matches").groupBy("private_id").agg(F.min("anchor_label").alias("anchor"))
    return table(spark, d, "documents").join(anchors, F.col("private_id") == F.col("ref")).filter("text is not null and anchor is not null").select("doc_id", "text", "anchor")


@query(f"""WITH t AS (SELECT *, strpos(lower(text), lower(anchor)) - 1 AS hit FROM ({ANCHOR})) SELECT doc_id, CASE WHEN hit < 0 THEN 0 ELSE greatest(0, hit - 400) END AS "start", CASE WHEN hit < 0 THEN least(length(text), 1100) ELSE least(length(text), hit + 700) END AS "end" FROM t""")
def passage_span(spark, d):
    return _anchored(spark, d).select("doc_id", text.passage_span(F.col("text"), F.col("anchor")).alias("s")).select("doc_id", "s.start", "s.end")


@query(f"""WITH t AS (SELECT *, strpos(lower(text), lower(anchor)) AS hit, string_split(anchor, ' ')[-1] AS fam FROM ({ANCHOR})), u AS (SELECT *, strpos(lower(text), lower(fam)) AS hit2 FROM t)
SELECT doc_id, CASE WHEN length(anchor) >= 4 AND hit > 0 THEN substring(text, hit, length(anchor)) WHEN contains(anchor, ' ') AND length(fam) >= 4 AND hit2 > 0 THEN substring(text, hit2, length(fam)) ELSE '' END AS written FROM u""")
def written_as(spark, d):
    return _anchored(spark, d).select("doc_id", text.written_as(F.col("anchor"), F.col("text")).alias("written"))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1500) / 1250)) * 1250 + 1 AS BIGINT), 1250)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(start AS INT) AS start, md5(substring(text, CAST(start AS BIGINT) + 1, 1500)) AS piece FROM s""")
def text_windows(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(text.windows(F.col("text"))).alias("w"))
    return w.select("doc_id", "w.start", F.md5("w.piece").alias("piece"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 600 THEN text ELSE regexp_replace(left(text, 600), '[\\s\\x{a0}\\x{85}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{3000}]+$', '') || chr(10) || '[... truncated]' END) AS clipped FROM documents")
def clip_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clip(F.col("text"), 600)).alias("clipped"))


@query("""SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_acctbal IS NOT NULL THEN 's acctbal: ' || CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR) END, CASE WHEN s_name <> '' THEN 's name: ' || s_name END], lambda x: x IS NOT NULL), chr(10)) AS text FROM supplier""")
def record_text(spark, d):
    # half to even, as SQL rounds
    return table(spark, d, "supplier").select("s_suppkey", text.record_lines({"s_name": F.col("s_name"), "s_acctbal": F.rint("s_acctbal").cast("bigint").cast("string")}).alias("text"))


@query("SELECT DISTINCT doc_ref AS ref, split_part(doc_ref, ':', 1) AS source, regexp_extract(doc_ref, '^[^:]*:(.*)$', 1) AS doc_id FROM mentions")
def ref_parts(spark, d):
    c = F.col("doc_ref")
    return table(spark, d, "mentions").select(c.alias("ref"), text.ref_source(c).alias("source"), text.ref_id(c).alias("doc_id")).distinct()


@query("SELECT event_id, try_cast(json_extract_string(regexp_extract('say: ' || props || ' end', '(\\{.*\\})', 1), '$.k') AS BIGINT) AS k FROM events")
def json_slice(spark, d):
    cut = text.json_slice(F.concat(F.lit("say: "), F.col("props"), F.lit(" end")))
    return table(spark, d, "events").select("event_id", F.get_json_object(cut, "$.k").try_cast("bigint").alias("k"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '<think>hm</think> Yes ' || event_type WHEN 1 THEN 'x </think> Mixed' WHEN 2 THEN '<THINK>never ends' ELSE event_type END AS reply, event_type FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Yes ' || event_type WHEN 1 THEN 'Mixed' WHEN 2 THEN '' ELSE event_type END AS said, CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'mixed' ELSE '' END AS word, CASE event_id % 4 WHEN 1 THEN 'Mixed' ELSE '' END AS verdict FROM r""")
def reply_parsing(spark, d):
    n = F.col("event_id") % 4
    reply = F.when(n == 0, F.concat(F.lit("<think>hm</think> Yes "), F.col("event_type"))).when(n == 1, "x </think> Mixed").when(n == 2, "<THINK>never ends").otherwise(F.col("event_type"))
    said = table(spark, d, "events").select("event_id", text.strip_reasoning(reply).alias("said"))
    return said.select("event_id", "said", text.first_word(F.col("said"), ["Yes", "No", "Mixed"]).alias("word"), text.verdict_of(F.col("said"), list(gates.VERDICTS)).alias("verdict"))


@query("SELECT mention_id, CASE WHEN regexp_full_match(qid, 'Q[0-9]+') THEN qid ELSE '' END AS qid, NOT contains(surface_form, '##') AND length(trim(surface_form)) >= 3 AND (CASE entity_type WHEN 'PERSON' THEN 'PER' WHEN 'GPE' THEN 'LOC' ELSE entity_type END) IN ('PER', 'LOC', 'ORG') AND coalesce(confidence, 1) >= 0.85 AS usable FROM mentions")
def span_filter(spark, d):
    group = F.when(F.col("entity_type") == "PERSON", "PER").when(F.col("entity_type") == "GPE", "LOC").otherwise(F.col("entity_type"))
    return table(spark, d, "mentions").select("mention_id", text.qid_or_blank(F.col("qid")).alias("qid"), text.usable_span(F.col("surface_form"), group, F.col("confidence")).alias("usable"))


@query("SELECT DISTINCT label, array_to_string(regexp_extract_all(lower(strip_accents(label)), '[a-z0-9]+'), ' ') AS folded FROM entities")
def fold_labels(spark, d):
    return table(spark, d, "entities").select("label").distinct().select("label", text.fold_ascii("label").alias("folded"))


@query("SELECT doc_id, substring(text, 1, least(length(text), 12)) AS head, ' [START] ' || substring(text, 1, 5) || ' [END] ' || substring(text, 6, 200) AS marked FROM documents WHERE length(text) >= 12")
def marked_spans(spark, d):
    docs = table(spark, d, "documents").filter(F.length("text") >= 12)
    return docs.select("doc_id", F.left("text", F.lit(12)).alias("head"), text.marked_span(F.col("text"), F.lit(0), F.lit(5)).alias("marked"))
