"""Further registered queries: dictionary linking, typed candidates, reconciliation and the record formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom import sinks
from threadloom.functions import dates, text
from threadloom.operators import dictionary, gates, links, temporal, typed
from threadloom.plans import adapters as ad
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


STOP = "[" + ", ".join(f"'{w}'" for w in sorted(dictionary.STOPWORDS)) + "]"
DICTIONARY = f"""t AS (SELECT regexp_replace(regexp_replace(label, '\\s*\\([^)]*\\)$', ''), '^\\s+|\\s+$', '', 'g') AS t, qid FROM entities WHERE label IS NOT NULL),
k AS (SELECT lower(t) AS title, qid, row_number() OVER (PARTITION BY lower(t) ORDER BY qid) AS i FROM t WHERE length(t) >= 6 AND len(regexp_split_to_array(t, '\\s+')) >= 2 AND len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: NOT list_contains({STOP}, trim(lower(w), '.,''-')))) > 0)"""


def _dictionary(spark, d):
    return dictionary.dictionary(table(spark, d, "entities").filter("label is not null").select(F.col("label").alias("title"), "qid", F.col("qid").alias("pos")))


@query(f"WITH {DICTIONARY} SELECT title, qid FROM k WHERE i = 1")
def dictionary_build(spark, d):
    return _dictionary(spark, d)


@query()
def dictionary_match(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return dictionary.match(docs, _dictionary(spark, d))


NORMAL = lambda c: f"array_to_string(regexp_extract_all(lower({c}), '[a-z0-9]+'), ' ')"
LABELED = """WITH one AS (SELECT doc_ref, a_qid, b_qid, shared_qid, min(a_surface) AS a_surface FROM associations WHERE a_qid IS NOT NULL AND b_qid IS NOT NULL GROUP BY 1, 2, 3, 4),
s AS (SELECT shared_qid, coalesce((SELECT min(e.label) FROM entities e WHERE e.qid = shared_qid), min(b_surface)) AS label FROM associations WHERE shared_qid IS NOT NULL GROUP BY shared_qid), near AS (SELECT a_qid AS qid, min(b_qid) AS other FROM associations GROUP BY 1),
art AS (SELECT qid, label, label || ' is known' || CASE WHEN regexp_matches(qid, '[05]$') THEN ' beside ' || coalesce((SELECT min(o.label) FROM entities o WHERE o.qid = near.other), 'nobody') ELSE '' END AS text FROM entities LEFT JOIN near USING (qid))"""


@query(LABELED + f""", r AS (SELECT o.*, d.text AS private, a.label AS al, b.label AS bl, s.label AS sl, a.text AS ta, b.text AS tb FROM one o LEFT JOIN documents d ON d.ref = o.doc_ref LEFT JOIN art a ON a.qid = o.a_qid LEFT JOIN art b ON b.qid = o.b_qid LEFT JOIN s ON s.shared_qid = o.shared_qid),
n AS (SELECT *, CASE WHEN coalesce(private, '') = '' THEN 'no_private_text' WHEN coalesce(sl, '') = '' THEN 'no_answer' WHEN coalesce(ta, '') = '' OR coalesce(tb, '') = '' THEN 'no_article'
WHEN contains({NORMAL('ta')}, {NORMAL("coalesce(bl, '')")}) OR contains({NORMAL('tb')}, {NORMAL("coalesce(al, '')")}) THEN 'co_occurring' WHEN contains({NORMAL('private')}, {NORMAL('sl')}) THEN 'answer_in_private' ELSE 'good' END AS reason FROM r) SELECT reason, count(*) AS n FROM n GROUP BY 1""")
def association_reasons(spark, d):
    # articles are made from the labels, some of which tell of an associate; an affiliation is called after its first member
    every = table(spark, d, "associations")
    a = every.filter("a_qid is not null and b_qid is not null").groupBy(F.col("doc_ref").alias("doc_id"), "a_qid", "b_qid", "shared_qid").agg(F.min("a_surface").alias("a_surface"))
    docs = table(spark, d, "documents").select(F.col("ref").alias("id"), "text")
    shared = every.filter("shared_qid is not null").groupBy(F.col("shared_qid").alias("qid")).agg(F.min("b_surface").alias("label"))
    known = ad.labels(spark, d)
    shared = shared.join(known, "qid", "left_anti")
    near = every.filter("a_qid is not null").groupBy(F.col("a_qid").alias("qid")).agg(F.min("b_qid").alias("other"))
    other = known.groupBy(F.col("qid").alias("other")).agg(F.min("label").alias("other_label"))
    beside = F.when(F.col("qid").rlike("[05]$"), F.concat(F.lit(" beside "), F.coalesce("other_label", F.lit("nobody")))).otherwise("")
    articles = known.join(near, "qid", "left").join(other, "other", "left").select(F.col("qid").alias("id"), F.concat("label", F.lit(" is known"), beside).alias("text"))
    made = typed.from_association(a, docs, articles.unionByName(shared.select(F.col("qid").alias("id"), F.lit("an affiliation").alias("text"))), known.unionByName(shared))
    return made.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT DISTINCT private_id, public_id, n_days FROM chronologies), t AS (SELECT ref, text FROM documents), r AS (SELECT c.*, CASE WHEN coalesce(a.text, '') = '' THEN 'no_private_text' WHEN coalesce(b.text, '') = '' THEN 'no_public_text' END AS reason FROM c LEFT JOIN t a ON a.ref = private_id LEFT JOIN t b ON b.ref = public_id)
SELECT private_id, public_id, CAST(n_days AS VARCHAR) || ' days' AS answer, reason FROM r""")
def chronology_items(spark, d):
    pairs = table(spark, d, "chronologies").select("private_id", "public_id", F.col("n_days").alias("days")).distinct()
    docs = table(spark, d, "documents").select(F.col("ref").alias("id"), "text")
    return typed.from_pairs(pairs, docs, "chronology").select("private_id", "public_id", "answer", "reason")


@query("""WITH c AS (SELECT DISTINCT private_id, public_id FROM candidates), t AS (SELECT ref, text FROM documents) SELECT CASE WHEN coalesce(a.text, '') = '' THEN 'no_private_text' WHEN coalesce(b.text, '') = '' THEN 'no_public_text' ELSE 'good' END AS reason, count(*) AS n FROM c LEFT JOIN t a ON a.ref = private_id LEFT JOIN t b ON b.ref = public_id GROUP BY 1""")
def posture_reasons(spark, d):
    pairs = table(spark, d, "candidates").select("private_id", "public_id").distinct()
    docs = table(spark, d, "documents").select(F.col("ref").alias("id"), "text")
    return typed.from_pairs(pairs, docs, "posture").groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT DISTINCT doc_ref AS doc_id, qid, surface_form FROM mentions WHERE qid IS NOT NULL AND coalesce(surface_form, '') <> ''), t AS (SELECT e.doc_id, e.qid, e.surface_form, text, string_split(surface_form, ' ')[-1] AS fam FROM e JOIN documents ON ref = e.doc_id WHERE coalesce(text, '') <> '' AND NOT regexp_matches(surface_form, '^\\s|\\s$|\\s\\s'))
SELECT doc_id, qid, CASE WHEN length(surface_form) >= 4 AND strpos(lower(text), lower(surface_form)) > 0 THEN substring(text, strpos(lower(text), lower(surface_form)), length(surface_form)) ELSE substring(text, strpos(lower(text), lower(fam)), length(fam)) END AS surface_form FROM t
WHERE (length(surface_form) >= 4 AND strpos(lower(text), lower(surface_form)) > 0) OR (contains(surface_form, ' ') AND length(fam) >= 4 AND strpos(lower(text), lower(fam)) > 0)""")
def as_written(spark, d):
    e = ad.links(spark, d).filter("qid is not null and coalesce(surface_form, '') <> ''").select("doc_id", "qid", "surface_form").distinct().filter(~F.col("surface_form").rlike(r"^\s|\s$|\s\s"))
    return typed.spelled(e, table(spark, d, "documents").select(F.col("ref").alias("id"), "text"))


@query("""WITH s AS (SELECT DISTINCT surface_form AS name FROM mentions WHERE surface_form IS NOT NULL), b AS (SELECT name, list_sort(list_distinct(regexp_extract_all(lower(name), '[a-z]+'))) AS bag FROM s WHERE regexp_full_match(name, '[A-Za-z .,]+')),
e AS (SELECT qid, list_sort(list_distinct(regexp_extract_all(lower(label), '[a-z]+'))) AS bag FROM entities WHERE regexp_full_match(label, '[A-Za-z .,]+') AND kind = 'person'), m AS (SELECT name, qid, row_number() OVER (PARTITION BY name ORDER BY qid) AS i FROM b JOIN e USING (bag)) SELECT name, qid FROM m WHERE i = 1""")
def search_verified(spark, d):
    plain = "^[A-Za-z .,]+$"
    names = ad.links(spark, d).select(F.col("surface_form").alias("name")).dropna().distinct().filter(F.col("name").rlike(plain))
    asked = names.select("name", text.name_bag("name").alias("bag"), F.lit("person").alias("kind"), F.lit(None).cast("int").alias("year"))
    e = table(spark, d, "entities").filter(F.col("label").rlike(plain) & (F.col("kind") == "person"))
    found = e.select(F.col("qid").alias("rank"), "qid", text.name_bag("label").alias("label_bag"), F.array("kind").alias("kinds"), F.array().cast("array<int>").alias("years"))
    return links.verified_search(asked, asked.select("name", F.col("bag").alias("label_bag")).join(found, "label_bag").select("name", "rank", "qid", "label_bag", "kinds", "years"))


@query()
def search_verified_all(spark, d):
    # every name and label, with the accents, figures and other alphabets that the SQL of search_verified can't fold
    names = ad.links(spark, d).select(F.col("surface_form").alias("name")).dropna().distinct()
    asked = names.select("name", text.name_bag("name").alias("bag"), F.lit("person").alias("kind"), F.lit(None).cast("int").alias("year")).filter(F.size("bag") > 0)
    e = table(spark, d, "entities").filter("label is not null and kind = 'person'")
    found = e.select(F.col("qid").alias("rank"), "qid", text.name_bag("label").alias("label_bag"), F.array("kind").alias("kinds"), F.array().cast("array<int>").alias("years"))
    return links.verified_search(asked, asked.select("name", F.col("bag").alias("label_bag")).join(found, "label_bag").select("name", "rank", "qid", "label_bag", "kinds", "years"))


@query()
def as_written_all(spark, d):
    # every surface form, with the outer and doubled white space that as_written leaves out
    e = ad.links(spark, d).filter("qid is not null and coalesce(surface_form, '') <> ''").select("doc_id", "qid", "surface_form").distinct()
    return typed.spelled(e, table(spark, d, "documents").select(F.col("ref").alias("id"), "text"))


@query("""WITH s AS (SELECT doc_id AS n, title, lang FROM documents WHERE title IS NOT NULL), k AS (SELECT title, lang, min(ref) AS q FROM documents WHERE title IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2), a AS (SELECT title, min(ref) AS q FROM documents WHERE title IS NOT NULL AND lang IS NULL GROUP BY 1)
SELECT n AS doc_id, CASE WHEN coalesce(k.q, a.q) IS NOT NULL THEN 'Q' || coalesce(k.q, a.q) END AS qid FROM s LEFT JOIN k ON k.title = s.title AND k.lang = s.lang LEFT JOIN a ON a.title = s.title""")
def title_lookup(spark, d):
    docs = table(spark, d, "documents").filter("title is not null")
    mapping = docs.select(F.col("title").alias("a"), F.col("lang").alias("b"), F.col("ref").alias("qid"))
    return dictionary.title_to_qid(docs.select("doc_id", "title", "lang"), mapping).select("doc_id", "qid")


@query("WITH q AS (SELECT DISTINCT item_id FROM items), r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM q) SELECT item_id, CAST(i % 5 AS INT) AS asker FROM r")
def positional_asker(spark, d):
    from threadloom.operators.ordered import numbered

    return numbered(table(spark, d, "items").select("item_id").distinct(), "item_id").select("item_id", ((F.col("number") - 1) % 5).cast("int").alias("asker"))


@query("SELECT doc_id, sha256('{\"doc_id\": ' || CAST(doc_id AS VARCHAR) || ', \"lang\": ' || coalesce('\"' || lang || '\"', 'null') || '}') AS record_hash FROM documents")
def record_hashes(spark, d):
    return sinks.record_hash(table(spark, d, "documents").select("doc_id", "lang")).select("doc_id", "record_hash")


@query("SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || '.' || CAST(month(o_orderdate) AS VARCHAR) || '.' || CAST(year(o_orderdate) AS VARCHAR) AS raw, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS us FROM orders")
def written_dates(spark, d):
    # the order's date, written as each source writes dates and read again
    c = F.col("o_orderdate").cast("date")
    parts = [F.day(c).cast("string"), F.month(c).cast("string"), F.year(c).cast("string")]
    raw, american = F.concat_ws(".", *parts), F.concat(F.concat_ws("/", parts[1], parts[0], parts[2]), F.lit(" 0:00"))
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw"), dates.dotted_date(raw).alias("iso"), dates.us_timestamp(american).alias("us"))


#: What white space is, in a class of the SQL engine's expressions.
WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP = lambda c: f"regexp_replace({c}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"
NARRATIVE = rf"""WITH b AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{text.NARRATIVE_START}') THEN regexp_extract(text, '{text.NARRATIVE_START}(.|\n)*', 0) ELSE text END AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, {STRIP(f"regexp_replace(regexp_replace(t, '{text.CLASSIFICATION}', '', 'g'), '{text.MARKER_LINE}', '', 'g')")} AS t FROM b),
l AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {STRIP('x')} <> '') AS lines FROM m),
s AS (SELECT *, len(lines) > 1 AND length({STRIP('lines[-1]')}) <= 30 AND len(regexp_split_to_array({STRIP('lines[-1]')}, '\s+')) <= 3 AS short FROM l)"""


@query(NARRATIVE + " SELECT doc_id, md5(array_to_string(CASE WHEN short THEN lines[:-2] ELSE lines END, chr(10))) AS body FROM s")
def narrative(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(text.narrative_body(F.col("text"))).alias("body"))


@query()
def narrative_bodies(spark, d):
    # the body itself, whose cuts and markings the SQL of narrative doesn't follow
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.narrative_body(F.col("text")).alias("body"))


@query()
def subject_tags(spark, d):
    docs = table(spark, d, "documents").filter("text is not null and source = 'cablegate'")
    return docs.select("doc_id", text.tags_in(F.col("text")).alias("tags"), text.subject_of(F.col("text")).alias("subject"))


@query()
def gate_verdicts(spark, d):
    # all nine gates of each row
    made = gates.judged(table(spark, d, "items").select("item_id", "question", "answer", "evidence", "provenance"))
    return made.select("item_id", "question", "answer", *[F.element_at("gates", k).alias(k) for k in gates.gate_columns(*[F.lit("")] * 2, F.array(F.struct(F.lit("").alias("side"))), F.lit(""))], "accepted")


@query("""WITH f AS (SELECT DISTINCT ref AS id, CAST(doc_ts AS DATE) AS day FROM documents WHERE doc_ts IS NOT NULL), e AS (SELECT DISTINCT doc_id, CAST(event_ts AS DATE) AS day, unnest(qids) AS qid FROM event_records WHERE event_ts IS NOT NULL), m AS (SELECT DISTINCT doc_ref, qid FROM mentions WHERE qid IS NOT NULL)
SELECT f.id AS doc_id, e.doc_id AS r_event_id, m.qid, datediff('day', f.day, e.day) AS days FROM f JOIN m ON m.doc_ref = f.id JOIN e ON e.qid = m.qid WHERE abs(datediff('day', f.day, e.day)) <= 45""")
def interval_join(spark, d):
    left = ad.dated_documents(spark, d).filter("date is not null").distinct().join(ad.links(spark, d).select("doc_id", "qid").dropna().distinct(), "doc_id")
    right = table(spark, d, "event_records").filter("event_ts is not null").select(F.col("doc_id").alias("event_id"), F.col("event_ts").cast("date").alias("date"), F.explode("qids").alias("qid")).distinct()
    return temporal.by_windows(left, right, ["qid"], 45).select("doc_id", "r_event_id", "qid", F.datediff("r_date", "date").alias("days"))
