"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from threadloom.llm import broken_pairs, bytebpe, language, mixing, names, nearest, spam, splitting
from threadloom.sources.tables import table


def _items(spark, d):
    return splitting.corpus_items(table(spark, d, "documents"), table(spark, d, "candidates"), table(spark, d, "link_settings"))


def p2_found(spark, d):
    return splitting.oversized(_items(spark, d))


def p2_pieces(spark, d):
    return splitting.split_items(_items(spark, d))


def p3_found(spark, d):
    return broken_pairs.defects(table(spark, d, "items"), language.fitted(table(spark, d, "documents")))


def p4_nearest(spark, d):
    return nearest.match_events(table(spark, d, "matches"), table(spark, d, "event_records"))


def p4_found(spark, d):
    return p4_nearest(spark, d).select("private_id", "anchor_qid", "public_id")


def p5_found(spark, d):
    return language.faulty_labels(table(spark, d, "documents"))


def p5_documents(spark, d):
    return language.document_languages(table(spark, d, "documents"))


def p5_segments(spark, d):
    return language.language_segments(table(spark, d, "documents"))


def p6_found(spark, d):
    return names.variants(names.spellings(table(spark, d, "mentions"), table(spark, d, "associations")), table(spark, d, "entities"))


def p6_links(spark, d):
    return names.link_spellings(names.spellings(table(spark, d, "mentions"), table(spark, d, "associations")), table(spark, d, "entities"))


def p7_ids(spark, d):
    return bytebpe.token_ids(table(spark, d, "documents"))


def p8_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p8_shares(spark, d):
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p9_found(spark, d):
    return spam.list_pages(table(spark, d, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p3_found, p4_found, p4_nearest, p5_found, p5_documents, p5_segments, p6_found, p6_links, p7_ids, p8_mix, p8_shares, p9_found)}

NEAREST = """WITH e AS (SELECT doc_id, event_ts, unnest(qids) AS q FROM event_records WHERE event_ts IS NOT NULL),
n AS (SELECT m.private_id, m.anchor_qid, e.doc_id AS public_id, m.private_ts, e.event_ts, abs(epoch_us(e.event_ts) - epoch_us(m.private_ts)) AS distance
FROM matches m JOIN e ON e.q = m.anchor_qid AND abs(epoch_us(e.event_ts) - epoch_us(m.private_ts)) <= CAST(m.window_days AS BIGINT) * 86400000000),
r AS (SELECT *, row_number() OVER (PARTITION BY private_id, anchor_qid ORDER BY distance, event_ts, public_id) AS i FROM n)
"""

SQL = {
    "p2_found": """WITH s AS (SELECT * FROM link_settings), d AS (SELECT 'documents' AS item_table, CAST(doc_id AS VARCHAR) AS item_key, source, text, 'd' AS k FROM documents
UNION ALL SELECT 'candidates', item_id, split_part(private_id, ':', 1), passage, 'c' FROM candidates)
SELECT DISTINCT item_table, item_key FROM d LEFT JOIN s ON s.source = d.source, (SELECT * FROM s WHERE source = '*') r
WHERE length(text) > CASE WHEN k = 'd' THEN coalesce(s.max_chars, r.max_chars) ELSE coalesce(s.passage_chars, r.passage_chars) END""",
    "p4_found": NEAREST + "SELECT private_id, anchor_qid, public_id FROM r WHERE i = 1 AND private_id IS NOT NULL",
    "p4_nearest": NEAREST + """SELECT private_id, anchor_qid, public_id, datediff('day', CAST(private_ts AS DATE), CAST(event_ts AS DATE)) AS days_apart,
abs(datediff('day', CAST(private_ts AS DATE), CAST(event_ts AS DATE))) AS n_days, distance FROM r WHERE i = 1 AND private_id IS NOT NULL""",
}
