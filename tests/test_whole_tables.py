import re
import unicodedata

import __spark_entry__ as entry


def saved(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_search_and_spelling_read_every_row(spark, tmp_path):
    labels = [("Q1", "Genève-Zoé O'Hara", "person"), ("Q2", "Ann Avon", "person"), ("Q3", "Ann Avon", "organisation"), ("Q0", "Avon, Ann", "person"), ("Q5", "Ann 2nd", "person"), ("Q6", None, "person"), ("Q7", "?", "person")]
    forms = ["geneve zoe o'hara", "O'HARA, Genève Zoé", "Ann Avon", " ann  avon ", "Ann 2nd", "Zoé", "?!", "", None]
    text = "GENÈVE-zoé said:  ann  avon  met ann 2ND."
    mentions = [("d", "private", "Q1", f, 0.9, "PERSON", i) for i, f in enumerate(forms)]
    d = saved(
        spark, tmp_path, entities=(labels, "qid string, label string, kind string"), documents=([("d", text)], "ref string, text string"),
        mentions=(mentions, "doc_ref string, side string, qid string, surface_form string, confidence double, entity_type string, mention_id int"),
    )

    def bag(x):
        return frozenset(re.findall(r"\w+", "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()))

    want = {f: min(q) for f in forms if f and bag(f) and (q := [q for q, label, kind in labels if label and kind == "person" and bag(label) == bag(f)])}
    assert len(want) == 5 and {r["name"]: r.qid for r in entry.queries()["search_verified_all"](spark, d).collect()} == want
    got = {(r.doc_id, r.qid, r.surface_form) for r in entry.queries()["as_written_all"](spark, d).collect()}
    assert ("d", "Q1", " ann  avon ") in got and ("d", "Q1", "ann 2ND") in got


def test_bodies_tags_and_all_gates_are_returned(spark, tmp_path):
    cable = "TAGS: PREL, PGOV\nSUBJECT: AVON QUOTA\n\n 1. (C) Ann met Bob on the quota for two hours.\n\n 2. (C) Nothing came of it.\nAVON"
    item = ("i", "Who met Bob Beal, and why?", "Ann Avon", [("private",), ("public",)], {"withheld": "Bob Beal"})
    d = saved(
        spark, tmp_path, documents=([(1, "cablegate", cable), (2, "cablegate", None)], "doc_id bigint, source string, text string"),
        items=([item, ("j", *item[1:4], {"withheld": "Cid Coot"})], "item_id string, question string, answer string, evidence array<struct<side:string>>, provenance map<string,string>"),
    )
    [body] = entry.queries()["narrative_bodies"](spark, d).collect()
    assert "Ann met Bob" in body.body and "SUBJECT" not in body.body and not body.body.endswith("AVON")
    [tags] = entry.queries()["subject_tags"](spark, d).collect()
    assert tags.tags == ["PREL", "PGOV"] and tags.subject.startswith("AVON QUOTA")
    rows = {r.item_id: r for r in entry.queries()["gate_verdicts"](spark, d).collect()}
    assert len(rows["i"]) == 13 and not rows["i"].withholds_what_it_was_told_to and rows["j"].withholds_what_it_was_told_to and rows["j"].not_referential
