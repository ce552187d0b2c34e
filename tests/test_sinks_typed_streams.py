import json
import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from threadloom import sinks
from threadloom.functions import text
from threadloom.operators import dictionary, links, temporal, typed
from threadloom.streaming.events import event_stream


def test_records_sidecar_split_and_hash(spark, tmp_path):
    df = spark.createDataFrame([("b", True), ("a", False), ("c", True)], "item_id string, accepted boolean")
    assert sinks.emit(df, f"{tmp_path}/yes", f"{tmp_path}/no", {"kind": "derived"}) == (2, 1)
    side = json.loads(Path(f"{tmp_path}/yes.{sinks.SIDECAR}").read_text())
    assert side["rows_out"] == 2 and side["rows_in"] == 3 and spark.read.json(f"{tmp_path}/no").first().item_id == "a"
    import hashlib

    h = sinks.record_hash(spark.createDataFrame([(1, None, "é")], "b int, c string, a string")).first().record_hash
    assert h == hashlib.sha256('{"a": "é", "b": 1, "c": null}'.encode()).hexdigest()
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    kept, counts = sinks.kept_by_verdict(items, spark.createDataFrame([("a", "keep"), ("b", "drop")], "item_id string, verdict string"))
    assert kept.first().item_id == "a" and tuple(counts.first()) == (1, 1, 1)
    page = sinks.review_page(spark.createDataFrame([("i<1", "Q & A?", "x", "w" * 300)], "item_id string, question string, answer string, rationale string"), "T")
    assert "Q &amp; A?" in page and "w" * 200 + "…" in page


def test_dictionary(spark):
    index = spark.createDataFrame([("United States", "Q1", 0), ("united states", "Q2", 1), ("Has Been", "Q3", 2), ("Bern (city)", "Q4", 3), ("States Navy Board (x)", "Q5", 4), ("Navy Board", "Q6", 5)], "title string, qid string, pos int")
    made = dictionary.dictionary(index)
    assert {tuple(r) for r in made.collect()} == {("united states", "Q1"), ("states navy board", "Q5"), ("navy board", "Q6")}
    texts = spark.createDataFrame([(1, "The UNITED STATES Navy Board met. Navy Board."), (2, None), (3, "")], "key int, text string")
    got = sorted((r.key, r["first"], r.surface_form, r.qid) for r in dictionary.match(texts, made).collect())
    assert got == [(1, 2, "STATES Navy Board", "Q5"), (1, 6, "Navy Board", "Q6")]
    spans = spark.createDataFrame([("Bern", "de"), ("Rom", "de"), ("X", None)], "title string, lang string")
    mapping = spark.createDataFrame([("de", "Bern", "70"), ("Rom", None, "Q220"), ("Bern", None, "9")], "a string, b string, qid string")
    assert {(r.title, r.qid) for r in dictionary.title_to_qid(spans, mapping).collect()} == {("Bern", "Q70"), ("Rom", "Q220"), ("X", None)}


def test_typed_candidates(spark):
    c = spark.createDataFrame([("d", "Q1", "Q2", "Ann", "Q9"), ("e", "Q1", "Q2", "Ann", "Q9"), ("f", "Q1", "Q3", "Ann", "Q9")], "doc_id string, a_qid string, b_qid string, a_surface string, shared_qid string")
    texts = spark.createDataFrame([("d", "Ann met Bob."), ("f", "Ann of the Board")], "id string, text string")
    articles = spark.createDataFrame([("Q1", "Ann is"), ("Q2", "Bob is"), ("Q3", "Cid knew Ann"), ("Q9", "Board")], "id string, text string")
    labels = spark.createDataFrame([("Q1", "Ann"), ("Q2", "Bob"), ("Q3", "Cid"), ("Q9", "Board")], "qid string, label string")
    got = {r.doc_id: r for r in typed.from_association(c, texts, articles, labels).collect()}
    assert (got["d"].reason, got["d"].answer, got["e"].reason, got["f"].reason) == (None, "Board", "no_private_text", "co_occurring")
    pairs = spark.createDataFrame([("d", "f", 3), ("d", "x", 4)], "private_id string, public_id string, days int")
    assert {(r.answer, r.reason) for r in typed.from_pairs(pairs, texts, "chronology").collect()} == {("3 days", None), ("4 days", "no_public_text")}
    asked = spark.createDataFrame([("i", "who?", "Ann", "Ann did", "none")], "item_id string, question string, answer string, private string, public string")
    n = typed.ablated(asked, lambda p: "ann" if "Ann did" in p else "?").first().necessity
    assert (n.closed_book, n.public_only, n.private_only) == (False, False, True)
    item = typed.to_item(spark.createDataFrame([("i", "event")], "item_id string, question_type string"), F.array(F.lit(1)), F.create_map(F.lit("gold"), F.lit("seen"), F.lit("question_type"), F.lit("no")))
    assert item.first().provenance == {"gold": "seen", "question_type": "event"}
    spelled = typed.spelled(spark.createDataFrame([("d", "Q1", "ANN"), ("d", "Q2", "Robert Bobby"), ("e", "Q1", "Ann")], "doc_id string, qid string, surface_form string"), spark.createDataFrame([("d", "ann avon met BOBBY")], "id string, text string"))
    assert [(r.qid, r.surface_form) for r in spelled.collect()] == [("Q2", "BOBBY")]
    res = typed.from_resolution(spark.createDataFrame([("d", "Q1", "Ann"), ("f", "Q2", "x")], "doc_id string, qid string, surface_form string"), texts, labels, spark.createDataFrame([("f", "Q2", "verified")], "doc_id string, qid string, verdict string"))
    assert {(r.doc_id, r.reason) for r in res.collect()} == {("d", "full_name_given"), ("f", None)}


def test_event_stream(spark, tmp_path):
    t = datetime(2020, 1, 1)
    spark.createDataFrame([("d1", "q", t), ("d2", "r", t)], "doc_id string, qid string, ts timestamp").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([("e1", "q", t + timedelta(days=21)), ("e2", "q", t + timedelta(days=22)), ("e3", "q", t - timedelta(days=3))], "event_id string, qid string, event_ts timestamp").write.parquet(f"{tmp_path}/e")
    a = spark.readStream.schema("doc_id string, qid string, ts timestamp").parquet(f"{tmp_path}/d")
    b = spark.readStream.schema("event_id string, qid string, event_ts timestamp").parquet(f"{tmp_path}/e")
    q = event_stream(a, b).writeStream.format("memory").queryName("near_events").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.event_id for r in spark.table("near_events").collect()) == ["e1", "e3"]


def test_dictionary_cells_lose_no_title(spark):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("aÄéİzß") for _ in range(r.randint(1, 4)))
    titles = sorted({f"{word()} {word()}".lower() for _ in range(200)})
    df = spark.createDataFrame([(t, f"Q{i}") for i, t in enumerate(titles)], "title string, qid string")
    texts = [" ".join(r.choice([word(), r.choice(titles).upper(), r.choice(titles)]) for _ in range(40)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    every = bytes([1]) * dictionary.CELLS
    held = dictionary.title_cells(df)
    found = lambda cells: dictionary.phrases(docs, cells).withColumn("title", F.lower("phrase")).join(df, "title").select("key", "first", "words", "title").collect()
    assert sorted(found(held)) == sorted(found(every)) and len(found(held)) > 100 and sum(held) < dictionary.CELLS
    assert dictionary.match(docs, df.limit(0)).count() == 0 and dictionary.match(docs.limit(0), df).count() == 0


def test_maps_events_and_names(spark):
    facts = spark.createDataFrame([("Q1", "Ann", 0, {"instance_of": ["Q5"]}), ("Q2", "", 1, {"instance_of": ["Q6"]}), ("Q1", "Anna", 2, None), (None, None, 3, None)], "qid string, label string, pos int, statements map<string, array<string>>")
    assert [r.qid for r in typed.people_in(facts).collect()] == ["Q1"] and {tuple(r) for r in typed.labels_in(facts).collect()} == {("Q1", "Anna")}
    rows = spark.createDataFrame([("Q1", "a", 5, 0), ("Q1", None, None, 1), ("", "x", 1, 2), (None, "x", 1, 3)], "qid string, text string, article_bytes int, pos int")
    assert [tuple(r) for r in typed.articles_in(rows).collect()] == [("Q1", "", 0)]
    m = spark.createDataFrame([("d", "Q1", "Ann", ["e1", "e2"]), ("x", "Q1", "Ann", ["e3"])], "private_id string, anchor_qid string, anchor_label string, public_ids array<string>")
    ev = spark.createDataFrame([("e1", "1 May", None), ("e2", "", "Avon"), ("e2", "", "Avon"), ("e3", None, None)], "event_id string, date_start string, country string")
    lines = ev.select("event_id", temporal.rendered({"date_start": "date ", "country": "country "}).alias("line"))
    made = {r.private_id: r for r in typed.from_events(temporal.with_lines(m, lines), spark.createDataFrame([("d", "Ann spoke.")], "id string, text string"), 21, 3).collect()}
    assert made["d"].facts["events"] == "  - date 1 May\n  - country Avon" and made["d"].facts["private_evidence"] == "Ann" and made["d"].provenance["events_shown"] == "2" and made["d"].public_id == "e1" and made["d"].reason is None
    assert made["x"].reason == "no_evidence"
    n = spark.createDataFrame([(" Ann Avon ", ["Bo", " ", None, "Cid Coot"]), (None, None)], "a string, b array<string>")
    assert [r.n for r in n.select(links.names_in({"a": False, "b": True}).alias("n")).collect()] == [["Ann Avon", "Bo", "Cid Coot"], []]
    assert n.select(links.names_in({"b": True, "a": False}, 2).alias("n")).first().n == ["Cid Coot", "Ann Avon"]


def test_search_needs_name_kind_and_year(spark):
    asked = [("a", ["Avon", "Ann Avon"], "individual", ["1950"]), ("b", ["Avon Board"], "entity", []), ("c", ["Avon"], "individual", []), ("d", ["x y", "x z", "x v", "x w", "Ann Avon"], None, None)]
    hits = [("Ann Avon", 0, "Q0", "Ann Avon"), ("Ann Avon", 1, "Q1", "Avon, Ann"), ("Ann Avon", 2, "Q2", "other"), ("Ann Avon", 3, "Q3", "Ann Avon"), ("Avon Board", 0, "Q1", "Avon Board"), ("Avon Board", 1, "Q4", "no"), ("Avon", 0, "Q1", "Avon")]
    facts = [("Q0", "Ann Avon", ["ship"], []), ("Q1", "Ann Avon", ["human"], ["1960"]), ("Q2", "AVON Ann", ["human"], ["1950"]), ("Q3", "Ann Avon", ["human"], []), ("Q4", "Board Avon", ["body"], [])]
    got = links.search_resolved(
        spark.createDataFrame(asked, "id string, variants array<string>, kind string, years array<string>"), spark.createDataFrame(hits, "variant string, rank int, qid string, label string"),
        spark.createDataFrame(facts, "qid string, label string, classes array<string>, births array<string>"), {"individual": ["human"], "entity": ["body"]},
    )
    assert {tuple(r) for r in got.collect()} == {("a", "Q2"), ("b", "Q4")}


def test_drafts_and_judges(spark):
    pairs = spark.createDataFrame([(p, u, q) for p, u, q in (("d1", "u1", "Q1"), ("d1", "d1", "Q1"), ("d1", "none", "Q1"), ("d2", "u1", "Q2"), ("d3", "u1", "Q3"))] * 2, "private_id string, public_id string, qid string")
    texts = spark.createDataFrame([("d1", "Ann {public} spoke"), ("u1", "The Board met"), ("d2", "fail"), ("d3", "odd")], "id string, text string")

    def phrase(prompt):
        if "fail" in prompt:
            raise TimeoutError
        return "no" if "odd" in prompt else '<think>{</think> {"question": "Who?", "answer": " Ann ", "private_contribution": "she spoke", "public_contribution": "it met"}'

    labels = spark.createDataFrame([("Q1", "Ann")], "qid string, label string")
    made = {(r.private_id, r.public_id): r for r in typed.drafted(pairs, texts, labels, "{private}|{public}|{bridge}", phrase).collect()}
    assert {k: r.outcome for k, r in made.items()} == {("d1", "u1"): "drafted", ("d1", "d1"): "same_document", ("d1", "none"): "no_evidence", ("d2", "u1"): "phraser_error", ("d3", "u1"): "unparseable_draft"}
    assert made["d1", "u1"].answer == "Ann" and made["d1", "u1"].rationale == "she spoke it met" and made["d3", "u1"].question is None
    items = spark.createDataFrame([(x, "d1", "u1", "Who?", x) for x in ("yes", "no", "wavers", "fails")] + [("gone", "d1", "none", "Who?", "yes")], "item_id string, private_id string, public_id string, question string, answer string")

    def judge(prompt, turn=[0]):
        turn[0] += 1
        if prompt.endswith("fails"):
            raise ConnectionError
        return "UNSUPPORTED" if prompt.endswith("no") or prompt.endswith("wavers") and turn[0] % 2 else "<think>UNSUPPORTED?</think> supported"

    told = {r.item_id: r.outcome for r in typed.supported(items, texts, "{private}{public}{question}{answer}", judge).collect()}
    assert told == {"yes": "verified", "no": "judge_rejected", "wavers": "judge_rejected", "fails": "judge_error", "gone": "no_evidence"}


def test_windows_are_recognised_once(spark):
    import re

    body = "".join(f"{'x' * 40} Name{i:03d} " for i in range(60))

    def recognise(piece):
        return [{"word": m.group(), "start": m.start(), "end": m.end(), "entity_group": "PER", "score": 0.9} for m in re.finditer(r"Name\d{3}", piece)] + [{"word": "xx", "start": 0, "end": 2, "entity_group": "PER"}, {"word": "xxxx", "start": 0, "end": 4, "entity_group": "MISC"}]

    docs = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id bigint, text string")
    got = text.recognised(docs, recognise, 300, 100).collect()
    assert sorted((r.start, r.surface) for r in got) == [(m.start(), m.group()) for m in re.finditer(r"Name\d{3}", body)]
    assert all(f"[START] {r.surface} [END]" in r.marked for r in got)
    assert [r.text for r in text.prepared(docs, case=str.title).orderBy("doc_id").collect()][1:] == ["", ""] and text.truecased(docs, "text") is docs


def test_release_and_calibration(spark, tmp_path):
    import hashlib

    from threadloom.operators import reports

    n = "necessity struct<closed_book: boolean, public_only: boolean, private_only: boolean>"
    rows = [(f"i{i:02d}", "t", f"Q{i} & é?", "a", "d", "u", (False, i % 2 == 0, False), {"g": True}) for i in random.Random(1).sample(range(40), 40)]
    items = spark.createDataFrame(rows, f"item_id string, question_type string, question string, answer string, private_id string, public_id string, {n}, gates map<string, boolean>")
    told = sinks.freeze(items, reports.datasheet(items), {"c": {"rows": 1}}, f"file://{tmp_path}/r")
    lines = [line for f in sorted((tmp_path / "r/questions").glob("part-*")) for line in f.read_text().splitlines()]
    assert [json.loads(x)["item_id"] for x in lines] == [f"i{i:02d}" for i in range(40)]
    assert told["sha256"] == hashlib.sha256("".join(x + "\n" for x in lines).encode()).hexdigest() == sinks.release_digest(sinks.canonical_lines(items)) == json.loads((tmp_path / "r/datasheet.json").read_text())["sha256"]
    assert told["types"] == {"t": 40} and told["necessity"]["needs_both"] == 20
    page = sinks.calibration_page(items, spark.createDataFrame([("d", "<secret>")], "id string, text string"), "C", 2)
    assert page.count("<article") == 2 and "&lt;secret&gt;" in page and "(not available)" in page and "the public record alone" in page and "both documents are needed" in page


def test_steps_run_by_name(spark, tmp_path):
    import pytest

    from threadloom import steps
    from threadloom.settings import Settings

    s = Settings(confidence=0.5, batch_size=8, max_chars=2000, max_private=200, window_days=90, pairs_per_entity=50, event_days=21, per_type=20, seed=1)
    models = {"phraser": lambda p: json.dumps({"question": f"Did {p[-3:]} of the talks vote?", "answer": "Yes"}), "judge": lambda p: "SUPPORTED", "solver": lambda p: "yes" if len(p) > 100 else "no"}
    r = steps.Run(spark, "/root/testdata/sf0.01", f"file://{tmp_path}", s, models)
    rows = {name: steps.run(name, r) for name in steps.STEPS}
    assert rows["link"] > rows["graph"] > 0 and rows["pair"] >= rows["generate"] == rows["release"] > 0 and rows["sources"] == 3
    assert "Calibration" in (tmp_path / "review/calibration.html").read_text() and json.loads((tmp_path / f"pair.{sinks.SIDECAR}").read_text())["rows_out"] == rows["pair"]
    with pytest.raises(KeyError, match="no step"):
        steps.run("other", r)
    with pytest.raises(KeyError, match="needs a model"):
        steps.run("generate", steps.Run(spark, r.tables, r.out, s))
