import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from threadloom.functions import dates, text
from threadloom.operators import gates, graph, keychunks, links, ordered, reports, temporal


def one(spark, value, *columns):
    """The columns' values over one row with a string column c."""
    return tuple(spark.createDataFrame([(value,)], "c string").select(*[x.alias(f"_{i}") for i, x in enumerate(columns)]).first())


def test_key_profiles_against_brute_force_with_a_hot_key(spark):
    r = random.Random(1)
    rows = [(r.choice(["d1", "d2", None, "hot"]), f"e{r.randrange(400)}" if r.random() < 0.95 else None, "Q1" if r.random() < 0.6 else r.choice(["Q2", "Q3", None]), r.choice([None, -5, 7, 9])) for _ in range(3000)]
    df = spark.createDataFrame(rows + rows[:50], "private_id string, public_id string, qid string, days_apart int").withColumn("pairs", F.lit("x"))
    want = {}
    for field, at in (("qid", 2), ("private_id", 0)):
        for x in rows + rows[:50]:
            if x[at] is not None:
                n, partners, days = want.setdefault((field, x[at]), (0, set(), []))
                want[field, x[at]] = (n + 1, partners | {x[1]}, days + [x[3]])
    for chunk in (16, 100, None):
        got = {(g.key_field, g.key_text): (g.pairs, g.partners, g.least_days, g.greatest_days) for g in keychunks.key_profiles(df, chunk).collect()}
        assert got == {k: (n, len(p - {None}), min(d for d in days if d is not None), max(d for d in days if d is not None)) for k, (n, p, days) in want.items()}
    cut = keychunks.key_profiles(df, 16).filter("key_text = 'Q1'").first()
    assert cut.chunks > 10 and cut.straddling > 10  # partners with rows in two chunks
    one = df.filter("qid = 'Q1'").limit(500).withColumn("public_id", F.lit("only")).withColumn("days_apart", F.expr("cast(pmod(xxhash64(private_id, rand(3)), 300) as int)"))
    assert [(r.partners, r.pairs, r.straddling > 5) for r in keychunks.key_profiles(one, 16).filter("key_field = 'qid'").collect()] == [(1, 500, True)]
    assert {tuple(g) for g in keychunks.heavy_keys(df).collect()} == {k for k, (n, _, _) in want.items() if n * 50 >= 3050}
    assert keychunks.heavy_keys(df.limit(0)).count() == 0


def test_numbers_in_chunks_are_exact(spark):
    states = spark.createDataFrame([("a", f"p{i:04}") for i in range(1000)] + [(None, f"p{i}") for i in range(60)] + [("b", None)], "k string, o string")
    got = keychunks.number_in_chunks(states, ["k"], ["o"], 64).collect()
    for key, n in (("a", 1000), (None, 60), ("b", 1)):
        mine = [g for g in got if g.k == key]
        assert sorted(g.number for g in mine) == list(range(1, n + 1)) and all(g.chunk == (g.number - 1) // 64 for g in mine)
    assert all(g.o == f"p{g.number - 1:04}" for g in got if g.k == "a") and len({g.part for g in got if g.k == "a"}) > 1
    assert keychunks.number_in_chunks(states.limit(0), ["k"], ["o"], 64).count() == 0


def test_numbered_and_strided(spark):
    df = spark.createDataFrame([(i * 3, "y" if i % 2 else "n") for i in random.Random(2).sample(range(500), 500)], "id int, f string")
    assert [(r.id, r.number) for r in ordered.numbered(df, "id").orderBy("id").collect()] == [(i * 3, i + 1) for i in range(500)]
    assert sorted(r.id for r in reports.strided(df, "id", 10, 3, F.col("f") == "y").collect()) == [3, 63, 123]


def test_bridges_and_pairs(spark):
    rows = [("p1", "private", "Q1", "Iran"), ("p1", "private", "Q1", "Iran"), ("p2", "private", "Q1", "IRAN"), ("u1", "public", "Q1", "Iran"), ("u2", "public", "Q1", ""), ("p1", "private", "Q2", "x"), ("p1", "private", None, "x")]
    df = spark.createDataFrame(rows, "doc_id string, side string, qid string, surface_form string")
    b = {r.qid: r for r in links.build_bridges(df).collect()}
    assert b["Q1"].private == ["p1", "p2"] and b["Q1"].public == ["u1", "u2"] and b["Q2"].public_count == 0
    assert {tuple(r) for r in links.surface_counts(df).collect()} == {("Q1", "Iran", 3), ("Q1", "IRAN", 1), ("Q2", "x", 1)}
    assert [r.qid for r in links.build_bridges(df, 200).collect()] == ["Q1"] == [r.qid for r in links.build_bridges(df, 0).collect()] and links.build_bridges(df, 1).count() == 0
    kept = links.bridge_sides(df)
    days = spark.createDataFrame([("p1", date(2006, 1, 1)), ("u1", date(2006, 2, 1)), ("u2", date(1950, 1, 1)), ("p2", None)], "doc_id string, date date")
    got = {(r.private_id, r.public_id): (r.days_apart, r.same_period) for r in links.pair_documents(kept, days).collect()}
    assert got == {("p1", "u1"): (31, True), ("p1", "u2"): (-20454, False), ("p2", "u1"): (None, False), ("p2", "u2"): (None, False)}
    wide = spark.createDataFrame([("Q", s, f"{s[1]}{i:02d}") for i in range(20) for s in ("private", "public")], "qid string, side string, doc_id string")
    assert sorted(r.private_id for r in links.pair_documents(wide, days, cap=25).collect()) == ["r00"] * 20 + ["r01"] * 5
    with pytest.raises(Exception, match="unknown side"):
        links.build_bridges(df.withColumn("side", F.lit("other"))).collect()


def test_mentions_merge_and_candidates(spark):
    m = spark.createDataFrame([("d", "Q1", "a", 0.9, "ORG", 1), ("d", "Q1", "b", 0.9, "ORG", 2), ("d", "Q2", "c", 0.4, "ORG", 3), ("d", "Q3", "d", 0.9, "DATE", 4), ("d", "Q4", "e", 0.8, None, 5)], "doc_id string, qid string, surface_form string, confidence double, entity_type string, pos int")
    kept = links.keep_mentions(m, 0.5)
    assert sorted(r.surface_form for r in kept.collect()) == ["a", "b", "e"]
    assert sorted(r.surface_form for r in links.best_mentions(kept, ["doc_id", "qid"], ["pos"]).collect()) == ["a", "e"]
    assert links.keep_mentions(m, 0.5, spark.createDataFrame([("Q4",)], "qid string")).count() == 1
    second = spark.createDataFrame([("d", "Q1", "z", 0.9, "ORG", 0), ("d", "Q4", "y", 0.85, "ORG", 0)], m.schema)
    assert sorted(r.surface_form for r in links.merge_links(kept, second, ["doc_id", "qid"], ["pos"]).collect()) == ["a", "y"]
    known = spark.createDataFrame([("A", "Q1", "alias"), ("A", "Q2", "label"), ("B", "Q3", "alias")], "name string, qid string, predicate string")
    names = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    assert {tuple(r) for r in links.labels_over_aliases(names, known).collect()} == {("A", "Q2"), ("B", "Q3")}
    found = spark.createDataFrame([("A", 0, "Q1", ["a"], ["person"], [1960]), ("A", 1, "Q2", ["a"], ["person"], [1950]), ("A", 2, "Q3", ["a"], ["person"], [1950])], "name string, rank int, qid string, label_bag array<string>, kinds array<string>, years array<int>")
    asked = spark.createDataFrame([("A", ["a"], "person", 1950)], "name string, bag array<string>, kind string, year int")
    assert links.verified_search(asked, found).first().qid == "Q2"


def test_temporal(spark):
    docs = spark.createDataFrame([("d", date(2006, 7, 5)), ("n", None)], "doc_id string, date date")
    ents = spark.createDataFrame([("d", "Q1"), ("n", "Q1")], "doc_id string, qid string")
    ev = spark.createDataFrame([(f"e{i:02d}", date(2006, 7, 1 + i), "Q1") for i in range(20)] + [("far", date(2006, 9, 1), "Q1"), ("none", None, "Q1")], "event_id string, date date, qid string")
    lab = spark.createDataFrame([("Q1", "One")], "qid string, label string")
    got = temporal.event_windows(docs, ents, ev, lab, max_share=1.0).collect()
    assert len(got) == 1 and got[0].public_ids == [f"e{i:02d}" for i in range(8)]
    assert temporal.event_windows(docs, ents, ev, lab, max_share=0.5).count() == 0
    c = spark.createDataFrame([("c", date(2005, 3, 1), ["Wirtschaft"], ["Q2", "Q4"])], "doc_id string, date date, topics array<string>, qids array<string>")
    i = spark.createDataFrame([("i", date(2005, 4, 1), "swissair report", ["Wirtschaft"], ["Q2", "Q4"]), ("j", date(2005, 4, 1), "x", ["Energie"], ["Q2"]), ("k", date(2006, 4, 1), "x", ["Wirtschaft"], ["Q2"])], "doc_id string, date date, title string, topics array<string>, qids array<string>")
    known = spark.createDataFrame([("Q2", "Swissair", "swissair", False), ("Q4", "Geneva", "geneva", True)], "qid string, label string, norm string, place boolean")
    p = temporal.topical_pairs(c, i, known, max_share=2).collect()
    assert [tuple(r) for r in p] == [("c", "i", 31, ["Q2", "Q4"], ["Q2"], True)]
    assert temporal.topical_pairs(c, i, known.filter("place"), max_share=2).first().focused is False
    assert one(spark, "PREL,x", temporal.topics_of(F.split("c", ",")), temporal.reports_on(F.lit("Mission Geneva"))) == (["Internationale Politik"], True)


def test_topical_pairs_by_brute_force(spark):
    draw = random.Random(3)
    names = {f"Q{k}": ("Abc" if k == 8 else f"Name{k}") for k in range(9)}  # Q8's label is too short, Q9 has none
    place = {q: k in (1, 2, 5) for k, q in enumerate(names)}
    labels = spark.createDataFrame([(q, n, "" if q == "Q7" else n.lower(), place[q]) for q, n in names.items()], "qid string, label string, norm string, place boolean")
    day = lambda: date(2000, 1, 1) + timedelta(draw.randrange(500)) if draw.random() < 0.95 else None
    topics = lambda: draw.sample(["Energie", "Migration", "Umwelt", "Sport", "Tanz"], draw.randrange(3))
    qids = lambda: draw.sample([f"Q{k}" for k in range(10)], draw.randrange(8))
    cables = [(f"c{k}", day(), topics(), qids()) for k in range(60)]
    items = [(f"i{k}", day(), draw.choice([None, "", *(f"on name{n} and name{m}" for n in range(9) for m in range(9))]), topics(), qids()) for k in range(60)]
    ignored = {q for q in names if sum(q in c[3] for c in cables) > 0.35 * len(cables)}
    want = {}
    for c, a, at, cq in cables:
        for i, b, title, it, iq in items:
            shared = [q for q in cq if q in iq and len(names.get(q, "")) > 3 and q not in ignored]
            if a and b and abs((a - b).days) <= 90 and {*at} & {*it} and shared:
                titled = [q for q in shared if q != "Q7" and names[q].lower() in (title or "").split()][:4]
                good = any(not place[q] for q in shared[:4]) and (any(not place[q] for q in titled) or len(shared) > 1)
                want[c, i] = (abs((a - b).days), shared[:4], titled, good)
    assert ignored and len({len(w[1]) for w in want.values()}) == 4 and len({w[3] for w in want.values()}) == 2
    left = spark.createDataFrame(cables * 2, "doc_id string, date date, topics array<string>, qids array<string>")
    right = spark.createDataFrame(items * 2, "doc_id string, date date, title string, topics array<string>, qids array<string>")
    for wide in (64, 3, 0):
        rows = temporal.topical_pairs(left, right, labels, max_share=0.35, wide=wide).collect()
        assert len(rows) == len(want) and {(r[0], r[1]): tuple(r)[2:] for r in rows} == want
    none = temporal.topical_pairs(left.limit(0), right.limit(0), labels)
    assert none.count() == 0


def test_topical_pairs_are_made_where_documents_meet(spark):
    left = spark.createDataFrame([("c", date(2005, 3, 1), "TAGS: ECON", ["Q2"])], "doc_id string, date date, text string, qids array<string>").withColumn("topics", temporal.topics_of(text.tags_in(F.col("text"))))
    right = spark.createDataFrame([("i", date(2005, 4, 1), "x", ["Wirtschaft"], ["Q2"])], "doc_id string, date date, title string, topics array<string>, qids array<string>")
    labels = spark.createDataFrame([("Q2", "Swissair", "swissair", False)], "qid string, label string, norm string, place boolean")
    plan = temporal.topical_pairs(left, right, labels)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join [qid#")]
    assert "Exchange" not in above and "Aggregate" not in above  # pairs are far more than documents
    assert left.select("topics")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1


def test_graph(spark):
    edges = spark.createDataFrame([("Q1", "party", "Q7"), ("Q2", "party", "Q7"), ("Q1", "employer", "Q8"), ("Q2", "employer", "Q8"), ("Q3", "employer", "Q8"), ("Q3", "party", "Q1")], "qid string, predicate string, neighbour string")
    l = spark.createDataFrame([("d", 0, "Q1", "a", 0.99), ("d", 1, "Q2", "b", 0.99), ("d", 2, "Q3", "c", 0.99), ("d", 3, "Q2", "b", 0.5)], "doc_id string, pos int, qid string, surface_form string, confidence double")
    got = graph.associations(l, edges, edges.select("qid")).collect()
    assert {tuple(r) for r in got} == {("d", "Q1", "Q2", "Q7", "party", 2), ("d", "Q2", "Q3", "Q8", "employer", 3)}  # Q3 points at Q1
    lab = spark.createDataFrame([("Q1", "hosni mubarak"), ("Q2", "alaa mubarak"), ("Q3", "gamal mubarak")], "qid string, norm string")
    size = spark.createDataFrame([("Q1", 107885), ("Q2", 3377), ("Q3", 25491)], "qid string, bytes int")
    m = spark.createDataFrame([(1, "mubarak", "Q2", 0.95), (2, "mubarak", "Q1", 0.95), (3, "mubarak", "Q3", 0.95), (4, "alaa mubarak", "Q2", 0.95)], "mention_id int, norm string, qid string, confidence double")
    assert [(r.mention_id, r.rank, r.bearers) for r in graph.name_candidates(m, lab, lab, size).collect()] == [(1, 2, 3)]
    w = graph.content_words(spark.createDataFrame([("p", "The OSCE media OSCE and official")], "id string, t string"), "id", "t")
    assert {tuple(r) for r in w.collect()} == {("p", "osce", 2), ("p", "media", 1)}
    assert graph.echo(w, w).first().score > 1
    assert one(spark, "", *[graph.margin_verdict(F.lit(g), F.lit(r), F.lit(True)) for g, r in ((2.0, 1.0), (1.0, 1.0), (0.0, 0.0))]) == ("verified", "refuted", "unchecked")


def test_gates(spark):
    schema = "item_id string, question string, answer string, evidence array<struct<side: string>>, provenance map<string, string>"
    rows = [("ok", "Did Ann vote?", "Yes", [("private",), ("public",)], {}), ("bad", "To what extent does the cable name Ann Avon's birthplace 中?", "Mixed", [("private",)], {"withheld": "Ann Avon; "}), ("nul", None, None, None, None), ("leak", "Was the U.N. there?", "u n", [("public",), ("private",)], {})]
    got = {r.item_id: r for r in gates.judged(spark.createDataFrame(rows, schema)).collect()}
    assert got["ok"].accepted and all(got["ok"].gates.values())
    assert {k for k, v in got["bad"].gates.items() if not v} == {"two_sided", "no_source_attribution", "withholds_what_it_was_told_to", "no_foreign_script", "polar_when_the_answer_is_a_verdict"}
    assert not got["nul"].accepted and not got["leak"].gates["answer_not_in_question"]


def test_text(spark):
    assert one(spark, "TAGS: PREL, ETRD, X1\nSUBJECT:  Talks on water \nrest", text.tags_in(F.col("c")), text.subject_of(F.col("c"))) == (["PREL", "ETRD"], "Talks on water")
    cable = "VZCZ ROUTING\nFM EMBASSY\n 1. (SBU) The envoy said so.\nSIPDIS\n\n2. (C//NF) More.\nSMITH"
    assert one(spark, cable, text.narrative_body(F.col("c"))) == ("1.  The envoy said so.\n2.  More.",)
    assert [one(spark, x, text.narrative_body(F.col("c")))[0] for x in ("", " \n", None, "SMITH")] == ["", "", None, "SMITH"]
    assert one(spark, "he met OSTTUGÅRD there", text.written_as(F.lit("Anna Osttugård"), F.col("c")), text.passage_span(F.col("c"), F.lit("zz"))) == ("OSTTUGÅRD", (0, 22))
    assert one(spark, "x" * 20, text.clip(F.col("c"), 10), text.windows(F.col("c"), 8, 2)) == ("x" * 10 + text.CLIPPED, [(0, "x" * 8), (6, "x" * 8), (12, "x" * 8)])
    assert one(spark, "enwiki:Q1:2", text.ref_source(F.col("c")), text.ref_id(F.col("c"))) == ("enwiki", "Q1:2")
    assert one(spark, "<think>a</think> Yes, b", text.strip_reasoning(F.col("c")), text.first_word(F.lit("well: no."), ["Yes", "No"]), text.verdict_of(F.lit(" not ENOUGH evidence"), list(gates.VERDICTS)), text.json_slice(F.lit("so {\"a\": {}} ok"))) == ("Yes, b", "no", "Not enough evidence", '{"a": {}}')
    assert one(spark, "Genève-Zürich", text.fold_ascii("c"), text.name_bag("c"), text.normalise(F.col("c"))) == ("geneve zurich", ["geneve", "zurich"], "gen ve z rich")
    assert one(spark, "", text.record_lines({"b_x": F.lit("1"), "a": F.lit(""), "c": F.lit(None).cast("string")}), text.windows(F.col("c"))) == ("b x: 1", None)


def test_dates(spark):
    d = lambda f, *v: [one(spark, x, f(F.col("c")))[0] for x in v]
    assert d(dates.strict_date, "2006-1-5", "2006-01-15T10:00", "20060115", None, "2006-13-01") == [date(2006, 1, 5), date(2006, 1, 15), None, None, None]
    assert d(dates.lenient_date, "20060115", "2006-01-15T10:00", "x", "15.1.2006") == [date(2006, 1, 15), date(2006, 1, 15), None, None]
    assert d(dates.dotted_date, "31.2.1947", "1947", "5.1947", None) == ["1947-02-31", "1947-01-01", None, None]
    assert d(dates.us_timestamp, "2/28/2005 9:05", "28/2/2005 9:05") == ["2005-02-28T09:05:00", None]
    assert d(dates.odata_date, "/Date(1104537600000+0000)/", "text") == ["2005-01-01", "text"]


def test_reports(spark):
    n = "necessity struct<closed_book: boolean, public_only: boolean, private_only: boolean>"
    rows = [(f"i{i:02d}", "t", f"How many people were {i}", (False, False, i % 4 == 0) if i else None, {"g": i % 2 == 0}) for i in range(24)]
    items = spark.createDataFrame(rows, f"item_id string, question_type string, question string, {n}, gates map<string, boolean>")
    sheet = {(r.section, r.name): r.n for r in reports.datasheet(items).collect()}
    assert sheet["total", "questions"] == 24 and sheet["necessity", "measured"] == 23 and sheet["necessity", "needs_both"] == 18 and sheet["gates", "g"] == 12
    assert {tuple(r) for r in reports.run_alarms(items).collect()} == {("one_type", "t")}
    s = reports.calibration_sample(items).collect()
    assert len(s) == 12 and sum(r.both for r in s) == 7
    assert reports.per_type_sample(items, 5, 1).count() == 5
    f = reports.table_fingerprint(items, ["item_id", "question"]).first()
    assert f == reports.table_fingerprint(items.orderBy(F.desc("item_id")), ["item_id", "question"]).first() and f.rows == 24
    assert reports.table_fingerprint(items.limit(0), ["item_id"]).first().rows == 0
    assert one(spark, "", F.array_join(reports.provenance_problems(F.lit("x"), F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("c"), F.lit("")), F.create_map(F.lit("b"), F.lit(" ")), F.lit(1), F.lit(2)), ",")) == ("unknown kind,unexplained fields,kept keys that are no fields,dropped without a reason,more rows out than in",)


def test_written_tables_are_discarded(spark):
    from pathlib import Path

    from threadloom.session import discard, shared_folder, written

    discard(spark)
    df = written(spark.range(5), "mine")
    assert df.count() == 5 and discard(spark) == 1 and discard(spark) == 0
    assert not list(Path(shared_folder(spark).removeprefix("file://")).glob("mine-*"))
