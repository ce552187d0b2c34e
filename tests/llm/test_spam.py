import random

from threadloom.llm.spam import list_pages, pages

WORDS = ["visa", "permit", "notary", "courier", "stamp", "broker", "passport", "archive"]
PROSE = "The committee heard the minister for two hours on the budget, and asked that the remark stay between them. "


def table(spark, texts):
    rows = [(i, t, f"host {i % 4}", "web", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, origin string, source string, chars string")


def test_lists_links_and_tags_are_found_prose_figures_and_codes_are_not(spark):
    lists = [" ".join(WORDS[(i * 3 + j * (i + 1)) % 8] for j in range(60)) for i in range(8)]
    links = " | ".join(f"https://www.a{i}.example/p/{i}" for i in range(20))
    tags = " ".join(f"#{w}{p}" for w in WORDS for p in ("Avon", "Beal"))
    goods = "\n".join(f"SKU-{i:04d} | {w} | fast | A{i % 5} | {i}%" for i, w in enumerate(WORDS * 2))
    cases = [*lists, links, tags, goods, PROSE + " ".join(lists[:2])]
    others = [None, "", " \n ", PROSE * 3, PROSE * 4 + " ".join(WORDS), "\n".join("12\t345\t6789" for _ in range(30)), "QX7Z" * 500, PROSE + "1010" * 300]
    got = {r.doc_id for r in list_pages(table(spark, cases + others)).collect()}
    assert got == set(range(len(cases)))


def test_repeated_rows_nulls_and_empty_tables(spark):
    df = table(spark, [" ".join(WORDS * 8)]).selectExpr("cast(null as bigint) as doc_id", "text", "cast(null as string) origin", "cast(null as string) source", "text as listed")
    assert list_pages(df.union(df)).count() == 2
    assert list_pages(df.limit(0)).count() == 0
    assert pages(df).first().host is None  # no origin, source or id


def test_long_text(spark):
    assert list_pages(table(spark, ["visa notary " * 100_000])).count() == 1


def test_replicated_phrases_are_counted_by_hosts(spark):
    rng = random.Random(3)
    lists = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(8)]
    links = ["\n".join(f"{w} (https://www.docline{i}{j}.example/p/{i}{j})" for j, w in enumerate(WORDS)) for i in range(4)]
    tags = [" ".join(f"#{w.title()}{p}" for w in WORDS for p in ("Avon", f"Beal{i}")) for i in range(4)]
    rows = {r.doc_id: r for r in list_pages(table(spark, [*lists, *links, *tags])).collect()}
    assert len(rows) == 16 and all(r.replicated * 2 > r.chars and r.replicated <= r.evidence <= r.listed <= r.chars for r in rows.values())
    # the same pages on one host, and a page of its own
    same = table(spark, lists).selectExpr("doc_id", "text", "'one' as origin", "source")
    assert {r.replicated for r in list_pages(same).collect()} == {0}
    # phrases that every page has are matched without a shuffle, and give the same
    from threadloom.llm import spam

    before = spam.MOST_HOT
    try:
        spam.MOST_HOT = 1
        many = table(spark, [*lists, *links, *tags] * 30)
        assert {r.doc_id % 16: r.replicated for r in list_pages(many).collect()} == {i: r.replicated for i, r in rows.items()}
    finally:
        spam.MOST_HOT = before
