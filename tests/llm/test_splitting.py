from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm.splitting import corpus_items, oversized, pieces, split_items, with_settings


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", ". ", "\n\n", "\n", ", ", "é", "漢", "😀", "x" * 30])).map("".join), st.integers(1, 40), st.integers(-1, 45))
def test_pieces_are_within_the_limit_cover_and_overlap(text, limit, overlap):
    spans = pieces(text, limit, overlap)
    if not text:
        assert spans == []
        return
    over = min(max(0, overlap), limit - 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    assert all(c == max(0, b - over) and d > b for (_, b), (c, d) in zip(spans, spans[1:]))
    assert len(spans) == 1 or len(text) > limit


def test_strongest_joint_near_the_middle():
    text = "a" * 40 + ". " + "b" * 6 + "\n\n" + "c" * 50
    assert pieces(text, 60, 0) == [(0, 50), (50, 100)]
    assert pieces("one two three four. five six seven eight", 25, 0)[0] == (0, 20)
    assert all(b - a <= 50 for a, b in pieces("x" * 1000, 50, 7))
    assert len(pieces("." * 200_000, 4000, 250)) < 120 and len(pieces(" " * 200_000, 4000, 250)) < 120
    assert len(pieces("word and, more. " * 200_000, 4000, 250)) < 2000


def test_limits_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x" * 30, 1), (2, None, "x" * 30, 1), (3, "zz", "x" * 12, 1), (4, "a", None, 1), (5, "a", "", 1), (1, "a", "x" * 30, 1)], "doc_id bigint, source string, text string, limit int")
    cand = spark.createDataFrame([("i", "a:7", "y" * 9), ("j", None, "y" * 9), ("k", "a:7", None)], "item_id string, private_id string, passage string")
    sets = spark.createDataFrame([("a", 20, 8, 3), ("*", 40, 9, 2), (None, 1, 1, 1)], "source string, max_chars int, passage_chars int, overlap_chars int")
    items = corpus_items(docs, cand, sets)
    assert sorted(map(tuple, oversized(items).collect())) == [("candidates", "i"), ("documents", "1")]
    rows = split_items(items).filter("item_key = '1'").orderBy("piece").collect()
    assert len(rows) == 4 and all(len(r.text) == r.chars <= 20 for r in rows) and {r.piece for r in rows} == {1, 2}
    assert rows[2].first_char == rows[0].chars - 3
    bare = with_settings(docs.selectExpr("'d' item_table", "'1' item_key", "source", "text"), sets.limit(0), "max_chars")
    assert split_items(bare).count() == 0 and split_items(items.limit(0)).count() == 0


def test_a_run_that_fits_a_piece_is_not_cut():
    for lead, run, tail, most in ((500, 1100, 500, 1900), (754, 3691, 0, 3750), (400, 700, 400, 1000), (0, 900, 300, 1000), (300, 1000, 0, 1000), (3000, 999, 3000, 1000)):
        text = "w " * (lead // 2) + "x" * run + " w" * (tail // 2)
        spans = pieces(text, most, 0)
        assert all(b - a <= most for a, b in spans) and spans[-1][1] == len(text)
        assert any(a <= lead and lead + run <= b for a, b in spans), (lead, run, spans)
    # a longer run is cut as seldom as can be, and long texts don't take long
    assert pieces("w " * 50 + "x" * 1300 + " w" * 50, 1000, 0) == [(0, 750), (750, 1500)]
    assert len(pieces("a b " + "x" * 2_000_000, 4000, 250)) < 1100
