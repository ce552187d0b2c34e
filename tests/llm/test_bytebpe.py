import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import bytebpe
from threadloom.llm.bytebpe import TOKENIZER, BatchEncoder, PieceEncoder, TextEncoder, token_counts, token_ids

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
ODD = ["a", "e", "s", "t", "re", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\u00a0", "é", "²", "!?", "漢", "😀", "\u200b", "\u0301", "the", "<|endoftext|>"]


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(ODD) | st.characters(exclude_categories=["Cs"]), max_size=25).map("".join), max_size=20))
def test_like_the_public_tokenizer(public, texts):
    assert BatchEncoder(TOKENIZER).ids(pa.array(texts, pa.string())).to_pylist() == public(texts)


def test_every_token_is_its_own_encoding():
    v = bytebpe.vocabulary(TOKENIZER)
    assert all(v.piece(w) == [i] for w, i in v.ids.items())


def test_appends_and_edits_are_exact_and_local():
    r = random.Random(5)
    v = bytebpe.vocabulary(TOKENIZER)
    for _ in range(30):
        data = bytes(r.choice(b"abcdethings0123") for _ in range(r.randint(0, 1500)))
        p = PieceEncoder(data=data[:40]).append(data[40:])
        assert p.ids() == v.piece(data)
        before = p.computed
        a = r.randint(0, len(data))
        b = min(len(data), a + r.randint(0, 9))
        new = bytes(r.choice(b"xyzest") for _ in range(r.randint(0, 9)))
        p.replace(a, b, new)
        assert p.data == data[:a] + new + data[b:] and p.ids() == v.piece(p.data)
        assert p.computed - before <= len(data)
    p = PieceEncoder(data=b"ab" * 5000)
    before = p.computed
    p.replace(100, 101, b"z")
    assert p.computed - before < 1000


def test_growing_text(public):
    r = random.Random(2)
    t, text = TextEncoder(), ""
    for _ in range(200):
        part = r.choice(ODD)
        text += part
        t.append(part)
    assert [t.ids()] == public([text])


def test_nulls_long_texts_repeats_and_extra_columns(spark):
    long = "x1" * 60_000 + " end"
    rows = [(1, None, 9), (2, "", 9), (2, "", 9), (None, "it's", 9), (3, long, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in token_ids(df).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2)] == [(1, []), (2, []), (2, [])]
    assert (None, [270, 338]) in got
    words = {i: w for w, i in bytebpe.vocabulary(TOKENIZER).ids.items()}
    assert b"".join(words[i] for i in dict(got)[3]).decode() == long
    assert {r.doc_id: r.tokens for r in token_counts(df, ["doc_id"]).collect()} == {k: len(x) for k, x in got}
    assert token_ids(df.limit(0)).count() == 0
