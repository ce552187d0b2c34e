import pytest

from threadloom.llm import language
from threadloom.llm.broken_pairs import defects, ending, is_copy, is_empty
from tests.llm.test_language import SAID


@pytest.fixture(scope="module")
def weights():
    return language.fit([" ".join(x) for x in SAID.values()], list(SAID))


def test_rules():
    assert all(map(is_empty, [None, "", " \n", "n/a", "null", "<br>", "```\n```", "\u200b", "—", "[]"]))
    assert not any(map(is_empty, ["No", "0", "<b>Yes</b>", "8 days"]))
    q = "Which body counted both Ann Avon and Bob Beal among its members when the quota was set?"
    assert all(is_copy(q, t) for t in (q, q.upper(), "Question: " + q, q[:-1] + ".", q + " " + q, " ".join(q.split()[:-3]) + "?"))
    assert not any(is_copy(q, t) for t in ("Both belonged to the Avon Office for Trade.", "Ann Avon declined to comment, and Bob Beal said it could not help with the quota.", "Yes"))
    assert [ending(t) for t in ("It was so.", "It was so. (sic)", "It was so, and,", "It was…", "Avon Office for Trade", "It was so. Ann Av", "Ann Avon", "8 days", "It was \"", 'He said "no."', "The cost of the")] == ["stop", "stop", "cut", "cut", "label", "cut", "name", "name", "cut", "stop", "open"]


def test_defects(spark, weights):
    ask = "Who heard {} for two hours about the budget, and what was said to the press?"
    who = ["Ann Avon", "Bob Beal", "Cid Coot", "Dot Dane", "Eva Egg", "Fay Fox", "Gus Gray", "Hal Hay", "Ida Ivy", "Jon Jay"]
    good = "The committee heard {} for two hours on the budget. The minister told the press that the budget was already spent."
    answers = [
        "Unfortunately I cannot answer this question, as it concerns confidential matters.", "Unfortunately I cannot answer this question, as it concerns confidential matters.",
        "Cid Coot declined to comment on the budget, and said nothing to the press.", None, "n/a", ask.format("Fay Fox"), "The committee heard Gus Gray for two hours on the budget. The minister told the",
        "Die Kommission hörte den Minister während zweier Stunden an, obwohl niemand darum bat.", "The committee heard Ida Ivy for two hours on the budget", "Yes",
    ]
    rows = [(f"i{i}", ask.format(w), a, None if i == 3 else good.format(w), "x") for i, (w, a) in enumerate(zip(who, answers))]
    items = spark.createDataFrame(rows + rows[:3], "item_id string, question string, answer string, rationale string, defect string")
    got = {tuple(r) for r in defects(items, weights).collect()}
    assert got == {("i0", "answer", "refusal"), ("i1", "answer", "refusal"), ("i3", "answer", "empty"), ("i4", "answer", "empty"), ("i5", "answer", "copied"), ("i6", "answer", "truncated"), ("i7", "answer", "other_language")}
    assert defects(items.limit(0), weights).count() == 0
    long = spark.createDataFrame([(None, None, "word " * 100_000 + "end.", None)], "item_id string, question string, answer string, rationale string")
    assert defects(long, weights).count() in (0, 1)


def shaken(n=120, words=40):
    import random

    rng = random.Random(7)
    base = [f"w{i}" for i in range(words)]
    out = ["alone"]
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(words)] = rng.choice("xyz")
        out.append(" ".join(w))
    return sorted(set(out))


def brute_clusters(raws):
    """Roots by linking every two texts of similarity 0.8 or more."""
    def grams(raw):
        w = raw.split(" ")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [grams(r) for r in raws], list(range(len(raws)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(raws)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {frozenset(raws[i] for i in range(len(raws)) if find(i) == r) for r in {find(i) for i in range(len(raws))}}


@pytest.mark.parametrize("block", [1_000, 7])
def test_clusters_are_those_of_all_pairs(spark, monkeypatch, block):
    from threadloom.llm import broken_pairs

    monkeypatch.setattr(broken_pairs, "BLOCK", block)
    # chains: each is similar to the next only
    long = [f"v{i}" for i in range(80)]
    raws = [*shaken(), *(" ".join(long[i : i + 40]) for i in range(0, 41, 2)), *(" ".join(long[i : i + 40]) + " z" for i in range(0, 41, 4))]
    df = spark.createDataFrame([(f"{i:03}", r) for i, r in enumerate(raws)], "id string, raw string")
    held = broken_pairs.signatures(df)
    roots = {r.id: r.root for r in broken_pairs.clusters(held).collect()}
    got = {}
    for i, r in enumerate(raws):
        got.setdefault(roots.get(f"{i:03}", f"{i:03}"), set()).add(r)
    want = brute_clusters(raws)
    assert 3 < len(want) < len(raws) and {frozenset(x) for x in got.values()} == want
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("b", "a"), ("a", "b"), ("c", "c")]
    roots = dict(map(tuple, broken_pairs.components(spark.createDataFrame(chain, "a string, b string")).collect()))
    assert roots == {f"{i:03}": "000" for i in range(1, 41)} | {"b": "a"}


def read_rows(spark, rows):
    """rows: raw, opening, named, nouns, cue, prompt"""
    return spark.createDataFrame(rows, "raw string, opening string, named boolean, nouns array<string>, cue boolean, prompt bigint")


def test_templates_recur_under_unrelated_prompts_and_give_no_answer(spark):
    from threadloom.llm.broken_pairs import refusal_openings

    asked = spark.createDataFrame([("Avon",)], "word string")
    rows = [
        ("this request falls outside what can be told", "this request falls outside what can be told", False, [], False, 1), ("this request falls outside what can be told", "this request falls outside what can be told", False, [], False, 2),
        ("sorry but this request falls outside what can be told", "sorry but this request falls outside what can be told", False, [], False, 3),  # alone, but with a phrase of the template
        ("one prompt only and no cue", "one prompt only and no cue", False, [], False, 4), ("one prompt only and no cue", "one prompt only and no cue", False, [], False, 4),
        ("alone with a cue", "alone with a cue", False, [], True, 5),
        *[("it was ann avon", "it was n", True, [], False, i) for i in (6, 7)],  # a name, however often
        *[(f"es war die {w}", "es war die n", False, [w.title()], False, i) for i, w in enumerate(["quote", "quote", "rente", "rente"], 8)],  # a slot filled anew
        *[("man fragte in avon danach", "man fragte in n danach", False, ["Avon"], False, i) for i in (12, 13)],  # a capital that questions hold
        *[(f"der rat wird gebeten zu klaren wie die {w} kommt", "der n wird gebeten zu klaren wie die n kommt", False, ["Rat", w.title()], False, 20 + i) for i, w in enumerate(["quote", "rente", "bahn"])],
        *[("der rat wird gebeten zu klaren wie die sperre fur waren kommt", "der n wird gebeten zu klaren wie die n fur n kommt", False, ["Rat", "Sperre", "Waren"], False, i) for i in (30, 31)],  # its phrases are answers'
        (None, None, None, None, None, 9),
    ]
    got = sorted(r.raw for r in refusal_openings(read_rows(spark, rows), asked).collect())
    assert got == ["alone with a cue", "sorry but this request falls outside what can be told", "this request falls outside what can be told"]
    assert refusal_openings(read_rows(spark, rows).limit(0), asked).count() == 0


def test_refusals_are_found_without_any_cue_word(spark, weights, monkeypatch):
    import re

    from threadloom.llm import broken_pairs

    monkeypatch.setattr(broken_pairs, "CUES", re.compile("(?!)"))
    who = ["Ann Avon", "Bob Beal", "Cid Coot", "Dot Dane", "Eva Egg", "Fay Fox"]
    said = ["I would leave that for others to tell you.", "I would leave that for others to tell you.", "As it is, I would leave that for others to tell you.", "It was Dot Dane of the Office for Trade.", "The committee heard Eva Egg for two hours.", "The mission asked whether"]
    items = spark.createDataFrame([(f"i{i}", f"Who heard {w} on the budget?", a, None) for i, (w, a) in enumerate(zip(who, said))], "item_id string, question string, answer string, rationale string")
    assert {r.item_id for r in defects(items, weights).filter("defect = 'refusal'").collect()} == {"i0", "i1", "i2"}


def test_what_an_opening_answers():
    from threadloom.llm.broken_pairs import answers

    none = frozenset()
    assert [answers(x.split(), n, nouns) for x, n, nouns in (("It took 5 weeks", none, False), ("It was he", none, False), ("It was Ann", none, False), ("he asked Ann", frozenset(("Ann",)), True), ("Avon Office", none, False), ("I cannot say what I know", none, False))] == [
        (True, []), (False, []), (True, []), (True, []), (True, []), (False, [])]
    assert answers("Als Assistent kann ich diese Frage nicht beantworten".split(), none, True) == (False, ["Assistent", "Frage"])
    assert answers("Gestern kam Ann T Avon".split(), none, True)[0] and answers("Gestern kam Ann Avon".split(), none, True)[0]


def test_an_opening_is_the_whole_first_sentence(spark, weights):
    from threadloom.llm.broken_pairs import read_responses

    long = "it was said that " * 20
    items = spark.createDataFrame([(e, "answer", "Who heard Ann Avon, and why?", f"{long}{e}.") for e in ("this cannot be discussed", "the quota was set in May")], "item_id string, field_name string, question string, text string")
    assert {r.raw.split(" ", 80)[-1] for r in read_responses(items, weights).collect()} == {"this cannot be discussed", "the quota was set in may"}
