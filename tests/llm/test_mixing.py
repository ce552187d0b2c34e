import random
from itertools import product

import pytest

from threadloom.llm import mixing
from threadloom.llm.mixing import budgets, fit_budget, fit_exactly, mix, shares


def test_exact_fit_against_brute_force():
    r = random.Random(3)
    for _ in range(40):
        counts = {n: r.randint(1, 3) for n in r.sample(range(1, 40), r.randint(0, 4))}
        budget = r.randint(0, 90)
        best = max(s for s in (sum(n * k for n, k in zip(counts, ks)) for ks in product(*(range(c + 1) for c in counts.values()))) if s <= budget)
        got = fit_exactly(counts, budget)
        assert sum(n * k for n, k in got.items()) == best and all(0 < k <= counts[n] for n, k in got.items())


def test_large_budgets_are_met_to_the_token():
    r = random.Random(1)
    counts = {n: r.randint(1, 50) for n in range(20, 900, 3)}
    total = sum(n * k for n, k in counts.items())
    for budget in (0, 19, total // 3, total - 21, total, total + 5):
        got = fit_budget(counts, budget, window=4096)
        used = sum(n * k for n, k in got.items())
        assert all(0 < k <= counts[n] for n, k in got.items()) and used <= budget
        assert used == min(total, budget) or budget < 20 or budget > total - 22


def test_lengths_above_the_window():
    assert fit_budget({150000: 5}, 160000) == {150000: 1}
    assert sum(n * k for n, k in fit_budget({140000: 50, 9: 3}, 700027).items()) == 700027
    r = random.Random(5)
    for _ in range(60):
        counts = {n: r.randint(1, 4) for n in r.sample(range(30, 200), r.randint(1, 4))}
        every = [sum(n * k for n, k in zip(counts, ks)) for ks in product(*(range(c + 1) for c in counts.values()))]
        for budget in (r.randint(0, 2 * max(counts)), r.randint(0, sum(n * k for n, k in counts.items()))):
            got = fit_budget(counts, budget, window=16)
            used, best = sum(n * k for n, k in got.items()), max(s for s in every if s <= budget)
            assert all(0 < k <= counts[n] for n, k in got.items()) and used <= budget
            assert used == best if budget <= 2 * max(counts) else used >= best - max(counts)


def test_budgets_keep_within_repeats(spark):
    have = {"a": 100, "b": 20, "x": 9}
    assert budgets(have, {"a": (0.5, 1), "b": (0.5, 3), "none": (0.0, 2)}) == {"a": (60, 0, 60), "b": (60, 3, 0), "none": (0, 0, 0)}
    assert budgets({"a": 100}, {"a": (1.0, 2)}, total=1000)["a"][1:] == (2, 0)
    assert budgets({}, {"a": (1.0, 2)}) == {"a": (0, 0, 0)}
    many = spark.range(mixing.MOST_TARGETS + 1).selectExpr("cast(id as string) as source", "0.1 as target_share", "1 as max_repeats")
    with pytest.raises(ValueError, match="too many targets"):
        mixing.read_targets(many)


def test_mix_and_shares(spark):
    docs = [(i, "a" if i % 3 else "b", "word " * (5 + i % 7), "x") for i in range(60)] + [(90, None, "word", "x"), (91, "a", None, "x"), (92, "zz", "word", "x"), (None, "a", "word", "x"), (1, "a", "word " * 6, "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, tokens string")
    t = spark.createDataFrame([("a", 0.25, 2), ("b", 0.75, 3), ("c", 0.0, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mix(d, t).collect()
    report = {r.source: r for r in shares(d, t).collect()}
    for s, cap in (("a", 2), ("b", 3)):
        mine = [r for r in got if r.source == s]
        assert sum(r.tokens * r.copies for r in mine) == report[s].mixed and max(r.copies for r in mine) <= cap
        assert len({r.doc_id for r in mine}) == len(mine)
    assert abs(report["b"].actual_share - 0.75) < 0.02 and report["b"].repeats == 3.0 and report["c"].mixed == 0
    assert sorted(map(tuple, mix(d, t).collect())) == sorted(map(tuple, got))
    assert mix(d.limit(0), t).count() == 0 and mix(d, t.limit(0)).count() == 0
