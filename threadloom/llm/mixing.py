"""Mixing sources to target shares of tokens (problem 8).

Documents are counted by source and exact token length. The size of the mix is the greatest at which each
source that has documents reaches its share within its repeats. A source is repeated whole as often as
its budget holds it; the rest of the budget is fitted by a bounded knapsack over the length counts: an even part
of each length first, then the longest that fit, then exact dynamic programming over what is left, which is WINDOW
tokens or the lengths of a few of the longest documents. Sources are fitted each in a task of its own, and documents are then chosen
by length count in the order of a seeded hash.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.bytebpe import TOKENIZER, token_counts
from threadloom.operators.keychunks import number_rows
from threadloom.session import written

#: Tokens over which the remaining budget is fitted exactly, if no document is longer.
WINDOW = 1 << 16
#: Targets of more sources aren't a list of targets; they are refused.
MOST_TARGETS = 10_000
SEED = 7


def fit_exactly(counts: Mapping[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the greatest within budget; dynamic programming."""
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by = np.full(budget + 1, -1, np.int32)  # the item that first reached a sum
    items: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if 0 < x <= budget), reverse=True):
        left, part = min(counts[length], budget // length), 1
        while left and not reach[budget]:  # counts in powers of two
            take = min(part, left)
            left, part, size = left - take, part * 2, take * length
            if size > budget:
                continue
            new = np.zeros_like(reach)
            new[size:] = reach[:-size]
            new &= ~reach
            by[new] = len(items)
            items.append((length, take))
            reach |= new
        if reach[budget]:
            break
    at, out = int(np.flatnonzero(reach)[-1]), {}
    while at:
        # sums were first reached by later items from sums reached earlier
        length, take = items[by[at]]
        out[length] = out.get(length, 0) + take
        at -= length * take
    return out


def fit_budget(counts: Mapping[int, int], budget: int, window: int = WINDOW) -> dict[int, int]:
    """How many documents of each token length make up the budget, as nearly as they can from below.

    What is left for the exact fit is at least half the window and twice the longest length (or the whole budget), and
    less than a window and three times that length, since the even part and the longest that fit take all beyond.
    """
    total = sum(n * k for n, k in counts.items())
    if budget >= total:
        return dict(counts)
    kept = max(window // 2, 2 * max(counts))
    share = max(0, budget - kept) / max(1, total)
    taken = {n: int(k * share) for n, k in counts.items() if n > 0}
    left = budget - sum(n * k for n, k in taken.items())
    for n in sorted(taken, reverse=True):
        more = min(counts[n] - taken[n], (left - kept) // n)
        if more > 0:
            taken[n] += more
            left -= more * n
    rest = {n: counts[n] - k for n, k in taken.items() if counts[n] > k}
    for n, k in fit_exactly(rest, left).items():
        taken[n] += k
    return {n: k for n, k in taken.items() if k}


def budgets(have: Mapping[str, int], targets: Mapping[str, tuple[float, int]], total: int | None = None) -> dict[str, tuple[int, int, int]]:
    """Of each source: target tokens, whole passes, and tokens of the pass that is in part.

    Without `total` it is the greatest size at which every source that has tokens and a share keeps within its repeats.
    With one, a source that can't reach its share gives all it may.
    """
    live = {s for s, (share, cap) in targets.items() if share > 0 and cap > 0 and have.get(s, 0) > 0}
    if total is None:
        total = int(min((have[s] * targets[s][1] / targets[s][0] for s in live), default=0))
    out = {}
    for s, (share, cap) in targets.items():
        goal = int(round(share * total)) if share > 0 else 0
        out[s] = (goal, *divmod(min(goal, have[s] * cap), have[s])) if s in live else (goal, 0, 0)
    return out


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, most repeats); a null share is 0, a null cap 1. More than MOST_TARGETS sources are an error."""
    rows = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).filter(F.col("source").isNotNull()).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError("too many targets")
    return {r.source: (max(0.0, r.share or 0.0), 1 if r.cap is None else max(0, r.cap)) for r in rows}


def counted(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of each document with tokens and a source; repeated rows count once."""
    rows = token_counts(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), ["doc_id", "source"], path=path)
    return written(rows.filter((F.col("tokens") > 0) & F.col("source").isNotNull() & F.col("doc_id").isNotNull()).distinct(), "token-counts")


def planned(tokens: DataFrame, targets: DataFrame, total: int | None) -> tuple[dict[str, tuple[float, int]], dict[str, int], dict[str, tuple[int, int, int]], DataFrame]:
    """Targets, tokens of each source, budgets(), and source, tokens, extra: how many documents of each length the part passes take.

    One row a target reaches the driver. The length counts of a source are as many as lengths occur in it, and are fitted in one task.
    """
    spark = tokens.sparkSession
    goals = read_targets(targets)
    named = F.broadcast(spark.createDataFrame([(s,) for s in goals], "source string"))
    lengths = written(tokens.join(named, "source").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "lengths")
    have = {r.source: r.have for r in lengths.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("have")).collect()}
    chosen = budgets(have, goals, total)
    rest = F.broadcast(spark.createDataFrame([(s, part) for s, (_, _, part) in chosen.items() if part], "source string, part bigint"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        made = fit_budget(dict(zip(rows["tokens"].tolist(), rows["n"].tolist())), int(rows["part"].iloc[0]))
        return pd.DataFrame({"source": rows["source"].iloc[0], "tokens": list(made), "extra": list(made.values())}).astype({"tokens": "int64", "extra": "int64"})

    return goals, have, chosen, written(lengths.join(rest, "source").groupBy("source").applyInPandas(fit, "source string, tokens bigint, extra bigint"), "parts")


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens and copies (1 or more) of each document of the mix.

    Documents without tokens, a source, a doc_id or a target for their source are left out, as are sources
    with a share or repeats of 0. Empty tables give no rows. The same seed gives the same mix.
    """
    spark = docs.sparkSession
    tokens = counted(docs, path)
    _, _, chosen, parts = planned(tokens, targets, total)
    passes = spark.createDataFrame([(s, p) for s, (_, p, _) in chosen.items() if p], "source string, passes bigint")
    keyed = tokens.withColumn("order", F.xxhash64(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))))
    numbered = number_rows(keyed.select("source", "tokens", "doc_id", "order"), ["source", "tokens"], ["order", "doc_id"])
    part = numbered.join(parts, ["source", "tokens"], "left").withColumn("more", F.when(F.col("number") <= F.col("extra"), 1).otherwise(0))
    copies = part.join(F.broadcast(passes), "source", "left").withColumn("copies", F.coalesce("passes", F.lit(0)) + F.col("more"))
    return copies.filter("copies > 0").select("doc_id", "source", "tokens", F.col("copies").cast("int").alias("copies"))


def shares(docs: DataFrame, targets: DataFrame, total: int | None = None, path: str = TOKENIZER) -> DataFrame:
    """One row for each target: source, target_share, max_repeats, available and mixed tokens, actual_share and repeats (mixed by available)."""
    tokens = counted(docs, path)
    goals, have, chosen, parts = planned(tokens, targets, total)
    fitted = {r.source: r.n for r in parts.groupBy("source").agg(F.sum(F.col("tokens") * F.col("extra")).alias("n")).collect()}
    mixed = {s: passes * have.get(s, 0) + fitted.get(s, 0) for s, (_, passes, _) in chosen.items()}
    every = sum(mixed.values())
    rows = [(s, share, cap, have.get(s, 0), chosen[s][0], mixed[s], mixed[s] / every if every else 0.0, mixed[s] / have[s] if have.get(s) else 0.0) for s, (share, cap) in sorted(goals.items())]
    return docs.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, available bigint, target_tokens bigint, mixed bigint, actual_share double, repeats double")
