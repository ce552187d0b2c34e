"""Linking of variant spellings of names to entities (problem 6).

Every spelling meets every entity that it can be read as, however common its names are. A spelling must have a token that
stands for a certain one of the label (a person's family name, a body's first word), and each further token must stand for
another of the label: the longest of these is the second half of the key. Which tokens stand for which is found over the distinct
tokens of either side: by symmetric-delete neighbourhoods (a token and a spelling of it within k edits share a string that k deletions
make of either), and by the first letters of abbreviations. Of entities that cost the same by their key alone the least and the
greatest qid go on, which is enough to see that there are several. Each pair is then scored by an optimal
assignment of its tokens, in which a token may be equal, misspelt, an initial, an abbreviation or a pet name. Pet names are learned
from the spellings: a name that stands before many family names, of which nearly all have a bearer of one given name, and more than
chance would have it, is short for that. A spelling means the entity of least cost, if no other has the same and no token speaks against it.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import written

#: Titles, which no label holds, and words that bind the parts of a body's name.
TITLES = frozenset("prof professor dr doctor hr herr frau mr mrs ms miss mme mlle madame monsieur amb ambassador min minister sir lady lord senator sen gen general col hon rev don dona sig signor senor senora".split())
BINDERS = frozenset("for of the and f de la le les du des der die das fur und et para por e y".split())
#: Edits allowed in a token of at least LONG_ENOUGH letters: more would take neighbouring names for each other. A token of
#: more than LONGEST letters is no word; it is only met by its like.
EDITS, LONG_ENOUGH, LONGEST = 1, 4, 40
#: A pet name's given name has a bearer in this share of the families it stands before, in LEAST_FAMILIES of them, and the
#: chance that any given name had so is exp(-SURE).
PET_SHARE, LEAST_FAMILIES, SURE = 0.8, 3, 7.0


def folded(text: str) -> str:
    """Lower case without accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return plain.replace("ß", "ss").replace("ø", "o").replace("æ", "a").replace("œ", "o").replace("ł", "l")


def letters(plain: str) -> str:
    """A folded word with usual transliterations made alike."""
    # the first letter stays, so that initials tell names apart
    head, rest = plain[:1], plain[1:]
    rest = re.sub(r"off$", "ov", rest).replace("w", "v").replace("y", "i").replace("tz", "cz").replace("qu", "kv")
    return re.sub(r"([aou])e(?=[^aeiou]|$)", r"\1", head + rest).replace("aa", "a")


Token = tuple[str, str]  # with transliterations made alike, and only folded


@functools.lru_cache(maxsize=1 << 17)
def tokens(name: str) -> tuple[Token, ...]:
    """Tokens of a name, without titles and binders; words that stand together (JaneDoe, J.D.) come apart."""
    name = unicodedata.normalize("NFC", name)
    name = re.sub(r"(?<=[a-zà-öø-ÿ]{2})(?=[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ])", " ", name)
    raw = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+", name)
    mixed = any(t[0].isupper() for t in raw)
    kept = [t for t in raw if not (t.lower() in BINDERS and (len(t) > 1 or (mixed and t.islower())))]
    return tuple((letters(p), p) for t in kept if (p := folded(t)) and p not in TITLES)


def edits_allowed(size: int) -> int:
    return EDITS if LONG_ENOUGH <= size <= LONGEST else 0


def deletions(token: Token) -> set[str]:
    """Both forms of the token with EDITS letters left out, or fewer; a short one may be an edit from one of LONG_ENOUGH letters."""
    most = EDITS if len(token[1]) <= LONGEST else 0
    return {"".join(c for i, c in enumerate(t) if i not in gone) for t in token for k in range(most + 1) for gone in map(set, combinations(range(len(t)), k))}


@functools.lru_cache(maxsize=1 << 18)
def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) from a to b, or most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, line = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, line = before, line, [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, line[j - 1] + 1, before[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            line.append(v)
        if min(line) > most and (before is None or min(before) > most):
            return most + 1
    return min(line[-1], most + 1)


def within(short: str, full: str) -> bool:
    """Whether short's letters stand in full in order, the first at its start."""
    at = iter(full)
    return short[0] == full[0] and all(c in at for c in short)


@functools.lru_cache(maxsize=1 << 18)
def token_cost(said: Token, full: Token) -> float | None:
    """What it costs that `said` stands for `full`; None if it can't."""
    if said[0] == full[0] or said[1] == full[1]:
        return 0.0
    a, b = said[1], full[1]
    if len(b) == 1:  # an initial of a label is met by a name that begins so
        return 0.3 if a[0] == b else None
    if len(a) == 1:
        return 0.3 if b[0] == a else None
    most = edits_allowed(max(len(a), len(b)))
    d = min(distance(x, y, most) for x, y in zip(said, full))
    if d <= most:
        return 0.5 * d
    if len(a) < len(b) and (b.startswith(a) or (len(a) <= 5 and within(a, b))):
        return 0.25
    return None


Pets = frozenset[tuple[str, str]]  # (pet name, given name)
#: Names of more tokens are assigned by shortest augmenting paths, since sets of tokens grow too many.
MOST_SETS = 12


def cost_with(said: Token, full: Token, pets: Pets) -> float | None:
    c = token_cost(said, full)
    return 0.2 if c is None and (said[1], full[1]) in pets else c


def assign(said: tuple[Token, ...], full: tuple[Token, ...], pets: Pets = frozenset()) -> list[tuple[float, int, tuple[int, ...]]]:
    """Least cost of giving each token of `said` its own token of `full`, by dynamic programming over sets of tokens.

    For each set of tokens that can be met: cost, the set (as bits) and the partner of each token; none if a token finds none.
    Of names of more than MOST_SETS tokens only the set of least cost is given.
    """
    if len(said) > len(full):
        return []
    if len(full) > MOST_SETS:
        return assign_long(said, full, pets)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for t in said:
        costs = [(j, c) for j, f in enumerate(full) if (c := cost_with(t, f, pets)) is not None]
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for met, (cost, way) in best.items():
            for j, c in costs:
                if not met >> j & 1:
                    new = (cost + c, (*way, j))
                    if new < step.get(met | 1 << j, (9e9, ())):
                        step[met | 1 << j] = new
        best = step
    return [(cost, met, way) for met, (cost, way) in best.items()]


def assign_long(said: tuple[Token, ...], full: tuple[Token, ...], pets: Pets) -> list[tuple[float, int, tuple[int, ...]]]:
    """The same for long names: the Hungarian method, one augmenting path for each token of `said`."""
    barred = 1e6
    costs = np.full((len(said), len(full)), barred)
    for i, t in enumerate(said):
        found = [(j, c) for j, f in enumerate(full) if (c := cost_with(t, f, pets)) is not None]
        if not found:
            return []
        for j, c in found:
            costs[i, j] = c
    rows, columns = np.zeros(len(said) + 1), np.zeros(len(full) + 1)
    owner, back = np.zeros(len(full) + 1, int), np.zeros(len(full) + 1, int)  # 1-based; column 0 begins a path
    for i in range(1, len(said) + 1):
        owner[0], at = i, 0
        least, used = np.full(len(full) + 1, np.inf), np.zeros(len(full) + 1, bool)
        while owner[at]:
            used[at] = True
            reduced = np.append(np.inf, costs[owner[at] - 1] - rows[owner[at]] - columns[1:])
            better = ~used & (reduced < least)
            least[better], back[better] = reduced[better], at
            to = int(np.argmin(np.where(used, np.inf, least)))
            step = least[to]
            rows[owner[used]] += step
            columns[used] -= step
            least[~used] -= step
            at = to
        while at:
            owner[at], at = owner[back[at]], back[at]
    way = [0] * len(said)
    for j in range(1, len(full) + 1):
        if owner[j]:
            way[owner[j] - 1] = j - 1
    cost = float(sum(costs[i, j] for i, j in enumerate(way)))
    return [] if cost >= barred else [(cost, sum(1 << j for j in way), tuple(way))]


def acronym(full: tuple[Token, ...]) -> str:
    return "".join(t[1][0] for t in full)


def run_together(said: tuple[Token, ...]) -> str:
    return "".join(t[1] for t in said)


def cost_of(form: str, label: str, kind: str, pets: Pets = frozenset()) -> float | None:
    """Cost of reading the spelling as the label, or None."""
    said, full = tokens(form), tokens(label)
    if not said or not full:
        return None
    if said == full:
        return 0.0
    joined = run_together(said)
    if kind == "organisation" and len(full) >= 3 and joined == acronym(full):
        return 0.6
    readings = [c for x in assign(said, full, pets) if (c := (person_cost if kind == "person" else body_cost)(said, full, *x)) is not None]
    return min(readings, default=0.4 if joined == run_together(full) else None)


def person_cost(said: tuple[Token, ...], full: tuple[Token, ...], cost: float, met: int, way: tuple[int, ...]) -> float | None:
    """Cost of a person's name with what is left out; the family name, which stands last in labels, must be met, and beside it the given name."""
    name = len(full) - 1
    if not met >> name & 1 or len(said[way.index(name)][1]) < 2 or (len(said) > 1 and not met & 1):
        return None
    missing = [t for j, t in enumerate(full) if not met >> j & 1]
    # a family name alone says nothing of the rest: all its bearers cost the same
    cost += 0.6 if not met & 1 else sum(0.1 if len(t[1]) == 1 else 0.6 for t in missing)
    # given names and initials keep their order
    given = [j for j in way if j != name]
    cost += 0.05 * sum(a > b for a, b in zip(given, given[1:]))
    return cost if cost <= 2.2 else None


def body_cost(said: tuple[Token, ...], full: tuple[Token, ...], cost: float, met: int, way: tuple[int, ...]) -> float | None:
    """Cost of a body's name; its distinctive first token must be met by more than an initial."""
    missing = len(full) - met.bit_count()
    if not met & 1 or len(said[way.index(0)][1]) < 3 or missing > max(1, len(full) - 3):
        return None
    cost += 0.4 * missing
    return cost if cost <= 2.4 else None


#: Marks of what is no word and only met by its like: acronyms, names run together, initials, and nothing.
MARKS = "#=^"


def beside(others: Iterable[Token]) -> str:
    """The longest of the tokens, an initial with its mark; empty if there are none."""
    t = max((t[1] for t in others), key=lambda t: (len(t), t), default="")
    return "^" + t if len(t) == 1 else t


def label_tokens(entities: DataFrame) -> DataFrame:
    """token, besides, qid, label, kind, n: under which keys a label is met; n is the number of its tokens.

    token: the one that a spelling has to meet; besides: each of the others, and their initials. Spellings of one token
    (besides is empty) cost the same for all persons of several names with this family name, and for all bodies of two
    words with this first one; an acronym for all bodies that have it; any spelling for all labels of the same tokens. Of
    such the least and the greatest qid stand for all.
    """
    named = entities.select("qid", "label", "kind").dropna(subset=["qid", "label"]).distinct()

    def cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for qid, label, kind in zip(f["qid"], f["label"], f["kind"]):
                t = tokens(label)
                if not t:
                    continue
                person, words = kind == "person", [x[1] for x in t]
                must, *others = words[::-1] if person else words
                rows += [(must, x, words, qid, label, kind, len(t)) for x in sorted({*others, *("^" + x[0] for x in others)})]
                if person or len(t) <= 2:
                    rows.append((must, "", words if len(t) > MOST_SETS else [str(min(len(t), 2))], qid, label, kind, len(t)))
                if kind == "organisation" and len(t) >= 3:
                    rows.append(("#" + acronym(t), "", [], qid, label, kind, len(t)))
                rows.append(("=" + run_together(t), "", words, qid, label, kind, len(t)))
            yield pd.DataFrame(rows, columns=["token", "besides", "alike", "qid", "label", "kind", "n"])

    rows = named.mapInPandas(cut, "token string, besides string, alike array<string>, qid string, label string, kind string, n int")
    one = F.struct("qid", "label")
    ends = rows.groupBy("token", "besides", "alike", "kind").agg(F.array_distinct(F.array(F.min(one), F.max(one))).alias("ends"), F.max("n").alias("n"))
    return ends.select("token", "besides", "kind", "n", F.explode("ends").alias("e")).select("token", "besides", "e.qid", "e.label", "kind", "n")


def form_tokens(forms: DataFrame) -> DataFrame:
    """surface_form, token, besides, n: a spelling's tokens, each with the longest of the others, their number, and what it is when run together."""

    def cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for form in f["surface_form"]:
                t = tokens(form)
                longest = sorted(t, key=lambda x: (len(x[1]), x[1]))[-2:]
                for x in dict.fromkeys(t):
                    if len(x[1]) > 1:
                        rows.append((form, x[1], beside(longest[:-1] if x == longest[-1] else longest[-1:]), len(t)))
                if t:
                    rows += [(form, mark + run_together(t), "", 0) for mark in "#="]
            yield pd.DataFrame(rows, columns=["surface_form", "token", "besides", "n"])

    return forms.mapInPandas(cut, "surface_form string, token string, besides string, n int")


def abbreviations(full: str) -> set[str]:
    """The first letter with each later one, and with each two later ones in order: how its abbreviations of up to five letters begin."""
    ends: set[str] = set()
    pairs: set[str] = set()
    for c in reversed(full[1:]):
        pairs |= {c + e for e in ends}
        ends.add(c)
    return {full[0] + e for e in ends | pairs}


def neighbours(said: DataFrame, full: DataFrame) -> DataFrame:
    """said, full: the distinct tokens (token) of either side of which the one can stand for the other, by keys that both give.

    Such as are within their edits share a string that deletions make of both, abbreviations and initials their first letters.
    """

    def of_said(t: str) -> set[str]:
        return {t} if t[0] in MARKS else deletions((letters(t), t)) | {"^" + t[0], "~" + t[:3] if len(t) <= 5 else ">" + t[:6]}

    def of_full(t: str) -> set[str]:
        if t[0] in MARKS or len(t) == 1:
            return {t if t[0] in MARKS else "^" + t}
        return deletions((letters(t), t)) | {"~" + x for x in abbreviations(t)} | {">" + t[:6]}

    def near(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            kept = [a == b or (a[0] not in MARKS and token_cost((letters(a), a), (letters(b), b)) is not None) for a, b in zip(f["said"], f["full"])]
            yield f[kept]

    def keys(df: DataFrame, of: Callable[[str], set[str]], name: str) -> DataFrame:
        def cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame([(t, k) for t in f["token"] for k in of(t)], columns=[name, "key"])

        return df.distinct().mapInPandas(cut, f"{name} string, key string")

    halves = full.select("token").union(full.select("besides").filter("besides != '' and not startswith(besides, '^')"))
    return keys(said.select("token"), of_said, "said").join(keys(halves, of_full, "full"), "key").select("said", "full").distinct().mapInPandas(near, "said string, full string")


def meeting(spoken: DataFrame, entry: DataFrame, matched: DataFrame) -> DataFrame:
    """surface_form, qid, label, kind of the pairs to be scored: spellings by form_tokens(), labels by label_tokens() and what stands for what."""
    musts = matched.join(entry.select(F.col("token").alias("full")).distinct(), "full", "left_semi")
    met = spoken.withColumnRenamed("token", "said").join(musts, "said").select("surface_form", F.col("full").alias("token"), "besides", F.col("n").alias("least"))
    word = F.expr("besides != '' and not startswith(besides, '^')")
    by_word = met.filter(word).withColumnRenamed("besides", "said").join(matched, "said").select("surface_form", "token", F.col("full").alias("besides"), "least")
    pairs = met.filter(~word).union(by_word).join(entry, ["token", "besides"]).filter("least <= n")
    return pairs.select("surface_form", "qid", "label", "kind").distinct()


def pet_names(spoken: DataFrame, entities: DataFrame) -> DataFrame:
    """said, given: pet names and what they are short for, learned from the tokens (surface_form, token) of spellings.

    said is no token of any label. Of the families that it stands before PET_SHARE have a bearer of the given name, at
    least LEAST_FAMILIES; and as a family of k given names out of all G has a certain one with chance k/G, these
    chances come to exp(-SURE) or less together.
    """
    def first_and_family(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            t = [tokens(x) for x in f["label"]]
            yield pd.DataFrame([(x[0][1], x[-1][1]) for x in t if len(x) > 1], columns=["given", "family"])

    def unmet(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            kept = [not any(token_cost(t, (letters(given), given)) is not None for t in tokens(form)) for form, given in zip(f["surface_form"], f["given"])]
            yield f.loc[kept, ["said", "given", "family"]]

    people = written(entities.filter("kind = 'person'").select("label").dropna().distinct().mapInPandas(first_and_family, "given string, family string").distinct(), "people")
    given = people.select("given").distinct().count()
    names = people.groupBy("family").agg((F.count(F.lit(1)) / F.lit(float(max(1, given)))).alias("chance"))
    known = people.select(F.explode(F.array("given", "family")).alias("said")).distinct()
    words = spoken.filter("not rlike(token, '^[#=]')").select("surface_form", F.col("token").alias("said"))
    families = words.withColumnRenamed("said", "family").join(names.select("family"), "family", "left_semi")
    before = written(words.join(known, "said", "left_anti").join(families, "surface_form"), "before-families")
    # a name before fewer families can't be told
    enough = before.groupBy("said").agg(F.countDistinct("family").alias("of")).filter(F.col("of") >= LEAST_FAMILIES).select("said")
    seen = before.join(enough, "said", "left_semi").join(people, "family").mapInPandas(unmet, "said string, given string, family string").distinct().join(names, "family")
    families = seen.groupBy("said").agg(F.countDistinct("family").alias("of"))
    told = seen.groupBy("said", "given").agg(F.count(F.lit(1)).alias("n"), F.sum(-F.log("chance")).alias("sure")).join(families, "said")
    good = told.filter((F.col("n") >= LEAST_FAMILIES) & (F.col("n") >= PET_SHARE * F.col("of")) & (F.col("sure") >= SURE))
    # of several given names the one of most families, if there is but one
    top = good.join(good.groupBy("said").agg(F.max("n").alias("n")), ["said", "n"]).groupBy("said").agg(F.min("given").alias("given"), F.max("given").alias("_other"))
    return top.filter("given = _other").select("said", "given")


def link_spellings(forms: DataFrame, entities: DataFrame) -> DataFrame:
    """surface_form, qid, cost: the entity that each distinct spelling means; spellings of strangers have no row.

    Null, empty and wordless spellings have none; of entities that share their least cost none is chosen; entities
    without a qid or label take no part. Empty tables give no rows.
    """
    spoken = written(form_tokens(forms.select("surface_form").dropna().distinct()), "form-tokens")
    entry = written(label_tokens(entities), "name-index")
    matched = written(neighbours(spoken, entry), "name-tokens")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)))
            costs = [cost_of(form, label, kind, frozenset(tuple(x.split(">")) for x in pets or ())) for form, label, kind, pets in rows]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(costs, pa.float64())], ["surface_form", "qid", "cost"])
            yield out.filter(pa.compute.is_valid(out.column(2)))

    costs = lambda df: df.select("surface_form", "qid", "label", "kind", "pets").mapInArrow(score, "surface_form string, qid string, cost double")
    pairs = written(meeting(spoken, entry, matched), "name-pairs")
    plain = written(costs(pairs.withColumn("pets", F.lit(None).cast("array<string>"))), "name-costs")
    # pet names are learned from the spellings that mean nobody so far; what holds one (a few for a name) is met and scored again
    pets = written(pet_names(spoken.join(plain.select("surface_form").distinct(), "surface_form", "left_anti"), entities), "pet-names")
    held = spoken.join(pets.withColumnRenamed("said", "token"), "token").groupBy("surface_form").agg(F.collect_set(F.concat_ws(">", "token", "given")).alias("pets"))
    held = written(held, "held-pets")
    again = meeting(spoken.join(held, "surface_form", "left_semi"), entry, matched.union(pets)).join(held, "surface_form")
    scored = plain.join(held, "surface_form", "left_anti").unionByName(costs(again)).withColumn("cost", F.round("cost", 6))
    # the least and the greatest qid of least cost: the same if there is but one
    least = scored.groupBy("surface_form").agg(F.min(F.struct("cost", "qid")).alias("a"), F.max(F.struct((-F.col("cost")).alias("cost"), "qid")).alias("b"))
    return least.filter("a.qid = b.qid").select("surface_form", F.col("a.qid").alias("qid"), F.col("a.cost").alias("cost"))


def spellings(mentions: DataFrame, associations: DataFrame) -> DataFrame:
    """surface_form: every spelling in mentions and associations."""
    return mentions.select("surface_form").union(associations.select("a_surface")).union(associations.select("b_surface"))


def variants(forms: DataFrame, entities: DataFrame) -> DataFrame:
    """surface_form, qid of each distinct spelling that means an entity and isn't its label letter for letter."""
    linked = link_spellings(forms, entities)
    labels = entities.select("qid", F.col("label").alias("surface_form"))
    return linked.select("surface_form", "qid").join(labels, ["surface_form", "qid"], "left_anti")
