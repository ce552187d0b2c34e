"""Defects of responses to questions (problem 3): empty, copied, refusal, truncated, other_language.

The first sentence of a response is its opening. Openings are clustered by MinHash of their word shingles, each link
verified on the shingles themselves. A cluster that recurs under unrelated prompts and gives no answer (no figure, no
name, no slot that is filled anew from prompt to prompt) is a refusal template, and its members refuse. An opening
that recurs nowhere refuses if it gives no answer either and shares a phrase with such a template. Copies are told by
shingles shared with the question, languages by the classifiers of problem 5, and endings by what ends and what goes
on in all complete sentences of the table: counts of the last words, with shorter contexts where a longer one is
unseen. At most one defect is given to a field, the first in the order above.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from threadloom.llm.language import LANGUAGES, Features, decode
from threadloom.llm.words import Slice, fold
from threadloom.session import parts, written

#: What speaks of declining, in folded English, German and French. They only decide openings that give no
#: answer and share no phrase with any template; without them all others are found alike.
CUES = re.compile(
    r"\b(cannot|can not|can't|won't|unable|not able|not in a position|must (?:decline|refuse)|have to (?:decline|refuse)|declined?:|not have access|no access|not something to be|no comment"
    r"|inappropriate|not appropriate|outside what|beyond what|too sensitive|not (?:permitted|allowed|possible)|against (?:my|our) (?:policy|guidelines)|refrain from|prefer not|rather not|(?:i|we) decline to|won't (?:discuss|answer|comment|share)|do not (?:wish|want) to|could not be shared|cannot be (?:shared|discussed|answered|given)"
    r"|kann (?:ich|man|hier|dazu|hierzu|nicht)|darf (?:ich|man|hier|dazu|hierzu|nicht)|nicht moglich|keine (?:auskunft|angaben|antwort|stellungnahme)|abgelehnt|ablehnen|nicht spekuliert|nicht (?:aussern|beantworten|helfen|besprochen|beantwortet)|verweigert?|kein kommentar|keinen zugang|nicht in der lage|zu heikel|ausserhalb dessen|mochte ich|lieber nicht|nicht (?:kommentieren|eingehen|weitergeben|mitteilen)|muss ich (?:leider )?(?:ablehnen|passen)"
    r"|ne (?:peux|puis|dois|suis|peut|saurais|souhaite)|pas en mesure|pas (?:possible|acces|autorise|approprie)|aucune? (?:commentaire|reponse|information|renseignement)|dois (?:refuser|decliner)|refusee?\s*:|declinee?\s*:|trop sensible|hors de ce|impossible de (?:repondre|commenter)|deplace de|inapproprie|n'ai pas acces|sort du cadre|doit (?:\w+ )?etre (?:refusee?|declinee?|rejetee?)|prefere ne pas|ne pas (?:commenter|repondre|aborder|discuter|speculer|me prononcer|m'exprimer)|ne doit pas|ne saurait)\b|\bdeclined?:|\brefus\b"
)
#: Labels that are answers in every language.
LABELS = frozenset(("yes", "no", "mixed", "not enough evidence"))
#: Whole texts that hold nothing.
NOTHING = frozenset("null none nil na n/a nan undefined tbd todo empty leer aucun aucune br p div nbsp - -- ? ...".split())
SHINGLE, SIMILAR = 5, 0.8
#: MinHash bands and the hashes of each: two openings of similarity 0.8 share a band with probability 0.9996.
BANDS, ROWS = 20, 5
#: Openings of one side that meet in a cell of a band; what the rounding of a product with SIMILAR can come to.
BLOCK, EPSILON = 1_000, 1e-9
#: Share of final among all occurrences of a context from which it can end a sentence.
FINAL_SHARE = 0.1
#: The language that writes nouns with a capital.
NOUNS = LANGUAGES.index("de")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: What may follow a finished sentence: notes in brackets, marks, quotes.
AFTER = re.compile(r"(?:\s*(?:\[[^\]]{0,12}\]|\([^)]{0,12}\)|[*†‡¹²³\"'»”’)\]]))+\s*$")
STOP = re.compile(r"[.!?。][\"'»”’)\]]*$")


def bare(text: str) -> str:
    return re.sub(r"[​‌‍﻿\xa0]", " ", text).strip()


def is_empty(text: str | None) -> bool:
    """No letter or figure but in tags, or a word for nothing."""
    if text is None:
        return True
    plain = re.sub(r"<[^<>]*>|&\w+;", " ", bare(text)).strip().lower()
    return not any(c.isalnum() for c in plain) or plain.strip(" .-–—()[]{}`'\"*_#/\n") in NOTHING


def is_copy(question: str | None, text: str) -> bool:
    """Most of the response's shingles are the question's, and it gives back most of its words."""
    q, t = (fold(x) for x in (question or "", text))
    q, t = WORD.findall(q), WORD.findall(t)
    t = t[1:] if t[:1] in (["question"], ["frage"], ["q"]) else t
    if len(t) < 3 or len(q) < 3:
        return bool(t) and t == q
    grams = {tuple(q[i : i + 3]) for i in range(len(q) - 2)}
    own = [tuple(t[i : i + 3]) for i in range(len(t) - 2)]
    inside = sum(g in grams for g in own) / len(own)
    return inside >= 0.75 and len(set(q) & set(t)) >= 0.6 * len(set(q)) or (inside == 1 and len(t) >= 6 and len(t) >= 0.4 * len(q))


def sentences(text: str) -> list[str]:
    return re.split(r"(?<=[a-zà-ÿ0-9)\]\"'»”’]{2}[.!?])\s+(?=[\"'«„“(]*[A-ZÀ-Þ0-9])", bare(text))


def units(sentence: str) -> list[str]:
    """Words with figures as `#`; a capital is kept, since names are rare words with one."""
    return ["#" if w[0].isdigit() else w for w in WORD.findall(sentence)]


def contexts(words: list[str], at: int) -> list[str]:
    """The longest first: the last three, two and one words up to `at`."""
    return ["\x1f".join(words[max(0, at - k) : at + 1]) for k in (2, 1, 0)]


def capitals(question: str) -> frozenset[str]:
    """The words of a question, but the first, that begin with a capital: its names."""
    return frozenset(w for w in WORD.findall(question)[1:] if w[:1].isupper())


def masked(words: list[str], names: frozenset[str]) -> list[str]:
    """Names of the question, with the initials among them, as one slot N; the rest as it is."""
    out: list[str] = []
    for w in words:
        slot = w in names or (len(w) == 1 and w.isupper() and out[-1:] == ["N"])
        if not slot or out[-1:] != ["N"]:
            out.append("N" if slot else w)
    return out


def answers(words: list[str], names: frozenset[str], nouns: bool) -> tuple[bool, list[str]]:
    """Whether an opening gives a figure, a name of its question or another name; and the capitals that may be names.

    A name is a capital beyond the first word, or two in a row where the language writes its nouns with one (`nouns`): there
    a single capital is a name if questions hold it, which is told later. An opening of nothing but capitals is a name.
    """
    up = [w[:1].isupper() and not (len(w) == 1 or w[1] in "'’") for w in words]
    initial = [len(w) == 1 and w.isupper() for w in words]
    if any(w[0].isdigit() or w in names and u for w, u in zip(words, up)) or not any(w[0].islower() for w in words):
        return True, []
    if not nouns:
        return any(up[1:]), []
    return any((a or i) and b for a, i, b in zip(up[1:], initial[1:], up[2:])), sorted({w for w, u in zip(words[1:], up[1:]) if u})


def capital_context(words: list[str], at: int) -> str:
    """The word before the run of capitals that ends at `at`, which stands for any name."""
    i = at
    while i > 0 and words[i - 1][:1].isupper():
        i -= 1
    return "\x1e" + (words[i - 1] if i else "")


def ending(text: str) -> str:
    """`stop` finished, `cut` surely broken off, `open` to be told by its last words, `name` only names or figures, `label` names bound by one small word."""
    t = bare(text)
    stripped = AFTER.sub("", t).rstrip()
    if STOP.search(stripped) and not re.search(r"(\.\.|…)[\"'»”’)\]]*$", stripped):
        before = re.sub(r"[.!?\"'»”’)\]\s]+$", "", stripped)
        return "cut" if re.search(r"[,;:–—(\[-]$", before) else "stop"
    if re.search(r"(…|\.\.\.|[,;:–—(\[„“«\"/&-])$", t) and not AFTER.search(t):
        return "cut"
    if re.search(r"(…|\.\.\.|\s[\"'„“«(\[])$", t):
        return "cut"
    if STOP.search(t):
        return "stop"
    *before, last = sentences(stripped)
    words = WORD.findall(last)
    if not words:
        return "stop"
    small = [w for w in words if w[0].islower()]
    if len(words) == 2 and words[0][0].isdigit():  # a figure and what it counts
        return "name"
    if not small or (len(small) == 1 and not words[-1][0].islower()):
        # after whole sentences a bare name is the beginning of another
        return "cut" if any(STOP.search(x) for x in before) and not words[-1].isdigit() else "label" if small else "name"
    return "open"


def read_responses(responses: DataFrame, weights: np.ndarray) -> DataFrame:
    """Each response (item_id, field_name, question, text) with what can be told from it alone."""

    def languages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best language and confidences of each whole text."""
        s = Slice(pa.array(texts, pa.string()))
        first = s.text_words()
        scores = Features(s).scores(weights)[s.index]
        upto = np.vstack([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
        sums = upto[first[1:]] - upto[first[:-1]]
        return decode(np.clip(sums[:, :-1] / np.sqrt(np.maximum(1, sums[:, -1:])), -8, 8))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = []
            questions, texts = ([x or "" for x in b.column(i).to_pylist()] for i in (2, 3))
            asked = languages(questions)
            said = languages([re.sub(r"\b[A-ZÀ-Þ]\S*(?: for)?(?= [A-ZÀ-Þ])", " ", t) for t in texts])
            for i, (question, text, given) in enumerate(zip(questions, texts, b.column(3).to_pylist())):
                if is_empty(given):
                    rows.append(("empty", *[None] * 9))
                    continue
                if bare(text).lower().strip(".") in LABELS:
                    rows.append([None] * 10)
                    continue
                if is_copy(question, text):
                    rows.append(("copied", *[None] * 9))
                    continue
                words = units(text)
                small = sum(w[0].islower() and w not in ("for", "of") for w in words)
                best, sure = said[0][i], said[1][i]
                foreign = small >= 3 and best != asked[0][i] and sure[best] >= 0.8 and asked[1][i][asked[0][i]] >= 0.5
                end = ending(text)
                names = capitals(question)
                last = masked(units(sentences(AFTER.sub("", bare(text)))[-1]), names)
                # a name that the question doesn't hold stands for any; a short one may be the beginning of another
                capital = [capital_context(last, len(last) - 1)] if end == "open" and last and len(last[-1]) >= 5 and last[-1][:1].isupper() else []
                first, *more = sentences(text)
                slots = masked(units(first), names)
                template = masked(slots, frozenset(w for w in slots[1:] if w[:1].isupper()))
                named, nouns = answers(WORD.findall(first), names, NOUNS == best)
                rows.append((
                    "other_language" if foreign else None, end if end in ("cut", "label") else None, [*contexts(last, len(last) - 1), *capital] if end in ("open", "label") and last else None,
                    " ".join(map(fold, WORD.findall(first))), " ".join(map(fold, template)), named, nouns, bool(CUES.search(fold(re.sub("’", "'", first)))), xxhash.xxh64_intdigest(question) >> 1, not more,
                ))
            columns = list(zip(*rows)) if rows else [[]] * 10
            types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.bool_(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(columns, types)]], names_out)

    schema = "item_id string, field_name string, plain string, end string, contexts array<string>, raw string, opening string, named boolean, nouns array<string>, cue boolean, prompt bigint, only boolean"
    names_out = [x.split()[0] for x in schema.split(", ")]
    return responses.select("item_id", "field_name", "question", "text").mapInArrow(run, schema)


def context_counts(responses: DataFrame) -> DataFrame:
    """context, ends, goes: how often a context ends a complete sentence, and how often one goes on after it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends: Counter[str] = Counter()
            goes: Counter[str] = Counter()
            for question, text in {x for x in zip(*(c.to_pylist() for c in b.columns)) if x[1]}:
                names = capitals(question or "")
                for s in sentences(text):
                    if not STOP.search(AFTER.sub("", s).rstrip()) or re.search(r"(\.\.|…)$", s):
                        continue
                    words = masked(units(s), names)
                    for i in range(len(words)):
                        final = i == len(words) - 1
                        (ends if final else goes).update(contexts(words, i))
                        if words[i][:1].isupper() and (final or not words[i + 1][:1].isupper()):
                            (ends if final else goes).update([capital_context(words, i)])
            keys = list({**ends, **goes})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([goes[k] for k in keys], pa.int64())], ["context", "ends", "goes"])

    parts = responses.select("question", "text").filter(F.col("text").isNotNull()).mapInArrow(run, "context string, ends bigint, goes bigint")
    return parts.groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))


def broken_off(read: DataFrame, counts: DataFrame) -> DataFrame:
    """item_id, field_name of open endings whose last words don't end sentences elsewhere."""
    open_ = read.filter(F.col("contexts").isNotNull()).select("item_id", "field_name", "end", F.posexplode("contexts").alias("order", "context"))
    met = open_.join(counts, "context", "left").withColumn("seen", F.coalesce(F.col("ends") + F.col("goes"), F.lit(0)))
    at = lambda i, c: F.max(F.when(F.col("order") == i, F.col(c)))
    # of the contexts that were seen the longest decides; a last word never seen was cut itself
    told = met.groupBy("item_id", "field_name").agg(
        F.min(F.when((F.col("order") < 3) & (F.col("seen") >= F.when(F.col("order") == 2, 1).otherwise(2)), F.struct("order", "ends", "seen"))).alias("best"),
        F.max(F.col("end") == "label").alias("label"), at(1, "seen").alias("pair"), at(2, "seen").alias("word"), at(3, "ends").alias("named"), at(3, "seen").alias("names"),
    )
    final = lambda ends, seen: ends >= F.lit(FINAL_SHARE) * seen
    whole = (
        F.when(F.col("label"), F.col("pair") > 0)
        .when((F.col("names") > 0) & (F.col("word") > 0) & final(F.col("named"), F.col("names")), True)
        .otherwise(F.col("best").isNotNull() & final(F.col("best.ends"), F.col("best.seen")))
    )
    return told.filter(~whole).select("item_id", "field_name")


def signatures(openings: DataFrame) -> DataFrame:
    """openings with a column raw, and their shingles `grams` (sorted hashes) and MinHash `bands` (one hash a band)."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        r = np.random.RandomState(11)
        factor, shift = (r.randint(0, 1 << 62, BANDS * ROWS, np.int64).astype(np.uint64)[:, None] for _ in "ab")
        factor |= np.uint64(1)
        for f in frames:
            grams = []
            for raw in f["raw"]:
                w = raw.split(" ")
                grams.append(sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + SHINGLE])) >> 1 for i in range(max(1, len(w) - SHINGLE + 1))}))
            bands: list[list[int]] = []
            for at in range(0, len(grams), 512):
                part = grams[at : at + 512]
                begins = np.cumsum([0, *map(len, part[:-1])])
                with np.errstate(over="ignore"):
                    least = np.minimum.reduceat((np.concatenate([np.array(g, np.uint64) for g in part]) * factor + shift) >> np.uint64(20), begins, axis=1)
                rows = np.ascontiguousarray(least.T).reshape(len(part), BANDS, ROWS)
                bands += [[xxhash.xxh64_intdigest(x.tobytes(), seed=i) >> 1 for i, x in enumerate(row)] for row in rows]
            yield f.assign(grams=grams, bands=bands)

    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in openings.schema)
    return openings.mapInPandas(run, kinds + ", grams array<bigint>, bands array<bigint>")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those pairs (a, b) of ids of held (id, grams) that share at least SIMILAR of their shingles."""
    grams = lambda side: held.select(F.col("id").alias(side), F.col("grams").alias(f"grams_{side}"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    whole = pairs.join(grams("a"), "a").join(grams("b"), "b")
    return whole.filter(shared >= SIMILAR * (F.size("grams_a") + F.size("grams_b") - shared) - EPSILON).select("a", "b")


def clusters(held: DataFrame) -> DataFrame:
    """id, root: the components of the similar ones among held (id, grams, bands), but for those that have no like.

    First each opening of a band's bucket is compared with the least of the bucket, which is linear in its size. Only in
    buckets that these links leave in several components do members of different ones meet, in blocks of about BLOCK on
    one side; so no link between components is lost, and a bucket that is one cluster is never paired out.
    """
    each = held.select("id", F.size("grams").alias("size"), F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = written(each.join(shared, "band"), "buckets")
    stars = written(verified(met.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), held), "links")
    roots = components(stars)
    named = met.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = named.groupBy("band").agg(F.min("root").alias("_least"), F.max("root").alias("_most"), F.floor(F.count(F.lit(1)) / BLOCK).alias("blocks")).filter("_least <> _most")
    apart = named.join(mixed.select("band", "blocks"), "band")
    left = apart.select("band", F.expr("pmod(xxhash64(id), blocks + 1)").alias("block"), F.col("id").alias("a"), F.col("root").alias("root_a"), F.col("size").alias("m"))
    right = apart.select("band", F.explode(F.sequence(F.lit(0).cast("bigint"), "blocks")).alias("block"), F.col("id").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("n"))
    fit = (F.col("root_a") < F.col("root_b")) & (F.least("m", "n") >= SIMILAR * F.greatest("m", "n") - EPSILON)
    further = written(verified(left.join(right, ["band", "block"]).filter(fit).select("a", "b").distinct(), held), "links")
    return components(stars.union(further)) if further.take(1) else roots


def components(links: DataFrame) -> DataFrame:
    """id, root: of each id in links (a, b) the least id that it is linked with, over any number of links.

    Large and small stars in turn until nothing changes; each round is written, so lineage stays short.
    """
    def kept(found: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        return written(found.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id", "root").cast("decimal(38,0)")).alias("h")), "links"), tuple(seen.get.values())

    (edges, state), before = kept(links.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("root")).filter("id <> root").distinct()), None
    while state != before:
        before = state
        both = edges.union(edges.select("root", "id")).toDF("u", "v")
        large = both.filter("v > u").join(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges, state = kept(small.select(F.explode(F.array("u", "v")).alias("id"), F.col("m").alias("root")).filter("id <> root").distinct())
    return edges


def refusal_openings(read: DataFrame, asked: DataFrame) -> DataFrame:
    """raw of each opening that refuses, of read_responses() and the words (word) that questions write with a capital.

    Openings equal word for word are counted first; the components of verified links are clusters. A cluster that stands
    under two prompts or more is a template. Where names are slots of the opening, it must be filled alike: of all openings
    that differ in slots only, its cluster must hold more than half, else the slot is the answer. Nor may it share a
    phrase that stands in more answers than other openings.
    """
    texts = read.filter(F.col("raw").isNotNull()).groupBy("raw", "opening").agg(
        F.min("prompt").alias("one"), F.max("prompt").alias("other"), F.count(F.lit(1)).alias("times"), F.max("named").alias("named"), F.max("cue").alias("cue"), F.max("nouns").alias("nouns")
    )
    texts = written(texts.withColumn("id", F.xxhash64("raw")), "openings")
    distinct = texts.groupBy("id").agg(F.min("raw").alias("raw"), F.min("one").alias("one"), F.max("other").alias("other"), F.max("named").alias("named"), F.max("cue").alias("cue"), F.max("nouns").alias("nouns"))
    held = written(signatures(distinct.select("id", "raw")).drop("raw"), "signatures")
    rooted = distinct.join(clusters(held), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = written(rooted, "rooted")
    recurs = rooted.groupBy("root").agg((F.min("one") != F.max("other")).alias("recurs"))
    slots = texts.join(rooted.select("id", "root"), "id").groupBy("opening", "root").agg(F.sum("times").alias("n"))
    varied = slots.groupBy("opening").agg(F.max("n").alias("top"), F.sum("n").alias("n")).filter("top * 2 <= n")
    varying = texts.join(varied, "opening", "left_semi").select("id").distinct()
    owned = rooted.select("id", F.explode("nouns").alias("word")).join(asked, "word", "left_semi").select("id").distinct()
    free = rooted.filter(~F.col("named")).join(owned, "id", "left_anti").join(varying, "id", "left_anti").join(recurs, "root").select("id", "raw", "recurs", "cue")
    free = written(free, "free")
    grams = held.select("id", F.explode("grams").alias("gram")).join(free.select("id", F.lit(1).alias("_free")), "id", "left")
    of_answers = grams.groupBy("gram").agg(F.count("_free").alias("n"), F.count(F.lit(1)).alias("all")).filter("all > 2 * n")
    own = grams.filter("_free = 1").select("id", "gram")
    empty = written(free.join(own.join(of_answers, "gram", "left_semi").select("id").distinct(), "id", "left_anti"), "empty")
    phrases = own.join(empty.filter("recurs").select("id"), "id", "left_semi").select("gram").distinct()
    near = own.join(empty.filter(~F.col("recurs")).select("id"), "id", "left_semi").join(phrases, "gram", "left_semi").select("id").distinct()
    alone = empty.filter(~F.col("recurs")).join(near.withColumn("near", F.lit(True)), "id", "left").filter(F.coalesce("near", "cue"))
    return empty.filter("recurs").select("raw").union(alone.select("raw"))


def defects(items: DataFrame, weights: np.ndarray) -> DataFrame:
    """item_id, field_name, defect. weights: the fitted classifiers of language.fitted.

    A null answer is empty and a null rationale no case; repeated rows give one row; a null item_id keeps its row. Very
    long texts are read whole. Fields without a defect and empty tables give no rows.
    """
    fields = F.array(F.struct(F.lit("answer").alias("field_name"), F.col("answer").alias("text")), F.struct(F.lit("rationale").alias("field_name"), F.col("rationale").alias("text")))
    responses = items.select("item_id", "question", F.inline(fields)).filter((F.col("field_name") == "answer") | F.col("text").isNotNull()).distinct()
    responses = responses.repartition(parts(items.sparkSession), "item_id", "field_name")
    read = written(read_responses(responses, weights), "responses")
    # words with a capital that don't begin the question
    asked = items.select(F.explode(F.regexp_extract_all("question", F.lit(r"(?<=\s)\p{Lu}[\p{L}'’]+"), F.lit(0))).alias("word")).distinct()
    # read by both what refuses and what is left of the broken off ones
    cut = written(read.filter(F.col("end") == "cut").select("item_id", "field_name").union(broken_off(read, context_counts(responses))), "cut")
    refused = read.filter(F.col("plain").isNull() | (F.col("plain") == "other_language")).join(refusal_openings(read, asked), "raw", "left_semi").select("item_id", "field_name", "only")
    # a response of one sentence that breaks off has not said yet what it is
    broken = cut.select(F.col("item_id").alias("i"), F.col("field_name").alias("f"))
    refused = refused.join(broken, F.col("only") & F.col("item_id").eqNullSafe(F.col("i")) & (F.col("field_name") == F.col("f")), "left_anti").select("item_id", "field_name", F.lit(2).alias("rank"), F.lit("refusal").alias("defect"))
    ranks = {"empty": 0, "copied": 1, "refusal": 2, "truncated": 3, "other_language": 4}
    plain = read.filter(F.col("plain").isNotNull()).select("item_id", "field_name", F.when(F.col("plain") == "empty", 0).when(F.col("plain") == "copied", 1).otherwise(ranks["other_language"]).alias("rank"), F.col("plain").alias("defect"))
    every = plain.union(refused).union(cut.select("item_id", "field_name", F.lit(ranks["truncated"]), F.lit("truncated")))
    return every.groupBy("item_id", "field_name").agg(F.min(F.struct("rank", "defect")).alias("d")).select("item_id", "field_name", F.col("d.defect").alias("defect"))
