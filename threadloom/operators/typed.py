"""Typed candidates: each builder gives every candidate with the reason for which it is dropped, or null.

Counting the reasons is a group-by; keeping the good ones a filter. Texts and articles are joined by key; models
are injected as functions over partitions, never called from here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import first_word, json_slice, normalise, passage_span, strip, strip_reasoning, verdict_of, written_as
from threadloom.operators.gates import VERDICTS


def reasons(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that holds."""
    out: Column | None = None
    for name, failed in checks:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def names(text: Column, label: Column) -> Column:
    """Whether the normalised text holds the normalised label, an empty one included: substring, not whole words."""
    return F.contains(normalise(text), normalise(label))


def with_texts(rows: DataFrame, texts: DataFrame, key: str, as_: str) -> DataFrame:
    """Left join of texts (id, text) on a key of rows."""
    return rows.join(texts.select(F.col("id").alias(key), F.col("text").alias(as_)), key, "left")


def from_association(candidates: DataFrame, texts: DataFrame, articles: DataFrame, labels: DataFrame) -> DataFrame:
    """candidates (doc_id, a_qid, b_qid, a_surface, shared_qid) with answer, start, end and reason."""
    named = lambda df, k: df.join(labels.select(F.col("qid").alias(k), F.col("label").alias(k[:-4] + "_label")), k, "left")
    rows = with_texts(candidates, texts, "doc_id", "private")
    for k in ("a_qid", "b_qid", "shared_qid"):
        rows = with_texts(named(rows, k), articles, k, k[:-4] + "_article")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    label = lambda c: F.coalesce(F.col(c), F.lit(""))
    why = reasons(
        ("no_private_text", blank("private")), ("no_answer", blank("shared_label") | blank("shared_article")), ("no_article", blank("a_article") | blank("b_article")),
        ("co_occurring", names(F.col("a_article"), label("b_label")) | names(F.col("b_article"), label("a_label"))), ("answer_in_private", names(F.col("private"), label("shared_label"))),
    )
    span = passage_span(F.col("private"), F.col("a_surface"))
    return rows.select(*candidates.columns, F.col("shared_label").alias("answer"), span["start"].alias("start"), span["end"].alias("end"), why.alias("reason"))


def from_resolution(candidates: DataFrame, texts: DataFrame, labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """candidates (doc_id, qid, surface_form) with answer and reason; verdicts (doc_id, qid, verdict) are those of the margin test."""
    rows = with_texts(candidates, texts, "doc_id", "private").join(labels.select("qid", "label"), "qid", "left").join(verdicts, ["doc_id", "qid"], "left")
    why = reasons(("no_private_text", F.coalesce("private", F.lit("")) == ""), ("full_name_given", names(F.col("private"), F.coalesce("label", F.lit("")))), ("not_verified", F.coalesce("verdict", F.lit("unchecked")) != "verified"))
    return rows.select(*candidates.columns, F.col("label").alias("answer"), why.alias("reason"))


def from_pairs(pairs: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """pairs (private_id, public_id, days or none) of chronology or posture with answer and reason: both texts must be there."""
    rows = with_texts(with_texts(pairs, texts, "private_id", "private"), texts, "public_id", "public")
    why = reasons(("no_private_text", F.coalesce("private", F.lit("")) == ""), ("no_public_text", F.coalesce("public", F.lit("")) == ""))
    answer = F.concat(F.col("days").cast("string"), F.lit(" days")) if kind == "chronology" else F.lit(None).cast("string")
    return rows.select(*pairs.columns, F.lit(kind).alias("question_type"), answer.alias("answer"), why.alias("reason"))


def people_in(facts: DataFrame, human: str = "Q5") -> DataFrame:
    """qid of facts (qid, statements map<string, array<string>>) that are instances of `human`."""
    return facts.filter(F.array_contains(F.try_element_at("statements", F.lit("instance_of")), human)).select("qid").distinct()


def labels_in(facts: DataFrame) -> DataFrame:
    """qid, label of facts (qid, label, pos) that have one that isn't empty: of several the last by pos."""
    return facts.filter(F.coalesce("label", F.lit("")) != "").groupBy("qid").agg(F.max_by("label", "pos").alias("label"))


def articles_in(rows: DataFrame) -> DataFrame:
    """qid, text, bytes of articles (qid, text, article_bytes, pos): a null text is empty, a null size 0, of several the last by pos counts."""
    last = rows.filter(F.coalesce("qid", F.lit("")) != "").groupBy("qid").agg(F.max_by(F.struct("text", "article_bytes"), "pos").alias("r"))
    return last.select("qid", F.coalesce("r.text", F.lit("")).alias("text"), F.coalesce("r.article_bytes", F.lit(0)).cast("bigint").alias("bytes"))


def from_events(matches: DataFrame, texts: DataFrame, window: int, private_chars: int = 6000) -> DataFrame:
    """matches (private_id, anchor_qid, anchor_label, public_ids, rendered) of event windows to candidates of type event.

    The public side is all the events shown: that none of them bears the matter out is evidence as well. item_id,
    question_type, gold_qid, private_id, public_id (the first event), public_ids, facts, provenance and reason: a match
    without private text or rendered events has no evidence.
    """
    rows = with_texts(matches, texts, "private_id", "private")
    none = (F.coalesce("private", F.lit("")) == "") | (F.coalesce("rendered", F.lit("")) == "")
    shown = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    days = F.lit(str(window))
    return rows.select(
        F.concat_ws("|", "private_id", "anchor_qid", F.lit("event")).alias("item_id"), F.lit("event").alias("question_type"), F.col("anchor_qid").alias("gold_qid"), "private_id", F.try_element_at("public_ids", F.lit(1)).alias("public_id"), "public_ids",
        shown(private_evidence=F.left("private", F.lit(private_chars)), anchor=F.col("anchor_label"), events=F.col("rendered"), window=days).alias("facts"),
        shown(anchor=F.col("anchor_label"), anchor_qid=F.col("anchor_qid"), events_shown=F.size("public_ids").cast("string"), window_days=days).alias("provenance"),
        F.when(none, "no_evidence").alias("reason"),
    )


def spelled(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """entities (doc_id, qid, surface_form) in the document's own spelling; those that it doesn't write, and documents without text, are left out."""
    rows = with_texts(entities, texts, "doc_id", "text").filter(F.coalesce("text", F.lit("")) != "")
    return rows.withColumn("surface_form", written_as(F.coalesce("surface_form", F.lit("")), F.col("text"))).filter("surface_form <> ''").drop("text")


def to_item(rows: DataFrame, evidence: Column, extra: Column | None = None) -> DataFrame:
    """item rows (item_id, question_type, question, answer, rationale) with evidence and provenance; later keys of provenance win."""
    base = F.create_map(F.lit("gold"), F.lit("computed"))
    fixed = F.create_map(F.lit("question_type"), F.col("question_type"))
    # later maps first: of equal keys the first entry stays
    maps = [x for x in (fixed, extra, base) if x is not None]
    entries = F.flatten(F.array(*[F.map_entries(m) for m in maps]))
    once = F.filter(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: e["i"] == F.array_position(F.transform(entries, lambda y: y["key"]), e["key"]) - 1)
    return rows.withColumn("evidence", evidence).withColumn("provenance", F.map_from_entries(F.transform(once, lambda e: F.struct(e["key"], e["value"]))))


def completed(prompts: DataFrame, complete: Callable[[str], str], samples: int = 1) -> DataFrame:
    """prompts (id, prompt) with the reply of an injected model, asked `samples` times; '' where the replies differ."""

    def ask(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies = [{complete(p) for _ in range(max(1, samples))} for p in f["prompt"]]
            yield pd.DataFrame({"id": f["id"], "reply": [r.pop() if len(r) == 1 else "" for r in replies]})

    return prompts.select("id", "prompt").mapInPandas(ask, "id string, reply string")


def agreed(prompts: DataFrame, complete: Callable[[str], str], words: list[str], samples: int = 1) -> DataFrame:
    """prompts (id, prompt) with `word`, the first of `words` in each of `samples` replies, '' where these differ, and `error`.

    A model that fails costs one prompt, not the run.
    """

    def ask(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies, errors = [], []
            for p in f["prompt"]:
                try:
                    replies.append([complete(p) for _ in range(max(1, samples))])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    replies.append([])
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"id": f["id"], "replies": replies, "error": errors})

    asked = prompts.select("id", "prompt").mapInPandas(ask, "id string, replies array<string>, error string")
    said = F.array_distinct(F.transform("replies", lambda r: first_word(strip_reasoning(r), words)))
    return asked.select("id", F.when(F.size(said) == 1, said[0]).otherwise("").alias("word"), "error")


def drafted(pairs: DataFrame, texts: DataFrame, labels: DataFrame, template: str, phrase: Callable[[str], str], clipped: int = 6000) -> DataFrame:
    """pairs (private_id, public_id, qid) with a question that an injected model drafts from both texts, and the outcome.

    outcome: no_evidence (a text is missing), same_document (both texts are one), phraser_error, unparseable_draft (no JSON
    object with question and answer) or drafted. Only pairs with evidence reach the model. template has the
    slots {private}, {public} and {bridge}.
    """
    rows = with_texts(with_texts(pairs.select("private_id", "public_id", "qid").distinct(), texts, "private_id", "private"), texts, "public_id", "public").join(labels.select("qid", "label"), "qid", "left")
    blank = (F.coalesce("private", F.lit("")) == "") | (F.coalesce("public", F.lit("")) == "")
    rows = rows.withColumn("item_id", F.concat_ws("|", "private_id", "public_id", "qid")).withColumn("lost", reasons(("no_evidence", blank), ("same_document", F.col("private") == F.col("public"))))
    prompt = F.lit(template)
    for slot, value in (("private", F.left("private", F.lit(clipped))), ("public", F.left("public", F.lit(clipped))), ("bridge", F.coalesce("label", "qid"))):
        prompt = F.replace(prompt, F.lit("{" + slot + "}"), value)

    def ask(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, p in zip(f["item_id"], f["prompt"]):
                try:
                    out.append((i, phrase(p), False))
                except Exception:  # noqa: BLE001
                    out.append((i, None, True))
            yield pd.DataFrame(out, columns=["item_id", "reply", "failed"])

    replies = rows.filter("lost is null").select("item_id", prompt.alias("prompt")).mapInPandas(ask, "item_id string, reply string, failed boolean")
    made = F.from_json(json_slice(strip_reasoning(F.col("reply"))), "question string, answer string, private_contribution string, public_contribution string")
    joined = rows.select("item_id", "private_id", "public_id", "qid", "lost").join(replies.withColumn("d", made), "item_id", "left")
    good = (F.coalesce("d.question", F.lit("")) != "") & (F.coalesce("d.answer", F.lit("")) != "")
    outcome = F.coalesce("lost", F.when(F.coalesce("failed", F.lit(False)), "phraser_error").when(good, "drafted").otherwise("unparseable_draft"))
    why = F.concat_ws(" ", "d.private_contribution", "d.public_contribution")
    kept = lambda c: F.when(F.col("outcome") == "drafted", c)
    return joined.withColumn("outcome", outcome).select("item_id", "private_id", "public_id", "qid", "outcome", kept(strip(F.col("d.question"))).alias("question"), kept(strip(F.col("d.answer"))).alias("answer"), kept(why).alias("rationale"))


def supported(items: DataFrame, texts: DataFrame, template: str, judge: Callable[[str], str], samples: int = 3, clipped: int = 6000) -> DataFrame:
    """items (item_id, private_id, public_id, question, answer) with the outcome of an injected judge, a model other than the phraser.

    verified where all of `samples` replies say SUPPORTED first, judge_rejected, judge_error, or no_evidence. template has the slots
    {private}, {public}, {question} and {answer}.
    """
    rows = with_texts(with_texts(items, texts, "private_id", "private"), texts, "public_id", "public")
    rows = rows.withColumn("lost", F.when((F.coalesce("private", F.lit("")) == "") | (F.coalesce("public", F.lit("")) == ""), "no_evidence"))
    prompt = F.lit(template)
    for slot, value in (("private", F.left("private", F.lit(clipped))), ("public", F.left("public", F.lit(clipped))), ("question", F.col("question")), ("answer", F.col("answer"))):
        prompt = F.replace(prompt, F.lit("{" + slot + "}"), F.coalesce(value, F.lit("")))
    told = agreed(rows.filter("lost is null").select(F.col("item_id").alias("id"), prompt.alias("prompt")), judge, ["SUPPORTED", "UNSUPPORTED"], samples)
    outcome = F.coalesce("lost", F.when(F.col("error").isNotNull(), "judge_error").when(F.col("word") == "supported", "verified").otherwise("judge_rejected"))
    return rows.join(told.withColumnRenamed("id", "item_id"), "item_id", "left").select(*items.columns, outcome.alias("outcome"))


def ablated(items: DataFrame, solve: Callable[[str], str]) -> DataFrame:
    """items (item_id, question, answer, private, public) with `necessity`: whether the answer is found with no, public or private evidence alone."""
    sides = {"closed_book": F.lit(""), "public_only": F.coalesce("public", F.lit("")), "private_only": F.coalesce("private", F.lit(""))}
    asked = items.select("item_id", "answer", F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(k), F.concat_ws("\n", v, F.col("question"))) for k, v in sides.items()]))).alias("side", "prompt"))
    replies = completed(asked.select(F.concat_ws("|", "side", "item_id").alias("id"), "prompt"), solve)
    told = replies.select(F.substring_index("id", "|", 1).alias("side"), F.regexp_extract("id", r"(?s)^[^|]*\|(.*)$", 1).alias("item_id"), "reply")
    right = told.join(items.select("item_id", "answer"), "item_id").withColumn("hit", normalise(F.col("reply")) == normalise(F.col("answer")))
    outcomes = right.groupBy("item_id").agg(*[F.max(F.when(F.col("side") == k, F.col("hit"))).alias(k) for k in sides])
    return items.join(outcomes, "item_id", "left").withColumn("necessity", F.struct(*sides)).drop(*sides)


def posture_verdict(reply: Column) -> Column:
    return verdict_of(reply, list(VERDICTS))
