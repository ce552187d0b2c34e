"""Rule-based tests of questions, as boolean columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import contains_tokens, normalise, strip, tokens

#: Fields that an encyclopaedia holds, and so may not be asked for.
ATTRIBUTES = ("birthplace", "place of birth", "born in", "date of birth", "founding year", "founded in", "year was", "inception", "capital of", "headquarters", "headquartered", "political party", "population of")
#: Phrases that point at the evidence in place of the world.
ATTRIBUTION = (
    "the cable", "the cables", "the telegram", "the dispatch", "the document", "the documents", "both documents", "two documents", "the report", "the record", "the records", "public record", "public records",
    "the public record", "the event record", "event records", "the article", "the passage", "the text", "the excerpt", "as reported in", "as described in", "as stated in", "as mentioned in", "according to the", "in the source",
)
#: Looser attribution, scripts that the corpora never use (ranges by their first and last characters, as SQL engines
#: differ in escapes of code points), openers of polar questions and verdicts.
REFERENTIAL = r"(?i)\b(?:(?:as\s+)?(?:described|noted|detailed|reported|recorded|mentioned|discussed|stated)\s+in\s+[\w\s.'’-]{0,40}?(?:diplomatic|embassy|cable|dispatch|archive)|diplomatic\s+(?:record|archive)s?|embassy\s+(?:report|reporting|cable))"
FOREIGN = r"[Ѐ-ӿ֐-׿؀-ۿ　-ヿ一-鿿＀-￯]"
POLAR = ("did", "do", "does", "is", "was", "were", "are", "has", "have", "had", "will", "would", "can", "could", "should")
VERDICTS = ("Yes", "No", "Mixed", "Not enough evidence")


def names_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(map(re.escape, phrases)))


def two_sided(evidence: Column) -> Column:
    has = lambda side: F.exists(evidence, lambda e: F.coalesce(e.side == side, F.lit(False)))
    return F.coalesce(has("private") & has("public"), F.lit(False))


def answer_not_in_question(question: Column, answer: Column) -> Column:
    """An answer without tokens fails."""
    said = normalise(answer)
    return F.coalesce((said != "") & ~contains_tokens(normalise(question), said), F.lit(False))


def withholds(question: Column, withheld: Column) -> Column:
    """None of the `;`-separated names is a run of the question's tokens."""
    asked = normalise(question)
    named = F.exists(F.split(F.coalesce(withheld, F.lit("")), ";"), lambda n: contains_tokens(asked, normalise(n)))
    return ~F.coalesce(named, F.lit(False))


def polar(question: Column, answer: Column) -> Column:
    opener = F.coalesce(F.try_element_at(tokens(question), F.lit(1)), F.lit(""))
    return F.when(answer.isin(*VERDICTS), opener.isin(*POLAR)).otherwise(True)


def gate_columns(question: Column, answer: Column, evidence: Column, withheld: Column) -> dict[str, Column]:
    """All nine gates; a null question or answer counts as empty text."""
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    return {
        "two_sided": two_sided(evidence),
        "answer_not_in_question": answer_not_in_question(q, a),
        "no_source_attribution": ~names_any(q, ATTRIBUTION),
        "not_a_bare_attribute": (F.coalesce(withheld, F.lit("")) != "") | ~names_any(q, ATTRIBUTES),
        "answer_is_substantive": F.length(strip(a)) >= 2,
        "withholds_what_it_was_told_to": withholds(q, withheld),
        "no_foreign_script": ~q.rlike(FOREIGN),
        "not_referential": ~q.rlike(REFERENTIAL),
        "polar_when_the_answer_is_a_verdict": polar(q, a),
    }


def judged(items: DataFrame, withheld: Column | None = None) -> DataFrame:
    """items with `gates` (map of name to outcome) and `accepted` (all of them)."""
    gates = gate_columns(F.col("question"), F.col("answer"), F.col("evidence"), F.try_element_at("provenance", F.lit("withheld")) if withheld is None else withheld)
    made = F.create_map(*[x for k, v in gates.items() for x in (F.lit(k), v)])
    return items.withColumn("gates", made).withColumn("accepted", F.forall(F.map_values("gates"), lambda x: x))


def needs_both(necessity: Column) -> Column:
    """All three were measured and none sufficed."""
    return F.coalesce(~(necessity["closed_book"] | necessity["public_only"] | necessity["private_only"]), F.lit(False))


def measured(necessity: Column) -> Column:
    return necessity["closed_book"].isNotNull() & necessity["public_only"].isNotNull() & necessity["private_only"].isNotNull()
