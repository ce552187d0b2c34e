"""The steps of a run by name, each from tables to tables: python -m threadloom.steps pair --tables DIR --out DIR --settings FILE.

A step reads the tables of the data folder and what earlier steps wrote under `out`, and writes its records with a provenance
sidecar; a step whose input isn't there fails by name. Models are callables given to run(); a step that needs one says so.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import sinks
from threadloom.operators import gates, links, reports, temporal, typed
from threadloom.plans import adapters as ad
from threadloom.settings import Settings, load
from threadloom.sources.tables import table

Models = Mapping[str, Callable[[str], str]]


class Run:
    """Where a run reads and writes."""

    def __init__(self, spark: SparkSession, tables: str, out: str, settings: Settings, models: Models | None = None) -> None:
        self.spark, self.tables, self.out, self.settings, self.models = spark, tables.rstrip("/"), out.rstrip("/"), settings, dict(models or {})

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.tables, name)

    def earlier(self, step: str) -> DataFrame:
        """What another step wrote."""
        return self.spark.read.parquet(f"{self.out}/{step}")

    def write(self, df: DataFrame, step: str, note: str) -> int:
        return sinks.write_records(df, f"{self.out}/{step}", {"kind": "derived", "source": self.tables, "note": note}, format="parquet")

    def model(self, name: str) -> Callable[[str], str]:
        if name not in self.models:
            raise KeyError(f"this step needs a model: {name}")
        return self.models[name]

    def texts(self) -> DataFrame:
        return self.table("documents").select(F.col("ref").alias("id"), "text")


def sources(r: Run) -> int:
    """Fingerprints of the tables, to be compared with published ones."""
    named = {"documents": ["doc_id", "ref", "text"], "event_records": ["doc_id", "event_ts"], "entities": ["qid", "label"]}
    made = None
    for name, columns in named.items():
        one = reports.table_fingerprint(r.table(name).withColumns({c: F.col(c).cast("string") for c in columns}), columns).withColumn("source", F.lit(name))
        made = one if made is None else made.unionByName(one)
    return r.write(made, "sources", "one fingerprint a table")


def link(r: Run) -> int:
    """The strongest mention of each document and entity."""
    kept = links.keep_mentions(ad.links(r.spark, r.tables), r.settings.confidence).filter("qid is not null")
    return r.write(links.best_mentions(kept, ["doc_id", "qid"], ["pos"]), "link", "mentions at or above the confidence")


def graph(r: Run) -> int:
    """Bridges: entities named on both sides, under the cap."""
    sides = links.bridge_sides(r.earlier("link").filter(F.col("side").isin("private", "public")))
    return r.write(sides.join(links.bridging(links.bridge_counts(sides), r.settings.max_private).select("qid"), "qid", "left_semi"), "graph", "long form of the bridges")


def public(r: Run) -> int:
    """Events of each document's entities within the window."""
    entities = r.earlier("link").select("doc_id", "qid")
    events = r.table("event_records").select(F.col("doc_id").alias("event_id"), F.col("event_ts").cast("date").alias("date"), F.explode("qids").alias("qid"))
    return r.write(temporal.event_windows(ad.dated_documents(r.spark, r.tables), entities, events, ad.labels(r.spark, r.tables), r.settings.event_days), "public", "event windows")


def pair(r: Run) -> int:
    """A private document beside a public one for each bridge, under the cap."""
    made = links.pair_documents(r.earlier("graph"), ad.dated_documents(r.spark, r.tables), r.settings.window_days, r.settings.pairs_per_entity, r.settings.max_private)
    return r.write(made, "pair", "pairs of the bridges")


def generate(r: Run) -> int:
    """Questions that one model drafts and another supports, with their gates."""
    drafts = typed.drafted(r.earlier("pair"), r.texts(), ad.labels(r.spark, r.tables), "{private}\n{public}\n{bridge}", r.model("phraser"), r.settings.max_chars)
    r.write(drafts, "drafts", "every pair with its outcome")
    told = typed.supported(r.earlier("drafts").filter("outcome = 'drafted'").drop("outcome"), r.texts(), "{private}\n{public}\n{question}\n{answer}", r.model("judge"), 3, r.settings.max_chars)
    side = lambda name: F.struct(F.col(f"{name}_id").alias("doc_id"), F.lit(name).alias("source"), F.lit(name).alias("side"))
    items = typed.to_item(told.filter("outcome = 'verified'").withColumn("question_type", F.lit("bridge")), F.array(side("private"), side("public")), F.create_map(F.lit("bridge_qid"), F.col("qid")))
    return r.write(gates.judged(items).drop("outcome"), "generate", "questions that the judge supports, with gates")


def necessity(r: Run) -> int:
    """Whether an answer is found with no, public or private evidence alone."""
    items = typed.with_texts(typed.with_texts(r.earlier("generate").filter("accepted"), r.texts(), "private_id", "private"), r.texts(), "public_id", "public")
    return r.write(typed.ablated(items, r.model("solver")).drop("private", "public"), "necessity", "necessity of each accepted question")


def review(r: Run) -> int:
    """Pages for reviewers and for calibration, beside each other."""
    items = r.earlier("necessity")
    folder = Path(r.out.removeprefix("file://")) / "review"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "review.html").write_text(sinks.review_page(items, "Review"), encoding="utf-8")
    sample = items.join(reports.calibration_sample(items).select("item_id"), "item_id", "left_semi")
    (folder / "calibration.html").write_text(sinks.calibration_page(sample, r.texts(), "Calibration"), encoding="utf-8")
    return 2


def release(r: Run) -> int:
    """The frozen questions with their datasheet and digest."""
    items = r.earlier("necessity").drop("accepted")
    told = sinks.freeze(items, reports.datasheet(items), {}, f"{r.out}/release")
    return told["total"]["questions"]


STEPS: dict[str, Callable[[Run], int]] = {f.__name__: f for f in (sources, link, graph, public, pair, generate, necessity, review, release)}


def run(name: str, r: Run) -> int:
    """Rows that the step wrote; an unknown name is an error."""
    if name not in STEPS:
        raise KeyError(f"no step {name}; there are {', '.join(STEPS)}")
    return STEPS[name](r)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("step", choices=STEPS)
    p.add_argument("--tables", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--settings", required=True)
    a = p.parse_args()
    print(run(a.step, Run(SparkSession.builder.getOrCreate(), a.tables, a.out, load(a.settings))))


if __name__ == "__main__":
    main()
