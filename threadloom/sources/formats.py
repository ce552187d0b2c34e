"""Readers of the collections' own formats as DataFrames."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import dates
from threadloom.functions.text import strip

#: Fixed value: the first line of a record of the cable dump.
CABLE_START = r'^"(\d+)","(\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2})","([^"]*)","([^"]*)","([^"]*)",'
#: Columns of the two event collections, in their order.
UCDP_COLUMNS = (
    "id relid year active_year code_status type_of_violence conflict_dset_id conflict_new_id conflict_name dyad_dset_id dyad_new_id dyad_name side_a_dset_id side_a_new_id side_a side_b_dset_id "
    "side_b_new_id side_b number_of_sources source_article source_office source_date source_headline source_original where_prec where_coordinates where_description adm_1 adm_2 latitude longitude geom_wkt "
    "priogrid_gid country country_id region event_clarity date_prec date_start date_end deaths_a deaths_b deaths_civilians deaths_unknown best high low gwnoa gwnob"
).split()
GDELT_COLUMNS = (
    "event_id date month_year year fraction_date actor1_code actor1_name actor1_country actor1_known_group actor1_ethnic actor1_religion1 actor1_religion2 actor1_type1 actor1_type2 "
    "actor1_type3 actor2_code actor2_name actor2_country actor2_known_group actor2_ethnic actor2_religion1 actor2_religion2 actor2_type1 actor2_type2 actor2_type3 is_root_event "
    "event_code event_base_code event_root_code quad_class goldstein num_mentions num_sources num_articles avg_tone actor1_geo_type actor1_geo_name actor1_geo_country actor1_geo_adm1 "
    "actor1_geo_lat actor1_geo_long actor1_geo_feature_id actor2_geo_type actor2_geo_name actor2_geo_country actor2_geo_adm1 actor2_geo_lat actor2_geo_long actor2_geo_feature_id "
    "action_geo_type action_geo_name action_geo_country action_geo_adm1 action_geo_lat action_geo_long action_geo_feature_id date_added"
).split()
#: The prose fields of each kind of parliamentary record, and the length from which other text is prose.
PROSE_FIELDS = {
    "Business": "Title Description InitialSituation SubmittedText ReasonText MotionText FederalCouncilResponseText FederalCouncilProposalText DraftText DocumentationText Proceedings SubmittedBy".split(),
    "Person": "FirstName LastName OfficialName PersonNumber".split(), "MemberCouncil": "FirstName LastName CantonName PartyName CouncilName".split(),
    "PersonInterest": "Name Function Description".split(), "PersonOccupation": "Name Description".split(), "Party": "PartyName PartyAbbreviation".split(),
}
#: The kinds of parliamentary records, in the order in which they are read.
ENTITIES = ("Person", "MemberCouncil", "PersonInterest", "PersonOccupation", "Party", "Business")
PROSE_CHARS = 40


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One row for each line that isn't blank; .gz by its suffix."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def cable_records(spark: SparkSession, path: str) -> DataFrame:
    """start (the first line) and record (all lines) of each cable; lines before the first start are left out.

    A record begins at a line of quoted fields and runs to the next. Lines are numbered within their file block, and
    each block gets the last start of the blocks before it, so that no task holds more than a block's lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    starts = F.when(F.col("value").rlike(CABLE_START), F.struct("block", "n"))
    inside = Window.partitionBy("file", "block").orderBy("n")
    local = lines.withColumn("own", F.last(starts, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = lines.groupBy("file", "block").agg(F.max(starts).alias("latest"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "block", F.last("latest", ignorenulls=True).over(before).alias("carried"))
    placed = local.join(F.broadcast(carried), ["file", "block"]).withColumn("of", F.coalesce("own", "carried")).filter(F.col("of").isNotNull())
    texts = placed.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("l"))
    return texts.select(F.col("l")[0]["value"].alias("start"), F.array_join(F.transform("l", lambda x: x.value), "\n").alias("record"))


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("refs", "header", "body")]))
def _cable_tail(records: pd.Series) -> pd.DataFrame:
    def tail(record: str) -> tuple[str, str, str]:
        try:
            for row in csv.reader(io.StringIO(record), escapechar="\\"):
                if len(row) >= 8:
                    return row[5], row[6], row[7]
        except csv.Error:
            pass
        return "", "", ""

    return pd.DataFrame([tail(r) for r in records], columns=["refs", "header", "body"])


def cables(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a cable dump; a record that can't be parsed has empty text."""
    part = lambda i: F.regexp_extract("start", CABLE_START, i)
    made = cable_records(spark, path).withColumn("tail", _cable_tail("record"))
    meta = F.struct(part(3).alias("reference"), part(4).alias("origin"), part(5).alias("classification"), "tail.refs", "tail.header", part(2).alias("date_raw"))
    return made.select(part(1).alias("doc_id"), F.lit("cablegate").alias("source"), F.col("tail.body").alias("text"), dates.us_timestamp(part(2)).alias("date"), F.lit("en").alias("lang"), part(3).alias("title"), meta.alias("meta"))


def zipped_rows(spark: SparkSession, path: str, columns: list[str], delimiter: str, header: bool) -> DataFrame:
    """Rows of the first member of each archive, all text; archives are read in parallel and streamed row by row.

    With a header it must be `columns`, else the read fails; without one, rows that are too short are left out.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as member:
                    rows = csv.reader(io.TextIOWrapper(member, encoding="utf-8", errors="replace", newline=""), delimiter=delimiter)
                    if header:
                        found = next(rows, [])
                        if found != columns:
                            raise ValueError(f"unexpected columns: {sorted(set(found) ^ set(columns))}")
                    part: list[list[str]] = []
                    for row in rows:
                        if len(row) >= len(columns):
                            part.append(row[: len(columns)])
                        if len(part) >= 10_000:
                            yield pd.DataFrame(part, columns=columns)
                            part = []
                    yield pd.DataFrame(part, columns=columns, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def ucdp(spark: SparkSession, path: str) -> DataFrame:
    rows = zipped_rows(spark, path, UCDP_COLUMNS, ",", header=True)
    return rows.withColumn("doc_id", F.col("id")).withColumn("date", F.nullif(F.col("date_start"), F.lit("")))


def gdelt(spark: SparkSession, path: str) -> DataFrame:
    """`date` stays as it is, eight figures; `iso_date` is the date that it means."""
    rows = zipped_rows(spark, path, GDELT_COLUMNS, "\t", header=False)
    return rows.withColumn("doc_id", F.col("event_id")).withColumn("iso_date", dates.lenient_date(F.col("date")))


def odata(rows: DataFrame) -> DataFrame:
    """Without the envelope; stamps in text columns as ISO dates."""
    kept = [c for c in rows.columns if c != "__metadata" and not (isinstance(rows.schema[c].dataType, T.StructType) and "__deferred" in rows.schema[c].dataType.names)]
    text = {f.name for f in rows.schema if isinstance(f.dataType, T.StringType)}
    return rows.select(*[dates.odata_date(F.col(c)).alias(c) if c in text else F.col(c) for c in kept])


def prose(entity: str, rows: DataFrame) -> Column:
    """The prose fields in order, then other long text by field name, each once, one a line."""
    text = {f.name for f in rows.schema if isinstance(f.dataType, T.StringType)}
    named = [F.col(c) for c in PROSE_FIELDS.get(entity, ()) if c in text]
    others = [F.when(F.length(c) > PROSE_CHARS, F.col(c)) for c in sorted(text - set(PROSE_FIELDS.get(entity, ()))) if not c.startswith("__")]
    parts = F.filter(F.array(*[strip(c) for c in [*named, *others]]), lambda x: x.isNotNull() & (x != "")) if named or others else F.array().cast("array<string>")
    return F.array_join(F.array_distinct(parts), "\n")


def parliament(spark: SparkSession, folder: str, entities: Iterable[str] = ENTITIES) -> DataFrame:
    """The entity files in their order; doc_id is entity:ID, and fields of the source win over made ones of the same name."""
    out: DataFrame | None = None
    for entity in entities:
        rows = odata(jsonl(spark, f"{folder}/{entity}.jsonl"))
        made = {"doc_id": F.concat(F.lit(f"{entity}:"), F.col("ID").cast("string")), "entity": F.lit(entity), "text": prose(entity, rows)}
        part = rows.select("*", *[v.alias(k) for k, v in made.items() if k not in rows.columns])
        # a field may hold text in one kind of record and a number in another
        part = part.select(*[F.col(c).cast("string").alias(c) if not isinstance(part.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(c).alias(c) for c in part.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


NAME = "array<struct<`name-part`: array<struct<value: string>>>>"
TARGET = (
    "_ssid string, `sanctions-set-id` array<string>, individual struct<identity: array<struct<name: {n}, `day-month-year`: array<struct<_year: string>>>>, justification: array<string>, `other-information`: array<string>>, "
    "entity struct<identity: array<struct<name: {n}>>, justification: array<string>, `other-information`: array<string>>, modification array<struct<`_modification-type`: string, `_enactment-date`: string, `_publication-date`: string, `_effective-date`: string>>"
).format(n=NAME)
PROGRAMME = "`program-name` array<struct<_VALUE: string, _lang: string>>, `program-key` array<struct<_VALUE: string, _lang: string>>, origin string, `sanctions-set` array<struct<_VALUE: string, _lang: string, _ssid: string>>"


def sanctions(spark: SparkSession, path: str) -> DataFrame:
    """Listed targets with a name, their programme and the dates they were listed and removed.

    Only outer targets are rows; the copies within modifications are not in the schema and so are not read.
    """
    rows = spark.read.format("xml").option("rowTag", "target").schema(TARGET).load(path)
    programmes = spark.read.format("xml").option("rowTag", "sanctions-program").schema(PROGRAMME).load(path)
    english = lambda c: F.try_element_at(F.filter(c, lambda x: x["_lang"] == "eng"), F.lit(1))["_VALUE"]
    sets = programmes.select(F.trim(english("`program-name`")).alias("programme"), F.trim(english("`program-key`")).alias("programme_key"), "origin", F.posexplode("`sanctions-set`").alias("pos", "s"))
    entry = sets.select(F.col("s._ssid").alias("sanctions_set_id"), "programme", "programme_key", "origin", F.coalesce(F.when(F.col("s._lang") == "eng", F.trim("s._VALUE")), F.lit("")).alias("measures"), "pos")
    # the first entry of a set, but one with measures before one without
    pick = entry.groupBy("sanctions_set_id").agg(F.min_by(F.struct("programme", "programme_key", "origin", "measures"), F.struct((F.col("measures") == "").alias("none"), "pos")).alias("p"))
    identities = F.coalesce(F.transform("individual.identity", lambda i: i["name"]), F.transform("entity.identity", lambda i: i["name"]))
    names = F.filter(F.transform(F.flatten(identities), lambda n: F.array_join(F.filter(F.transform(n["name-part"], lambda p: F.trim(p["value"])), lambda v: v.isNotNull() & (v != "")), " ")), lambda n: n != "")
    when = lambda kind: F.filter(F.transform(F.filter("modification", lambda m: m["_modification-type"] == kind), lambda m: F.coalesce(F.nullif(m["_publication-date"], F.lit("")), m["_enactment-date"])), lambda x: x.isNotNull())
    made = rows.select(
        F.col("_ssid").alias("doc_id"), F.when(F.col("individual").isNotNull(), "individual").when(F.col("entity").isNotNull(), "entity").alias("type"), names.alias("names"),
        F.filter(F.flatten(F.transform("individual.identity", lambda i: F.transform(i["day-month-year"], lambda x: x["_year"]))), lambda x: x.isNotNull()).alias("dobs"), F.try_element_at("sanctions-set-id", F.lit(-1)).alias("sanctions_set_id"),
        F.coalesce(F.try_element_at("individual.justification", F.lit(-1)), F.try_element_at("entity.justification", F.lit(-1)), F.lit("")).alias("justification"),
        F.try_element_at(when("listed"), F.lit(1)).alias("added"), F.try_element_at(when("de-listed"), F.lit(1)).alias("removed"),
    )
    return made.filter(F.coalesce(F.size("names"), F.lit(0)) > 0).join(F.broadcast(pick) if pick.limit(100_001).count() <= 100_000 else pick, "sanctions_set_id", "left").select("*", "p.*").drop("p")


VOCABULARY = "http://dodis.ch/schema/vocab/"


@F.pandas_udf(T.StringType())
def _literal(terms: pd.Series) -> pd.Series:
    import re

    shape = re.compile(r'^"(.*)"(?:\^\^<[^>]+>|@[\w-]+)?$', re.S)

    def value(term: str | None) -> str | None:
        if term is None:
            return None
        term = term.strip()
        if term.startswith("<"):
            return term[1:-1]
        m = shape.match(term)
        if not m:
            return term
        try:
            return json.loads(f'"{m[1]}"')
        except json.JSONDecodeError:
            return m[1]

    return terms.map(value)


def triples(spark: SparkSession, path: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """subject, field, value, n of a N-Triples file's lines in the vocabulary; n grows along the file."""
    line = r"^<([^>]+)>\s+<([^>]+)>\s+(.+)\s\.\s*$"
    rows = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("n")).filter(F.col("value").rlike(line))
    cut = rows.select(F.regexp_extract("value", line, 1).alias("subject"), F.regexp_extract("value", line, 2).alias("p"), F.regexp_extract("value", line, 3).alias("o"), "n")
    kept = cut.filter(F.startswith("p", F.lit(vocabulary)))
    return kept.select("subject", F.substring("p", len(vocabulary) + 1, 1000).alias("field"), _literal("o").alias("value"), "n")


def plain_html(c: Column) -> Column:
    broken = F.regexp_replace(F.regexp_replace(c, r"<br\s*/?>", "\n"), r"<[^>]+>", "")
    return strip(F.regexp_replace(broken, r"[ \t]+", " "))


def archive_documents(spark: SparkSession, path: str, langs: tuple[str, ...] = ("de", "fr")) -> DataFrame:
    """doc_id, lang, date, classification, title, summary, persons and places of the archive's dump; the last triple of a field wins."""
    t = triples(spark, path)

    def wide(fields: dict[str, str]) -> DataFrame:
        own = t.filter(F.col("field").isin(*fields))
        return own.groupBy("subject").agg(*[F.max_by(F.when(F.col("field") == k, F.col("value")), F.when(F.col("field") == k, F.col("n"))).alias(v) for k, v in fields.items()], F.min("n").alias("first"))

    docs = wide({f"document_{c}": v for c, v in (("summary", "summary"), ("title", "title"), ("classification", "classification"), ("lang_code", "lang"), ("doc_date", "date"))})
    name = F.trim(F.concat_ws(" ", F.nullif(F.col("given"), F.lit("")), F.nullif(F.col("family"), F.lit(""))))
    people = wide({"person_fallback_person_id": "person", "person_fallback_first_name": "given", "person_fallback_last_name": "family"}).withColumn("name", name).filter("name <> ''").groupBy("person").agg(F.min_by("name", "first").alias("name"))
    places = wide({"place_fallback_place_id": "place", "place_fallback_name": "name"}).filter("name <> ''").groupBy("place").agg(F.min_by("name", "first").alias("name"))
    qids = wide({"place_wikidata_id": "qid"}).select(F.col("subject").alias("place"), "qid")
    has_person = wide({"document_has_person_document_id": "doc", "document_has_person_person_id": "person"}).join(people, "person").groupBy("doc").agg(F.array_sort(F.collect_set("name")).alias("persons"))
    at = wide({"document_has_place_document_id": "doc", "document_has_place_place_id": "place"}).join(qids, "place", "left").join(places, "place", "left").filter("qid is not null or name is not null")
    has_place = at.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "qid", "name"))), lambda x: F.struct(x["qid"].alias("qid"), x["name"].alias("name"))).alias("places"))
    kept = docs.filter(F.col("lang").isin(*langs) & (F.coalesce("summary", F.lit("")) != "")).withColumnRenamed("subject", "doc")
    joined = kept.join(has_person, "doc", "left").join(has_place, "doc", "left")
    return joined.select(
        F.substring_index("doc", "/", -1).alias("doc_id"), "lang", dates.dotted_date(F.col("date")).alias("date"), F.col("date").alias("date_raw"), "classification", plain_html(F.coalesce("title", F.lit(""))).alias("title"), plain_html(F.col("summary")).alias("summary"),
        F.coalesce("persons", F.array().cast("array<string>")).alias("persons"), "places",
    )


def scanned_documents(spark: SparkSession, folder: str, described: DataFrame) -> DataFrame:
    """described with the text of its dodis-<doc_id>.txt; documents without one, or with a blank one, are left out."""
    texts = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^dodis-(.+)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))
    return described.join(texts.filter(strip(F.col("text")) != ""), "doc_id")


def title_index(spark: SparkSession, props: str, pages: str) -> DataFrame:
    """doc_id, qid, page_id, title of the articles of a wiki's two SQL dumps; tuples are the records of the read, not lines."""
    read = lambda p: spark.read.option("lineSep", "),(").text(p)
    shape = r"(?s)(?:^|\()(\d+),'wikibase_item','(Q\d+)'"
    qids = read(props).select(F.regexp_extract("value", shape, 1).cast("bigint").alias("page_id"), F.regexp_extract("value", shape, 2).alias("qid")).filter("qid <> ''").groupBy("page_id").agg(F.max("qid").alias("qid"))
    page = r"(?s)(?:^|\()(\d+),0,'((?:[^'\\]|\\.)*)'"
    titles = read(pages).select(F.regexp_extract("value", page, 1).alias("id"), F.regexp_extract("value", page, 2).alias("t")).filter("id <> ''")
    clean = F.replace(F.replace(F.col("t"), F.lit("\\'"), F.lit("'")), F.lit("_"), F.lit(" "))
    return titles.select(F.col("id").cast("bigint").alias("page_id"), clean.alias("title")).join(qids, "page_id").select(F.col("qid").alias("doc_id"), "qid", "page_id", "title")


#: Properties that are kept, and what they are called here.
PROPERTIES = dict(
    P31="instance_of", P279="subclass_of", P569="birth_date", P570="death_date", P19="birth_place", P20="death_place", P106="occupation", P39="position_held", P102="party", P27="citizenship", P159="headquarters", P571="inception",
    P576="dissolved", P112="founder", P108="employer", P169="chief_executive", P488="chairperson", P452="industry", P17="country", P36="capital", P463="member_of", P361="part_of", P155="follows", P156="followed_by",
)
CLAIMS = "map<string, array<struct<rank: string, mainsnak: struct<datavalue: struct<type: string, value: string>>>>>"


def statements(entities: DataFrame) -> DataFrame:
    """qid, label, description and statements (map of name to values) of entities given as qid, json (one entity's object)."""
    terms = "map<string, struct<value: string>>"
    row = entities.withColumn("e", F.from_json("json", f"labels {terms}, descriptions {terms}, claims {CLAIMS}, lastrevid bigint"))
    english = lambda c: F.coalesce(F.nullif(F.try_element_at(c, F.lit("en"))["value"], F.lit("")), F.try_element_at(c, F.lit("mul"))["value"], F.lit(""))

    def value(claim: Column) -> Column:
        kind, data = claim["mainsnak"]["datavalue"]["type"], claim["mainsnak"]["datavalue"]["value"]
        part = lambda p: F.get_json_object(data, f"$.{p}")
        return F.when(kind == "string", data).when(kind == "wikibase-entityid", part("id")).when(kind == "time", F.ltrim(part("time"), F.lit("+"))).when(kind == "quantity", F.ltrim(part("amount"), F.lit("+"))).when(kind == "monolingualtext", part("text"))

    def values(p: str) -> Column:
        kept = F.filter(F.try_element_at("e.claims", F.lit(p)), lambda c: F.coalesce(c["rank"] != "deprecated", F.lit(True)))
        return F.filter(F.transform(kept, value), lambda v: v.isNotNull() & (v != ""))

    made = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), values(p).alias("value")) for p, n in PROPERTIES.items()]), lambda x: F.coalesce(F.size(x.value), F.lit(0)) > 0))
    return row.select("qid", F.col("e.lastrevid").alias("revision"), english("e.labels").alias("label"), english("e.descriptions").alias("description"), made.alias("statements"))


#: Name of a source and its reader.
REGISTRY = {"cablegate": cables, "ucdp": ucdp, "gdelt": gdelt, "parliament": parliament, "sanctions": sanctions, "dodis": archive_documents, "wikipedia_index": title_index}


def source(name: str):
    """The reader of a source; the error names those that there are."""
    if name not in REGISTRY:
        raise KeyError(f"no source {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
