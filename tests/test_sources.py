import json
import zipfile

import pytest

from threadloom.sources import formats as f


def test_cables(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        'lost line\n"1","2/28/2005 9:05","05BERN1","Embassy Bern","SECRET","ref","HEAD","line one\nsays \\"yes\\"\n"quoted line","\n'
        '"2","13/45/2005 9:05","05BERN2","Embassy Bern","","","",""\n"3","1/2/2006 10:00","x","y","z","only six"\n'
    )
    got = {r.doc_id: r for r in f.cables(spark, f"{tmp_path}/c.csv").collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"].date == "2005-02-28T09:05:00" and got["1"].meta.origin == "Embassy Bern" and got["1"].text.startswith('line one\nsays "yes"')
    assert got["2"].date is None and got["3"].text == ""


def test_zipped_events(spark, tmp_path):
    row = ["x"] * 49
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("a.csv", ",".join(f.UCDP_COLUMNS) + "\n" + ",".join(["7", *row[1:]]) + "\n")
    got = f.ucdp(spark, f"{tmp_path}/u.zip").collect()
    assert len(f.UCDP_COLUMNS) == 49 and len(f.GDELT_COLUMNS) == 57 and got[0].doc_id == "7" and got[0].date == "x"
    for i in range(2):
        with zipfile.ZipFile(tmp_path / f"g{i}.zip", "w") as z:
            z.writestr("b.csv", "\t".join([f"e{i}", "20060115", *["v"] * 55]) + "\nshort\trow\n")
    g = f.gdelt(spark, f"{tmp_path}/g*.zip").collect()
    assert sorted((r.doc_id, r.date, str(r.iso_date)) for r in g) == [("e0", "20060115", "2006-01-15"), ("e1", "20060115", "2006-01-15")]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("a.csv", "id,other\n1,2\n")
    with pytest.raises(Exception, match="unexpected columns"):
        f.ucdp(spark, f"{tmp_path}/bad.zip").collect()


def test_parliament(spark, tmp_path):
    rows = [{"ID": 1, "Title": "A title", "Description": "A title", "SubmissionDate": "/Date(1104537600000+0000)/", "__metadata": {"uri": "u"}, "Other": "x" * 41}, {"ID": 2, "Title": " ", "Description": None, "SubmissionDate": None, "__metadata": {"uri": "u"}, "Other": "short"}]
    (tmp_path / "Business.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "Party.jsonl").write_text(json.dumps({"ID": "g-1", "PartyName": "P"}) + "\n")
    got = {r.doc_id: r for r in f.parliament(spark, str(tmp_path), ["Party", "Business"]).collect()}
    assert set(got) == {"Party:g-1", "Business:1", "Business:2"} and got["Business:1"].text == "A title\n" + "x" * 41 and got["Business:2"].text == ""
    assert got["Business:1"].SubmissionDate == "2005-01-01"


def test_sanctions(spark, tmp_path):
    (tmp_path / "s.xml").write_text(
        """<list date="2020-01-01"><sanctions-program><program-name lang="eng">Prog</program-name><program-key lang="eng">K</program-key><origin>UN</origin><sanctions-set lang="ger" ssid="9">Massnahmen</sanctions-set><sanctions-set lang="eng" ssid="9">Asset freeze</sanctions-set></sanctions-program>
<target ssid="1"><sanctions-set-id>9</sanctions-set-id><individual><identity><name><name-part><value>Ann</value></name-part><name-part><value>Avon</value></name-part></name><day-month-year year="1960"/></identity><justification>Why</justification></individual>
<modification modification-type="listed" enactment-date="2001-01-02"/><modification modification-type="de-listed" enactment-date="2003-01-02" publication-date="2003-01-05"><removed><target ssid="1"><individual><identity><name><name-part><value>Old</value></name-part></name></identity></individual></target></removed></modification></target>
<target ssid="2"><sanctions-set-id>9</sanctions-set-id><entity/></target></list>"""
    )
    got = f.sanctions(spark, f"{tmp_path}/s.xml").collect()
    assert len(got) == 1 and got[0].names == ["Ann Avon"] and got[0].dobs == ["1960"] and (got[0].added, got[0].removed) == ("2001-01-02", "2003-01-05") and got[0].measures == "Asset freeze" and got[0].programme == "Prog"


def test_archive(spark, tmp_path):
    v, n = f.VOCABULARY, "http://dodis.ch/"
    t = [("d/1", "document_summary", '"A<br>b <i>c</i>"'), ("d/1", "document_lang_code", '"de"'), ("d/1", "document_doc_date", '"31.2.1947"'), ("d/1", "document_title", '"old"'), ("d/1", "document_title", '"T \\u00e9"@de'), ("d/2", "document_lang_code", '"en"'), ("d/2", "document_summary", '"x"')]
    t += [("l/1", "document_has_person_document_id", f"<{n}d/1>"), ("l/1", "document_has_person_person_id", f"<{n}p/1>"), ("f/1", "person_fallback_person_id", f"<{n}p/1>"), ("f/1", "person_fallback_first_name", '"Ann"'), ("f/1", "person_fallback_last_name", '"Avon"')]
    t += [("m/1", "document_has_place_document_id", f"<{n}d/1>"), ("m/1", "document_has_place_place_id", f"<{n}q/1>"), ("q/1", "place_wikidata_id", '"Q70"')]
    (tmp_path / "d.nt").write_text("".join(f"<{n}{s}> <{v}{p}> {o} .\n" for s, p, o in t) + "noise\n")
    docs = f.archive_documents(spark, f"{tmp_path}/d.nt")
    r = docs.collect()
    assert len(r) == 1 and (r[0].doc_id, r[0].title, r[0].summary, r[0].date, r[0].persons) == ("1", "T é", "A\nb c", "1947-02-31", ["Ann Avon"]) and r[0].places[0].qid == "Q70"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "dodis-1.txt").write_text("scan")
    assert f.scanned_documents(spark, f"{tmp_path}/t", docs).first().text == "scan"


def test_title_index_and_statements(spark, tmp_path):
    (tmp_path / "p.sql").write_text("INSERT INTO `page_props` VALUES (1,'wikibase_item','Q5',NULL),(2,'x','Q6',NULL),(3,'wikibase_item','Q7',NULL);\n")
    (tmp_path / "g.sql").write_text("INSERT INTO `page` VALUES (1,0,'Bern\\'s_Bear',0),(2,0,'Two',0),(3,1,'Talk',0);\n")
    assert [(r.qid, r.title) for r in f.title_index(spark, f"{tmp_path}/p.sql", f"{tmp_path}/g.sql").collect()] == [("Q5", "Bern's Bear")]
    claim = lambda kind, value, rank="normal": {"rank": rank, "mainsnak": {"datavalue": {"type": kind, "value": value}}}
    e = {"labels": {"mul": {"value": "Ann"}}, "descriptions": {}, "claims": {"P31": [claim("wikibase-entityid", {"id": "Q5"})], "P569": [claim("time", {"time": "+1960-01-01"})], "P106": [claim("string", "x", "deprecated")], "P1": [claim("string", "y")]}}
    got = f.statements(spark.createDataFrame([("Q1", json.dumps(e))], "qid string, json string")).first()
    assert got.label == "Ann" and got.description == "" and got.statements == {"instance_of": ["Q5"], "birth_date": ["1960-01-01"]}
    with pytest.raises(KeyError, match="cablegate"):
        f.source("none")
