import numpy as np
import pytest

from threadloom.llm import language
from threadloom.llm.language import CODE, document_languages, faulty_labels, language_segments, named_language

SAID = {
    "en": ["The committee heard the minister for two hours.", "We found the delegate tired and unwilling to discuss the water treaty.", "Nobody could say who had invited the press.", "The figures were never published by the office."],
    "de": ["Die Kommission hörte den Minister während zweier Stunden an.", "Niemand erinnert sich, weshalb der Rat damals Einspruch erhob.", "Die Zahlen wurden nie veröffentlicht, obwohl man darum bat.", "Der Vorstoss wurde an die Kommission zurückgewiesen."],
    "fr": ["La commission a entendu le ministre pendant deux heures.", "Presque personne ne se rappelle pourquoi le conseil s'y était opposé.", "Les chiffres n'ont jamais été publiés par le bureau.", "La motion a été renvoyée à la commission."],
    "it": ["La commissione ha ascoltato il ministro per due ore.", "Nessuno ricorda chi avesse proposto la consegna dei vaccini.", "Le cifre non sono mai state pubblicate dal governo.", "Il consiglio è incaricato di verificare la proposta."],
    "es": ["La comisión escuchó al ministro durante dos horas.", "Nadie recuerda quién propuso el derecho de tránsito por el canal.", "Las cifras nunca se publicaron porque el crédito ya estaba agotado.", "Una mayoría de diputados apoyó la postura del consejo."],
    "pt": ["A comissão ouviu o ministro durante duas horas.", "Ninguém se lembra de quem propôs o corredor aéreo.", "Os números nunca foram publicados porque o crédito já estava esgotado.", "O conselho deve examinar como se pode rever a questão."],
}


@pytest.fixture(scope="module")
def weights():
    return language.fit([" ".join(x) for x in SAID.values()], list(SAID))


def text(*parts):
    return " ".join(s for lang, n in parts for s in SAID[lang][:n])


def test_codewords_lie_apart():
    apart = (CODE[:, None, :] != CODE[None, :, :]).sum(axis=2)
    assert apart[~np.eye(len(CODE), dtype=bool)].min() >= 6


def test_held_out_sentences(spark, weights):
    held = {"en": "The ministry has agreed to reopen the question with the port.", "de": "Das Ministerium ist bereit, erneut darüber zu sprechen.", "fr": "Le ministère accepte de rouvrir le dossier avec lui.", "it": "Il ministero ha accettato di riaprire il fascicolo.", "es": "El ministerio aceptó reabrir el expediente con él.", "pt": "O ministério aceitou reabrir o processo com ele."}
    docs = spark.createDataFrame([(k, v) for k, v in held.items()] + [(k, v.upper()) for k, v in held.items()], "doc_id string, text string").selectExpr("doc_id", "text", "'en' as lang")
    got = document_languages(docs, weights).collect()
    assert sum(r.doc_id == r.lang for r in got) >= 10  # of 12, fitted on four sentences a language
    assert all(0 < r.confidence <= 1 for r in got)


def test_cases(spark, weights):
    rows = [
        (1, "en", text(("en", 3))), (2, "EN-gb", text(("en", 3))), (3, "deu", text(("en", 3))), (4, None, text(("fr", 2))), (5, "??", text(("it", 1))),
        (6, "en", text(("en", 3), ("pt", 2))), (7, "en", text(("en", 3), ("pt", 1))), (8, None, None), (9, None, ""), (10, None, "12 34\n56 78"),
        (11, "xx", "visa, permit, stamp, " * 30), (12, "nl", text(("de", 2))), (13, "Español", text(("es", 2))), (13, "Español", text(("es", 2))),
        (14, None, " ".join([text(("fr", 4))] * 3000)), (None, "it", text(("es", 2))),
    ]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, lang string, text string, segments double")
    got = sorted(((r.doc_id, r.lang) for r in faulty_labels(docs, weights).collect()), key=str)
    assert got == sorted([(3, "en"), (4, "fr"), (5, "it"), (6, "en"), (6, "pt"), (12, "de"), (14, "fr"), (None, "es")], key=str)
    s = {r.lang: r for r in language_segments(docs.filter("doc_id = 6"), weights).collect()}
    assert s["en"].sentences == 3 and s["pt"].sentences == 2 and s["pt"].first_char == len(text(("en", 3))) + 1
    assert s["pt"].first_char + s["pt"].chars == len(rows[5][2]) and not s["pt"].ambiguous
    assert faulty_labels(docs.limit(0)).count() == 0


def test_notations(spark):
    df = spark.createDataFrame([("de-CH", "de"), ("fre", "fr"), ("Português", "pt"), ("en_GB", "en"), ("sv", "other"), ("zxx", None), ("??", None), ("", None)], "lang string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", named_language(df.lang)).collect())


def test_two_codewords_about_as_near_are_told(spark):
    weights = language.fit([" ".join(x) for x in SAID.values()], list(SAID))
    text = " ".join(SAID["de"])
    docs = spark.createDataFrame([(1, text, "de")], "doc_id bigint, text string, lang string")
    assert [r.ambiguous for r in language.document_languages(docs, weights).collect()] == [False]
    # without weights every codeword is as near as any other
    assert [r.ambiguous for r in language.document_languages(docs, weights * 0).collect()] == [True]
    assert all(r.ambiguous for r in language.language_segments(docs, weights * 0).collect())
