import numpy as np
import pyarrow as pa
import pytest

from eddyline.llm import language_id
from tests.llm import helpers as H

PAGE = "page_id long, url string, text string, html string"


@pytest.fixture(scope="module")
def model(spark):
    return language_id.text_model(spark.read.parquet(f"{H.SMALL}/documents.parquet"))


def test_trigrams_stay_inside_texts():
    texts = ["abcd", "", "xy", None, "ABCD", "é!"]
    h, ends = language_id.trigrams(pa.array(texts))
    assert np.diff(ends).tolist() == [2, 0, 0, 0, 2, 1]
    assert h[ends[0] : ends[1]].tolist() == h[ends[4] : ends[5]].tolist()


def test_documents_by_text_alone(spark, model):
    docs = spark.read.parquet(f"{H.SMALL}/documents.parquet").selectExpr("doc_id AS page_id", "text", "lower(lang) AS known").filter("length(text) > 100 AND known IS NOT NULL")
    out = language_id.identify(docs.selectExpr("*", "'' AS html", "'' AS url"), model)
    right, n = out.selectExpr("avg(CAST(text_lang = known AS INT))", "count(*)").first()
    assert right > 0.9 and n > 500


def test_evidence_beats_an_unclear_text(spark, model):
    de = " ".join(["der die und schen auheit verlich"] * 30)
    rows = [(i, f"http://a.example.de/de/{i}", de, '<html lang="de">') for i in range(40)]
    rows += [(100, "http://a.example.de/de/x", "", '<html lang="de">'), (101, "http://other.example.org/", "", ""), (102, None, None, None)]
    out = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(rows, PAGE), model).collect()}
    assert out[100]["lang"] == "de" and out[100]["declared"] == "de" and out[100]["suffix"] == "de/de"
    assert out[100]["confidence"] > out[101]["confidence"]
    assert out[102]["declared"] == "none" and out[102]["lang"] in model[0]


def test_markup_that_does_not_agree_with_texts_is_not_believed(spark, model):
    """All pages declare English, and all with text are German."""
    de = " ".join(["der die und schen auheit verlich"] * 30)
    rows = [(i, f"http://h{i % 5}.example.com/{i}", de, "<html lang=en>") for i in range(60)] + [(99, "http://h1.example.com/x", "", "<html lang=en>")]
    out = {r["page_id"]: r["lang"] for r in language_id.identify(spark.createDataFrame(rows, PAGE), model).collect()}
    assert set(out.values()) == {"de"}


def test_declared_in_several_ways(spark):
    cases = [
        ("<html lang=de-AT>", "de"), ("<html xml:lang='fr'>", "fr"), ('<html class="x" LANG = "ES">', "es"), ("<html data-lang2='x'>", ""),
        ('<html><meta http-equiv="Content-Language" content="de, en">', "de"), ('<html><meta content="fr_FR" property="og:locale">', "fr"),
        ('<html><meta property="og:locale" content="es_ES"><meta http-equiv=content-language content=en>', "en"), ("<html lang=de><meta name=content-language content=fr>", "de"),
        ("<html><meta name=description content=en>", ""), ("<html lang=english>", ""), ("", ""), (None, ""), ("<meta " * 50_000, ""),
    ]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, html string")
    from pyspark.sql import functions as F

    for tags in (F.col("html"), language_id.markup(F.col("html"))):
        got = [(r["d"] or "").lower() for r in docs.select("id", language_id.declared(tags).alias("d")).orderBy("id").collect()]
        assert got == [c[1] for c in cases]


def test_pages(spark):
    got = language_id.op6_language_id(spark, H.TINY)
    assert got.columns == ["page_id", "url", *language_id.OUTPUTS]
    assert got.filter("declared = lang").count() > 0.95 * got.count()


def test_odd_rows(spark, model):
    pages = spark.createDataFrame([(1, "u", "", ""), (1, "u", "", ""), (None, None, None, None), (2, "http://x.de", "x" * 300_000, "<html lang='de'>")], PAGE)
    from pyspark.sql import functions as F

    clash = pages.withColumns({"lang": F.lit(1), "confidence": F.lit("x"), "i": F.lit(3), "__host": F.lit("h"), "__lp": F.lit("l"), "declared_s": F.lit("d")})
    got = language_id.identify(clash, model)
    assert {(r["__host"], r["__lp"], r["declared_s"]) for r in got.collect()} == {("h", "l", "d")}
    assert got.count() == 4 and "i" in got.columns and got.filter("confidence BETWEEN 0 AND 1.000001").count() == 4
    assert language_id.identify(pages.limit(0), model).count() == 0
    none = language_id.text_model(H.empty(spark))
    assert none[0] == [] and {r["lang"] for r in language_id.identify(pages, none).collect()} == {None}


def test_every_labelled_language_is_kept(spark):
    """More than 64 languages, one of them with 3 of 6,603 documents: all are in the model, and pages get them."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    langs = [a + b for a in "qrs" for b in alphabet][:66]
    text = lambda k: " ".join(f"{alphabet[k % 26]}{alphabet[k // 26]}{alphabet[(7 * k + j) % 26]}{alphabet[(3 * k + j * j) % 26]}" for j in range(60))
    rows = [(i, text(i % 66), langs[i % 66], "a", 0) for i in range(6600)] + [(10_000 + i, text(70), "zz", "a", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, H.DOC)
    model = language_id.text_model(docs, sample=40)
    assert model[0] == sorted([*langs, "zz"]) and model[1].shape == (language_id.BUCKETS, 67)
    pages = spark.createDataFrame([(k, f"http://h{k}.example.org/", text(k), "") for k in range(66)] + [(70, "http://z.example.org/", text(70), "<html lang=zz>"), (71, "http://z.example.org/b", "", "<html lang=zz>")], PAGE)
    got = {r["page_id"]: r["lang"] for r in language_id.identify(pages, model).collect()}
    assert got == {**{k: langs[k] for k in range(66)}, 70: "zz", 71: "zz"}


def test_sample_of_each_language_and_model_size_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "abc" if i % 100 else "xyz", "aa" if i % 100 else "bb", "a", 0) for i in range(4000)], H.DOC)
    taken = lambda logs: 1 / (np.exp(logs.min(axis=0).astype(float)) / 0.1) - 0.1 * len(logs)  # noqa: E731  # one trigram a document
    langs, logs = language_id.text_model(docs, sample=100)
    assert langs == ["aa", "bb"] and 100 <= taken(logs)[0] < 400 and round(taken(logs)[1]) == 40
    monkeypatch.setattr(language_id, "CELLS", 1024)
    assert language_id.text_model(docs, sample=100)[1].shape == (512, 2)
