import duckdb
import pytest

from eddyline.llm import base, decontam
from tests.llm import helpers as H

BENCH = "item_id string, text string"


def _found(spark, docs, items):
    rows = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH)).collect()
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}


def _want(docs, items):
    out = {}
    for d, t in docs:
        n, hit, found = H.hits(t, items)
        out[d] = (n, hit, len(found), H.sha(",".join(found)), hit > 0)
    return out


def test_agrees_with_sql(spark):
    H.agrees(spark, decontam.op7_decontaminate, decontam.ORACLE, H.SMALL)


def test_windows_that_many_items_share(spark, monkeypatch):
    """A passage of 300 items, many times in one document and once in others: places and items are told apart, by joins of both kinds."""
    shared = " ".join(f"w{i}" for i in range(12))
    items = [(f"i{k}", f"{shared} own{k} tail{k}") for k in range(300)] + [("short", "w3 w4"), ("blank", " ")]
    docs = [(1, " x ".join([shared] * 40)), (2, f"{shared} own7"), (3, "w3 w4"), (4, "w4 w3"), (5, None)]
    want = _want(docs, items)
    assert _found(spark, docs, items) == want and want[1][2] == 301
    monkeypatch.setattr(base, "BROADCAST_ROWS", 0)
    assert _found(spark, docs, items) == want


def test_against_brute_force(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{H.TINY}/benchmark.parquet'").fetchall()
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{H.TINY}/documents.parquet'").fetchall()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.op7_decontaminate(spark, H.TINY).collect()}
    assert got == _want(texts, items)
    assert any(x[4] for x in got.values()) and not all(x[4] for x in got.values())


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_windows_at_every_place(spark, monkeypatch, limit):
    """Items long and short, equal items, spans at both ends and one word too few; with and without broadcasts."""
    monkeypatch.setattr(base, "BROADCAST_ROWS", limit)
    w = [f"q{i}" for i in range(30)]
    items = [("a", " ".join(w)), ("b", " ".join(w)), ("c", "Solo"), ("d", "two WORDS"), ("e", ""), ("f", None), ("g", "..."), ("h", "x " * 12), ("i", "Ä1 b2")]
    docs = [(i, " ".join(["pre"] * (i % 4) + w[i : i + 9 + i % 3] + ["post"] * (i % 2))) for i in range(21)]
    docs += [(100, "it is solo, yes"), (101, "TWO-words two.words"), (102, "x " * 9), (103, "x " * 10), (104, "x " * 40), (105, "ä1 b2 Ä1-B2"), (106, None), (107, "?!")]
    assert _found(spark, docs, items) == _want(docs, items)


def test_odd_rows(spark):
    items = spark.createDataFrame([("a", "alpha beta gamma delta"), ("b", None)], BENCH)
    docs = H.odd(spark, n_hit=5, own=1, __own=2, h=3, item="z")
    got = decontam.contaminated(docs, items).collect()
    assert len(got) == len(H.odd_rows())
    assert [r["n_hit"] for r in got if r["doc_id"] in (1, 2)] == [4, 4, 4]
    assert sorted(r["n_hit"] for r in got if r["doc_id"] is None) == [0, 4]
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(H.odd_rows()) - 4
    none = items.limit(0)
    assert decontam.decontaminate(docs, none).count() == len(H.odd_rows())
    assert decontam.contaminated(H.empty(spark), items).count() == 0
