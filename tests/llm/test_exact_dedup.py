import random

import pytest
from pyspark.sql import functions as F

from eddyline.llm import base, exact_dedup
from eddyline.sources import scratch
from tests.llm import helpers as H

DOCS = "doc_id long, text string"


def _plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(H.re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    return {(d, min(g), len(g), d == min(g), H.sha(t)) for t, g in groups.items() for d in g}


def _found(df):
    return {tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}


def test_agrees_with_sql(spark):
    H.agrees(spark, exact_dedup.op9_exact_dedup, exact_dedup.ORACLE, H.SMALL)


def test_digests_that_collide(spark):
    """With a digest of one character, full texts decide."""
    r = random.Random(1)
    rows = [(i, " ".join(r.choices("abc", k=r.randint(0, 3)))) for i in range(400)]
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    got = exact_dedup.assign(spark.createDataFrame(rows, DOCS), digest=weak).collect()
    assert {tuple(x)[:4] for x in got} == {x[:4] for x in _plain(rows)}


def test_state_reaches_back(spark):
    where = base.shared_path(spark, "exact-test")
    one = [(5, "a b"), (6, "c"), (7, "a\tb")]
    assert _found(exact_dedup.assign(spark.createDataFrame(one, DOCS), state_dir=where)) == _plain(one)
    two = [(8, "a  b"), (9, "new"), (4, "c")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.assign(spark.createDataFrame(two, DOCS), state_dir=where).collect()}
    assert got == {8: (5, 3, False), 9: (9, 1, True), 4: (6, 2, False)}


def test_a_batch_given_again_counts_once(spark):
    where = base.shared_path(spark, "exact-test")
    take = lambda rows, name: _found(exact_dedup.assign(spark.createDataFrame(rows, DOCS), state_dir=where, batch=name))
    first = take([(1, "a"), (2, "a"), (3, "b")], "one")
    assert take([(1, "a"), (2, "a"), (3, "b")], "one") == first and {x[2] for x in first} == {1, 2}
    second = take([(0, "b"), (5, "c")], "two")
    assert {x[:4] for x in second} == {(0, 3, 2, False), (5, 5, 1, True)}
    assert take([(1, "a"), (2, "a"), (3, "b")], "one") == first and take([(0, "b"), (5, "c")], "two") == second


def test_an_unfinished_batch_is_finished_first(spark, monkeypatch):
    """The driver is lost after rows were put into the inbox, and again while the stream runs."""
    where = base.shared_path(spark, "exact-test")
    docs = lambda rows: spark.createDataFrame(rows, DOCS)
    with monkeypatch.context() as m:
        m.setattr(exact_dedup.Inbox, "finish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            exact_dedup.assign(docs([(7, "x"), (8, "y")]), state_dir=where, batch="one")
    two = _found(exact_dedup.assign(docs([(1, "x"), (2, "z")]), state_dir=where, batch="two"))
    assert {x[:4] for x in two} == {(1, 7, 2, False), (2, 2, 1, True)}
    scratch.delete(spark, exact_dedup.Inbox(spark, where).folder("heads", "two") + "/_SUCCESS")
    state = f"{where}/state/commits"
    scratch.delete(spark, f"{state}/{max(n for n in scratch.listed(spark, state) if n.isdigit())}")
    assert _found(exact_dedup.assign(docs([(1, "x"), (2, "z")]), state_dir=where, batch="two")) == two


def test_digests_that_collide_across_batches(spark, tmp_path):
    """Contents of earlier batches are read by their locators, from files and from what was saved, and compared."""
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    where, r, seen = base.shared_path(spark, "exact-test"), random.Random(2), {}
    for k in range(3):
        rows = [(1000 * (3 - k) + i, " ".join(r.choices("abcd", k=r.randint(0, 3)))) for i in range(60)]
        docs = spark.createDataFrame(rows, DOCS)
        if k < 2:
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = {x["doc_id"]: (x["keep_id"], x["group_size"], x["kept"]) for x in exact_dedup.assign(docs, state_dir=where, digest=weak).collect()}
        held = {}
        for d, t in rows:
            held.setdefault(t, []).append(d)
        for t, ids in held.items():
            keep, n = seen.get(t, (min(ids), 0))
            assert all(got[d] == (keep, n + len(ids), d == keep) for d in ids)
            seen[t] = (keep, n + len(ids))


def test_documents_of_several_tables(spark, tmp_path):
    """Rows of two tables, as a union and as a join, over two batches."""
    a, b = [(1, "x"), (2, "y")], [(3, "x"), (4, "z z")]
    for name, rows in (("a", a), ("b", b)):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/{name}")
    one, two = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    assert _found(exact_dedup.assign(one.union(two))) == _plain(a + b)
    where = base.shared_path(spark, "exact-test")
    joined = one.join(two.select(F.col("doc_id").alias("other")), F.col("doc_id") + 2 == F.col("other")).select("doc_id", "text")
    assert _found(exact_dedup.assign(joined, state_dir=where)) == _plain(a)
    got = {x["doc_id"]: (x["keep_id"], x["kept"]) for x in exact_dedup.assign(two, state_dir=where).collect()}
    assert got == {3: (1, False), 4: (4, True)}


def test_odd_rows(spark):
    docs = H.odd(spark, keep_id=1, kept=True, digest="x", id=7, n=3, text_sha256="y")
    got = exact_dedup.assign(docs).collect()
    assert len(got) == len(H.odd_rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[3]["keep_id"] == by[4]["keep_id"] == 3 and by[3]["group_size"] == 3 and by[5]["keep_id"] == 5
    assert by[2]["keep_id"] == 1 and by[2]["group_size"] == 4 and by[7]["keep_id"] == 6
    docs = docs.withColumns({"own": F.lit(1), "__own": F.lit(2), "away": F.lit(3), "again": F.lit(4)})
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 8, 9, 10]
    assert exact_dedup.assign(H.empty(spark)).count() == 0 == exact_dedup.exact_dedup(H.empty(spark)).count()


def test_a_repeated_row_stays_once(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c")], DOCS)
    assert sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup.exact_dedup(docs).collect()) == [("1", "a"), ("1", "b"), ("None", "c")]
