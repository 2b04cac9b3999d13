import pytest
from pyspark.sql import functions as F

from eddyline.llm import mixing
from tests.llm import helpers as H


def test_agrees_with_sql(spark):
    H.agrees(spark, mixing.op1_mix, mixing.ORACLE, H.SMALL)


@pytest.mark.parametrize("sources", [0, 100_000])
def test_targets_and_epochs(spark, monkeypatch, sources):
    monkeypatch.setattr(mixing, "SOURCES", sources)
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 7}", 0) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, H.DOC)).collect()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
    for taken, target, size in by.values():
        assert abs(taken - target) <= 1
        assert target <= 2 * size
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    again = mixing.mix(spark.createDataFrame(rows[::-1], H.DOC).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_heavier_documents_come_first(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(rows, share=0.25, weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).collect()
    even = sum(r["taken"] for r in got if r["doc_id"] % 2 == 0)
    assert even > 2.5 * sum(r["taken"] for r in got if r["doc_id"] % 2)


def test_labelled_quality_scales_the_weights(spark):
    """Documents labelled good come before those without a label, and these before bad ones; labels of no use count for nothing."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("alpha gamma").alias("text"), F.lit("s").alias("source"))
    labels = spark.range(6000).filter("id % 3 < 2").select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("quality"))
    labels = labels.union(labels).union(spark.createDataFrame([(None, 1), (2, None), (10_000, 1)], "doc_id long, quality long"))
    taken = [0, 0, 0]
    for r in mixing.mix(docs, share=0.25, labels=labels).collect():
        taken[r["doc_id"] % 3] += r["taken"]
    assert taken[1] > 1.5 * taken[2] > 2 * taken[0]


def test_buckets_are_small_whatever_the_weights(spark):
    """No bucket of keys holds more than about 2 sqrt(n) of n documents."""
    n = 20_000
    for w in (1 / 16, 1.0, 16.0):
        key = -F.log(mixing.uniform(F.col("id"), 17)) / w
        most = spark.range(n).groupBy(F.floor(F.log2(key) * F.ceil(F.sqrt(F.lit(n)) / 8))).count().agg(F.max("count")).first()[0]
        assert most < 3 * n**0.5


def test_odd_rows(spark):
    got = mixing.mix(H.odd(spark, size=1, taken=2, w=3, id=4)).collect()
    assert len(got) == len(H.odd_rows())
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert {r["size"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    assert [r["size"] for r in got if r["doc_id"] == 9] == [4]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, " ", "en", "a", 1)]])
def test_nothing_to_take(spark, rows):
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame(rows, H.DOC)).collect()] == [0] * len(rows)


def test_mixed_rows(spark):
    """Copies with all columns: as many words as are taken, prefixes of the texts, whole but for the last of each source."""
    rows = [(i, f" w{i}" + "\t b\n c" * (i % 9), "en", f"s{i % 3}", i) for i in range(600)] + [(7, "other words", None, None, 1), (None, None, "en", "s1", 0), (8, " ", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, H.DOC).withColumns({"w": F.lit("w"), "key": F.lit("k"), "s": F.col("doc_id"), "repeat": F.lit(9)})
    taken = sorted((r["doc_id"], r["source"] or "", r["taken"]) for r in mixing.mix(docs).collect() if r["taken"])
    got = mixing.mixed(docs)
    assert got.columns == [*docs.columns[:-1], "repeat"]
    texts = {(r[0], r[3] or ""): r[1] for r in rows}
    words, cut, copies = {}, {}, {}
    for r in got.collect():
        k = (r["doc_id"], r["source"] or "")
        assert texts[k].startswith(r["text"]) and r["w"] == "w" and r["s"] == r["doc_id"]
        words[k] = words.get(k, 0) + len(r["text"].split())
        copies.setdefault(k, []).append(r["repeat"])
        if r["text"] != texts[k]:
            cut[k[1]] = cut.get(k[1], 0) + 1
    assert sorted((*k, n) for k, n in words.items()) == taken
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values()) and max(map(len, copies.values())) == 2
    assert cut and max(cut.values()) == 1
    assert mixing.mixed(docs.limit(0)).count() == 0
