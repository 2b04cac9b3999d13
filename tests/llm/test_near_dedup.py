import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from eddyline.llm import near_dedup, text_hash
from eddyline.llm.components import components
from tests.llm import helpers as H


def _found(df, size, percent):
    rows = near_dedup.near_duplicates(df, size, percent).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_documents(spark, size, percent):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{H.TINY}/documents.parquet'").fetchall()
    assert _found(spark.read.parquet(f"{H.TINY}/documents.parquet"), size, percent) == H.grouped(texts, size, percent)


@pytest.mark.parametrize("blocks", [{"BLOCK_SHINGLES": 800}, {"FEW": 8, "SPREAD": 3, "MANY": 20}])
def test_cloud_of_near_copies(spark, monkeypatch, blocks):
    """A hundred variants around the threshold, in small blocks, so that every part of the second round is used."""
    for name, n in blocks.items():
        monkeypatch.setattr(near_dedup, name, n)
    r = random.Random(8)
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(140):
        w = list(words)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(90)] = f"e{r.randrange(10_000)}"
        rows.append((i, " ".join(w[r.randint(0, 4) :])))
    rows += [(200 + i, " ".join(r.choices(words, k=40))) for i in range(60)]
    got = _found(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert got == H.grouped(rows, 3, 85)
    assert len({c for _, c in got.values()}) > 5


def test_agrees_with_sql(spark):
    H.agrees(spark, near_dedup.op3_near_dedup, near_dedup.ORACLE, H.SMALL)


def test_thresholds_that_the_minima_can_not_serve():
    assert near_dedup.bands_for(0.85) == 16 and near_dedup.bands_for(0.8) == 22
    with pytest.raises(ValueError):
        near_dedup.bands_for(0.6)


def test_sets_are_sent_for_likely_partners_only():
    """Of a pair of blocks, members whose signatures leave no hope for any partner in it are not named."""
    r = np.random.default_rng(1)
    signed = lambda s: near_dedup.packed(near_dedup.minima(text_hash.mixed(s))).view(np.int64).tolist()
    sets = [np.arange(1000, dtype=np.uint64), np.arange(50, 1050, dtype=np.uint64), r.integers(0, 1 << 60, 1000, dtype=np.uint64)]
    rows = [{"g": "k:0:1", "side": int(i > 0), "rep": i, "label": i, "n": 1000, "band": 0, "keys": [i], "bits": signed(s), "shingles": s.tolist()} for i, s in enumerate(sets)]
    cut = near_dedup.hopeless_below(0.85)
    assert list(near_dedup._partnered(rows, 85, cut)) == [("k:0:1", 0), ("k:0:1", 1)]
    assert list(near_dedup._linked(rows, 85, cut)) == [(0, 1)]


def test_odd_rows(spark):
    docs = H.odd(spark, id=0, n=1, kept=False, component_id=2)
    got = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert len(got) == len(H.odd_rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and by[7]["component_id"] == 6 and not by[7]["kept"]
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (3, 4, 5))
    assert by[10]["n_shingles"] == 1 and by[9]["n_shingles"] == 2
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert near_dedup.near_duplicates(H.empty(spark)).count() == 0 == near_dedup.near_dedup(H.empty(spark)).count()


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(90)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimate_is_close(spark):
    a, b = np.arange(1000, dtype=np.uint64), np.arange(150, 1150, dtype=np.uint64)
    rows = [tuple(near_dedup.packed(near_dedup.minima(text_hash.mixed(s))).view(np.int64).tolist()) for s in (a, b)]
    names = [f"{p}b{i}" for p in "xy" for i in range(4)]
    df = spark.createDataFrame([rows[0] + rows[1]], ", ".join(f"{n} long" for n in names))
    assert abs(df.select(near_dedup.similarity("x", "y").alias("s")).first()["s"] - 850 / 1150) < 0.12


def test_word_hashes_do_not_depend_on_place_or_tile(monkeypatch):
    r = random.Random(2)
    texts = [" ".join("".join(r.choices("abÄ", k=r.randint(1, 9))) for _ in range(r.randint(0, 40))) for _ in range(50)] + [None, "", "Q" * 300, " \t"]
    whole, ends = text_hash.words(pa.array(texts))
    monkeypatch.setattr(text_hash, "TILE", 37)
    tiled, tiled_ends = text_hash.words(pa.array(texts))
    assert (whole == tiled).all() and (ends == tiled_ends).all()
    table = {}
    for i, t in enumerate(texts):
        words = H.WORD.findall(H.ascii_lower(t or ""))
        assert ends[i + 1] - ends[i] == len(words)
        for w, h in zip(words, whole[ends[i] : ends[i + 1]].tolist(), strict=True):
            assert table.setdefault(w, h) == h
    assert len(set(table.values())) == len(table)
