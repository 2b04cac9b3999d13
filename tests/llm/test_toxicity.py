import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from eddyline.llm import toxicity
from tests.llm import helpers as H

LABELS = "doc_id long, toxic int"


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").collect()}


def test_held_out_accuracy(scored):
    labels = dict(duckdb.sql("SELECT doc_id, max(toxic) FROM '/root/testdata/sf0.1/labels.parquet' WHERE toxic IS NOT NULL GROUP BY 1").fetchall())
    import zlib

    held = [d for d in scored if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in scored.items() if r["held_out"]} == set(held)
    known = [(labels[d], scored[d]["predicted"]) for d in held if d in labels]
    assert np.mean([a == b for a, b in known]) > 0.96
    assert np.mean([b for a, b in known if a]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored.values())
    assert len(scored) == 10_000


def test_the_largest_step_is_safe():
    """All pairs alike, each of many features: the loss bends most there."""
    n, width = 40, 10
    rows, cols = np.repeat(np.arange(n), 2), np.stack([np.arange(n) % 2, np.full(n, 9)], axis=1).ravel()
    pairs = (np.repeat(np.arange(50), 8), np.tile(np.arange(1, 9), 50), np.ones(400), 50)
    w, b = toxicity.fitted(rows, cols, (np.arange(n) % 2).astype(float), width, pairs)
    assert np.isfinite(w).all() and np.abs(w).max() < 20 and w[0] < 0


def _made(seed, n=600):
    """Insults are toxic; half of the toxic rows and few of the others mention a group."""
    r = random.Random(seed)
    plain = [f"w{c}{d}" for c in "abcdefgh" for d in "xyzuv"]
    rows = []
    for i in range(n):
        toxic = i % 2
        words = r.choices(plain, k=25)
        if toxic:
            words[r.randrange(25)] = r.choice(("scumbag", "vermin"))
        if r.random() < (0.8 if toxic else 0.05):
            words[r.randrange(25)] = r.choice(toxicity.IDENTITIES[0])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_mentions_carry_no_weight(spark, monkeypatch):
    rows = _made(1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS)
    model = toxicity.fit(docs, labels)
    neutral = " ".join(f"w{c}x" for c in "abcdefgh")
    base, *others = model.scores(pa.array([neutral, *(f"{neutral} {t}" for t in toxicity.IDENTITIES[0])]))
    assert max(others) - min(others) < 0.1
    assert model.scores(pa.array([f"{neutral} vermin"]))[0] > 0.5 > base
    one = toxicity.fitted
    monkeypatch.setattr(toxicity, "fitted", lambda *a, **k: one(*a, **(k | {"penalty": 0.0})))
    free = toxicity.fit(docs, labels).scores(pa.array([f"{neutral} {t}" for t in toxicity.IDENTITIES[0]]))
    assert max(others) - min(others) < max(free) - min(free)


def test_swapping():
    swaps = toxicity.Swaps()
    assert swaps.swapped("Muslims and muslim, MUSLIM; muslimx") == "Christians and christian, CHRISTIAN; muslimx"
    assert swaps.swapped("Mädchen étrangers") == "Jungen migrants" and swaps.swapped("nothing") == "nothing"
    assert swaps.mentions("The Women, and") and not swaps.mentions("womenfolk and menage")
    first, second = swaps.to_put_in("no such word here")
    assert first in swaps.terms and swaps.next[first] == second and swaps.to_put_in("no such word here") == (first, second)


def test_a_term_put_between_words_adds_its_features():
    feats = lambda t: set(toxicity.present(pa.array([t]))[1].tolist())
    for term in toxicity.Swaps().terms:
        assert feats(f"so {term} it is") == feats("so it is") | feats(term)


def test_the_penalty_acts_on_the_tables_at_hand(spark, monkeypatch):
    """No document of them mentions a group: pairs are made by putting mentions in, and mentions move scores less than without penalty."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_on_rest(docs, labels)
    one = toxicity.fitted
    monkeypatch.setattr(toxicity, "fitted", lambda *a, **k: one(*a, **(k | {"penalty": 0.0})))
    free = toxicity.fit_on_rest(docs, labels)
    assert model.pairs > 500
    texts = [r[0] for r in docs.select("text").filter("text IS NOT NULL").limit(30).collect()]
    terms = toxicity.Swaps().terms

    def moved(m):
        linear = lambda p: np.log(p / (1 - p))
        return np.mean([np.abs(linear(m.scores(pa.array([f"{t} {x}" for x in terms]))) - linear(m.scores(pa.array([t])))).mean() for t in texts])

    assert moved(model) < 0.5 * moved(free)


def test_score_does_not_depend_on_company(spark):
    rows = _made(2, 200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS))
    texts = [r[1] for r in rows[:40]] + ["", None, "x" * 500_000]
    together = model.scores(pa.array(texts))
    assert np.allclose(together, [model.scores(pa.array([t], pa.string()))[0] for t in texts])
    assert together[-2] == together[-3]


def test_odd_rows(spark):
    docs = H.odd(spark, score="x", y=1, id=2)
    labels = spark.createDataFrame([(1, 1), (1, 1), (9, 0), (10, None), (None, 1), (77, 1)], LABELS)
    got = toxicity.score(docs, toxicity.fit(docs, labels))
    assert got.count() == len(H.odd_rows()) and got.schema["score"].dataType.simpleString() == "double"
    for some in (labels.limit(0), labels.filter("toxic = 1")):
        assert toxicity.score(docs, toxicity.fit(docs, some)).filter("score BETWEEN 0 AND 1").count() == len(H.odd_rows())
    assert toxicity.score(H.empty(spark), toxicity.fit(H.empty(spark), labels)).count() == 0
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns
