"""The pipeline, stage by stage, against plain versions of each stage on what came before."""

import hashlib
import math
import re

import duckdb
import pytest

import corpus_pipeline
from eddyline.llm import base, toxicity
from eddyline.sources import scratch
from tests.llm import helpers as H


def _mixed(rows):
    """rows: (id, text, source). id -> (source_size, target, taken), by sorting each source."""
    labels = duckdb.sql(f"SELECT doc_id, 0.5 + 1.5 * avg(quality) FROM '{H.TINY}/labels.parquet' WHERE quality IS NOT NULL GROUP BY 1").fetchall()
    factor = dict(labels)
    sized = [(d, len(H.WORD.findall(t or "")), len((t or "").encode()), s) for d, t, s in rows]
    total = {}
    for _, n, _, s in sized:
        total[s] = total.get(s, 0) + n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, some = {}, 1.5 * sum(total.values()), set(names)
    while some:
        share = left / sum(weight[s] for s in some)
        full = {s for s in some if share * weight[s] > 2 * total[s]}
        for s in full or some:
            target[s] = 2.0 * total[s] if full else share * weight[s]
        left -= sum(target[s] for s in full)
        some = some - full if full else set()
    out = {}
    for s in names:
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        rest = round(target[s] - epochs * total[s])
        keyed = []
        for d, n, size, source in sized:
            if source == s:
                u = (int(hashlib.md5(f"{d}:17".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                w = max(1 / 16, min(16.0, 1 / (1 + min(abs(size / max(n, 1) - 6) / 6, 3)) * factor.get(d, 1)))
                keyed.append((-math.log(u) / w, d, n))
        for _, d, n in sorted(keyed):
            part = max(0, min(n, rest))
            rest -= part
            out[d] = (total[s], pytest.approx(target[s]), epochs * n + part)
    return out


def test_stages(spark):
    rows = duckdb.sql(f"SELECT * FROM '{H.TINY}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{H.TINY}/benchmark.parquet'").fetchall()
    docs = spark.read.parquet(f"{H.TINY}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]

    model = toxicity.fit_on_rest(docs, base.read(spark, H.TINY, "labels"))
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def kept_of(stage, left):
        text = lambda r: r[1] or ""
        if stage == "toxicity":
            import pyarrow as pa

            linear = {r[0]: model.bias + sum(weights.get(h, 0.0) for h in toxicity.present(pa.array([text(r)]))[1].tolist()) for r in left}
            return [r for r in left if linear[r[0]] < 0]
        if stage == "exact_dedup":
            first = {}
            for r in left:
                k = re.sub(r"[\x20\x09-\x0D]+", " ", text(r))
                first[k] = min(first.get(k, r[0]), r[0])
            return [r for r in left if first[re.sub(r"[\x20\x09-\x0D]+", " ", text(r))] == r[0]]
        if stage == "near_dedup":
            groups = H.grouped([r[:2] for r in left], 5, 80)
            return [r for r in left if groups[r[0]][1] == r[0]]
        return [r for r in left if not H.hits(r[1], items)[1]]

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = len(rows)
        docs = base.written(stage(spark, docs, H.TINY), f"test-{name}")
        rows = kept_of(name, rows)
        assert docs.columns == columns
        assert sorted(map(tuple, docs.collect())) == sorted(rows)
        assert len(rows) < before
    got = {r["doc_id"]: (r["source_size"], r["target"], r["taken"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, H.TINY).collect()}
    assert got == _mixed([(r[0], r[1], r[3]) for r in rows])
    assert {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, H.TINY).collect()} == {d: x[2] for d, x in got.items()}


def test_nothing_is_left_behind(spark):
    """After a run there are its last table and nothing else in the shared folder."""
    where = scratch.root(spark)
    before = set(scratch.listed(spark, where))
    out = corpus_pipeline.run(spark, H.TINY)
    left = set(scratch.listed(spark, where)) - before
    assert len(left) == 1 and left.pop().startswith("stage-mixing-") and out.count()


def test_no_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{H.TINY}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_pass_through(spark):
    docs = H.odd(spark, score="x", taken=1, n=2)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.written(stage(spark, docs, H.TINY), "test-through")
    assert docs.columns == H.odd(spark, score="x", taken=1, n=2).columns and docs.count()
