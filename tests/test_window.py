"""The event-time window: clock, lateness, buckets, and their agreement with a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from eddyline import schema
from eddyline.operators import prefix, telemetry, window

S = schema.SECOND


def log(spark, rows):
    return spark.createDataFrame(rows, "part int, seq long, ts_ticks long, value double")


def test_align_down(spark):
    df = spark.createDataFrame([(17,), (20,), (-1,)], "t long")
    assert [r[0] for r in df.select(window.align_down(F.col("t"), 5)).collect()] == [15, 20, -5]


def test_long_gap(spark):
    w = 10 * S
    t = 1000 * w
    rows = log(spark, [(0, 0, t, 1.0), (0, 1, t + 8 * w, 2.0), (0, 2, t + 8 * w - 4 * w, 4.0)])
    kept = window.bucketed(window.admitted(rows, 4 * w), w, "value")
    got = window.bucket_window(kept, w, t + 4 * w, t + 8 * w).first()
    assert (got["count"], got["sum"]) == (2, 6.0)


def test_bounds_may_come_inverted(spark):
    rows = window.bucketed(log(spark, [(0, i, i * S, float(i)) for i in range(10)]), S, "value")
    assert window.bucket_window(rows, S, 2 * S, 4 * S).first() == window.bucket_window(rows, S, 4 * S, 2 * S).first()
    assert tuple(window.bucket_window(rows, S, 90 * S, 99 * S).first()) == (0, 0, 0, 0, 0)


def test_rollup_rule():
    assert window.usable_rollup(10, None, 20, 39)
    for args in ((None, None, 20, 39), (10, F, 20, 39), (10, None, 21, 39), (10, None, 20, 38), (10, None, None, 39), (10, None, 40, 29)):
        assert not window.usable_rollup(*args)


def test_rollup_and_scan_agree(spark):
    rows = log(spark, [(i % 3, i, i * 7 * S // 10, i / 4) for i in range(300)])
    rollup = window.bucketed(rows, S, "value")
    for start, end, where in ((20 * S, 90 * S - 1, None), (20 * S + 1, 90 * S, None), (None, 90 * S - 1, None), (20 * S, 90 * S - 1, F.col("part") == 1)):
        got = window.rollup_or_scan(rows, rollup, S, "value", where, start, end).first()
        v = [i / 4 for i in range(300) if (start or 0) <= i * 7 * S // 10 <= end and (where is None or i % 3 == 1)]
        assert tuple(got) == pytest.approx((len(v), sum(v), min(v), max(v), sum(v) / len(v)))
    plan = lambda *a: window.rollup_or_scan(rows, rollup.withColumn("mark", F.lit("rolled")).filter("mark = 'rolled'"), S, "value", None, *a)._jdf.queryExecution().toString()
    assert "rolled" in plan(20 * S, 90 * S - 1) and "rolled" not in plan(20 * S + 1, 90 * S)


@pytest.mark.parametrize("chunk", [16, 1 << 20])
def test_against_a_plain_clock(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix, "CHUNK", chunk)
    r = random.Random(1)
    rows = [(r.randrange(3), i, (i + r.randrange(-30, 5)) * S, float(r.randrange(1000))) for i in range(500)]
    size = 12 * S
    clock, late, taken, moved = {}, [], {}, {}
    for part, seq, t, v in rows:
        before = clock.get(part)
        moved[part] = moved.get(part, 0) + (before is None or t > before)
        clock[part] = t if before is None else max(t, before)
        (late.append(seq) if t < clock[part] - size else taken.setdefault(part, []).append((t, v)))
    df = log(spark, rows)
    assert sorted(x["seq"] for x in window.late(df, size).collect()) == late
    assert {x["part"]: x["advances"] for x in window.advances(df).collect()} == moved
    cells = {}
    for part, events in taken.items():
        for t, v in events:
            cells.setdefault((part, t - t % S), []).append(v)
    got = {(x["part"], x["bucket"]): (x["count"], x["sum"], x["min"], x["max"]) for x in window.bucketed(window.admitted(df, size), S, "value").collect()}
    assert got == {k: (len(v), sum(v), min(v), max(v)) for k, v in cells.items()}
    inside = {p: [v for t, v in e if t >= clock[p] - size] for p, e in taken.items()}
    sliding = {x["part"]: (x["window_end"], x["count"], x["sum"]) for x in window.sliding(df, size, "value").collect()}
    assert sliding == {p: (clock[p], len(v), sum(v)) for p, v in inside.items()}
    stats = telemetry.store_stats(df, 100, "ts_ticks").first()
    assert (stats["append_count"], stats["window_advance_count"]) == (500, sum(moved.values()))
    assert stats["buffered"] + stats["dropped_count"] == 500


def test_empty(spark):
    df = log(spark, [])
    assert window.sliding(df, S, "value").count() == window.late(df, S).count() == window.advances(df).count() == 0
    assert tuple(telemetry.store_stats(df, 5, "ts_ticks").first()) == (0, 0, 0, 0)
    assert tuple(telemetry.fullness(df, 5).first()) == (0, True, False)


def test_ticks(spark):
    df = spark.sql("SELECT TIMESTAMP '1970-01-01 00:00:00.000001' AS a, TIMESTAMP_NTZ '0001-01-01 00:00:00' AS b")
    got = df.select(schema.ticks(df, "a").alias("a"), schema.ticks(df, "b").alias("b")).first()
    assert tuple(got) == (schema.EPOCH_TICKS + 10, 0)
    back = df.select(schema.timestamp(schema.ticks(df, "a")).alias("a")).first()["a"]
    assert back == df.first()["a"]
