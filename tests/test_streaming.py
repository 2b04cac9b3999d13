"""Streams: bounded appends, windows with a watermark, the clock, JSON events."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from eddyline import schema
from eddyline.operators import prefix, retention, window
from eddyline.sources import events as source
from eddyline.streaming import append, ring, windowed

LOG = "part int, seq long, ts_ticks long, value double"


def _files(spark, tmp_path, rows, kind, cuts):
    """rows as a folder of files, one for each cut, and a stream over it that takes one file at a time."""
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f{i}"))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_ring_table(spark, tmp_path):
    rows = [(i % 3, i, i, float(i)) for i in range(300)]
    gone = []
    table = append.RingTable(spark, str(tmp_path / "ring"), 20, on_discarded=lambda d: gone.append(d.count()))
    stream = _files(spark, tmp_path, rows, LOG, [50, 90, 200])
    got = table.drain(stream, str(tmp_path / "state"))
    want = retention.retain(spark.createDataFrame(rows, LOG), 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(table._versions()) == 2 and sum(gone) == 240
    spark.createDataFrame([(0, 500, 500, 1.0)], LOG).coalesce(1).write.parquet(str(tmp_path / "in" / "more"))
    assert table.drain(stream, str(tmp_path / "state")).agg(F.max("seq")).first()[0] == 500
    # a batch that runs again starts from the version before it
    last = table._versions()[-1]
    table._take(spark.createDataFrame([(0, 500, 500, 1.0)], LOG), last)
    assert table.events().filter("seq = 500").count() == 1


def test_ring_table_without_events(spark, tmp_path):
    table = append.RingTable(spark, str(tmp_path / "ring"), 5)
    (tmp_path / "in").mkdir()
    assert table.drain(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), str(tmp_path / "state")).count() == 0


def test_carried_clocks_equal_the_batch_result(spark, tmp_path, monkeypatch):
    """In files that cut the stream, with small chunks; one partition is that of events without a key, and some events have no time."""
    monkeypatch.setattr(prefix, "CHUNK", 16)
    r = random.Random(7)
    s, width, size = schema.SECOND, schema.SECOND, 20 * schema.SECOND
    rows = [(r.choice([0, 1, None]), i, None if i % 50 == 7 else (1000 + i + r.randrange(-40, 3)) * s, float(r.randrange(100))) for i in range(240)]
    table = ring.ClockTable(spark, str(tmp_path / "clock"), size, width)
    found = {x["part"]: x for x in table.drain(_files(spark, tmp_path, rows, LOG, [60, 61, 150]), str(tmp_path / "state")).collect()}
    df = spark.createDataFrame(rows, LOG)
    late = {x["part"]: x["count"] for x in window.late(df, size).groupBy("part").count().collect()}
    moved = {x["part"]: x["advances"] for x in window.advances(df).collect()}
    ends = {p: max(t for q, _, t, _ in rows if q == p and t) for p in (0, 1, None)}
    cells = window.bucketed(window.admitted(df, size), width, "value").collect()
    for p, x in found.items():
        inside = [c for c in cells if c["part"] == p and c["bucket"] + width > ends[p] - size]
        assert (x["clock"], x["appended"], x["late"], x["advances"]) == (ends[p], sum(q == p for q, *_ in rows), late.get(p, 0), moved[p])
        assert (x["count"], x["sum"], x["min"], x["max"]) == (sum(c["count"] for c in inside), sum(c["sum"] for c in inside), min(c["min"] for c in inside), max(c["max"] for c in inside))
    assert set(found) == {0, 1, None} and len(table._versions()) == 2
    # a batch that runs again starts from the version before it
    last = table._versions()[-1]
    table._take(df.filter("seq >= 150"), last)
    assert {x["part"]: tuple(x) for x in table.windows().collect()} == {p: tuple(x) for p, x in found.items()}
    assert ring.ClockTable(spark, str(tmp_path / "none"), size, width).windows().count() == 0


def test_windowed_drops_late_events(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    # an event is late by the watermark that the batch before left off with
    rows = [("a", 1.0, t), ("a", 2.0, t + dt.timedelta(hours=5)), ("a", 16.0, t + dt.timedelta(hours=5, minutes=9)), ("a", 4.0, t + dt.timedelta(minutes=5)), ("a", 8.0, t + dt.timedelta(hours=9))]
    stream = _files(spark, tmp_path, rows, "label string, value double, ts timestamp", [1, 2, 3, 4])
    got = windowed.drained(windowed.windowed(stream, "1 hour", "1 hour", "ts", "value", ["label"]), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r["count"], r["sum"]) for r in got.collect()) == [(1, 1.0), (2, 18.0)]


def test_json_events(spark, tmp_path):
    lines = [{"label": "cpu", "value": 10, "ts": "2024-01-15T11:55:00Z"}, {"label": "mem", "value": 99.5, "ts": "2024-01-15T11:57:00Z"}, {"value": 1}]
    (tmp_path / "m.json").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    got = source.metrics(spark, str(tmp_path / "m.json")).collect()
    assert sorted((r["label"], r["value"]) for r in got) == [("cpu", 10.0), ("mem", 99.5)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "r.json").write_text(json.dumps({"deviceId": "d", "temperature": 20.5, "humidity": 40, "timestampUtc": "2024-01-15T11:55:00Z"}))
    assert source.sensors(spark, str(tmp_path / "s")).first()["temperature"] == 20.5
    assert source.sensors(spark, str(tmp_path / "s"), stream=True).isStreaming


def test_json_by_the_names_that_services_send(spark, tmp_path):
    """Names in any case, an order's and a metric's own; further and broken fields and lines."""
    (tmp_path / "o.json").write_text("\n".join([
        json.dumps({"Id": "a", "Valor": 10, "Timestamp": "2024-01-15T12:00:00.1234567Z", "GatewayId": "g1", "More": {"x": [1]}}),
        json.dumps({"ID": "b", "VALOR": "20", "timestamp": "2024-01-15T14:00:00+02:00", "gatewayid": "g2", "Stream": "s"}),
        json.dumps({"id": "c", "valor": 2.5}), '{"id": "d", "id": "e", "valor": 7}', "", "nonsense", "[1]",
    ]))
    got = source.orders(spark, str(tmp_path / "o.json"), corrupt="bad").collect()
    first = dt.datetime(2024, 1, 15, 12, 0, 0, 123456)
    assert [tuple(x) for x in got[:3]] == [("a", None, "g1", 10, first, None), ("b", "s", "g2", 20, first.replace(microsecond=0), None), ("c", None, None, None, None, None)]
    assert got[3]["valor"] == 7 and [x["bad"] for x in got[4:]] == ["nonsense", "[1]"]
    assert source.orders(spark, str(tmp_path / "o.json")).columns == schema.ORDER.names
    (tmp_path / "m.json").write_text("\n".join([json.dumps({"Label": "cpu", "Value": 1.5, "Timestamp": "2024-01-15T12:00:00Z"}), json.dumps({"LABEL": "x"}), "{"]))
    assert [tuple(x) for x in source.metrics(spark, str(tmp_path / "m.json")).collect()] == [("cpu", 1.5, first.replace(microsecond=0))]
    assert [x["bad"] for x in source.metrics(spark, str(tmp_path / "m.json"), corrupt="bad").collect()] == [None, '{"LABEL": "x"}', "{"]


def test_progress_calls_back_at_each_step(spark):
    from types import SimpleNamespace

    told = []
    p = windowed.Progress(10, told.append)
    for n in (4, 5, 3, 25):
        p.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(numInputRows=n, processedRowsPerSecond=1.0)))
    assert [t["append_count"] for t in told] == [12, 37]
