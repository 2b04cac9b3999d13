"""The store's literal cases: appends, retention, scans, aggregates, maintenance."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.operators import aggregate, ingest, prefix, retention, scan
from eddyline.options import StoreOptions
from eddyline.store import EventStore

NOW = dt.datetime(2024, 1, 15, 12)
ORDER = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("amount", T.DecimalType(28, 6)), T.StructField("ts", T.TimestampType())])


def at(minutes):
    return NOW + dt.timedelta(minutes=minutes)


def store(spark, pairs, partitions=1, capacity=100, **more):
    """A store of (amount, minutes from now), in arrival order."""
    options = StoreOptions(capacity_per_partition=capacity, partitions=partitions, ts="ts", value="amount", **more)
    s = EventStore(spark, ORDER, options)
    rows = [(i + 1, a, at(m), i) for i, (a, m) in enumerate(pairs)]
    s.append(spark.createDataFrame(rows, "id int, amount int, ts timestamp, seq long").withColumn("amount", F.col("amount").cast("decimal(28,6)")))
    return s


def five(df):
    return tuple(float(x) for x in df.first())


@pytest.mark.parametrize(("pairs", "bounds", "want"), [
    ([(10, -5), (20, -3), (5, -1), (30, -6)], (-4, 0), (2, 25, 5, 20, 12.5)),
    ([(10, -6), (20, -4), (5, -3), (30, -2)], (-5, 0), (3, 55, 5, 30, 55 / 3)),
    ([(10, -10)], (-5, 0), (0, 0, 0, 0, 0)),
    ([(10, -5), (20, -3)], (0, -9), (0, 0, 0, 0, 0)),
    ([(10, -5), (20, -3)], (-5, -3), (2, 30, 10, 20, 15)),
])
def test_window_aggregate(spark, pairs, bounds, want):
    assert five(store(spark, pairs).window(start=at(bounds[0]), end=at(bounds[1]))) == pytest.approx(want)


def test_window_with_filter_and_many_partitions(spark):
    s = store(spark, [(10, -5), (25, -3), (15, -1)])
    assert five(s.window(where=F.col("amount") <= 20, start=at(-10), end=at(0))) == (2, 25, 10, 15, 12.5)
    s = store(spark, [((i + 1) * 10, -i) for i in range(8)], partitions=4, key="id")
    assert five(s.window(start=at(-10), end=at(0))) == (8, 360, 10, 80, 45)


def test_scalar_aggregates(spark):
    s = store(spark, [(10, -5), (20, -3), (30, -1)])
    one = lambda df: df.first()[0]
    assert one(s.count(start=at(-4), end=at(-2))) == 1
    assert one(s.sum()) == 60 and one(s.sum(where=F.col("amount") >= 20)) == 50
    assert (one(s.avg()), one(s.min()), one(s.max())) == (20, 10, 30)
    none = {"where": F.col("amount") > 99}
    assert (one(s.count(**none)), one(s.sum(**none)), one(s.avg(**none)), one(s.min(**none)), one(s.max(**none))) == (0, 0, 0, None, None)
    assert one(store(spark, [(10, 0), (20, 0), (5, 0)]).avg(F.col("id"))) == 2


def test_time_bounds_need_tracking_and_a_time(spark):
    s = store(spark, [(1, 0)], window_tracking=False)
    for f in (s.count, s.sum, s.min, s.max, s.avg, s.window):
        with pytest.raises(RuntimeError):
            f(start=at(-1))
    s = EventStore(spark, ORDER, StoreOptions(partitions=1))
    for f in (s.snapshot, s.views):
        with pytest.raises(ValueError):
            f(start=at(-1))
    with pytest.raises(ValueError):
        s.purge(at(0))


def test_folds(spark):
    s = store(spark, [(10, -3), (20, -2), (30, -1)])
    assert [r["amount"] for r in s.until(F.col("amount") >= 20).orderBy("seq").collect()] == [10, 20]
    assert s.until(F.col("amount") >= 99).count() == 3
    assert s.find_first(F.col("amount") > 15).first()["id"] == 2 and s.find_first(F.col("amount") > 50).first() is None
    product = store(spark, [(2, 0)] * 4).fold(["id"], F.lit(1), lambda acc, e: acc * 2)
    assert product.first()["result"] == 16
    assert s.fold(["id"], F.lit(7), lambda acc, e: acc + e["id"], where=F.col("id") > 9).first()["result"] == 7
    sizes = s.groups("id", ["amount"])
    assert sorted((r["id"], len(r["events"])) for r in sizes.collect()) == [(1, 1), (2, 1), (3, 1)]


def test_retention_and_hooks(spark):
    gone, full = [], []
    o = StoreOptions(capacity_per_partition=5, partitions=1, on_discarded=lambda d: gone.extend(r[0] for r in d.collect()), on_full=lambda: full.append(1))
    s = EventStore(spark, T.StructType([T.StructField("value", T.IntegerType())]), o)
    rows = lambda a, b: spark.createDataFrame([(i, i) for i in range(a, b)], "value int, seq long")
    assert s.append(rows(1, 6)) == 5 and s.is_full() and not gone
    assert s.append(rows(6, 9)) == 3
    assert [r["value"] for r in s.snapshot().collect()] == [4, 5, 6, 7, 8]
    assert sorted(gone) == [1, 2, 3] and full
    assert s.append(rows(9, 30)) == 21 and s.count_all() == 5
    stats = s.stats().first()
    assert (stats["append_count"], stats["dropped_count"], stats["buffered"]) == (29, 24, 5)
    s.clear()
    assert s.is_empty() and not s.is_full() and s.stats().first()["append_count"] == 29


def test_retention_comes_before_time(spark):
    s = store(spark, [(i, i) for i in range(7)], capacity=5)
    assert [int(r["amount"]) for r in s.snapshot(start=at(1), end=at(5)).collect()] == [2, 3, 4, 5]


def test_capacity_and_options():
    assert StoreOptions(capacity=1000, partitions=3).per_partition == 333
    assert StoreOptions(window_ticks=1024).width == 2
    for bad in ({"partitions": 0}, {"bucket_count": 0}, {"stats_interval": 0}, {"capacity_per_partition": 0}, {"bucket_ticks": 0},
                {"window_ticks": 5, "bucket_ticks": 10}, {"window_ticks": 15, "bucket_ticks": 10}):
        with pytest.raises(ValueError):
            StoreOptions(**bad)


def test_purge(spark):
    s = store(spark, [(1, -120), (2, -30), (3, -10)])
    s.purge(at(-60))
    assert [int(r["amount"]) for r in s.snapshot().collect()] == [2, 3]


def test_stats_interval(spark):
    told = []
    s = EventStore(spark, T.StructType([T.StructField("value", T.IntegerType())]), StoreOptions(partitions=1, stats_interval=8, on_stats=told.append))
    df = lambda a, n: spark.createDataFrame([(i, a + i) for i in range(n)], "value int, seq long")
    s.append(df(0, 7))
    assert not told
    s.append(df(7, 2))
    assert len(told) == 1 and told[0]["append_count"] == 9


def test_named_keys(spark):
    kind = T.StructType([T.StructField("k", T.StringType()), T.StructField("value", T.IntegerType()), T.StructField("key_id", T.IntegerType())])
    s = EventStore(spark, kind, StoreOptions(partitions=4, key="key_id"))
    rows = lambda *ks: spark.createDataFrame([(k, i, i) for i, k in enumerate(ks)], "k string, value int, seq long")
    s.append_named(rows("key1", "key2", "key1"), "k")
    assert (s.key_id("key1"), s.key_id("key2"), s.key_id("no")) == (1, 2, None)
    s.append_named(rows("key3", "key2"), "k")
    assert s.key_id("key3") == 3
    s.clear(keys=True)
    s.append_named(rows("key1"), "k")
    assert s.key_id("key1") == 1


def test_routing(spark):
    df = spark.createDataFrame([(-3,), (5,), (8,)], "k int")
    assert [r["part"] for r in ingest.by_key(df, "k", 4).collect()] == [1, 1, 0]
    with pytest.raises(ValueError):
        ingest.to_partition(df, 4, 4)
    a = ingest.by_hash(df, ["k"], 8).collect()
    assert a == ingest.by_hash(df, ["k"], 8).collect() and all(0 <= r["part"] < 8 for r in a)


def test_numbers_are_consecutive(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(9)
    got = ingest.numbered(df, ["v"], start=10).orderBy("v").collect()
    assert [r["seq"] for r in got] == list(range(10, 5010))
    assert ingest.numbered(df.limit(0), ["v"]).count() == 0


def test_generators(spark):
    orders = ingest.generated_orders(spark, 500, "g1").agg(F.countDistinct("id"), F.min("valor"), F.max("valor")).first()
    assert orders[0] == 500 and orders[1] >= 1 and orders[2] < 5000
    assert ingest.generated_metrics(spark, 40).groupBy("label").count().count() == 4
    readings = spark.createDataFrame([("d", 20.0, 50.0, NOW), (" ", 1.0, 1.0, NOW), ("e", float("nan"), 1.0, NOW)], "deviceId string, temperature double, humidity double, timestampUtc timestamp")
    assert sorted((r["key_id"], r["value"]) for r in ingest.sensor_events(readings).collect()) == [(1, 20.0), (2, 50.0)]


def test_views(spark):
    s = store(spark, [(10, -5), (20, -3), (30, -1)], partitions=4, key="id", capacity=1)
    rows = {r["part"]: r for r in s.views().collect()}
    assert [rows[p]["n"] for p in range(4)] == [0, 1, 1, 1]
    assert rows[1]["is_full"] and rows[0]["first_ts"] is None and rows[2]["first_ts"] == at(-3)
    assert [r["n"] for r in s.views(at(-4), at(0)).orderBy("part").collect()] == [0, 0, 1, 1]


def test_merge_of_partials(spark):
    parts = spark.createDataFrame([(2, 30.0, 10.0, 20.0), (3, 90.0, 15.0, 40.0), (0, 0.0, 0.0, 0.0)], "count long, sum double, min double, max double")
    assert tuple(aggregate.merged(parts).first()) == (5, 120, 10, 40, 24)
    assert tuple(aggregate.merged(parts.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_merge_of_no_partials_as_null(spark):
    parts = spark.createDataFrame([(2, 30.0, 10.0, 20.0), (0, 0.0, 0.0, 0.0)], "count long, sum double, min double, max double")
    assert tuple(aggregate.merged(parts, zeros=False).first()) == (2, 30, 10, 20, 15)
    assert tuple(aggregate.merged(parts.filter("count = 0"), zeros=False).first()) == (0, 0, 0, 0, 0)
    assert tuple(aggregate.merged(parts.limit(0), zeros=False).first()) == (None,) * 5


def test_chunks(spark):
    import pyarrow as pa

    sizes = scan.chunks(spark.range(10, numPartitions=1), lambda b: iter([pa.RecordBatch.from_pydict({"n": [b.num_rows]})]), "n long", 4)
    assert [r["n"] for r in sizes.collect()] == [4, 4, 2]
    total = aggregate.chunked(spark.range(100), lambda t: {"s": sum(t.column("id").to_pylist())}, "s long", [F.sum("s").alias("s")], 16)
    assert total.first()["s"] == 4950


def _model(rows, capacity):
    """A plain ring for each partition."""
    kept = {}
    for part, seq, v in sorted(rows, key=lambda r: r[1]):
        kept.setdefault(part, []).append((part, seq, v))
        del kept[part][:-capacity]
    return sorted(x for p in kept.values() for x in p)


@pytest.mark.parametrize("large", [False, True])
def test_retention_against_a_plain_ring(spark, monkeypatch, large):
    monkeypatch.setattr(prefix, "CHUNK", 50)
    r = random.Random(3)
    rows = [(r.choice([0, 0, 0, 1, 2]), i, r.randrange(99)) for i in r.sample(range(3000), 2000)]
    df = spark.createDataFrame(rows, "part int, seq long, v int")
    for capacity in (1, 70, 900, 5000):
        assert sorted(map(tuple, retention.retain(df, capacity, large=large).collect())) == _model(rows, capacity)
    assert retention.retain(df.limit(0), 5, large=large).count() == 0
    assert retention.retain(df, 70).count() + retention.discarded(df, 70).count() == 2000


def test_a_large_log_skips_old_events_in_the_scan(spark, tmp_path):
    spark.range(1000).select(F.lit(0).alias("part"), F.col("id").alias("seq")).write.parquet(str(tmp_path / "log"))
    kept = retention.retain(spark.read.parquet(str(tmp_path / "log")), 5, large=True)
    assert [r["seq"] for r in kept.orderBy("seq").collect()] == [995, 996, 997, 998, 999]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"DataFilters: \[[^\]]*seq#\d+L? >= [^,]*subquery", plan, re.I)
    assert not retention.is_large(spark.read.parquet(str(tmp_path / "log")))


def test_prefixes_do_not_depend_on_the_chunk(spark):
    r = random.Random(5)
    rows = [(r.randrange(3), i, r.choice([None, r.randrange(100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "part int, seq long, v int")
    v = F.col("v")
    adds = {k: (k, v) for k in ("max", "min", "sum", "count")}
    for own in (True, False):
        want, held = {}, {}
        for part, seq, x in rows:
            seen = held.setdefault(part, [])
            use = seen + [x] if own else seen
            some = [y for y in use if y is not None]
            want[seq] = (max(some, default=None), min(some, default=None), sum(some) if some else None, len(some))
            seen.append(x)
        for chunk in (1, 7, 64, 1 << 20):
            got = {row["seq"]: tuple(row[k] for k in adds) for row in prefix.running(df, adds, own=own, chunk=chunk).collect()}
            assert got == want


def test_statistics_and_compaction(spark):
    s = EventStore(spark, T.StructType([T.StructField("value", T.IntegerType())]), StoreOptions(partitions=1, capacity_per_partition=4))
    assert s.statistics()["appends_per_second"] == 0 and s.statistics()["last_append"] is None
    rows = lambda a, b: spark.createDataFrame([(i, i) for i in range(a, b)], "value int, seq long")
    s.append(rows(0, 10))
    got = s.statistics(now=s.statistics()["last_append"] + 5)
    assert (got["appended"], got["discarded"], got["appends_per_second"]) == (10, 6, 2)
    assert s.statistics(now=got["last_append"])["appends_per_second"] == 10
    s.compact()
    assert [r["value"] for r in s.snapshot().collect()] == [6, 7, 8, 9]
    s.append(rows(10, 12))
    stats = s.stats().first()
    assert (stats["append_count"], stats["dropped_count"], stats["buffered"]) == (12, 8, 4)
    assert s.statistics()["discarded"] == 8


TICKS = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("t", T.LongType()), T.StructField("v", T.DecimalType(12, 3))])


def ticked(spark, rows, **options):
    """A store of (k, t, v), in arrival order."""
    s = EventStore(spark, TICKS, StoreOptions(**({"capacity_per_partition": 1000, "partitions": 2, "key": "k", "ts": "t", "value": "v"} | options)))
    s.append(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k int, t long, v double, seq long"))
    return s


def test_aggregates_from_buckets_are_the_scan_s(spark):
    """Asked again for whole buckets, the store answers from these; kinds and values are those of the scan."""
    r = random.Random(2)
    rows = [(r.randrange(9), r.randrange(1000), r.choice([None, r.randrange(-500, 900) / 8])) for _ in range(400)]
    s, plain = ticked(spark, rows, bucket_ticks=100), ticked(spark, rows)
    asked = lambda s, f, a, b: getattr(s, f)(start=a, end=b)
    asked(s, "sum", 0, 99)
    for a, b in ((0, 99), (100, 699), (900, 2999), (5000, 5099), (150, 349)):
        for f in ("count", "sum", "min", "max", "avg", "window"):
            got, want = asked(s, f, a, b), asked(plain, f, a, b)
            assert got.schema == want.schema or [x.dataType for x in got.schema] == [x.dataType for x in want.schema]
            assert [float(x) if x is not None else None for x in got.first()] == pytest.approx([float(x) if x is not None else None for x in want.first()])
    uses = lambda df: "store-rollup" in df._jdf.queryExecution().executedPlan().toString()
    assert uses(s.sum(start=0, end=99)) and not uses(s.sum(start=0, end=98)) and not uses(s.sum(F.col("k"), start=0, end=99)) and not uses(s.sum(where=F.col("k") > 1, start=0, end=99))
    s.append(spark.createDataFrame([(1, 50, 1000.0, 10_000)], "k int, t long, v double, seq long"))
    assert not uses(s.max(start=0, end=99)) and s.max(start=0, end=99).first()[0] == 1000 and uses(s.max(start=0, end=99))


def test_a_store_is_bounded_by_itself(spark, monkeypatch):
    """Many appends: few folders, a plan of one scan, counters as if nothing had been compacted."""
    from eddyline import store as module
    from eddyline.sources import scratch

    monkeypatch.setattr(module, "COMPACT_APPENDS", 4)
    where = scratch.root(spark)
    before = set(scratch.listed(spark, where))
    r = random.Random(6)
    rows = [(r.randrange(4), r.randrange(5000), 1.0) for _ in range(300)]
    o = {"capacity_per_partition": 20, "window_ticks": 400, "bucket_ticks": 100}
    s, whole = ticked(spark, [], **o), ticked(spark, rows, **o)
    for a in range(0, 300, 15):
        s.append(spark.createDataFrame([(*x, a + i) for i, x in enumerate(rows[a : a + 15])], "k int, t long, v double, seq long"))
    assert s.stats().first() == whole.stats().first()
    assert s.snapshot().collect() == whole.snapshot().collect() and s.versions() == whole.versions()
    assert len([n for n in set(scratch.listed(spark, where)) - before if n.startswith("store-")]) < 14
    assert s._log._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    s.clear()
    stats = s.stats().first()
    assert (stats["append_count"], stats["buffered"]) == (300, 0) and stats["dropped_count"] == whole.stats().first()["dropped_count"]
    assert s.statistics()["appended"] == s.statistics()["discarded"] == 0


def test_views_are_counted_and_failing_callbacks_passed_over(spark):
    s = ticked(spark, [(i, i, 1.0) for i in range(5)], on_stats=lambda _: 1 / 0)
    assert s.appended == 5
    s.views()
    s.views(start=3, end=9)
    assert s.stats().first()["snapshot_bytes_exposed"] == 8 * (5 + 2)


def test_events_without_a_key(spark):
    s = ticked(spark, [(None, 1, 1.0), (3, 2, 2.0), (None, 3, 3.0)])
    assert sorted((str(r["part"]), float(r["v"])) for r in s.snapshot().collect()) == [("1", 2.0), ("None", 1.0), ("None", 3.0)]
    assert s.stats().first()["append_count"] == 3
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("key_id", T.IntegerType())])
    named = EventStore(spark, kind, StoreOptions(partitions=4, key="key_id"))
    assert named.append_named(spark.createDataFrame([("a", 0), (None, 1), ("b", 2)], "name string, seq long"), "name") == 3
    assert sorted((r["name"] or "", r["key_id"]) for r in named.snapshot().collect()) == [("", None), ("a", 1), ("b", 2)]


def test_purge_by_minutes_and_several_stores(spark):
    from eddyline import schema
    from eddyline.store import clear_all, purge_all

    ticks = lambda m: schema.EPOCH_TICKS + int((at(m) - dt.datetime(1970, 1, 1)).total_seconds()) * schema.SECOND
    a = store(spark, [(1, -120), (2, -30), (3, -10)])
    b = ticked(spark, [(0, ticks(-120), 1.0), (0, ticks(-59), 2.0)])
    now = NOW.replace(tzinfo=dt.UTC)
    purge_all([a, b], now=now)
    assert [int(r["amount"]) for r in a.snapshot().collect()] == [2, 3] and b.count_all() == 1
    purge_all([a], minutes=15, now=now)
    assert a.count_all() == 1
    purge_all([a], older_than=at(0))
    clear_all([a, b])
    assert a.is_empty() and b.is_empty()
    with pytest.raises(ValueError):
        EventStore(spark, ORDER, StoreOptions(partitions=1)).purge_minutes()


def test_gateways_own_counts_and_durations(spark):
    from eddyline.operators import dashboard

    orders = ingest.generated_orders(spark, 30, "g1").unionByName(ingest.generated_orders(spark, 12, "g2"))
    assert dashboard.sent_by(orders, "g2").first()["sent"] == 12
    rows, took = dashboard.timed(dashboard.by_gateway(orders, "gateway_id", "valor"))
    assert {r["gateway_id"]: r["count"] for r in rows} == {"g1": 30, "g2": 12, "all": 42} and took > 0


@pytest.mark.parametrize("large", [False, True])
def test_retention_of_events_without_number_or_partition(spark, monkeypatch, large):
    """The same with and without a cutoff; events without a number are the oldest."""
    monkeypatch.setattr(prefix, "CHUNK", 10)
    r = random.Random(4)
    rows = [(r.choice([None, 0, 1]), None if i % 9 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "part int, seq long")
    for capacity in (1, 30, 500):
        want = []
        for p in (None, 0, 1):
            mine = sorted((s for q, s in rows if q == p), key=lambda s: -1 if s is None else s)
            want += [(p, s) for s in mine[-capacity:]]
        key = lambda x: tuple(-1 if v is None else v for v in x)
        assert sorted(map(tuple, retention.retain(df, capacity, large=large).collect()), key=key) == sorted(want, key=key)
    none = df.withColumn("seq", F.lit(None).cast("long"))
    assert retention.retain(none, 3, large=large).count() == 9


def test_partial_rows_have_the_schema_s_kinds(spark):
    got = aggregate.chunked(spark.range(10), lambda t: {"n": t.num_rows, "s": 1, "most": None}, "n int, s double, most string", [F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("most").alias("most")])
    assert got.schema["s"].dataType.simpleString() == "double" and got.first()["n"] == 10 and got.first()["most"] is None
