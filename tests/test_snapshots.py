"""Snapshots: naming, newest, pruning, retries, restoring, and the binary form."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.options import StoreOptions
from eddyline.sources import snapshots
from eddyline.sources.snapshots import SnapshotOptions, SnapshotStore
from eddyline.store import EventStore

KIND = "part int, seq long, value double"


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "snaps"), SnapshotOptions(min_events=1, keep=3), sleep=lambda s: None)


def rows(spark, part, seqs):
    return spark.createDataFrame([(part, s, float(s)) for s in seqs], KIND)


def test_newest_breaks_ties_by_time(spark, store):
    for taken, seq in ((10, 1), (30, 3), (20, 2)):
        store.save(rows(spark, 0, [seq]), "p0", 5, taken)
    store.save(rows(spark, 0, [9]), "p0", 4, 99)
    kept, versions = store.restore(10, rows(spark, 0, []).schema)
    assert [r["seq"] for r in kept.collect()] == [3] and versions == {"p0": 5}


def test_prune(spark, store):
    names = [(1, 10), (2, 20), (2, 25), (3, 30), (5, 40), (4, 35), (5, 45)]
    random.Random(1).shuffle(names)
    for version, taken in names:
        store.save(rows(spark, 0, [1]), "p0", version, taken)
    assert store.prune("p0", 0) == 0
    assert store.prune("p0") == 4
    assert sorted((r["version"], r["taken"]) for r in store.catalog().collect()) == [(4, 35), (5, 40), (5, 45)]
    assert store.metrics().first()["pruned"] == 4


def test_an_existing_snapshot_stays(spark, store):
    store.save(rows(spark, 0, [1]), "p0", 1, 1)
    with pytest.raises(FileExistsError):
        store.save(rows(spark, 0, [2]), "p0", 1, 1)
    assert store.restore(5, rows(spark, 0, []).schema)[0].first()["seq"] == 1


def test_saving_is_tried_again(spark, store, monkeypatch):
    write, calls = store._write, []

    def failing(events, path, *by):
        calls.append(path)
        if len(calls) < 3:
            raise OSError("full")
        write(events, path, *by)

    monkeypatch.setattr(store, "_write", failing)
    store.save(rows(spark, 0, [1]), "p0", 1, 1)
    assert tuple(store.metrics().first())[:3] == (3, 2, 1)
    monkeypatch.setattr(store, "_write", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        store.save(rows(spark, 0, [1]), "p0", 2, 1)


def test_delays_grow():
    pauses = snapshots.delays(SnapshotOptions(min_events=1, factor=1.0), random.Random(2))
    got = [next(pauses) for _ in range(20)]
    assert all(b > a for a, b in zip(got, got[1:], strict=False)) and 0.09 <= got[0] <= 0.11


def test_due_and_options():
    o = SnapshotOptions(interval=5, min_events=10)
    assert o.due(6, 0) and o.due(0, 10) and not o.due(1, 1)
    for bad in ({}, {"min_events": 1, "keep": 0}, {"min_events": 1, "attempts": 0}, {"min_events": 1, "expected_schema": 0}, {"min_events": 1, "factor": 0}):
        with pytest.raises(ValueError):
            SnapshotOptions(**bad)


@pytest.mark.parametrize("key", ["", " ", "a/b", "../x", "/x", "a\\b", "CON", "com1", "a b", "a.b"])
def test_keys_that_are_no_folder_names(key):
    with pytest.raises((ValueError, PermissionError)):
        snapshots.checked_key(key)


def test_other_schemas_and_broken_snapshots(spark, store, tmp_path):
    store.save(rows(spark, 0, [1]), "p0", 1, 1, schema_version=99)
    store.save(rows(spark, 1, [2]), "p1", 1, 1)
    broken = tmp_path / "snaps" / "p2" / "1_1_s1"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    kept, versions = store.restore(5, rows(spark, 0, []).schema)
    assert [r["seq"] for r in kept.collect()] == [2] and set(versions) == {"p1"}
    strict = SnapshotStore(spark, store.root, SnapshotOptions(min_events=1, expected_schema=2))
    with pytest.raises(ValueError):
        strict.restore(5, rows(spark, 0, []).schema)


def test_a_store_goes_on_after_a_restore(spark, store):
    kind = T.StructType([T.StructField("key_id", T.IntegerType()), T.StructField("value", T.DoubleType())])
    options = StoreOptions(capacity_per_partition=4, partitions=2, key="key_id")
    new = lambda: EventStore(spark, kind, options)
    events = lambda a, b: spark.createDataFrame([(i % 2, float(i), i) for i in range(a, b)], "key_id int, value double, seq long")
    first = new()
    first.append(events(0, 20))
    first.save(store, 100)
    second = new()
    assert second.restore(store) == 2
    assert sorted(r["value"] for r in second.snapshot().collect()) == list(range(12, 20))
    second.append(events(20, 22))
    second.save(store, 101)
    third = new()
    third.restore(store)
    assert max(r["value"] for r in third.snapshot().collect()) == 21


def test_binary_form(spark, tmp_path):
    events = [(1, 2.5, 10), (-3, float("inf"), 2**62)]
    for compress in (False, True):
        data = snapshots.packed("k" * 200, 7, 9, events, compress=compress)
        assert snapshots.unpacked(data) == (1, "k" * 200, 7, 9, events)
        (tmp_path / f"{compress}.snap").write_bytes(data)
    (tmp_path / "cut.snap").write_bytes(snapshots.packed("a", 1, 1, events)[:-3])
    (tmp_path / "x.txt").write_bytes(b"")
    with pytest.raises(Exception, match="cut.snap can't be read"):
        snapshots.read_packed(spark, str(tmp_path)).collect()
    got = snapshots.read_packed(spark, str(tmp_path), problems=True)
    assert got.count() == 5 and {(r["seq"], r["key_id"]) for r in got.filter("problem IS NULL").collect()} == {(0, 1), (1, -3)}
    bad = got.filter("problem IS NOT NULL").first()
    assert bad["path"].endswith("cut.snap") and "out of range" in bad["problem"] and bad["key_id"] is None
    with pytest.raises(ValueError):
        snapshots.unpacked(snapshots.packed("a", 1, 1, events)[:-3])


def test_a_file_of_too_many_events_is_reported(spark, tmp_path, monkeypatch):
    data = bytearray(snapshots.packed("a", 1, 1, [(1, 1.0, 1)]))
    data[4 + 2 + 16 : 4 + 2 + 20] = (snapshots.MOST_EVENTS + 1).to_bytes(4, "little")
    (tmp_path / "big.snap").write_bytes(bytes(data))
    for k, junk in enumerate((b"", b"\x1f\x8bxx", b"\x00" * 9, b"\xff" * 40)):
        (tmp_path / f"j{k}.snap").write_bytes(junk)
    assert snapshots.read_packed(spark, str(tmp_path), problems=True).filter("problem IS NOT NULL").count() == 4


def test_binary_files_written_by_spark(spark, tmp_path):
    df = spark.createDataFrame([(p, s, s % 5, s / 4, 1000 + s) for p in (0, 1) for s in range(30)], "part int, seq long, key_id int, value double, ts_ticks long")
    made = snapshots.write_packed(df.orderBy(F.desc("seq")), str(tmp_path), {0: 30, 1: 31}, 77, compress=True)
    assert [m.rsplit("/", 1)[1] for m in made] == ["p0_30_77.snap", "p1_31_77.snap"]
    got = snapshots.read_packed(spark, str(tmp_path)).orderBy("part_key", "seq").collect()
    assert [tuple(r) for r in got] == [(f"p{p}", 30 + p, 77, 1, s, s % 5, s / 4, 1000 + s) for p in (0, 1) for s in range(30)]
    with pytest.raises(Exception):  # noqa: B017  # Hadoop's, of a file that exists
        snapshots.write_packed(df, str(tmp_path), {0: 30}, 77)


def test_damage_beyond_the_first_row_is_found(spark, store):
    """A file cut off, and one of a snapshot's files gone: the partition is left out, the others are restored."""
    many = spark.range(20_000).select(F.lit(0).alias("part"), F.col("id").alias("seq"), F.rand(1).alias("value"))
    for part in (0, 1, 2):
        store.save(many.withColumn("part", F.lit(part)).repartition(3), f"p{part}", 1, 1)
    from pathlib import Path

    files = {p: sorted(Path(store.root, f"p{p}").rglob("part-*.parquet")) for p in (0, 1)}
    data = bytearray(files[0][1].read_bytes())
    data[len(data) // 4 : len(data) // 2] = b"x" * (len(data) // 2 - len(data) // 4)
    files[0][1].write_bytes(bytes(data))
    files[0][1].with_name(f".{files[0][1].name}.crc").unlink(missing_ok=True)
    files[1][0].unlink()
    kept, versions = store.restore(50_000, many.schema)
    assert set(versions) == {"p2"} and kept.count() == 20_000


def test_metrics_of_partitions_and_traces(spark, tmp_path, monkeypatch):
    told = []
    target = SnapshotStore(spark, str(tmp_path / "snaps"), SnapshotOptions(min_events=1), sleep=lambda s: None, trace=lambda name, tags: told.append((name, tags["what"])))
    kind = T.StructType([T.StructField("key_id", T.IntegerType())])
    s = EventStore(spark, kind, StoreOptions(partitions=2, key="key_id", capacity_per_partition=3))
    events = lambda a, b: spark.createDataFrame([(i % 2, i) for i in range(a, b)], "key_id int, seq long")
    s.append(events(0, 10))
    write = target._write
    monkeypatch.setattr(target, "_write", lambda *a: (monkeypatch.setattr(target, "_write", write), 1 / 0))
    s.save(target, 1)
    s.append(events(10, 13))
    assert sorted(map(tuple, s.snapshot_metrics(target).collect())) == [(0, 5, 7, 2, 3, 2, 1), (1, 5, 6, 1, 3, 2, 1)]
    assert [n for n, _ in told] == ["snapshot.save", "snapshot.prune"]
    s.compact()
    assert [r["head_version"] for r in s.snapshot_metrics(target).orderBy("part").collect()] == [7, 6]


def test_expendable_and_newest(spark):
    catalog = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 2, 2), ("b", 1, 1)], "part_key string, version long, taken long")
    assert sorted(map(tuple, snapshots.newest(catalog).collect())) == [("a", 2, 2), ("b", 1, 1)]
    assert [tuple(r) for r in snapshots.expendable(catalog, 2).orderBy("part_key").collect()] == [("a", 1, 1)]
    assert snapshots.newest(catalog.filter(F.lit(False))).count() == 0


def test_snapshots_when_due(spark, tmp_path):
    kind = T.StructType([T.StructField("value", T.DoubleType())])
    target = SnapshotStore(spark, str(tmp_path / "due"), SnapshotOptions(interval=60, min_events=5, keep=1))
    s = EventStore(spark, kind, StoreOptions(partitions=1))
    events = lambda a, b: spark.createDataFrame([(float(i), i) for i in range(a, b)], "value double, seq long")
    now = [1000.0]
    with snapshots.Snapshotter(s, target, lambda: now[0]) as snapshotter:
        now[0] += 100
        assert snapshotter.tick() == {}
        s.append(events(0, 2))
        assert snapshotter.tick() == {"p0": 2}
        s.append(events(2, 4))
        assert snapshotter.tick() == {}
        s.append(events(4, 8))
        assert snapshotter.tick() == {"p0": 8}
        s.append(events(8, 9))
    assert [(r["part_key"], r["version"]) for r in target.catalog().collect()] == [("p0", 9)]


def test_saves_in_the_background(spark, tmp_path):
    """A thread saves what is due; a save that finds another running is dropped and counted; what is left is saved at the end."""
    import threading
    import time as clock

    class Slow:
        appended, saved, free = 0, [], threading.Event()

        def save(self, target, taken):
            self.free.wait(20)
            self.saved.append(self.appended)
            return {"p0": self.appended}

    slow, target = Slow(), SnapshotStore(spark, str(tmp_path / "x"), SnapshotOptions(min_events=1))
    with snapshots.Snapshotter(slow, target).start(poll=0.01) as s:
        slow.appended = 5
        end = clock.time() + 20
        while not s.dropped and clock.time() < end:
            clock.sleep(0.01)
        assert s.dropped and not slow.saved
        slow.free.set()
        while not slow.saved and clock.time() < end:
            clock.sleep(0.01)
        slow.appended = 9
    assert slow.saved[0] in (5, 9) and slow.saved[-1] == 9 and s._loop is None
    with pytest.raises(ValueError):
        snapshots.Snapshotter(slow, target, pending=0)


def test_all_partitions_in_one_write(spark, store, monkeypatch):
    write, calls = store._write, []
    monkeypatch.setattr(store, "_write", lambda *a: (calls.append(a[1]), write(*a)))
    events = rows(spark, 0, [1, 2]).union(rows(spark, 1, [3])).union(rows(spark, 7, [4]))
    assert store.save_all(events, {0: 2, 1: 1, 5: 9}, 50) == {"p0": 2, "p1": 1, "p5": 9}
    assert len(calls) == 1
    kept, versions = store.restore(10, events.schema)
    assert sorted(map(tuple, kept.collect())) == [(0, 1, 1.0), (0, 2, 2.0), (1, 3, 3.0)] and versions == {"p0": 2, "p1": 1, "p5": 9}
    with pytest.raises(FileExistsError):
        store.save_all(events, {0: 2}, 50)
    assert store.save_all(events, {}, 51) == {} and not [n for n in store._names(store.root) if n.startswith(".saving")]
