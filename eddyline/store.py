"""A store as one object: its options, and the events appended so far as a DataFrame."""

from __future__ import annotations

import datetime as dt
import logging
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline import schema
from eddyline.operators import aggregate, ingest, retention, scan, telemetry, window
from eddyline.options import StoreOptions
from eddyline.sources import scratch
from eddyline.sources.snapshots import SnapshotStore

log = logging.getLogger("eddyline.store")
#: Times its capacity, and appends, after which a store is compacted.
COMPACT_EVENTS, COMPACT_APPENDS = 2, 64


class EventStore:
    """Keyed, bounded events. Appends are written to the shared folder, in one pass each; queries
    return DataFrames and run nothing by themselves. Time bounds are inclusive and in the kind of
    the ts column.

    What lies in the shared folder is bounded: a store that holds COMPACT_EVENTS times its capacity more than after the last compaction,
    or COMPACT_APPENDS appends, is compacted. A DataFrame that was taken from it can be read until the second compaction after that.
    """

    def __init__(self, spark: SparkSession, kind: T.StructType, options: StoreOptions | None = None):
        self.spark, self.options = spark, options or StoreOptions()
        self.kind = T.StructType([*kind.fields])
        self._full_kind = T.StructType([*kind.fields, *self._system(kind)])
        self._kept: str | None = None
        self._fresh: list[str] = []
        self._fresh_events = 0
        self._old: list[list[str]] = []
        self._appended = self._stats = self._version = self._dropped = self._dropped_before = self._advances = self._exposed = 0
        self._clocks: dict[int | None, int] = {}
        self._gone: dict[int | None, int] = {}
        self._rollup: DataFrame | None = None
        self._asked = False
        self._last: float | None = None
        self._key_paths: list[str] = []

    def _system(self, kind: T.StructType) -> list[T.StructField]:
        have = {f.name for f in kind.fields}
        return [f for f in (T.StructField("part", T.IntegerType()), T.StructField(self.options.seq, T.LongType())) if f.name not in have]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self._full_kind).parquet(*paths) if paths else self.spark.createDataFrame([], self._full_kind)

    @property
    def _log(self) -> DataFrame:
        """What was kept at the last compaction, and all since then: one scan, however many appends."""
        return self._read([*([self._kept] if self._kept else []), *self._fresh])

    # appends

    def append(self, events: DataFrame, part: int | None = None, order: list[str] | None = None) -> int:
        """Appends events and returns how many. They go to their key's partition (those without a key to one of their own), to part if that is
        given, or by a hash of the whole event. Without a seq column they are numbered by order
        (by all columns, without that)."""
        path = scratch.folder(self.spark, "store", lasting=True)
        with scratch.Scope(self.spark):
            n = self._append(events, part, order, path)
        if self._fresh_events > COMPACT_EVENTS * self.options.per_partition * self.options.partitions or len(self._fresh) >= COMPACT_APPENDS:
            self.compact()
        return n

    def _append(self, events: DataFrame, part: int | None, order: list[str] | None, path: str) -> int:
        o = self.options
        if part is not None:
            routed = ingest.to_partition(events, part, o.partitions)
        elif o.key is not None:
            routed = ingest.by_key(events, o.key, o.partitions)
        else:
            routed = ingest.by_hash(events, [c for c in self.kind.names if c in events.columns], o.partitions)
        if o.seq not in routed.columns:
            routed = ingest.numbered(routed, order or self.kind.names, o.seq, self._appended)
        routed = routed.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self._full_kind.fields])
        seen = Observation()
        routed.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        n = seen.get["n"]
        if n and (o.on_discarded or o.on_full):
            self._tell_discarded(self.events.unionByName(self._read([path])))
        self._changed()
        self._fresh.append(path)
        self._fresh_events += n
        before, self._appended = self._appended, self._appended + n
        self._stats += n
        self._last = time.time() if n else self._last
        if o.on_stats and self._appended // o.stats_interval > before // o.stats_interval:
            try:
                o.on_stats(self.stats().first().asDict())
            except Exception:
                log.warning("on_stats failed", exc_info=True)
        return n

    def _tell_discarded(self, everything: DataFrame) -> None:
        """everything: what was kept before, and what came."""
        o = self.options
        gone = retention.discarded(everything, o.per_partition, o.seq)
        if o.on_full and not gone.isEmpty():
            o.on_full()
        if o.on_discarded:
            o.on_discarded(gone.select(*self.kind.names))

    def _changed(self) -> None:
        self._rollup, self._asked = None, False

    def append_named(self, events: DataFrame, key: str, order: list[str] | None = None) -> int:
        """Appends events whose key is a text: it gets a number, kept in keys, that routes it."""
        path = scratch.folder(self.spark, "store-keys", lasting=True)
        with scratch.Scope(self.spark):
            return self._append_named(events, key, order, path)

    @property
    def keys(self) -> DataFrame:
        """key and key_id of all names that were appended by."""
        kind = "key string, key_id int"
        return self.spark.read.schema(kind).parquet(*self._key_paths) if self._key_paths else self.spark.createDataFrame([], kind)

    def _append_named(self, events: DataFrame, key: str, order: list[str] | None, path: str) -> int:
        seq = self.options.seq
        if seq not in events.columns:
            events = ingest.numbered(events, order or [c for c in events.columns], seq, self._appended)
        whole = len(self._key_paths) >= COMPACT_APPENDS
        (ingest.dictionary if whole else ingest.fresh_keys)(events, key, seq, self.keys).write.parquet(path)
        self._key_paths = [path] if whole else [*self._key_paths, path]
        coded = ingest.encoded(events, self.keys, key)
        return self.append(ingest.by_key(coded, "key_id", self.options.partitions)) if self.options.key == "key_id" else self.append(coded)

    def key_id(self, key: str) -> int | None:
        row = self.keys.filter(F.col("key") == key).first()
        return None if row is None else row["key_id"]

    # state

    @property
    def events(self) -> DataFrame:
        """The events that are kept."""
        return retention.retain(self._log, self.options.per_partition, self.options.seq)

    def count_all(self) -> int:
        return self.events.count()

    def is_empty(self) -> bool:
        return self._log.isEmpty()

    def is_full(self) -> bool:
        """Whether any partition is."""
        return bool(telemetry.fullness(self.events, self.options.per_partition).first()["is_full"])

    def stats(self) -> DataFrame:
        """Events appended since the store was made, dropped by its bound and kept, how often partitions' windows moved, and bytes (8 an
        event) that views gave sight of; clearing resets only what is kept."""
        out = telemetry.store_stats(self._log, self.options.per_partition, None, self.options.seq)
        moved = self._moved()
        return out.withColumns({
            "append_count": F.lit(self._appended).cast("long"),
            "dropped_count": F.col("dropped_count") + self._dropped,
            "window_advance_count": F.lit(self._advances + moved).cast("long"),
            "snapshot_bytes_exposed": F.lit(8 * self._exposed).cast("long"),
        })

    def _moved(self) -> int:
        """How often windows moved since the last compaction."""
        if not (self.options.ts and self.options.window_ticks and self._fresh):
            return 0
        clocks = self.spark.createDataFrame(list(self._clocks.items()), "part int, window_end long")
        moved = window.advances(self._ticked(self._read(self._fresh)), seq=self.options.seq, clocks=clocks)
        return moved.agg(F.coalesce(F.sum("advances"), F.lit(0))).first()[0]

    @property
    def appended(self) -> int:
        """Events appended since the store was made."""
        return self._appended

    def statistics(self, now: float | None = None) -> dict:
        """Events appended and discarded since the last clearing or purge, when the last append was, and how
        many a second: all of them, if it was less than a second ago."""
        dropped = self._dropped + telemetry.store_stats(self._log, self.options.per_partition, None, self.options.seq).first()["dropped_count"]
        since = 0.0 if self._last is None else (time.time() if now is None else now) - self._last
        rate = self._stats / max(1.0, since) if self._last is not None else 0.0
        return {"appended": self._stats, "discarded": dropped - self._dropped_before, "last_append": self._last, "appends_per_second": rate}

    def compact(self) -> None:
        """Writes the kept events to the shared folder and goes on from there. Done by itself, see above."""
        self._goes_on_from(self.events)

    def _goes_on_from(self, events: DataFrame | None) -> None:
        """Keeps these of the events, and what counters need of the others."""
        o, n = self.options, F.count(F.lit(1)).alias("n")
        self._advances += self._moved()
        timed = o.ts and o.window_ticks
        held = self._ticked(self._log) if timed else self._log.withColumn("ts_ticks", F.lit(None).cast("long"))
        for r in held.groupBy("part").agg(n, F.max("ts_ticks").alias("clock")).collect():  # one row per partition
            self._dropped += max(0, r["n"] - o.per_partition)
            self._gone[r["part"]] = self._gone.get(r["part"], 0) + r["n"]
            if r["clock"] is not None:
                self._clocks[r["part"]] = max(r["clock"], self._clocks.get(r["part"], r["clock"]))
        path = None
        if events is not None:
            path = scratch.folder(self.spark, "store", lasting=True)
            events.write.parquet(path)
            for r in self._read([path]).groupBy("part").agg(n).collect():
                self._gone[r["part"]] = self._gone.get(r["part"], 0) - r["n"]
        self._old.append([*([self._kept] if self._kept else []), *self._fresh])
        self._kept, self._fresh, self._fresh_events = path, [], 0
        self._changed()
        while len(self._old) > 1:
            for old in self._old.pop(0):
                scratch.delete(self.spark, old)

    def _ticked(self, df: DataFrame) -> DataFrame:
        ts = self.options.ts
        if isinstance(df.schema[ts].dataType, T.LongType):
            return df.withColumn("ts_ticks", F.col(ts))
        return df.withColumn("ts_ticks", schema.ticks(df, ts))

    # scans

    def snapshot(self, where: Column | None = None, start=None, end=None) -> DataFrame:
        return scan.ordered(scan.selected(self.events, where, self.options.ts, start, end), self.options.seq)

    def views(self, start=None, end=None) -> DataFrame:
        """See scan.views; counts the events that they give sight of for stats()."""
        if (start is not None or end is not None) and self.options.ts is None:
            raise ValueError("a time range needs a timestamp column")
        out = scan.views(self.events, self.options.partitions, self.options.per_partition, self.options.ts, self.options.seq, start, end)
        self._exposed += out.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return out

    def enumerate(self) -> Iterator[Row]:
        return self.snapshot().toLocalIterator()

    def find_first(self, where: Column, start=None, end=None) -> DataFrame:
        return scan.find_first(scan.selected(self.events, None, self.options.ts, start, end), where, self.options.seq)

    # aggregates

    def _within(self, where: Column | None, start, end) -> DataFrame:
        if (start is not None or end is not None) and not self.options.window_tracking:
            raise RuntimeError("time bounds need window tracking")
        return scan.selected(self.events, where, self.options.ts, start, end)

    def _value(self, value: Column | str | None) -> Column:
        value = value if value is not None else self.options.value
        if value is None:
            raise ValueError("which value?")
        return F.col(value) if isinstance(value, str) else value

    def _buckets(self, value: Column | str | None, where: Column | None, start, end) -> DataFrame | None:
        """The buckets that make up a range, if they give just the scan's answer (window.usable_rollup, ticks as times, the store's own
        value), from the second such question on after a change."""
        o = self.options
        own = value is None or (isinstance(value, str) and value == o.value)
        if not own or o.value is None or o.ts is None or not isinstance(self.kind[o.ts].dataType, T.LongType) or not o.window_tracking:
            return None
        if not window.usable_rollup(o.width, where, start, end):
            return None
        if self._rollup is None:
            if not self._asked:
                self._asked = True
                return None
            v = F.col(o.value)
            by = self.events.groupBy(window.align_down(F.col(o.ts), o.width).alias("bucket"))
            made = by.agg(F.count(F.lit(1)).alias("rows"), F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))
            self._rollup = scratch.written(made, "store-rollup", lasting=True)
        return self._rollup.filter(F.col("bucket").between(start, end))

    def count(self, where: Column | None = None, start=None, end=None) -> DataFrame:
        if (held := self._buckets(None, where, start, end)) is not None:
            return held.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
        return aggregate.count(self._within(where, start, end))

    def sum(self, value=None, where: Column | None = None, start=None, end=None) -> DataFrame:
        scanned = aggregate.total(self._within(where, start, end), self._value(value))
        if (held := self._buckets(value, where, start, end)) is not None:
            return aggregate.total(held, F.col("sum").cast(scanned.schema["sum"].dataType)).select(F.col("sum").cast(scanned.schema["sum"].dataType))
        return scanned

    def min(self, value=None, where: Column | None = None, start=None, end=None) -> DataFrame:
        if (held := self._buckets(value, where, start, end)) is not None:
            return aggregate.least(held, F.col("min"))
        return aggregate.least(self._within(where, start, end), self._value(value))

    def max(self, value=None, where: Column | None = None, start=None, end=None) -> DataFrame:
        if (held := self._buckets(value, where, start, end)) is not None:
            return aggregate.most(held, F.col("max"))
        return aggregate.most(self._within(where, start, end), self._value(value))

    def avg(self, value=None, where: Column | None = None, start=None, end=None) -> DataFrame:
        if (held := self._buckets(value, where, start, end)) is not None:
            return held.agg(F.coalesce(F.sum("sum").cast("double") / F.sum("count"), F.lit(0.0)).alias("avg"))
        return aggregate.average(self._within(where, start, end), self._value(value))

    def window(self, value=None, where: Column | None = None, start=None, end=None) -> DataFrame:
        if (held := self._buckets(value, where, start, end)) is not None:
            return aggregate.merged(held.withColumns({c: F.col(c).cast("double") for c in ("min", "max")}).withColumn("sum", F.col("sum").cast("double")))
        return aggregate.window_aggregate(self._within(where, start, end), self._value(value))

    def fold(self, columns: list[str], seed: Column, step: Callable[[Column, Column], Column], where: Column | None = None, start=None, end=None) -> DataFrame:
        return aggregate.fold(scan.selected(self.events, where, self.options.ts, start, end), columns, seed, step, self.options.seq)

    def until(self, stop: Column, where: Column | None = None, start=None, end=None) -> DataFrame:
        return aggregate.until(scan.selected(self.events, where, self.options.ts, start, end), stop, self.options.seq)

    def groups(self, key: str, columns: list[str] | None = None, where: Column | None = None, start=None, end=None) -> DataFrame:
        return aggregate.groups(scan.selected(self.events, where, self.options.ts, start, end), key, columns or self.kind.names, self.options.seq)

    def top_k(self, key: str, k: int, value=None, start=None, end=None) -> DataFrame:
        return aggregate.top_k(scan.selected(self.events, None, self.options.ts, start, end), key, self._value(value), k)

    # the event-time window

    def rollup(self) -> DataFrame:
        """Buckets of the events that the window took in, derived from what is kept."""
        o = self.options
        if o.width is None or o.ts is None or o.value is None:
            raise ValueError("buckets need window_ticks or bucket_ticks, ts and value")
        kept = self._ticked(self.events)
        kept = window.admitted(kept, o.window_ticks, seq=o.seq) if o.window_ticks else kept
        return window.bucketed(kept, o.width, o.value)

    def bucket_window(self, start: int, end: int) -> DataFrame:
        """The aggregate of the buckets that a range of ticks overlaps, within each partition's own window if there are such."""
        o = self.options
        ends = window.ends(self._ticked(self.events)) if o.window_ticks else None
        return window.bucket_window(self.rollup(), o.width, start, end, ends, o.window_ticks)

    def sliding(self) -> DataFrame:
        return window.sliding(self._ticked(self.events), self.options.window_ticks, self.options.value, seq=self.options.seq)

    # maintenance

    def purge(self, older_than) -> None:
        """Drops events before a time; the rest keep partition and order."""
        if self.options.ts is None:
            raise ValueError("purging needs a timestamp column")
        self._goes_on_from(retention.purge(self.events, self.options.ts, older_than))
        self._stats, self._last, self._dropped_before = 0, None, self._dropped

    def purge_minutes(self, minutes: float = 60, now: dt.datetime | None = None) -> None:
        """Drops events of more than so many minutes ago; for stores whose ts is a timestamp or ticks."""
        if self.options.ts is None:
            raise ValueError("purging needs a timestamp column")
        cutoff = (now or dt.datetime.now(dt.UTC)) - dt.timedelta(minutes=minutes)
        kind = self.kind[self.options.ts].dataType
        if isinstance(kind, T.LongType):
            return self.purge(schema.EPOCH_TICKS + int((cutoff if cutoff.tzinfo else cutoff.replace(tzinfo=dt.UTC)).timestamp() * 1e6) * schema.MICRO)
        if isinstance(kind, T.TimestampNTZType):
            cutoff = cutoff.astimezone(dt.UTC).replace(tzinfo=None) if cutoff.tzinfo else cutoff
        return self.purge(cutoff)

    def clear(self, keys: bool = False) -> None:
        """Drops all events; the key dictionary too, if asked."""
        self._goes_on_from(None)
        self._stats, self._last, self._dropped_before = 0, None, self._dropped
        if keys:
            self._key_paths = []

    reset = clear

    def versions(self) -> dict[int | None, int]:
        """How many events each partition has taken in; goes on after a restore."""
        by = self._log.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
        return {r["part"]: self._version + self._gone.get(r["part"], 0) + r["n"] for r in by}

    def save(self, store: SnapshotStore, taken: int) -> dict[str, int]:
        """A snapshot of every partition. Versions count appended events and go on after a restore. Events without
        a partition are in none."""
        versions = {p: v for p, v in self.versions().items() if p is not None}
        saved = store.save_all(self.events, versions, taken)
        store.prune_all(list(saved))
        return saved

    def restore(self, store: SnapshotStore) -> int:
        """Takes the newest snapshot of every partition in place of what the store holds; returns how many."""
        events, versions = store.restore(self.options.per_partition, self._full_kind)
        self._goes_on_from(events)
        self._version, self._gone = max(versions.values(), default=0), {}
        self._appended = max(self._appended, self._log.agg(F.coalesce(F.max(self.options.seq), F.lit(-1))).first()[0] + 1)
        return len(versions)

    def snapshot_metrics(self, store: SnapshotStore) -> DataFrame:
        """One row per partition: saved_version, head_version, deltas (events since that was saved), buffered, attempts, failures."""
        held = {r["part"]: r["n"] for r in self.events.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = []
        for part, head in sorted((p, v) for p, v in self.versions().items() if p is not None):
            of = store.by_key.get(f"p{part}", {})
            saved = of.get("version", 0)
            rows.append((part, saved, head, head - saved, held.get(part, 0), of.get("attempts", 0), of.get("failures", 0)))
        return self.spark.createDataFrame(rows, "part int, saved_version long, head_version long, deltas long, buffered long, attempts long, failures long")


def clear_all(stores: Iterable[EventStore]) -> None:
    for s in stores:
        s.clear()


def purge_all(stores: Iterable[EventStore], older_than: dt.datetime | None = None, minutes: float = 60, now: dt.datetime | None = None) -> None:
    """Purges several stores by one cutoff: a time, or so many minutes ago."""
    now = now or dt.datetime.now(dt.UTC)
    for s in stores:
        s.purge(older_than) if older_than is not None else s.purge_minutes(minutes, now)
