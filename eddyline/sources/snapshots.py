"""Versioned snapshots of partitions: Parquet folders, and the compact binary file form.

A snapshot of a partition lies in <root>/<key>/<version>_<taken>_s<schema>_n<events>/, with its metadata in the
names (the number of events where it is known), so listing needs no file to be opened. It is written under another name first and renamed,
and an existing one is never overwritten. The newest is that of the largest (version, taken).
Folders are handled through Hadoop's file system interface, so any store that Spark reaches will do.
"""

from __future__ import annotations

import gzip
import logging
import random
import re
import struct
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline import schema
from eddyline.sources.scratch import at, ship

log = logging.getLogger("eddyline.snapshots")
SCHEMA_VERSION = 1
CATALOG = "part_key string, version long, taken long, schema_version int, events long, path string"
_KEY = re.compile(r"[A-Za-z0-9_-]+")
_DEVICES = {"CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))}
_NAME = re.compile(r"(-?\d+)_(\d+)_s(\d+)(?:_n(\d+))?")


def checked_key(key: str) -> str:
    """A partition key that is safe as a folder's name."""
    if not key or not key.strip():
        raise ValueError("a partition key can't be empty")
    if key.startswith("/") or ".." in key or "/" in key or "\\" in key:
        raise PermissionError(f"a partition key can't lead elsewhere: {key!r}")
    if not _KEY.fullmatch(key) or key.upper() in _DEVICES:
        raise ValueError(f"a partition key is made of letters, digits, _ and -: {key!r}")
    return key


@dataclass(frozen=True)
class SnapshotOptions:
    """When snapshots are due, how often a save is tried, and how many are kept. An interval or
    event threshold of 0 is off."""

    interval: float = 0.0
    min_events: int = 0
    keep: int = 3
    attempts: int = 3
    expected_schema: int | None = None
    base_delay: float = 0.1
    factor: float = 2.0

    def __post_init__(self) -> None:
        if self.interval <= 0 and self.min_events <= 0:
            raise ValueError("interval or min_events must be greater than 0")
        for name in ("keep", "attempts"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.expected_schema is not None and self.expected_schema <= 0:
            raise ValueError("expected_schema must be greater than 0")
        if self.base_delay <= 0 or self.factor <= 0:
            raise ValueError("base_delay and factor must be greater than 0")

    def due(self, seconds: float, appended: int) -> bool:
        """Whether a snapshot is due, so long and so many events after the last."""
        return (self.interval > 0 and seconds >= self.interval) or (self.min_events > 0 and appended >= self.min_events)


def delays(options: SnapshotOptions, rng: random.Random | None = None) -> Iterator[float]:
    """Growing pauses between attempts, each moved by up to a tenth, never shorter than the last."""
    rng, last, attempt = rng or random.Random(), 0.0, 0
    while True:
        pause = options.base_delay * options.factor**attempt * rng.uniform(0.9, 1.1)
        last = pause if pause > last else last + 0.001
        yield last
        attempt += 1


class Deltas:
    """A place for writing what changed since a snapshot, and reading it at a restore; this one does neither."""

    def write(self, key: str, version: int, events: DataFrame) -> None:
        pass

    def read(self, key: str, version: int) -> DataFrame | None:
        return None


class SnapshotStore:
    """Snapshots under one root folder. by_key: of each partition, the version saved last, attempts and failures. trace
    gets a name (snapshot.save or snapshot.prune) and tags, the seconds among them, when such a thing ends.
    """

    def __init__(
        self, spark: SparkSession, root: str, options: SnapshotOptions | None = None, sleep: Callable[[float], None] = time.sleep,
        trace: Callable[[str, dict], None] | None = None, deltas: Deltas | None = None,
    ):
        self.spark, self.root, self.options, self.sleep = spark, root.rstrip("/"), options or SnapshotOptions(min_events=1), sleep
        self.trace, self.deltas = trace or (lambda name, tags: log.info("%s %s", name, tags)), deltas or Deltas()
        self._counters = {"attempts": 0, "failures": 0, "saved": 0, "pruned": 0}
        self.by_key: dict[str, dict[str, int]] = {}

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []

    def keys(self) -> list[str]:
        return [k for k in self._names(self.root) if _KEY.fullmatch(k)]

    def catalog(self) -> DataFrame:
        """One row per snapshot: part_key, version, taken (ticks), schema_version, path."""
        found = []
        for key in self.keys():
            for name in self._names(f"{self.root}/{key}"):
                if m := _NAME.fullmatch(name):
                    found.append((key, int(m[1]), int(m[2]), int(m[3]), int(m[4]) if m[4] else None, f"{self.root}/{key}/{name}"))
        return self.spark.createDataFrame(found, CATALOG)

    def _count(self, keys: list[str], what: str) -> None:
        self._counters[what] += 1
        for key in keys:
            of = self.by_key.setdefault(key, {"version": 0, "attempts": 0, "failures": 0})
            of[what] += 1

    def _tried(self, versions: dict[str, int], attempt: Callable[[str], list[str]]) -> list[str]:
        """attempt(a new scratch folder), again with growing pauses if it fails; the folder is gone afterwards."""
        pause, keys, began = delays(self.options), list(versions), time.perf_counter()
        what = f"{keys[0]} version {versions[keys[0]]}" if len(keys) == 1 else f"{len(keys)} partitions"
        for k in range(1, self.options.attempts + 1):
            self._count(keys, "attempts")
            scratch = f"{self.root}/.saving-{uuid.uuid4().hex}"
            try:
                made = attempt(scratch)
                self._counters["saved"] += len(made)
                for key in keys:
                    self.by_key[key]["version"] = versions[key]
                self.trace("snapshot.save", {"what": what, "outcome": "saved", "attempt": k, "seconds": time.perf_counter() - began})
                return made
            except Exception as e:
                self._count(keys, "failures")
                log.warning("saving %s failed, attempt %d: %s", what, k, e)
                if isinstance(e, FileExistsError) or k == self.options.attempts:
                    self.trace("snapshot.save", {"what": what, "outcome": "failed", "attempt": k, "seconds": time.perf_counter() - began})
                    raise
                self.sleep(next(pause))
            finally:
                self._fs().delete(self._path(scratch), True)
        raise AssertionError

    def _moved(self, scratch: str, key: str, name: str, same: str) -> str:
        """A written folder under its final name; an existing one of the same version and time stays as it is."""
        fs, target = self._fs(), f"{self.root}/{key}/{name}"
        fs.mkdirs(self._path(f"{self.root}/{key}"))
        taken = [n for n in self._names(f"{self.root}/{key}") if n == same or n.startswith(f"{same}_n")]
        if taken or not fs.rename(self._path(scratch), self._path(target)):
            raise FileExistsError(target)
        return target

    def save(self, events: DataFrame, key: str, version: int, taken: int, schema_version: int = SCHEMA_VERSION) -> str:
        """Writes one partition's events; tries again, with growing pauses, if that fails."""
        name = f"{version}_{taken}_s{schema_version}"
        checked_key(key)

        def attempt(scratch: str) -> list[str]:
            self._write(events, scratch)
            n = self.spark.read.parquet(scratch).count()  # from the files' footers
            return [self._moved(scratch, key, f"{name}_n{n}", name)]

        return self._tried({key: version}, attempt)[0]

    def _write(self, events: DataFrame, path: str, *by: str) -> None:
        events.write.partitionBy(*by).parquet(path)

    def save_all(self, retained: DataFrame, versions: dict[int, int], taken: int) -> dict[str, int]:
        """One snapshot of every partition, written by one job. versions: by partition. Returns the versions saved by key."""
        todo = dict(versions)

        def attempt(scratch: str) -> list[str]:
            self._write(retained.filter(F.col("part").isin(*todo)).withColumn("__p", F.col("part")), scratch, "__p")
            made = []
            held = {}
            if self._names(scratch):
                # from the files' footers; one row for each partition
                held = {int(r["__p"]): r["n"] for r in self.spark.read.parquet(scratch).groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
            for part, version in sorted(todo.items()):
                name = f"{version}_{taken}_s{SCHEMA_VERSION}"
                made.append(self._moved(self._folder(scratch, part, retained), f"p{part}", f"{name}_n{held.get(part, 0)}", name))
                del todo[part]
            return made

        if todo:
            self._tried({f"p{part}": version for part, version in sorted(todo.items())}, attempt)
        return {f"p{part}": version for part, version in sorted(versions.items())}

    def _folder(self, scratch: str, part: int, retained: DataFrame) -> str:
        """Where a partition's events were written; an empty table for one without any."""
        folder = f"{scratch}/__p={part}"
        if not self._fs().exists(self._path(folder)):
            retained.limit(0).write.parquet(folder)
        return folder

    def prune(self, key: str, keep: int | None = None) -> int:
        """Deletes all but the newest keep snapshots of a partition; below 1 nothing. Returns how many went."""
        return self.prune_all([key], keep)

    def prune_all(self, keys: list[str], keep: int | None = None) -> int:
        """Prunes several partitions by one listing."""
        keep = self.options.keep if keep is None else keep
        for key in keys:
            checked_key(key)
        if keep < 1 or not keys:
            return 0
        gone, began = 0, time.perf_counter()
        for row in expendable(self.catalog().filter(F.col("part_key").isin(*keys)), keep).collect():
            try:
                gone += bool(self._fs().delete(self._path(row["path"]), True))
            except Exception as e:  # what can't be deleted now is tried at the next pruning
                log.warning("pruning %s failed: %s", row["path"], e)
        self._counters["pruned"] += gone
        self.trace("snapshot.prune", {"what": f"{len(keys)} partitions", "gone": gone, "seconds": time.perf_counter() - began})
        return gone

    def restore(self, capacity: int, kind: T.StructType) -> tuple[DataFrame, dict[str, int]]:
        """The newest snapshot of every partition, its newest capacity events, and the versions
        they had: later snapshots go on from there.

        Snapshots that can't be read to their end are left out, all their partition's events with them. One of another schema is left out
        too, or an error if the options expect a certain schema.
        """
        from eddyline.operators.retention import retain

        expected = self.options.expected_schema
        parts, versions, wanted = [], {}, []
        for row in newest(self.catalog()).collect():
            if row["schema_version"] != (expected or SCHEMA_VERSION):
                if expected:
                    raise ValueError(f"{row['path']} has schema {row['schema_version']}, not {expected}")
                continue
            wanted.append(row)
        held = self._whole([r["path"] for r in wanted], kind)
        for row in wanted:
            found = held.get(row["path"], 0)
            if found != (row["events"] if row["events"] is not None else found) or (row["events"] is None and row["path"] not in held):
                log.warning("%s can't be read: %d of %s events", row["path"], found, row["events"])
                continue
            parts.append(row["path"])
            versions[row["part_key"]] = row["version"]
        out = self.spark.read.schema(kind).parquet(*parts) if parts else self.spark.createDataFrame([], kind)
        return retain(out, capacity), versions

    def _whole(self, paths: list[str], kind: T.StructType) -> dict[str, int]:
        """How many rows of each snapshot can be read, every column of them, by one job."""
        if not paths:
            return {}
        names = {"/".join(p.rsplit("/", 2)[1:]): p for p in paths}
        read = self.spark.read.schema(kind).option("ignoreCorruptFiles", "true").parquet(*paths)
        of = F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+)/[^/]+$", 1)
        by = read.select(of.alias("of"), F.xxhash64(*[F.col(f"`{f.name}`") for f in kind.fields]).alias("h")).groupBy("of")
        return {names[r["of"]]: r["n"] for r in by.agg(F.count(F.lit(1)).alias("n"), F.max("h")).collect() if r["of"] in names}  # one row a snapshot

    def metrics(self) -> DataFrame:
        """One row: attempts, failures, saved, pruned so far."""
        return self.spark.createDataFrame([tuple(self._counters.values())], ", ".join(f"{k} long" for k in self._counters))


class Snapshotter:
    """Saves a store's partitions when its snapshot options say that they are due, and once more at the end.

    store: has appended (how many events so far) and save(target, taken). tick() belongs after every batch,
    such as in foreachBatch; start() has a thread do it, every poll seconds. A save that falls due while as many as pending wait
    or run is dropped, and counted in dropped; what it would have saved is saved by the next. As a context manager, what came
    after the last snapshot is saved on the way out.
    """

    def __init__(self, store, target: SnapshotStore, clock: Callable[[], float] = time.time, pending: int = 1):
        if pending < 1:
            raise ValueError("pending must be at least 1")
        self.store, self.target, self.clock, self.pending = store, target, clock, pending
        self._when, self._at = clock(), store.appended
        self.dropped = 0
        self._stop = threading.Event()
        self._loop: threading.Thread | None = None
        self._saver: ThreadPoolExecutor | None = None
        self._waiting: list[Future] = []

    def tick(self) -> dict[str, int]:
        """The versions saved by key; none if nothing is due."""
        return self._save() if self._due() else {}

    def _due(self) -> bool:
        fresh = self.store.appended - self._at
        return bool(fresh and self.target.options.due(self.clock() - self._when, fresh))

    def submit(self) -> bool:
        """Lets a save run in the background; false, and one more dropped, if too many do."""
        self._saver = self._saver or ThreadPoolExecutor(1)
        self._waiting = [f for f in self._waiting if not f.done()]
        if len(self._waiting) >= self.pending:
            self.dropped += 1
            return False
        self._waiting.append(self._saver.submit(self._save))
        return True

    def start(self, poll: float = 0.25) -> Snapshotter:
        """Begins to look, every poll seconds, whether a snapshot is due."""

        def loop() -> None:
            while not self._stop.wait(poll):
                try:
                    if self._due():
                        self.submit()
                except Exception:
                    log.warning("a snapshot could not be begun", exc_info=True)

        if self._loop is None:
            self._stop.clear()
            self._loop = threading.Thread(target=loop, daemon=True)
            self._loop.start()
        return self

    def close(self, timeout: float | None = None) -> dict[str, int]:
        """Ends the thread, waits for saves that run (for timeout seconds at most), and saves what came since."""
        self._stop.set()
        if self._loop is not None:
            self._loop.join()
            self._loop = None
        unfinished = wait(self._waiting, timeout).not_done
        if self._saver is not None:
            self._saver.shutdown(wait=False)
            self._saver = None
        if unfinished:
            log.warning("a snapshot was still being saved after %s s", timeout)
            return {}
        return self._save() if self.store.appended > self._at else {}

    def _save(self) -> dict[str, int]:
        now, at = self.clock(), self.store.appended
        saved = self.store.save(self.target, schema.EPOCH_TICKS + int(now * schema.SECOND))
        self._when, self._at = now, at
        return saved

    def __enter__(self) -> Snapshotter:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def newest(catalog: DataFrame) -> DataFrame:
    """Each partition's snapshot with the largest (version, taken)."""
    w = Window.partitionBy("part_key").orderBy(F.desc("version"), F.desc("taken"))
    return catalog.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def expendable(catalog: DataFrame, keep: int) -> DataFrame:
    """What lies beyond each partition's newest keep snapshots."""
    w = Window.partitionBy("part_key").orderBy(F.desc("version"), F.desc("taken"))
    return catalog.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") > keep).drop("rank")


# the compact binary form -----------------------------------------------------------------------

MOST_EVENTS = 10_000_000
_EVENT = struct.Struct("<idq")


def packed(key: str, version: int, taken: int, events: list[tuple[int, float, int]], schema_version: int = SCHEMA_VERSION, compress: bool = False) -> bytes:
    """One partition in the little-endian form: schema, key (length in 7-bit groups, UTF-8), version,
    taken ticks, count, then (int key, double value, long ticks) each; gzip on demand."""
    name, size = key.encode(), bytearray()
    n = len(name)
    while n > 127:
        size.append(n & 127 | 128)
        n >>= 7
    size.append(n)
    body = struct.pack("<i", schema_version) + bytes(size) + name + struct.pack("<qqi", version, taken, len(events))
    body += b"".join(_EVENT.pack(*e) for e in events)
    return gzip.compress(body) if compress else body


def unpacked(data: bytes) -> tuple[int, str, int, int, list[tuple[int, float, int]]]:
    """(schema, key, version, taken, events); compressed data is recognised by its first bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    (schema_version,), at, size, shift = struct.unpack_from("<i", data), 4, 0, 0
    while True:
        size |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            break
    key = data[at : at + size].decode()
    version, taken, count = struct.unpack_from("<qqi", data, at + size)
    at += size + 20
    if not 0 <= count <= MOST_EVENTS or len(data) < at + count * _EVENT.size:
        raise ValueError("a snapshot's event count is out of range")
    return schema_version, key, version, taken, [_EVENT.unpack_from(data, at + i * _EVENT.size) for i in range(count)]


PACKED = "part_key string, version long, taken long, schema_version int, seq long, key_id int, value double, ts_ticks long"


def read_packed(spark: SparkSession, path: str, problems: bool = False) -> DataFrame:
    """Binary snapshot files as rows, read on the executors: part_key, version, taken, schema_version,
    seq (the place in the file), key_id, value, ts_ticks.

    Spark passes over files of no bytes. Another file that can't be read (damaged, or of more than MOST_EVENTS events) is an error that names it. With problems, it is
    a row that has only path and problem, columns that are null in the others.
    """
    kind = f"{PACKED}, path string, problem string"
    names = [f.name for f in T.StructType.fromDDL(kind).fields]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.string(), pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    s, key, version, taken, found = unpacked(data.as_py())
                    out = [(key, version, taken, s, i, *e, None, None) for i, e in enumerate(found)]
                except (ValueError, IndexError, struct.error, UnicodeDecodeError, EOFError, OSError, zlib.error) as e:
                    if not problems:
                        raise ValueError(f"{where.as_py()} can't be read: {e}") from e
                    out = [(*[None] * 8, where.as_py(), str(e) or type(e).__name__)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.snap").load(path).select("path", "content")
    out = files.mapInArrow(rows, kind)
    return out if problems else out.drop("path", "problem")


def write_packed(retained: DataFrame, root: str, versions: dict[int, int], taken: int, seq: str = "seq", compress: bool = False) -> list[str]:
    """Writes partitions in the binary form (key_id, value and ts_ticks of part, in order of seq): packed on the executors, one
    partition at a time through the driver. An existing file is not overwritten. Returns the files' paths."""
    spark = retained.sparkSession

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        part, rows = int(rows["part"].iloc[0]), rows.sort_values("seq", kind="stable")
        if len(rows) > MOST_EVENTS:
            raise ValueError(f"a binary snapshot holds {MOST_EVENTS} events at most")
        events = list(zip(rows["key_id"].astype(int), rows["value"].astype(float), rows["ts_ticks"].astype("int64"), strict=True))
        data = packed(f"p{part}", versions[part], taken, [(int(k), float(v), int(t)) for k, v, t in events], compress=compress)
        return pd.DataFrame({"part": [part], "content": [data]})

    ship(spark)
    slim = retained.filter(F.col("part").isin(*versions)).select("part", F.col(seq).alias("seq"), "key_id", "value", "ts_ticks")
    made = []
    for row in slim.groupBy("part").applyInPandas(pack, "part int, content binary").toLocalIterator():
        path = f"{root.rstrip('/')}/p{row['part']}_{versions[row['part']]}_{taken}.snap"
        p, fs = at(spark, path)
        out = fs.create(p, False)
        try:
            out.write(bytearray(row["content"]))
        finally:
            out.close()
        made.append(path)
    return sorted(made)
