"""Appends a stream to a bounded store on disk: after every micro-batch each partition holds its newest events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.operators.retention import discarded, retain


class RingTable:
    """A table of the newest events, written anew for each batch under the batch's number.

    A batch that is run again after a failure starts from the same earlier version, so every event
    counts once. Two versions are kept.
    """

    def __init__(self, spark, path: str, capacity: int, seq: str = "seq", on_discarded: Callable[[DataFrame], None] | None = None):
        self.spark, self.path, self.capacity, self.seq, self.on_discarded = spark, path.rstrip("/"), capacity, seq, on_discarded

    def _versions(self) -> list[int]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        done = lambda s: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(fs_path) if s.getPath().getName()[:1] == "b" and done(s))

    def events(self, before: int | None = None) -> DataFrame | None:
        """The newest version (before a batch), if there is one."""
        found = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/b{found[-1]}") if found else None

    def _take(self, batch: DataFrame, number: int) -> None:
        held = self.events(number)
        every = batch if held is None else held.unionByName(batch)
        retain(every, self.capacity, self.seq).write.mode("overwrite").parquet(f"{self.path}/b{number}")
        if self.on_discarded:
            self.on_discarded(discarded(every, self.capacity, self.seq))
        for old in [v for v in self._versions() if v < number][:-1]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/b{old}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drain(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Takes in all that the stream's source holds now; returns the events that are kept."""
        stream.writeStream.foreachBatch(self._take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        found = self.events()
        return self.spark.createDataFrame([], stream.schema) if found is None else found


def named(events: DataFrame, stream: str) -> DataFrame:
    """The events of one named stream."""
    return events.filter(F.col("stream") == stream)
