"""A stream's newest event-time clock and window, per partition, in a table that each micro-batch carries on.

Of every partition the table holds the clock and counters, and the window's buckets; it is as large as windows have
buckets, however many events pass. Events of a micro-batch are taken in order of seq; batches themselves must come in that
order, as files that are written one after another do. No task runs through a whole partition: within a batch clocks are running
maxima by chunks of arrival numbers (operators.prefix), started from the clock that the table holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.operators import prefix, window
from eddyline.sources import scratch

_STATE = "part int, clock long, appended long, late long, advances long"
_BUCKETS = "part int, bucket long, n long, cents long, low double, high double"


class ClockTable:
    """Clocks and buckets of a stream (part, seq, ts_ticks, value) under a path, written anew for each batch under its number.

    A batch that is run again after a failure starts from the same earlier version, so every event counts once. Two
    versions are kept. Events without a time are counted as appended and nothing else.
    """

    def __init__(self, spark: SparkSession, path: str, span: int, width: int):
        self.spark, self.path, self.span, self.width = spark, path.rstrip("/"), span, width

    def _versions(self) -> list[int]:
        names = [n for n in scratch.listed(self.spark, self.path) if n[:1] == "b"]
        return sorted(int(n[1:]) for n in names if scratch.complete(self.spark, f"{self.path}/{n}/state"))

    def _read(self, version: int | None, what: str, kind: str) -> DataFrame:
        return self.spark.createDataFrame([], kind) if version is None else self.spark.read.schema(kind).parquet(f"{self.path}/b{version}/{what}")

    def _take(self, batch: DataFrame, number: int) -> None:
        before = max((v for v in self._versions() if v < number), default=None)
        with scratch.Scope(self.spark):
            self._step(batch, number, self._read(before, "state", _STATE), self._read(before, "buckets", _BUCKETS))
        for old in [v for v in self._versions() if v < number][:-1]:
            scratch.delete(self.spark, f"{self.path}/b{old}")

    def _step(self, batch: DataFrame, number: int, state: DataFrame, buckets: DataFrame) -> None:
        held = state.select(F.col("part").alias("hpart"), F.col("clock").alias("held"))
        tick = F.col("ts_ticks")
        rows = prefix.running(batch.select("part", "seq", "ts_ticks", "value"), {"run": ("max", tick)})
        rows = rows.join(held, F.col("part").eqNullSafe(F.col("hpart")), "left")
        rows = scratch.written(rows.select("part", "seq", "ts_ticks", "value", "held", F.greatest("run", "held").alias("clock")), "clock-rows")
        late = tick < F.col("clock") - self.span
        moved = window.advances(rows, clocks=state.select("part", F.col("clock").alias("window_end"))).select(F.col("part").alias("mpart"), "advances")
        counted = rows.groupBy("part").agg(F.max("clock").alias("clock"), F.count(F.lit(1)).alias("appended"), F.count_if(late).alias("late"))
        counted = counted.join(moved, F.col("part").eqNullSafe(F.col("mpart"))).select("part", "clock", "appended", "late", "advances")
        sums = state.unionByName(counted).groupBy("part").agg(F.max("clock").alias("clock"), *[F.sum(c).alias(c) for c in ("appended", "late", "advances")])
        sums = scratch.written(sums, "clock-state")
        fresh = rows.filter(~late).groupBy("part", window.align_down(tick, self.width).alias("bucket")).agg(
            F.count("value").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        every = buckets.unionByName(fresh).groupBy("part", "bucket").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.min("low").alias("low"), F.max("high").alias("high"))
        # buckets that lie before the window whole are let go
        ends = sums.select(F.col("part").alias("epart"), F.col("clock").alias("end"))
        kept = every.join(ends, F.col("part").eqNullSafe(F.col("epart"))).filter(F.col("bucket") + self.width > F.col("end") - self.span)
        kept.select("part", "bucket", "n", "cents", "low", "high").write.mode("overwrite").parquet(f"{self.path}/b{number}/buckets")
        sums.write.mode("overwrite").parquet(f"{self.path}/b{number}/state")  # last: it says that the version is whole

    def windows(self) -> DataFrame:
        """A row for each partition: clock, appended, late, advances, and count, sum, min and max of the buckets that its window overlaps."""
        newest = max(self._versions(), default=None)
        state, buckets = self._read(newest, "state", _STATE), self._read(newest, "buckets", _BUCKETS)
        total = buckets.groupBy(F.col("part").alias("bpart")).agg(F.sum("n").alias("count"), (F.sum("cents") / 100).alias("sum"), F.min("low").alias("min"), F.max("high").alias("max"))
        joined = state.join(total, F.col("part").eqNullSafe(F.col("bpart")), "left")
        zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
        return joined.select("part", "clock", "appended", "late", "advances", zero("count", "long"), *[zero(c, "double") for c in ("sum", "min", "max")])

    def drain(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Takes in all that the stream's source holds now; returns the windows as they stand then."""
        stream.writeStream.foreachBatch(self._take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self.windows()
