"""Counters of a store, derived from its events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.operators import window


def store_stats(log: DataFrame, capacity: int, ticks: str | None = None, seq: str = "seq") -> DataFrame:
    """One row: events appended, dropped and kept, and window advances. log: all events with part; those
    without one are counted as a partition."""
    by = log.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    if ticks:
        moved = window.advances(log, ticks, seq).withColumnRenamed("part", "__p")
        by = by.join(moved, F.col("part").eqNullSafe(F.col("__p")), "left")
    moved = F.coalesce(F.sum("advances"), F.lit(0)) if ticks else F.lit(0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return by.agg(
        zero(F.sum("n")).alias("append_count"),
        zero(F.sum(F.greatest(F.lit(0), F.col("n") - capacity))).alias("dropped_count"),
        zero(F.sum(F.least(F.lit(capacity), F.col("n")))).alias("buffered"),
        moved.cast("long").alias("window_advance_count"),
    )


def partition_stats(log: DataFrame, capacity: int, seq: str = "seq") -> DataFrame:
    """Per partition: the places of the oldest kept event and the next one, and how many are kept."""
    n = F.count(F.lit(1))
    return log.groupBy("part").agg(
        F.greatest(F.lit(0), n - capacity).cast("long").alias("head"), n.alias("tail"), F.least(F.lit(capacity), n).cast("long").alias("n"),
        F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"),
    )


def segments(log: DataFrame, capacity: int) -> DataFrame:
    """Where a ring of capacity places holds each partition's newest events: how many from the oldest up to the ring's end,
    how many from its beginning on, and whether they wrap around."""
    n, start = F.least(F.lit(capacity), F.col("all")), F.greatest(F.lit(0), F.col("all") - capacity) % capacity
    first = F.least(n, capacity - start)
    by = log.groupBy("part").agg(F.count(F.lit(1)).alias("all"))
    return by.select("part", start.cast("long").alias("start"), first.cast("long").alias("first"), (n - first).cast("long").alias("second"), (n > first).alias("wraps"))


def fullness(retained: DataFrame, capacity: int) -> DataFrame:
    """count, is_empty (of all partitions) and is_full (of any)."""
    by = retained.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return by.agg(n.alias("count"), (n == 0).alias("is_empty"), F.coalesce(F.max("n") >= capacity, F.lit(False)).alias("is_full"))
