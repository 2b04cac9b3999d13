"""Scans of retained events: whole, filtered, by inclusive time range, in views and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.sources.scratch import ship


def in_range(column: str, start=None, end=None) -> Column:
    """Inclusive at both ends; an absent bound is open; an inverted range holds nothing."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(column) >= (start if isinstance(start, Column) else F.lit(start)))
    if end is not None:
        out = out & (F.col(column) <= (end if isinstance(end, Column) else F.lit(end)))
    return out


def selected(df: DataFrame, where: Column | None = None, ts: str | None = None, start=None, end=None) -> DataFrame:
    """Events in a time range that meet a predicate."""
    if (start is not None or end is not None) and ts is None:
        raise ValueError("a time range needs a timestamp column")
    df = df.filter(in_range(ts, start, end)) if ts else df
    return df if where is None else df.filter(where)


def ordered(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Scan order: by partition, then by arrival."""
    return df.orderBy("part", seq)


def views(df: DataFrame, partitions: int, capacity: int, ts: str, seq: str = "seq", start=None, end=None) -> DataFrame:
    """One row per partition, empty ones too: count, first and last event time by arrival, whether full.

    With bounds, only events in the range count and the view's times are the bounds themselves.
    """
    bounded = start is not None or end is not None
    inner = selected(df, None, ts, start, end) if bounded else df
    if bounded:
        by = inner.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        by = by.withColumns({"first_ts": F.lit(start), "last_ts": F.lit(end)})
    else:
        by = inner.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min_by(ts, seq).alias("first_ts"), F.max_by(ts, seq).alias("last_ts"))
    every = df.sparkSession.range(partitions).select(F.col("id").cast("int").alias("part"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    out = every.join(by, "part", "left").select("part", n.alias("n"), "first_ts", "last_ts")
    return out if bounded else out.withColumn("is_full", F.col("n") >= capacity)


def find_first(df: DataFrame, where: Column, seq: str = "seq") -> DataFrame:
    """The first event that meets a predicate in scan order: one row or none."""
    return df.filter(where).orderBy("part", seq).limit(1)


def newest_of(df: DataFrame, part: int, most: int, seq: str = "seq") -> DataFrame:
    """The oldest most events of one partition, in order (a copy into a bounded destination)."""
    return df.filter(F.col("part") == part).orderBy(seq).limit(most)


def window_chunks(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, ts: str | None = None, start=None, end=None, size: int = 4096) -> DataFrame:
    """Runs a function over the events in a time range, in chunks; over all of them where no time column is named."""
    return chunks(selected(df, None, ts, start, end) if ts else df, each, schema, size)


def chunks(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, size: int = 4096) -> DataFrame:
    """Runs a function over the events in chunks of at most size rows, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield from each(batch.slice(at, size))

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
