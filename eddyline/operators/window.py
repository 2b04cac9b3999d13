"""The event-time window: one sliding window per partition, behind its largest event time, kept in buckets.

All arithmetic is on ticks. A partition's clock after an event is the largest event time so far by
arrival; an event is late, and left out of buckets though not of scans, if it lies more than the
window behind the clock. An event without a time is in no window, neither late nor admitted, and moves no clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.operators import aggregate, prefix, scan
from eddyline.operators.aggregate import MONEY


def align_down(tick: Column, width: int | Column) -> Column:
    """The multiple of width at or below a tick, also for negative ones."""
    width = F.lit(width) if isinstance(width, int) else width
    return tick - F.pmod(tick, width)


def clocked(df: DataFrame, ticks: str = "ts_ticks", seq: str = "seq") -> DataFrame:
    """Adds clock: the partition's largest event time up to and with this event."""
    return prefix.running(df, {"clock": ("max", F.col(ticks))}, seq)


def late(df: DataFrame, window: int, ticks: str = "ts_ticks", seq: str = "seq") -> DataFrame:
    return clocked(df, ticks, seq).filter(F.col(ticks) < F.col("clock") - window)


def admitted(df: DataFrame, window: int, ticks: str = "ts_ticks", seq: str = "seq") -> DataFrame:
    """The events that the window took in when they came."""
    return clocked(df, ticks, seq).filter(F.col(ticks) >= F.col("clock") - window)


def bucketed(df: DataFrame, width: int, value: str, ticks: str = "ts_ticks", exact: bool = True) -> DataFrame:
    """The rollup: count, sum, min and max by partition and bucket. exact: values have two decimals at most."""
    total = F.sum(F.col(value).cast(MONEY)) if exact else F.sum(value)
    return df.filter(F.col(ticks).isNotNull()).groupBy("part", align_down(F.col(ticks), width).alias("bucket")).agg(
        F.count(value).alias("count"),
        total.cast("double").alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def bucket_window(rollup: DataFrame, width: int, start: int, end: int, ends: DataFrame | None = None, window: int | None = None, exact: bool = True) -> DataFrame:
    """The buckets that overlap a range, whole; bounds are swapped if inverted. ends: part and window_end, one row for each
    partition; with them, the range is cut to each partition's own window, from window ticks before its end to that."""
    start, end = min(start, end), max(start, end)
    inside = rollup.filter((F.col("bucket") <= end) & (F.col("bucket") + width > start))
    if ends is not None:
        of = ends.select(F.col("part").alias("__p"), F.col("window_end").alias("__end"))
        inside = inside.join(of, F.col("part").eqNullSafe(F.col("__p"))).filter((F.col("bucket") <= F.col("__end")) & (F.col("bucket") + width > F.col("__end") - window))
    summed = F.sum(F.col("sum").cast(MONEY)).cast("double") if exact else F.sum("sum")
    total = F.coalesce(summed, F.lit(0.0))
    n = F.coalesce(F.sum("count"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return inside.agg(n.alias("count"), total.alias("sum"), zero(F.min("min")).alias("min"), zero(F.max("max")).alias("max"), zero(F.when(n > 0, total / n)).alias("avg"))


def sliding(df: DataFrame, window: int, value: str, ticks: str = "ts_ticks", seq: str = "seq") -> DataFrame:
    """Every partition's window as it stands: admitted events from its largest time minus the window on."""
    taken = admitted(df, window, ticks, seq)
    # one row per partition; an admitted event holds the largest time, so that of all events will do
    ends = df.groupBy(F.col("part").alias("__p")).agg(F.max(ticks).alias("end"))
    inside = taken.join(ends, F.col("part").eqNullSafe(F.col("__p"))).filter(F.col(ticks) >= F.col("end") - window)
    return inside.groupBy("part").agg(
        F.max("end").alias("window_end"),
        F.count(value).alias("count"),
        F.sum(F.col(value).cast(MONEY)).cast("double").alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def ends(df: DataFrame, ticks: str = "ts_ticks") -> DataFrame:
    """part and window_end, the largest event time of each partition."""
    return df.groupBy("part").agg(F.max(ticks).alias("window_end"))


def advances(df: DataFrame, ticks: str = "ts_ticks", seq: str = "seq", clocks: DataFrame | None = None) -> DataFrame:
    """How often each partition's clock moved forward. clocks: part and window_end before df's events, if there were others."""
    before = prefix.running(df, {"__before": ("max", F.col(ticks))}, seq, own=False)
    if clocks is not None:
        of = clocks.select(F.col("part").alias("__p"), F.col("window_end").alias("__end"))
        before = before.join(of, F.col("part").eqNullSafe(F.col("__p")), "left").withColumn("__before", F.greatest("__before", "__end")).drop("__p", "__end")
    moved = F.col(ticks).isNotNull() & F.coalesce(F.col(ticks) > F.col("__before"), F.lit(True))
    return before.groupBy("part").agg(F.count_if(moved).alias("advances"))


def usable_rollup(width: int | None, where: Column | None, start: int | None, end: int | None) -> bool:
    """Whether buckets answer a range exactly: no predicate, both bounds, and bounds at buckets' edges."""
    if width is None or where is not None or start is None or end is None or start > end:
        return False
    return start % width == 0 and (end + 1) % width == 0


def rollup_or_scan(kept: DataFrame, rollup: DataFrame, width: int, value: str, where: Column | None = None, start: int | None = None, end: int | None = None, ticks: str = "ts_ticks") -> DataFrame:
    """The five numbers of a range of ticks: from the rollup where that gives just the scan's answer, else from the scan."""
    if usable_rollup(width, where, start, end):
        return bucket_window(rollup, width, start, end)
    return aggregate.window_aggregate(scan.selected(kept, where, ticks, start, end), F.col(value), exact=True)
