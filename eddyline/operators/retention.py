"""Bounded retention: each partition keeps its newest events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eddyline.operators import prefix

_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
#: Bytes of a log that is worth a pass over two columns before it is read.
LARGE = 4 << 30


def ranked(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds rank: 1 for the newest event of a partition."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.desc(seq))))


def cutoff(df: DataFrame, capacity: int, seq: str = "seq", chunk: int | None = None) -> DataFrame:
    """One row and column: an arrival number at or below that of every event that retention keeps.

    Only part and seq are read; events are counted by chunk, and chunks are taken from the newest back until
    every partition has its fill.
    """
    size = chunk or prefix.CHUNK
    counts = df.groupBy("part", prefix.chunk_of(seq, size).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    newer = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1))
    return counts.filter("c IS NOT NULL").withColumn("newer", F.coalesce(newer, F.lit(0))).filter(F.col("newer") < capacity).agg(F.min("c").alias("least"))


def is_large(df: DataFrame) -> bool:
    """Whether the optimizer expects more bytes than LARGE; runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > LARGE


def retain(df: DataFrame, capacity: int, seq: str = "seq", large: bool | None = None) -> DataFrame:
    """The newest capacity events of every partition.

    The rank filter prunes inside every task before the shuffle as long as the optimizer's
    threshold allows, so that is raised to the capacity, for the session, and never lowered. Of a large log (by default: what the optimizer takes for
    one) the events below the cutoff are not even read: as a scalar it reaches the scan, which skips
    their row groups. Events without an arrival number are the oldest. Filters on time or value belong above this step; only those on part may move below it.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_LIMIT)) < capacity:
        conf.set(_LIMIT, str(capacity))
    if is_large(df) if large is None else large:
        df = df.filter((F.col(seq) >= cutoff(df, capacity, seq).scalar()) | F.col(seq).isNull())
    return ranked(df, seq).filter(F.col("rank") <= capacity).drop("rank")


def discarded(df: DataFrame, capacity: int, seq: str = "seq") -> DataFrame:
    """The events that retention pushed out."""
    return ranked(df, seq).filter(F.col("rank") > capacity).drop("rank")


def purge(retained: DataFrame, ts: str, older_than) -> DataFrame:
    """Survivors from the cutoff on; partitions and order stay."""
    return retained.filter(F.col(ts) >= F.lit(older_than))
