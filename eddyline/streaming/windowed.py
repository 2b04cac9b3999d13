"""Windowed aggregates over event streams, with a watermark as the rule for late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from eddyline.operators.aggregate import MONEY


def windowed(stream: DataFrame, width: str, delay: str, ts: str, value: str, by: list[str]) -> DataFrame:
    """count, sum, min and max by tumbling window; events more than delay behind the newest are dropped.

    ts must be a timestamp with time zone; the watermark is one for the whole stream and moves
    between micro-batches. For a clock per partition see eddyline.streaming.ring.
    """
    grouped = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *by)
    return grouped.agg(
        F.count(value).alias("count"), F.sum(F.col(value).cast(MONEY)).cast("double").alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")
    ).select(F.col("w.start").alias("bucket"), *by, "count", "sum", "min", "max")


def drained(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming result over all that its source holds now, into Parquet; returns what was written.

    Only modes whose rows are final can go to files: append.
    """
    result.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)


class Progress(StreamingQueryListener):
    """Calls back after every so many rows that queries have taken in."""

    def __init__(self, each: int, call: Callable[[dict], None]):
        self.each, self.call, self.rows = each, call, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        before, self.rows = self.rows, self.rows + event.progress.numInputRows
        if self.rows // self.each > before // self.each:
            self.call({"append_count": self.rows, "rows_per_second": event.progress.processedRowsPerSecond})
