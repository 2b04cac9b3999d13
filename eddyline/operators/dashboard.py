"""The queries of the metrics dashboard, the order streams and the sensor service."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from eddyline.operators import aggregate, scan


def metric_sum(df: DataFrame, label: str, label_col: str, value: str, ts: str, start=None, end=None) -> DataFrame:
    return scan.selected(df, F.col(label_col) == label, ts, start, end).agg(aggregate.exact_sum(F.col(value)).alias("sum"))


def metric_window(df: DataFrame, label: str | None, label_col: str, value: str, ts: str, start, end) -> DataFrame:
    where = None if label is None else F.col(label_col) == label
    return aggregate.window_aggregate(scan.selected(df, where, ts, start, end), F.col(value), exact=True)


def above(df: DataFrame, part_of_label: str, label_col: str, value: str, bound: float = 50.0) -> DataFrame:
    """How many events there are, and how many of a label that contains a text exceed a bound."""
    hit = F.col(label_col).contains(part_of_label) & (F.col(value) > bound)
    return df.agg(F.count(F.lit(1)).alias("processed"), F.count_if(hit).alias("above"))


def by_gateway(df: DataFrame, gateway: str, value: str) -> DataFrame:
    """Count and sum of each gateway, and of all under the name ``all``."""
    name = F.when(F.grouping(gateway) == 1, "all").otherwise(F.col(gateway).cast("string")).alias(gateway)
    rolled = df.rollup(gateway).agg(name.alias("__name"), F.count(F.lit(1)).alias("count"), aggregate.exact_sum(F.col(value)).alias("sum"))
    return rolled.select(F.col("__name").alias(gateway), "count", "sum")


def timed(result: DataFrame) -> tuple[list[Row], float]:
    """The rows of a small result, such as by_gateway's, and the milliseconds that they took."""
    began = time.perf_counter()
    rows = result.collect()
    return rows, (time.perf_counter() - began) * 1000


def sent_by(orders: DataFrame, gateway: str, column: str = "gateway_id") -> DataFrame:
    """How many orders one gateway has sent, by its own count."""
    return orders.agg(F.lit(gateway).alias("gateway"), F.count_if(F.col(column) == gateway).alias("sent"))


def sensor_state(df: DataFrame, key: str, value: str) -> DataFrame:
    """Running statistics of each key."""
    return df.groupBy(key).agg(*aggregate.five(F.col(value), exact=True))
