"""Aggregates over scans, with the store's rules for empty input: sums and averages are 0, extremes null."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eddyline.operators import prefix
from eddyline.sources.scratch import ship

#: Values with two decimals are summed exactly.
MONEY = "decimal(18,2)"


def exact_sum(value: Column) -> Column:
    return F.coalesce(F.sum(value.cast(MONEY)).cast("double"), F.lit(0.0))


def count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def total(df: DataFrame, value: Column, name: str = "sum") -> DataFrame:
    """The sum in the value's own kind; 0 where there is nothing."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def least(df: DataFrame, value: Column, name: str = "min") -> DataFrame:
    return df.agg(F.min(value).alias(name))


def most(df: DataFrame, value: Column, name: str = "max") -> DataFrame:
    return df.agg(F.max(value).alias(name))


def average(df: DataFrame, value: Column, name: str = "avg") -> DataFrame:
    """The sum in the value's own kind, then divided as doubles; 0.0 where there is nothing."""
    return df.agg(F.coalesce(F.sum(value).cast("double") / F.count(value), F.lit(0.0)).alias(name))


def five(value: Column, exact: bool = False) -> list[Column]:
    """count, sum, min, max and avg as one aggregate, all 0 where there is nothing."""
    summed = exact_sum(value) if exact else F.coalesce(F.sum(value).cast("double"), F.lit(0.0))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return [
        F.count(value).alias("count"),
        summed.alias("sum"),
        zero(F.min(value)).alias("min"),
        zero(F.max(value)).alias("max"),
        zero(F.when(F.count(value) > 0, summed / F.count(value))).alias("avg"),
    ]


def window_aggregate(df: DataFrame, value: Column, exact: bool = False) -> DataFrame:
    return df.agg(*five(value, exact))


def merged(partials: DataFrame, zeros: bool = True) -> DataFrame:
    """Partial aggregates (count, sum, min, max) as one; empty partials have no say in the extremes. Without any partials all is 0, or null if not zeros."""
    full = F.col("count") > 0
    n, s = F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("sum"), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = {
        "count": n, "sum": s, "min": zero(F.min(F.when(full, F.col("min")))),
        "max": zero(F.max(F.when(full, F.col("max")))), "avg": zero(F.when(n > 0, s / n)),
    }
    return partials.agg(*[(c if zeros else F.when(F.count(F.lit(1)) > 0, c)).alias(name) for name, c in out.items()])


def fold(df: DataFrame, columns: list[str], seed: Column, step: Callable[[Column, Column], Column], seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """A left fold in scan order over each group (all events as one group without by).

    The group's columns are gathered in order, so this is for folds that no aggregate expresses, over groups of
    bounded size such as a store's partitions. For larger ones see streamed_fold.
    """
    rows = F.array_sort(F.collect_list(F.struct("part", seq, *columns)))
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(rows.alias("__rows")).select(*(by or []), F.reduce("__rows", seed, step).alias("result"))


def streamed_fold(
    df: DataFrame, by: str, columns: list[str], seed: Callable[[], Any], step: Callable[[Any, pa.RecordBatch], Any], finish: Callable[[Any], dict], schema: str, seq: str = "seq"
) -> DataFrame:
    """A left fold in scan order over each group, of any size: rows are sorted by Spark, which spills, and pass a Python function in
    batches; only the state between them is held. seed() gives a group's first state, finish(state) the columns of schema.
    """
    kind = df.schema[by].dataType
    out = to_arrow_schema(T.StructType([T.StructField(by, kind), *T.StructType.fromDDL(schema).fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        for batch in batches:
            keys = batch.column(0)
            at = 0
            while at < batch.num_rows:
                here = keys[at]
                same = pc.is_null(keys) if not here.is_valid else pc.equal(keys, here)
                differs = pc.index(pc.fill_null(same.slice(at), False), False).as_py()
                to = batch.num_rows if differs < 0 else at + differs
                if not begun or here.as_py() != key:
                    if begun:
                        yield pa.RecordBatch.from_pylist([{by: key, **finish(state)}], out)
                    key, state, begun = here.as_py(), seed(), True
                state = step(state, batch.slice(at, to - at).select(columns))
                at = to
        if begun:
            yield pa.RecordBatch.from_pylist([{by: key, **finish(state)}], out)

    ship(df.sparkSession)
    order = list(dict.fromkeys([by, "part", seq]))
    rows = df.select(*dict.fromkeys([*order, *columns])).repartition(by).sortWithinPartitions(*order)
    return rows.mapInArrow(run, f"`{by}` {kind.simpleString()}, {schema}")


def until(df: DataFrame, stop: Column, seq: str = "seq") -> DataFrame:
    """Events in scan order up to the first that meets stop, itself included.

    The first stopping place is one aggregate, used as a scalar; the rest is a filter, so nothing is sorted
    in one task.
    """
    place = F.struct("part", seq)
    first = df.filter(stop).agg(F.min(place)).scalar()
    return df.filter(first.isNull() | (place <= first))


def chunked(df: DataFrame, each: Callable[[pa.Table], dict], schema: str, merge: list[Column], size: int = 4096) -> DataFrame:
    """A fold over chunks: each chunk gives a partial row of the schema on the executors, merge combines them."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_pylist([each(pa.Table.from_batches([batch.slice(at, size)]))], kind)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema).agg(*merge)


def groups(df: DataFrame, key: str, columns: list[str], seq: str = "seq") -> DataFrame:
    """The events of every key as a list in scan order. Where only reduced values are wanted, group and aggregate instead."""
    listed = F.array_sort(F.collect_list(F.struct("part", seq, *columns)))
    return df.groupBy(key).agg(F.transform(listed, lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias("events"))


def top_k(df: DataFrame, key: str, value: Column, k: int) -> DataFrame:
    """The k keys of the largest sums; equal sums in key order."""
    return df.groupBy(key).agg(exact_sum(value).alias("total")).orderBy(F.desc("total"), key).limit(k)


def running(df: DataFrame, value: str, seq: str = "seq") -> DataFrame:
    """Each partition's running count, sum, min and max by arrival."""
    v = F.col(value)
    adds = {"run_n": ("count", v), "run_sum": ("sum", v.cast(MONEY)), "run_min": ("min", v), "run_max": ("max", v)}
    return prefix.running(df, adds, seq).withColumn("run_sum", F.col("run_sum").cast("double"))
