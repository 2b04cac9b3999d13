"""Running aggregates by arrival that no single task has to make for a whole partition.

A partition's events are cut into chunks of consecutive arrival numbers. Chunks are aggregated first, within
tasks before the shuffle; what each chunk inherits is a running aggregate over chunks (one row for about
CHUNK events); within a chunk the rows are run through in order. All rows are dealt by (part, chunk), so a
store of few partitions still uses every core, and a sort holds a chunk at most.

Events without a partition are a partition of their own. Events without an arrival number came before all
others, in no order among themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive arrival numbers of a chunk.
CHUNK = 1 << 20


def chunk_of(seq: str, size: int) -> Column:
    """The first arrival number of an event's chunk."""
    return F.col(seq) - F.pmod(F.col(seq), F.lit(size))


def _added(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


#: How a chunk's rows are aggregated, how chunks are, and how the two come together. greatest and least skip nulls.
KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "max": (F.max, F.max, F.greatest),
    "min": (F.min, F.min, F.least),
    "sum": (F.sum, F.sum, _added),
    "count": (F.count, F.sum, _added),
}


def running(df: DataFrame, adds: dict[str, tuple[str, Column]], seq: str = "seq", own: bool = True, chunk: int | None = None) -> DataFrame:
    """Adds columns name: (kind, value) that aggregate each partition's events up to this one, itself
    included if own is true. Null where nothing came before; counts are 0 there."""
    size = chunk or CHUNK
    df = df.withColumn("__chunk", chunk_of(seq, size))
    inputs = {f"__in{i}": value for i, (_, value) in enumerate(adds.values())}
    df = df.withColumns(inputs)
    kinds = [KINDS[kind] for kind, _ in adds.values()]
    sums = df.groupBy(F.col("part").alias("__p"), F.col("__chunk").alias("__c")).agg(*[k[0](f"__in{i}").alias(f"__s{i}") for i, k in enumerate(kinds)])
    before = Window.partitionBy("__p").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("__p", "__c", *[k[1](f"__s{i}").over(before).alias(f"__b{i}") for i, k in enumerate(kinds)])
    joined = df.join(carried, F.col("part").eqNullSafe(F.col("__p")) & F.col("__chunk").eqNullSafe(F.col("__c")))
    within = Window.partitionBy("part", "__chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = {}
    for i, (name, (kind, _)) in enumerate(adds.items()):
        first, _, both = KINDS[kind]
        x = both(F.col(f"__b{i}"), first(f"__in{i}").over(within))
        out[name] = F.coalesce(x, F.lit(0)) if kind == "count" else x
    return joined.withColumns(out).drop("__chunk", "__p", "__c", *inputs, *[f"__b{i}" for i in range(len(kinds))])
