"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay in tables; each step is written to the shared folder, so lineage stays short and lost
executors only cost their tasks. A node with very many neighbours is summed within tasks before
its minimum is shuffled, and joined back by a join whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm import base
from eddyline.sources import scratch


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u < v. Links each node's larger (or smaller) neighbours, and itself, to its smallest neighbour."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = base.written(around.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("m")), "star-least")
        moved = edges.join(least, F.col("u") == F.col("node")).select(F.col("m").alias("u"), "v")
    else:
        least = base.written(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("m")), "star-least")
        moved = edges.join(least, F.col("v") == F.col("node")).select(F.col("m").alias("u"), F.col("u").alias("v")).filter("u < v")
        moved = moved.union(least.select(F.col("m").alias("u"), F.col("node").alias("v")))
    return base.written(moved.distinct(), "star")


def _two_steps(edges: DataFrame) -> DataFrame:
    with scratch.Scope(edges.sparkSession) as scope:
        out = _star(_star(edges, large=False), large=True)
        scope.keep(out)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of node ids, in any order. Returns node, component (its smallest node)
    for every node that has an edge to another, save the component's smallest node itself."""
    a, b = (F.col(c) for c in edges.columns)
    edges = base.written(edges.filter(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "star")
    mark = _mark(edges)
    while mark[0]:
        edges = _two_steps(edges)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
