"""Routing, key dictionaries and generators: how events get their partition and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddyline.sources import scratch


def by_key(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """part from a numeric key; never negative, and none for events without a key."""
    return df.withColumn("part", F.pmod(F.col(key), F.lit(partitions)).cast("int"))


def by_hash(df: DataFrame, columns: list[str], partitions: int) -> DataFrame:
    """part from a hash of the columns; the same in every run."""
    return df.withColumn("part", F.pmod(F.xxhash64(*columns), F.lit(partitions)).cast("int"))


def to_partition(df: DataFrame, part: int, partitions: int) -> DataFrame:
    if not 0 <= part < partitions:
        raise ValueError(f"part must be from 0 to {partitions - 1}")
    return df.withColumn("part", F.lit(part))


def numbered(df: DataFrame, order: list[str], name: str = "seq", start: int = 0) -> DataFrame:
    """Adds consecutive numbers in the given order, without sorting in one task.

    Ranges of the order go to partitions, whose sizes (one number each) give the offsets. The
    ranges are written to the shared folder, so that they can't shift between the two passes.
    """
    ranged = scratch.written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    # one row for each range, as many as tasks
    before = F.sum("n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy(F.col("__p").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(F.col("q").alias("__q"), (F.coalesce(before, F.lit(0)) + start).alias("__at"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    placed = ranged.withColumn("__i", within).join(F.broadcast(offsets), F.col("__p") == F.col("__q"))
    return placed.withColumn(name, (F.col("__at") + F.col("__i")).cast("long")).drop("__p", "__q", "__at", "__i")


def dictionary(df: DataFrame, key: str, seq: str, known: DataFrame | None = None) -> DataFrame:
    """(key, key_id): ids from 1 in order of first arrival, continuing the known ones."""
    fresh = fresh_keys(df, key, seq, known)
    return fresh if known is None else known.select("key", "key_id").unionByName(fresh)


def fresh_keys(df: DataFrame, key: str, seq: str, known: DataFrame | None = None) -> DataFrame:
    """(key, key_id) of the keys that are not known yet.

    First arrivals are found by an aggregate; only distinct keys are numbered, and not in one task.
    """
    firsts = df.groupBy(F.col(key).alias("key")).agg(F.min(seq).alias("first")).filter("key IS NOT NULL")
    base = 0
    if known is not None:
        firsts = firsts.join(known.select("key"), "key", "left_anti")
        base = known.agg(F.coalesce(F.max("key_id"), F.lit(0))).first()[0]
    return numbered(firsts, ["first", "key"], "key_id", base + 1).select("key", F.col("key_id").cast("int"))


def encoded(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Adds key_id from a dictionary. Events without a key, or with one that it lacks, stay and have none."""
    return df.join(keys.select(F.col("key").alias("__key"), "key_id"), F.col(key) == F.col("__key"), "left").drop("__key")


def sensor_events(readings: DataFrame) -> DataFrame:
    """Valid sensor readings as two keyed events each: 1 temperature, 2 humidity."""
    valid = (F.trim(F.coalesce("deviceId", F.lit(""))) != "") & ~F.isnan("temperature") & ~F.isnan("humidity")
    one = lambda k, c: F.struct(F.lit(k).alias("key_id"), F.col(c).cast("double").alias("value"))
    return (
        readings.filter(valid)
        .withColumn("ts", F.coalesce("timestampUtc", F.current_timestamp()))
        .withColumn("e", F.explode(F.array(one(1, "temperature"), one(2, "humidity"))))
        .select("deviceId", "ts", "e.*")
    )


def stream_orders(orders: DataFrame, stream: str | Column) -> DataFrame:
    """Names the stream that orders came by and fills a missing time with the present one."""
    return orders.withColumn("stream", F.lit(stream) if isinstance(stream, str) else stream).withColumn("ts", F.coalesce("ts", F.current_timestamp()))


def generated_orders(spark: SparkSession, n: int, gateway: str, seed: int = 0) -> DataFrame:
    """n orders of a gateway with values from 1 to 4999, made on the executors."""
    return spark.range(n).select(
        F.md5(F.concat_ws(":", F.lit(gateway), F.lit(seed), "id")).alias("id"),
        F.lit(gateway).alias("gateway_id"),
        (F.floor(F.rand(seed) * 4999) + 1).cast("int").alias("valor"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"),
    )


#: Labels of generated metrics, and the range of each one's values.
SPREAD = {"cpu_usage": (0, 100), "memory_usage": (1024, 8192), "disk_io": (0, 500), "network_io": (0, 1000)}


def generated_metrics(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n metric events over four labels, each with its own range of values."""
    labels = F.array(*map(F.lit, SPREAD))
    low, high = (F.array(*[F.lit(float(v[i])) for v in SPREAD.values()]) for i in (0, 1))
    k = F.pmod(F.col("id"), F.lit(4)).cast("int")
    return spark.range(n).select(
        F.get(labels, k).alias("label"),
        F.round(F.get(low, k) + F.rand(seed) * (F.get(high, k) - F.get(low, k)), 2).alias("value"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"),
    )
