"""Readers of event tables and of JSON event files, in batches and as streams.

A JSON line is an object whose fields are known by their names in any case, with the names that services send
besides those of our columns: an order's Id, Valor, Timestamp, GatewayId; a metric's Label, Value, Timestamp. Other fields are
left out; of fields that differ in case only the first counts. Numbers and times may be texts; what does not fit is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline import schema

#: Columns that JSON also has under other names, in lower case.
NAMES = {"ts": ("ts", "timestamp"), "gateway_id": ("gateway_id", "gatewayid"), "stream": ("stream", "streamname")}


def events(spark: SparkSession, sf_dir: str, partitions: int = 8) -> DataFrame:
    """The events table as a log: part from user_id, seq from event_id."""
    read = spark.read.parquet(f"{sf_dir}/events.parquet")
    return read.withColumns({"part": F.pmod("user_id", F.lit(partitions)).cast("int"), "seq": F.col("event_id")})


def metrics(spark: SparkSession, path: str, stream: bool = False, corrupt: str | None = None) -> DataFrame:
    """Metric events from JSON lines: label, value, ts. Lines without a label or value are left out, or kept whole
    in the column corrupt if that is named."""
    return _json(spark, path, schema.METRIC, stream, corrupt, F.col("label").isNull() | F.col("value").isNull(), drop=True)


def orders(spark: SparkSession, path: str, stream: bool = False, corrupt: str | None = None, origin: str | None = None) -> DataFrame:
    """Orders from JSON lines: id, stream, gateway_id, valor, ts. What is no JSON object is a row of nulls, with the line in
    the column corrupt if that is named. origin: a column for the file that a line is from, such as one that names its stream."""
    return _json(spark, path, schema.ORDER, stream, corrupt, F.col("__fields").isNull(), origin=origin)


def sensors(spark: SparkSession, path: str, stream: bool = False, corrupt: str | None = None) -> DataFrame:
    """Sensor readings from JSON lines; lines that are none as orders() has them."""
    return _json(spark, path, schema.SENSOR, stream, corrupt, F.col("__fields").isNull())


def _columns(fields: Column, kind: T.StructType) -> list[Column]:
    """The columns of kind from an array of a line's fields (key, value)."""
    out = []
    for f in kind.fields:
        names = NAMES.get(f.name, (f.name.lower(),))
        named = F.filter(fields, _has(names))
        out.append(F.get(named, F.lit(0))["value"].try_cast(f.dataType).alias(f.name))
    return out


def _has(names: tuple[str, ...]):
    return lambda e: F.lower(e["key"]).isin(*names)


def _json(spark: SparkSession, path: str, kind: T.StructType, stream: bool, corrupt: str | None, bad: Column, drop: bool = False, origin: str | None = None) -> DataFrame:
    lines = (spark.readStream if stream else spark.read).text(path).select(F.col("value").alias("__line"), F.input_file_name().alias("__file"))
    rows = lines.filter(F.trim("__line") != "").withColumn("__fields", F.map_entries(F.from_json("__line", "map<string, string>")))
    rows = rows.select("__line", "__file", "__fields", *_columns(F.col("__fields"), kind))
    named = [*kind.names, *([F.col("__file").alias(origin)] if origin else [])]
    if corrupt:
        return rows.select(*named, F.when(bad, F.col("__line")).alias(corrupt))
    return (rows.filter(~bad) if drop else rows).select(*named)
