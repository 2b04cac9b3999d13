"""Event schemas, and 100 ns ticks counted from the year 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ticks at 1970-01-01, and in a microsecond, second and minute.
EPOCH_TICKS = 621_355_968_000_000_000
MICRO, SECOND, MINUTE = 10, 10_000_000, 600_000_000

METRIC = T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("ts", T.TimestampType())])
KEYED = T.StructType([T.StructField("key_id", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("ts_ticks", T.LongType())])
ORDER = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("stream", T.StringType()), T.StructField("gateway_id", T.StringType()),
    T.StructField("valor", T.IntegerType()), T.StructField("ts", T.TimestampType()),
])
SENSOR = T.StructType([
    T.StructField("deviceId", T.StringType()), T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()), T.StructField("timestampUtc", T.TimestampType()),
])


def ticks(df: DataFrame, column: str) -> Column:
    """A timestamp column of df, with or without a time zone, as ticks."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")
    else:
        micros = F.unix_micros(F.col(column).cast("timestamp"))
    return micros * MICRO + EPOCH_TICKS


def timestamp(tick: Column) -> Column:
    """Ticks as a timestamp; what is below a microsecond is cut off."""
    return F.timestamp_micros(F.floor((tick - EPOCH_TICKS) / MICRO).cast("long"))
