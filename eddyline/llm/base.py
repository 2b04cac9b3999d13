"""What the corpus operators share: reading tables, shared scratch tables, word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.sources import scratch

#: White space and words as the contracts define them: ASCII blanks only.
BLANK = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch to a Python worker.
ARROW_BATCH = str(8 << 20)
#: Rows that a table may have to be sent to every executor.
BROADCAST_ROWS = 1_000_000
#: And their bytes together.
BROADCAST_BYTES = 64 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, and bounds the batches that they get by
    bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    scratch.ship(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that all executors share, as the session names it."""
    return scratch.folder(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, lineage cut, safe to reread."""
    return scratch.written(df, name)


def _width(field: T.StructField) -> Column:
    """Bytes of a column's value in a row, about."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def sized(table: DataFrame, rows: int | None = None) -> DataFrame:
    """table, marked for every executor if it has at most so many rows and BROADCAST_BYTES bytes, by count; else as it
    is, for a shuffle. table: one that is cheap to read, such as a written one."""
    most = BROADCAST_ROWS if rows is None else rows
    width = sum((_width(f) for f in table.schema.fields), F.lit(0))
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(table) if n <= most and size <= BROADCAST_BYTES else table


def smallest(df: DataFrame, by: Column, k: int, *then: str) -> DataFrame:
    """The k rows of the smallest numbers in by, a hash of 64 bits; equal ones in order of the columns then.

    Rows are counted by the first bits of the hash, so that little more than k of them reach the task that sorts.
    """
    bits = 12
    cell = F.shiftright(by, 64 - bits)
    held = dict(df.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 2 ** bits rows
    last, total = None, 0
    for c in sorted(held):
        last, total = c, total + held[c]
        if total >= k:
            break
    few = df if last is None else df.filter(cell <= last)
    return few.orderBy(by, *then).limit(k)


def most_frequent(counted: DataFrame, n: str, k: int, *then: str) -> DataFrame:
    """The k rows of the largest numbers in n, which are counts; equal ones in order of the columns then. counted: a written table.

    Rows are counted by the size of n first, so that little more than k of them reach the task that sorts.
    """
    cell = F.floor(F.log2(F.col(n).cast("double")) * 8).cast("int")
    held = dict(counted.filter(F.col(n) > 0).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("m")).collect())  # at most 512 rows
    last, total = None, 0
    for c in sorted(held, reverse=True):
        last, total = c, total + held[c]
        if total >= k:
            break
    few = counted if last is None else counted.filter((F.col(n) > 0) & (cell >= last))
    return few.orderBy(F.desc(n), *then).limit(k)


def spare(df: DataFrame, name: str) -> str:
    """name, or the like of it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; the fast built-in does just that to texts without other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def word_array(text: Column) -> Column:
    """The blank-separated words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """size(word_array(text)) without a lambda: the pieces between blanks, less an empty one at either end."""
    text = F.coalesce(text, F.lit(""))
    blank = lambda c: c.isin(*"\t\n\x0b\x0c\r ").cast("int")
    pieces = F.size(F.split(text, BLANK)) - blank(F.substring(text, 1, 1)) - blank(F.substring(text, -1, 1))
    return F.when(text == "", 0).otherwise(pieces).cast("long")


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns whose names an operator is about to add (its own values win)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
