"""Access to parquet tables, and broadcasts that are checked for size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a lookup side is broadcast; beyond either the join is left to the optimizer.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes_of(field: T.StructField) -> Column:
    """Bytes of a value: texts by their length, nested values by that of their text, others 16."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) + 16
    return F.lit(16)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of at most ``size`` bytes together."""
    weighed = df.limit(rows + 1).select(sum((_bytes_of(f) for f in df.schema.fields), F.lit(0)).cast("bigint").alias("b"))
    counted, held = weighed.agg(F.count("b"), F.coalesce(F.sum("b"), F.lit(0))).collect()[0]
    return counted <= rows and held <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is small; else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows, size) else df
