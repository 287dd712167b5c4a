"""Cleaning of orders as they arrive: the same rules, with deduplication kept in bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicebox.functions import expressions as X


def typed_stream(raw: DataFrame, arrived: str = "received_at") -> DataFrame:
    """Typed values of a stream of raw orders, rows without id or product left out."""
    rows = raw.select(
        F.col(arrived).cast("timestamp").alias("arrived"),
        X.normalise_string(F.col("order_id")).alias("order_id"),
        X.normalise_string(F.col("product_name")).alias("product_name"),
        F.col("category"),
        F.col("region"),
        X.clean_quantity(F.col("quantity")).alias("quantity"),
        X.clean_price(F.col("unit_price")).alias("unit_price"),
        X.clean_discount(F.col("discount_percent")).alias("discount_percent"),
    )
    return rows.where("order_id <> '' AND product_name <> ''").withColumn("revenue", X.order_revenue(F.col("unit_price"), F.col("quantity"), F.col("discount_percent")))


def first_orders(raw: DataFrame, arrived: str = "received_at", lateness: str = "7 days") -> DataFrame:
    """The first row of each order within the lateness; older keys leave the state."""
    return typed_stream(raw, arrived).withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["order_id"])


def hourly_revenue(raw: DataFrame, arrived: str = "received_at", lateness: str = "7 days", window: str = "1 hour") -> DataFrame:
    """(window_start, order_rows, total_revenue) per tumbling window of arrival; late rows count within the lateness."""
    rows = typed_stream(raw, arrived).withWatermark("arrived", lateness)
    totals = rows.groupBy(F.window("arrived", window).alias("w")).agg(F.count(F.lit(1)).alias("order_rows"), F.round(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double"), 2).alias("total_revenue"))
    return totals.select(F.col("w.start").alias("window_start"), "order_rows", "total_revenue")


def write_stream(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start writing parquet with all data available now, resumable from the checkpoint."""
    return rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
