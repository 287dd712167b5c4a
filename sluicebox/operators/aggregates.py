"""The materialised aggregates over cleaned orders.

Each is one aggregation from partial sums, counted exactly; a null group key is left out. Ties are
broken by name or order, so results repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.functions.expressions import month_key
from sluicebox.schemas import AGGREGATE_COLUMNS


def _money(column: str) -> Column:
    return F.round(F.sum(F.col(column).cast("decimal(18,2)")).cast("double"), 2)


def _mean(column: str, places: int = 4) -> Column:
    """Mean of fractions of at most six places; summed in decimals, so the order of rows doesn't matter."""
    return F.round(F.sum(F.col(column).cast("decimal(18,6)")).cast("double") / F.count(column), places)


def _quantity() -> Column:
    return F.sum("quantity").cast("bigint")


def monthly_sales_summary(clean: DataFrame) -> DataFrame:
    rows = clean.where(F.col("sale_date").isNotNull()).withColumn("month", month_key(F.col("sale_date")))
    return rows.groupBy("month").agg(
        _money("revenue").alias("total_revenue"), _quantity().alias("total_quantity"), _mean("discount_percent").alias("avg_discount_percent"), F.count_distinct("order_id").alias("order_count")
    ).orderBy("month")


def top_products_by_category(clean: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` best products of each category by revenue and by units; both rankings read one aggregate."""
    rows = clean.where(F.col("category").isNotNull() & F.col("product_name").isNotNull())
    totals = rows.groupBy("category", "product_name").agg(_money("revenue").alias("total_revenue"), _quantity().alias("total_quantity"), F.count_distinct("order_id").alias("order_count"))

    def best(metric: str, kind: str) -> DataFrame:
        own = Window.partitionBy("category").orderBy(F.col(metric).desc_nulls_last(), "product_name")
        return totals.withColumn("rank", F.row_number().over(own).cast("bigint")).where(F.col("rank") <= limit).withColumn("metric_type", F.lit(kind))

    return best("total_revenue", "revenue").unionByName(best("total_quantity", "units")).select(*AGGREGATE_COLUMNS["top_products_by_category"])


def region_wise_performance(clean: DataFrame) -> DataFrame:
    totals = clean.where(F.col("region").isNotNull()).groupBy("region").agg(
        F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("__sum"), _quantity().alias("total_quantity"), F.count_distinct("order_id").alias("order_count")
    )
    return totals.select(
        "region", F.round("__sum", 2).alias("total_revenue"), "total_quantity", "order_count", F.round(F.try_divide("__sum", "order_count"), 2).alias("avg_order_value")
    ).orderBy(F.col("total_revenue").desc_nulls_last(), "region")


def top_categories(clean: DataFrame) -> DataFrame:
    return clean.where(F.col("category").isNotNull()).groupBy("category").agg(
        _mean("discount_percent").alias("avg_discount_percent"), F.count_distinct("order_id").alias("order_count"), _money("revenue").alias("total_revenue")
    ).orderBy(F.col("avg_discount_percent").desc_nulls_last(), "category")


_ANOMALY_COLUMNS = AGGREGATE_COLUMNS["anomaly_records"]


def anomaly_records(clean: DataFrame, limit: int = 5, balanced: bool = False) -> DataFrame:
    """The ``limit`` rows of highest revenue, then of highest discount, each order once.

    As ranked, the first ``limit`` are kept, so revenue comes first; ``balanced`` keeps both lists.
    Only two short lists leave the executors' top-k, never a sorted table.
    """
    rest = ["order_id", "product_name", "category", "region", "quantity", "unit_price", "sale_date", "customer_email"]

    def highest(metric: str, reason: str, place: int) -> DataFrame:
        other = "discount_percent" if metric == "revenue" else "revenue"
        order = [F.col(metric).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in [*rest, other] if c in clean.columns]]
        top = clean.where(F.col(metric).isNotNull()).orderBy(*order).limit(limit)
        at = Window.orderBy(*order)  # over at most ``limit`` rows
        return top.withColumn("anomaly_reason", F.lit(reason)).withColumn("__list", F.lit(place)).withColumn("__at", F.row_number().over(at))

    both = highest("revenue", "high_revenue", 0).unionByName(highest("discount_percent", "high_discount", 1))
    first = both.withColumn("__n", F.row_number().over(Window.partitionBy("order_id").orderBy("__list", "__at"))).where("__n = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("__list", "__at")).cast("bigint"))
    if not balanced:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select(*_ANOMALY_COLUMNS)


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count()


def builders(top_products_limit: int = 10, anomaly_limit: int = 5) -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {
        "monthly_sales_summary": monthly_sales_summary,
        "top_products_by_category": partial(top_products_by_category, limit=top_products_limit),
        "region_wise_performance": region_wise_performance,
        "top_categories": top_categories,
        "anomaly_records": partial(anomaly_records, limit=anomaly_limit),
    }


def build_all_aggregations(clean: DataFrame, output_dir: str, *, top_products_limit: int = 10, anomaly_limit: int = 5) -> dict[str, str]:
    """Write every aggregate as parquet under ``output_dir``; an empty input gives typed empty tables."""
    paths = {}
    for name, build in builders(top_products_limit, anomaly_limit).items():
        paths[name] = str(PurePosixPath(output_dir) / f"{name}.parquet")
        build(clean).write.mode("overwrite").parquet(paths[name])
    return paths
