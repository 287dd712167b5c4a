"""Exploration queries over aggregates and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions.expressions import count_label, fill_label


def dataset_summary(df: DataFrame) -> DataFrame:
    """(rows, columns, column, type): one row per column."""
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("type")) for n, t in df.dtypes])).alias("c")
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), kinds).select("rows", "columns", "c.column", "c.type")


def extent(df: DataFrame, key: str = "order_id", date: str = "sale_date") -> DataFrame:
    """(rows, orders, first_date, last_date) of cleaned rows, dates as text; null where there are none."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("orders"), F.min(date).alias("a"), F.max(date).alias("b"))
    return counted.select("rows", "orders", *[F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd").alias(n) for c, n in (("a", "first_date"), ("b", "last_date"))])


def reason_view(df: DataFrame, column: str, reasons: list[str] | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a page on rows with reasons shows: (summary, counts of the commonest reasons, all reasons, a preview of the chosen rows)."""
    chosen = filter_by_reasons(df, column, reasons or [])
    return dataset_summary(df), reason_counts(df, column), options(df.select(fill_label(F.col(column)).alias(column)), column), preview(chosen, df.columns, limit)


def top_by(df: DataFrame, label: str, metric: str, limit: int = 15) -> DataFrame:
    """The ``limit`` rows of highest metric, ties by label."""
    return df.select(label, metric).orderBy(F.col(metric).desc_nulls_last(), F.col(label).asc_nulls_first()).limit(limit)


def sum_by(df: DataFrame, label: str, metric: str, limit: int = 15, metric_type: str | None = None) -> DataFrame:
    """The ``limit`` labels (null is one) of highest sum; ``metric_type`` keeps one block of a two-block table."""
    rows = df if metric_type is None else df.where(F.col("metric_type") == metric_type)
    total: Column = F.sum(F.col(metric).cast("decimal(20,2)")).cast("double") if isinstance(df.schema[metric].dataType, T.DoubleType) else F.sum(metric)
    return top_by(rows.groupBy(label).agg(total.alias("total")), label, "total", limit)


def auto_chart(df: DataFrame, limit: int = 15) -> DataFrame:
    """Sum of the first numeric column by the first other column; a histogram if all are numeric."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    labels = [f.name for f in df.schema.fields if f.name not in numeric]
    if not numeric:
        raise ValueError("no numeric column")
    return sum_by(df, labels[0], numeric[0], limit) if labels else histogram(df, numeric[0])


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, count) of equal widths between the least and the greatest value; the greatest falls in the last bin."""
    bounds = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")).crossJoin(F.broadcast(bounds))  # one row
    place = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    counted = rows.groupBy(place.cast("bigint").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    return counted.select("bin", F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins, 6).alias("low"), "count")


def reason_counts(df: DataFrame, column: str, limit: int | None = 5) -> DataFrame:
    """(reason, count, label), most frequent first; null counts as UNKNOWN."""
    counted = df.groupBy(fill_label(F.col(column)).alias("reason")).count().orderBy(F.col("count").desc(), "reason")
    counted = counted if limit is None else counted.limit(limit)
    return counted.select("reason", "count", count_label(F.col("reason"), F.col("count")).alias("label"))


def filter_by_reasons(df: DataFrame, column: str, reasons: list[str]) -> DataFrame:
    """Rows with one of the reasons; reasons that don't occur are ignored, and with none left all rows stay."""
    label = fill_label(F.col(column))
    chosen = df.where(label.isin(reasons)) if reasons else df
    return df if not reasons or chosen.isEmpty() else chosen


def options(df: DataFrame, column: str) -> DataFrame:
    """The different values but null, in order."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias(column)).distinct().orderBy(column)


def best_sellers(products: DataFrame, metric_type: str, category: str | None = None, limit: int = 3) -> DataFrame:
    """The ``limit`` best-ranked products of one category, or of each."""
    if limit < 1:
        raise ValueError("limit is 1 or more")
    rows = products.where(F.col("metric_type") == metric_type)
    if category is not None:
        rows = rows.where(F.col("category") == category)
    metric = "total_revenue" if metric_type == "revenue" else "total_quantity"
    own = Window.partitionBy("category").orderBy(F.col(metric).desc_nulls_last(), "product_name", "rank", "order_count")
    return rows.withColumn("place", F.row_number().over(own).cast("bigint")).where(F.col("place") <= limit).select("category", "place", "product_name", metric)


def preview(df: DataFrame, order: list[str], limit: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(limit)
