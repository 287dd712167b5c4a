"""Fixed schemas of raw orders, cleaned orders, rejects and aggregates."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_COLUMNS = ("order_id", "product_name", "category", "quantity", "unit_price", "discount_percent", "region", "sale_date", "customer_email", "revenue")
#: Raw columns without which cleaning can't start; revenue is recomputed anyway.
REQUIRED_COLUMNS = RAW_COLUMNS[:-1]

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

_KINDS = {"quantity": T.LongType(), "unit_price": T.DoubleType(), "discount_percent": T.DoubleType(), "sale_date": T.LongType(), "revenue": T.DoubleType()}
CLEAN_SCHEMA = T.StructType([*[T.StructField(name, _KINDS.get(name, T.StringType())) for name in RAW_COLUMNS], T.StructField("anomaly_flag", T.StringType())])

REJECTION_REASONS = (
    "missing_order_id_or_product",
    "duplicate_order_id",
    "unknown_category",
    "unknown_region",
    "invalid_unit_price",
    "zero_quantity",
    "invalid_sale_date",
    "sale_date_out_of_range",
    "invalid_calculated_revenue",
)

AGGREGATE_COLUMNS = {
    "monthly_sales_summary": ("month", "total_revenue", "total_quantity", "avg_discount_percent", "order_count"),
    "top_products_by_category": ("category", "rank", "product_name", "total_revenue", "total_quantity", "order_count", "metric_type"),
    "region_wise_performance": ("region", "total_revenue", "total_quantity", "order_count", "avg_order_value"),
    "top_categories": ("category", "avg_discount_percent", "order_count", "total_revenue"),
    "anomaly_records": (
        "rank", "order_id", "product_name", "category", "region", "revenue", "quantity", "unit_price", "discount_percent", "sale_date", "anomaly_reason",
    ),
}
