"""The cleaning funnel: nine rules in order, each dropped row with the first reason that holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions import expressions as X
from sluicebox.operators.dedup import mark_duplicates
from sluicebox.operators.lookups import attach_matches, attach_region, fuzzy_matches, nearest_of, region_labels, region_of, short_list
from sluicebox.schemas import RAW_COLUMNS, REQUIRED_COLUMNS
from sluicebox.session import cut_lineage


@dataclass(frozen=True)
class CleanConfig:
    """``as_of`` (a date as text) stands in for today, so that results can be repeated."""

    as_of: str
    chunk_size: int = 100_000
    drop_zero_quantity: bool = True
    save_rejected_rows: bool = True


def _worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are worked out once per row, whatever uses them.

    The rules name a value several times and filters are pushed down; as plain projections, costly
    expressions would be inlined at every use. A generator of one row is where that stops.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__made")
    return rows.select("*", made).select(*[F.col(n) for n in rows.columns], *[F.col(f"__made.{n}").alias(n) for n in columns])


def judge_orders(raw: DataFrame, categories: DataFrame, regions: DataFrame, config: CleanConfig, order: str = "row_index") -> DataFrame:
    """Raw orders with ``rejection_reason`` (null: clean) and the cleaned values, raw ones as raw_*.

    ``raw`` has text columns and a bigint ``order``; ``categories`` (canonical), ``regions`` (raw_label, canonical).
    """
    if missing := [c for c in REQUIRED_COLUMNS if c not in raw.columns]:
        raise ValueError(f"raw orders lack the columns {missing}")
    rows = raw.select(F.col(order), *[(F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(f"raw_{c}") for c in RAW_COLUMNS])
    as_of = F.lit(config.as_of).cast("date")
    rules = [
        (F.col("category").isNull(), "unknown_category"),
        (F.col("region").isNull(), "unknown_region"),
        (~((F.col("unit_price") > 0) & (F.col("unit_price") < 50_000)), "invalid_unit_price"),
        (F.lit(config.drop_zero_quantity) & (F.col("quantity") <= 0), "zero_quantity"),
        (F.col("__date").isNull(), "invalid_sale_date"),
        (~X.in_date_range(F.col("__date"), as_of), "sale_date_out_of_range"),
        (~F.coalesce((F.col("revenue") >= 0) & (F.col("revenue") < 1_000_000), F.lit(False)), "invalid_calculated_revenue"),
    ]
    texts = ("order_id", "product_name", "category", "quantity", "unit_price", "discount_percent", "region", "sale_date")
    rows = _worked_out(rows, **{f"__{c}": X.normalise_string(F.col(f"raw_{c}")) for c in texts})
    rows = _resolved(rows, categories, regions)
    rows = _worked_out(
        rows,
        quantity=X.quantity_of(F.col("__quantity")),
        unit_price=X.price_of(F.col("__unit_price")),
        discount_percent=X.discount_of(F.col("__discount_percent")),
        __day=X.date_of(F.col("__sale_date")),
    )
    rows = rows.withColumn("__date", X.plausible_date(F.col("__day"))).withColumnsRenamed({"__order_id": "order_id", "__product_name": "product_name"})
    rows = _worked_out(rows, revenue=X.order_revenue(F.col("unit_price"), F.col("quantity"), F.col("discount_percent")))
    no_key = (F.col("order_id") == "") | (F.col("product_name") == "")
    rows = rows.withColumn("__broken", F.coalesce(F.when(no_key, F.lit("missing_order_id_or_product")), *[F.when(rule, F.lit(reason)) for rule, reason in rules]))
    # rows without a key take no part in deduplication: each has a key of its own
    rows = rows.withColumn("__key", F.when(no_key, F.concat(F.lit("\u0000"), F.col(order).cast("string"))).otherwise(F.col("order_id")))
    kept = [order, *[f"raw_{c}" for c in RAW_COLUMNS], *VALUES, "__date", "__broken", "__key"]
    # every value is worked out in this one pass; what follows reads the judged rows back
    rows = cut_lineage(rows.select(*kept)).withColumn("__passes", F.col("__broken").isNull())
    judged = mark_duplicates(rows, "__key", order, "__passes", config.chunk_size, "__duplicate")
    late = F.col("__duplicate") & ~F.col("__broken").eqNullSafe("missing_order_id_or_product")
    reason = F.when(late, F.lit("duplicate_order_id")).otherwise(F.col("__broken"))
    return judged.select(
        "*",
        X.epoch_seconds(F.col("__date")).alias("sale_date"),
        X.clean_email(F.col("raw_customer_email")).alias("customer_email"),
        X.heavy_discount_flag(F.col("discount_percent")).alias("anomaly_flag"),
        reason.alias("rejection_reason"),
    ).drop("__date", "__key", "__duplicate", "__broken", "__passes")


VALUES = ("order_id", "product_name", "category", "region", "quantity", "unit_price", "discount_percent", "revenue")


def _resolved(rows: DataFrame, categories: DataFrame, regions: DataFrame) -> DataFrame:
    """``rows`` with category and region: by expressions for short lists, by joins for long ones."""
    names, entries = short_list(categories.where("canonical IS NOT NULL"), ["canonical"]), short_list(regions, ["raw_label", "canonical"])
    inline = {}
    if names is not None:
        inline["__lower"] = F.lower("__category")
    rows = _worked_out(rows, **inline) if inline else rows
    inline = {}
    if names is not None:
        inline["category"] = nearest_of(F.col("__lower"), [n for (n,) in names])
    else:
        rows = attach_matches(rows, "raw_category", fuzzy_matches(rows, "raw_category", categories), "category")
    if entries is not None:
        inline["region"] = region_of(F.col("__region"), entries)
    else:
        rows = attach_region(rows, "raw_region", region_labels(regions), "region")
    return _worked_out(rows, **inline) if inline else rows


def clean_rows(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("rejection_reason").isNull()).select(*RAW_COLUMNS, "anomaly_flag")


def rejected_rows(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("rejection_reason").isNotNull()).select(*[F.col(f"raw_{c}").alias(c) for c in RAW_COLUMNS], "rejection_reason")


def funnel_metrics(judged: DataFrame) -> DataFrame:
    """(rows_in, clean_rows, rejected_rows, retention_percent)."""
    counted = judged.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("rejection_reason").isNull()).alias("clean_rows"))
    return counted.select("rows_in", "clean_rows", (F.col("rows_in") - F.col("clean_rows")).alias("rejected_rows"), F.round(F.try_divide(F.col("clean_rows") * 100.0, F.col("rows_in")), 2).alias("retention_percent"))
