"""One query per operator of the order engine, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicebox.functions import expressions as X
from sluicebox.operators import aggregates, cleaning, dedup, explore, lookups, names
from sluicebox.operators.generator import OrderGenerator
from sluicebox.plans.core_sql import AS_OF
from sluicebox.sources.tables import table

CHUNK = 500


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clean_sales")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_sales")


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "common_categories").select(F.col("category").alias("canonical"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region_map").select("raw_label", "canonical")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).withColumn("row_index", F.col("row_id") - 1)
    return cleaning.judge_orders(raw, _categories(spark, sf_dir), _regions(spark, sf_dir), cleaning.CleanConfig(as_of=AS_OF))


def monthly_sales_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.monthly_sales_summary(_clean(spark, sf_dir))


def top_products_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_products_by_category(_clean(spark, sf_dir))


def region_wise_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.region_wise_performance(_clean(spark, sf_dir))


def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_categories(_clean(spark, sf_dir))


def anomaly_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.anomaly_records(_clean(spark, sf_dir))


def anomaly_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.anomaly_records(_clean(spark, sf_dir), balanced=True)


def normalise_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("row_id", X.normalise_string(F.col("category")).alias("category"), X.normalise_string(F.col("order_id")).alias("order_id"))


def email_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("row_id", X.clean_email(F.col("customer_email")).alias("customer_email"))


def quantity_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("row_id", X.clean_quantity(F.col("quantity")).alias("quantity"))


def price_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("row_id", X.clean_price(F.col("unit_price")).alias("unit_price"))


def discount_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    discount = X.clean_discount(F.col("discount_percent"))
    return _raw(spark, sf_dir).select("row_id", discount.alias("discount_percent"), X.heavy_discount_flag(discount).alias("anomaly_flag"))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = X.parse_order_date(F.col("sale_date"))
    in_range = X.in_date_range(date, F.lit(AS_OF).cast("date"), 2, 0)
    return _raw(spark, sf_dir).select("row_id", date.cast("string").alias("sale_date"), X.epoch_seconds(date).cast("string").alias("epoch"), in_range.cast("string").alias("in_range"))


def month_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).groupBy(X.month_key(F.col("sale_date")).alias("month")).agg(F.min("sale_date").alias("first_sale"), F.max("sale_date").alias("last_sale"), F.count(F.lit(1)).alias("row_count"))


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = X.order_revenue(X.clean_price(F.col("unit_price")), X.clean_quantity(F.col("quantity")), X.clean_discount(F.col("discount_percent")))
    return _raw(spark, sf_dir).select("row_id", F.coalesce(amount, F.lit(-1.0)).alias("revenue"), F.coalesce((amount >= 0) & (amount < 1_000_000), F.lit(False)).alias("valid"))


def category_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.resolve_exact(_raw(spark, sf_dir).select("row_id", "category"), "category", _categories(spark, sf_dir), "canonical").select("row_id", "canonical")


def category_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.resolve_fuzzy(_raw(spark, sf_dir).select("row_id", "category"), "category", _categories(spark, sf_dir), "canonical").select("row_id", "canonical")


def region_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.resolve_region(_raw(spark, sf_dir).select("row_id", "region"), "region", _regions(spark, sf_dir), "canonical").select("row_id", "canonical")


def region_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = lookups.resolve_region(_raw(spark, sf_dir).select("row_id", "region"), "region", _regions(spark, sf_dir), "canonical")
    return resolved.where("canonical IS NULL").groupBy(X.fill_label(F.col("region")).alias("region")).agg(F.count(F.lit(1)).alias("row_count"))


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select("row_id", "order_id", (F.col("row_id") - 1).alias("row_index"))
    return dedup.mark_chunk_repeats(raw, "order_id", "row_index", CHUNK).select("row_id", "repeat")


def dedup_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select("row_id", "order_id", (F.col("row_id") - 1).alias("row_index"), (X.clean_quantity(F.col("quantity")) > 0).alias("passes"))
    return dedup.mark_duplicates(raw, "order_id", "row_index", "passes", CHUNK).select("row_id", "duplicate")


def dedup_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select("row_id", "order_id", (X.clean_quantity(F.col("quantity")) > 0).alias("passes"))
    return dedup.first_passing(raw, "order_id", "row_id", "passes").select("row_id", "order_id")


def id_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("order_id").where("order_id IS NOT NULL").intersect(_clean(spark, sf_dir).select("order_id"))


def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_rows(_judged(spark, sf_dir))


def reject_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    return judged.where("rejection_reason IS NOT NULL").select((F.col("row_index") + 1).alias("row_id"), "rejection_reason")


def clean_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.funnel_metrics(_judged(spark, sf_dir))


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.reason_counts(cleaning.rejected_rows(_judged(spark, sf_dir)), "rejection_reason", None)


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.value_counts(_raw(spark, sf_dir), "category").withColumnRenamed("count", "row_count")


def lookup_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.frequent_labels(lookups.value_counts(_raw(spark, sf_dir), "category"), 0.01)


def region_map_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "common_regions").select(F.col("region").alias("canonical"))
    return lookups.build_region_map(_raw(spark, sf_dir), "region", _regions(spark, sf_dir), regions)


def product_category_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.product_categories(_clean(spark, sf_dir))


def product_name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("row_id", names.normalise_product_name(F.col("product_name")).alias("product_name"))


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.dataset_summary(_clean(spark, sf_dir))


def category_metric_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top_by(aggregates.top_categories(_clean(spark, sf_dir)), "category", "avg_discount_percent")


def category_metric_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.sum_by(table(spark, sf_dir, "top_products_by_category"), "category", "total_revenue")


def category_metric_sum_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.sum_by(table(spark, sf_dir, "top_products_by_category"), "category", "total_revenue", metric_type="revenue")


def default_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.auto_chart(_clean(spark, sf_dir).select("region", "revenue"))


def histogram30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.histogram(_clean(spark, sf_dir), "discount_percent")


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.reason_counts(_clean(spark, sf_dir), "anomaly_flag")


def filter_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = explore.filter_by_reasons(_clean(spark, sf_dir), "anomaly_flag", ["heavy_discount", "no such reason"])
    return flagged.groupBy("category").agg(F.count(F.lit(1)).alias("row_count"))


def category_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.options(_clean(spark, sf_dir), "category")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_sales written as CSV files and read back as whole records, in the checkpoint folder."""
    from sluicebox.session import shared_folder
    from sluicebox.sources import files

    folder = shared_folder(spark, "csv_round_trip")
    rows = _raw(spark, sf_dir)
    # a text of one value per row shows that line ends, quotes and blanks survive
    odd = rows.withColumn("product_name", F.concat(F.col("product_name"), F.when(F.col("row_id") % 7 == 0, F.lit(',\n"x" ')).otherwise(F.lit(""))))
    files.write_orders_csv(odd.select("order_id", "product_name", "category", "region", "sale_date"), folder)
    orders, malformed = files.read_orders_csv(spark, folder)
    return orders.groupBy("product_name", "region").agg(F.count(F.lit(1)).alias("row_count"), F.count("order_id").alias("keyed"), F.min("sale_date").alias("first_date")).unionByName(
        malformed.select(F.col("record").alias("product_name"), F.col("reason").alias("region"), F.lit(1).cast("bigint").alias("row_count"), F.lit(0).cast("bigint").alias("keyed"), F.lit(None).cast("string").alias("first_date"))
    )


def anomaly_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page on anomalies: counts of the reasons, as its heading shows them."""
    return explore.reason_view(aggregates.anomaly_records(_clean(spark, sf_dir), 20, balanced=True), "anomaly_reason")[1]


def anomaly_view_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page on anomalies with one reason chosen: the rows it lists."""
    return explore.reason_view(aggregates.anomaly_records(_clean(spark, sf_dir), 20, balanced=True), "anomaly_reason", ["high_discount"])[3].select("rank", "order_id", "anomaly_reason")


def reject_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page on rejects: counts of the commonest reasons."""
    return explore.reason_view(cleaning.rejected_rows(_judged(spark, sf_dir)), "rejection_reason")[1]


def data_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.extent(_clean(spark, sf_dir))


def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the funnel on rows of clean_sales, of which some are given a price, a date or an amount out of range."""
    rows = _clean(spark, sf_dir).where("category IS NOT NULL AND region IS NOT NULL")
    rows = rows.withColumn("row_index", F.row_number().over(Window.partitionBy("batch_id").orderBy(*[c for c in rows.columns if c != "batch_id"])) + F.col("batch_id").cast("bigint") * 1_000_000)
    turn = F.pmod("row_index", F.lit(10))
    price = F.when(turn == 1, F.lit("0")).when(turn == 2, F.lit("50000")).when(turn == 3, F.lit("49999.99")).otherwise(F.col("unit_price").cast("decimal(18,2)").cast("string"))
    quantity = F.when(turn == 3, F.lit("21")).when(turn == 4, F.lit("-2")).otherwise(F.col("quantity").cast("string"))
    date = F.when(turn == 5, F.lit("1990-01-01")).when(turn == 6, F.lit("2024-02-30")).otherwise(F.lit("2024-03-01"))
    made = rows.select(
        "row_index", F.concat("order_id", F.lit("-"), "row_index").alias("order_id"), "product_name", "category", quantity.alias("quantity"), price.alias("unit_price"),
        F.when(turn == 3, F.lit("0")).otherwise(F.lit("0.1")).alias("discount_percent"), "region", date.alias("sale_date"), "customer_email",
    )
    categories = rows.select(F.col("category").alias("canonical")).distinct()
    regions = rows.select(F.col("region").alias("raw_label"), F.col("region").alias("canonical")).distinct()
    judged = cleaning.judge_orders(made, categories, regions, cleaning.CleanConfig(as_of=AS_OF))
    return judged.select("row_index", F.coalesce("rejection_reason", F.lit("clean")).alias("reason"))


def best_sellers_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.best_sellers(aggregates.top_products_by_category(_clean(spark, sf_dir)), "revenue")


def best_sellers_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.best_sellers(aggregates.top_products_by_category(_clean(spark, sf_dir), 10), "units", "Footcare", 5)


def preview50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.preview(_raw(spark, sf_dir).select("row_id", "order_id", "category", "sale_date"), ["row_id"])


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    named = X.fill_label(F.col("category"))
    return rows.select(named.alias("category"), X.title_case(F.lower(named)).alias("titled"), X.count_label(named, F.col("n")).alias("label"))


def generator_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many dirty orders as raw_sales has rows."""
    return OrderGenerator(spark, seed=7).rows(_raw(spark, sf_dir).count())


def generator_clean_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated dirty orders through the funnel, with the engine's own lookups."""
    made = dedup.with_row_order(OrderGenerator(spark, seed=7).rows(_raw(spark, sf_dir).count()))
    judged = cleaning.judge_orders(made, lookups.category_table(spark), lookups.region_table(spark), cleaning.CleanConfig(as_of="2024-12-31"))
    return explore.reason_counts(judged.select(F.coalesce("rejection_reason", F.lit("clean")).alias("reason")), "reason", None)


QUERIES = {
    query.__name__: query
    for query in (
        monthly_sales_summary, top_products_by_category, region_wise_performance, top_categories, anomaly_records, anomaly_balanced,
        normalise_string, email_clean, quantity_clean, price_clean, discount_clip, parse_dates, month_keys, revenue,
        category_exact, category_fuzzy, region_resolve, region_unmapped, dedup_keep_first, dedup_chunked, dedup_global, id_intersection,
        clean_orders, reject_orders, clean_funnel, reject_reasons, category_counts, lookup_share, region_map_build, product_category_vote, product_name_normalise,
        dataset_summary, category_metric_top15, category_metric_sum, category_metric_sum_revenue, default_chart, histogram30, reason_counts, filter_by_reason,
        category_options, best_sellers_topn, best_sellers_drilldown, preview50, labels, generator_dirty, generator_clean_funnel, csv_round_trip, anomaly_view, anomaly_view_rows, reject_view, data_extent, all_rules,
    )
}
