"""Queries and comparison SQL of the training-data operators."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.llm import comparison_sql as sql
from sluicebox.llm import distinct_counts, seen_keys
from sluicebox.llm.bpe import encode_corpus
from sluicebox.llm.canonical import map_to_canonical
from sluicebox.llm.garbled import restore_garbled, train_on
from sluicebox.llm.leaked import find_leaks
from sluicebox.llm.quantile_sketch import add_sketches, dyadic_sketches, percentiles
from sluicebox.llm.top_n import top_n
from sluicebox.session import cut_lineage
from sluicebox.sources.tables import table

#: Folder of the public vocabulary files, the same on every worker.
TOKENIZERS = os.environ.get("SLUICEBOX_TOKENIZERS", "/opt/tokenizers")

#: Stated relative standard error of distinct counts, for the largest group.
COUNT_ERROR = 0.005


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Keys and order_id of clean_sales, and the bitmap size: rows bound the different orders."""
    sales = table(spark, sf_dir, "clean_sales")
    keyed = sales.select("batch_id", F.date_from_unix_date(F.floor(F.col("sale_date") / 86400).cast("int")).cast("string").alias("day"), "category", "region", "order_id")
    return keyed, distinct_counts.bitmap_size(sales.count(), COUNT_ERROR)


def p1_distinct_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different orders per day, category, region and all their combinations, with the standard error."""
    orders, m = _orders(spark, sf_dir)
    keys = ["day", "category", "region"]
    return distinct_counts.count_combinations(distinct_counts.bitmaps(orders, keys, "order_id", m), keys)


def p1_batches_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different orders per category from the bitmaps of single batches, beside the sum of the batches' own counts."""
    orders, m = _orders(spark, sf_dir)
    parts = cut_lineage(distinct_counts.bitmaps(orders.where("category IS NOT NULL"), ["batch_id", "category"], "order_id", m))
    merged = distinct_counts.count_groups(distinct_counts.union_bitmaps(parts, ["category"]), ["category"])
    single = distinct_counts.count_groups(parts, ["batch_id", "category"]).groupBy("category").agg(F.round(F.sum("estimate"), 2).alias("batch_sum"))
    return merged.join(single, "category")


def p1_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each combination of day, category and region: its groups, and those whose estimate lies within five standard errors of the exact count."""
    orders, m = _orders(spark, sf_dir)
    keys = ["day", "category", "region"]
    counted = distinct_counts.count_combinations(distinct_counts.bitmaps(orders, keys, "order_id", m), keys)
    exact = orders.where("order_id IS NOT NULL").groupingSets([[k for i, k in enumerate(keys) if kept >> i & 1] for kept in range(8)], *keys).agg(
        F.count_distinct("order_id").alias("exact"), *[F.grouping(k).alias(f"g_{k}") for k in keys]
    )
    level = F.concat_ws(",", *[F.when(F.col(f"g_{k}") == 0, F.lit(k)) for k in keys]).alias("exact_level")
    exact = exact.select(level, *[F.col(k).alias(f"e_{k}") for k in keys], "exact")
    same = (F.col("level") == F.col("exact_level")) & reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in keys])
    both = exact.join(counted, same, "left")
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(5 * F.col("std_error") * F.col("exact"), F.lit(3.0))  # small groups: single collisions
    return both.groupBy(F.col("exact_level").alias("level")).agg(F.count(F.lit(1)).alias("groups"), F.count_if(near).alias("within"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five products of highest revenue in each category, by bisection of the cutoffs."""
    totals = table(spark, sf_dir, "top_products_by_category").where(F.col("metric_type") == "revenue")
    return top_n(totals, "category", "total_revenue", "product_name", 5).select("category", "rank", "product_name")


SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of revenue and discount_percent per category, of each batch and of all batches.

    Those of all (``batch_id`` null) come from the batches' sketches, added up. ``rank_error`` bounds the error of the share.
    """
    sales = table(spark, sf_dir, "clean_sales").select("batch_id", "category", "revenue", "discount_percent")
    parts = cut_lineage(dyadic_sketches(sales, ["batch_id", "category"], ["revenue", "discount_percent"]))
    single = percentiles(parts, ["batch_id", "category"], SHARES)
    return single.unionByName(percentiles(add_sketches(parts, ["category"]), ["category"], SHARES), allowMissingColumns=True)


def p3_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles of all batches from sketches made without regard to batches."""
    sales = table(spark, sf_dir, "clean_sales").select("category", "revenue", "discount_percent")
    return percentiles(dyadic_sketches(sales, ["category"], ["revenue", "discount_percent"]), ["category"], SHARES)


def p3_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each category and column: percentiles of all batches, and those whose share lies within the stated error of the share that all rows give."""
    sales = table(spark, sf_dir, "clean_sales").select("batch_id", "category", "revenue", "discount_percent")
    found = cut_lineage(percentiles(add_sketches(dyadic_sketches(sales, ["batch_id", "category"], ["revenue", "discount_percent"]), ["category"]), ["category"], SHARES))
    long = sales.select("category", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in ("revenue", "discount_percent")])).alias("p"))
    long = long.select(F.col("category").alias("c"), F.col("p.column").alias("n"), "p.v").where("v IS NOT NULL AND NOT isnan(v)")
    met = long.join(F.broadcast(found.where("value IS NOT NULL")), F.col("category").eqNullSafe(F.col("c")) & (F.col("column") == F.col("n")))
    code = F.abs("value") * 2.0**-15
    ranked = met.groupBy("category", "column", "share", "rank_error").agg((F.count_if(F.col("v") < F.col("value") - code) / F.count("v")).alias("low"), (F.count_if(F.col("v") <= F.col("value") + code) / F.count("v")).alias("high"))
    near = (F.col("low") - F.col("rank_error") <= F.col("share")) & (F.col("share") <= F.col("high") + F.col("rank_error"))
    return ranked.groupBy("category", "column").agg(F.count(F.lit(1)).alias("shares"), F.count_if(near).alias("within"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical entry of each freely typed category and region of raw_sales, or UNKNOWN."""
    sales = table(spark, sf_dir, "raw_sales").select("row_id", "category", "region")
    categories = table(spark, sf_dir, "common_categories").select(F.col("category").alias("label"), F.col("category").alias("canonical"))
    regions = table(spark, sf_dir, "common_regions").select(F.col("region").alias("label"), F.col("region").alias("canonical"))
    named = table(spark, sf_dir, "region_map").select(F.col("raw_label").alias("label"), "canonical")
    return map_to_canonical(sales, "row_id", {"category": categories, "region": regions.unionByName(named)})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of raw_sales whose order_id is in clean_sales or an earlier row: coded sets, then the keys themselves."""
    past = table(spark, sf_dir, "clean_sales").select("order_id")
    new = table(spark, sf_dir, "raw_sales").select("row_id", "order_id")
    found = cut_lineage(seen_keys.seen_before(past, new, "order_id", "row_id"))
    return seen_keys.confirmed(found, past, "order_id").select("row_id")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theoretical and audited rate of wrong answers of the sets that p6_found uses (20 bits), and of deliberately coarse ones (8 bits)."""
    past = table(spark, sf_dir, "clean_sales").select("order_id")
    new = table(spark, sf_dir, "raw_sales").select("row_id", "order_id")
    rates = [seen_keys.audit(cut_lineage(seen_keys.seen_before(past, new, "order_id", "row_id", bits=bits)), past, new, "order_id", bits) for bits in (8, 20)]
    return reduce(DataFrame.unionByName, rates)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 16 consecutive words of a held-out passage, and which."""
    pages = table(spark, sf_dir, "documents").select("doc_id", "text", "line_boxes")
    items = table(spark, sf_dir, "eval_items").select("item_id", "passage")
    return find_leaks(pages, "doc_id", "text", "line_boxes", items, "item_id", "passage").select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one character from a wrong decoding."""
    pages = table(spark, sf_dir, "documents").select("doc_id", "text")
    return restore_garbled(pages, "text", train_on(pages, "text"), restored="").where("garbled_chars > 0").select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their restored text, and how many characters were garbled and lost."""
    pages = table(spark, sf_dir, "documents").select("doc_id", "text")
    return restore_garbled(pages, "text", train_on(pages, "text")).where("garbled_chars > 0").drop("text")


QUERIES = {"p1_distinct_orders": p1_distinct_orders, "p1_batches_merged": p1_batches_merged, "p1_within_error": p1_within_error, "p2_found": p2_found, "p3_percentiles": p3_percentiles, "p3_whole_table": p3_whole_table, "p3_within_error": p3_within_error, "p4_found": p4_found, "p6_found": p6_found, "p6_rates": p6_rates, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_restored": p10_restored}

SQL = {"p1_within_error": sql.P1_WITHIN_ERROR, "p2_found": sql.P2_FOUND, "p3_within_error": sql.P3_WITHIN_ERROR, "p4_found": sql.P4_FOUND, "p6_found": sql.P6_FOUND}
