import pytest
from pyspark.sql import functions as F

from sluicebox.operators import aggregates, explore, lookups
from sluicebox.operators.generator import OrderGenerator
from sluicebox.operators.names import normalise_product_name
from sluicebox.schemas import AGGREGATE_COLUMNS, CLEAN_SCHEMA


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "canonical string")


def words(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_fuzzy_takes_the_nearest_then_the_first(spark):
    found = lookups.resolve_fuzzy(words(spark, "cart", "Books", "bokz", "xxxxxx", "", None), "v", names(spark, "Dart", "Bart", "Books"), "c")
    assert {r.v: r.c for r in found.collect()} == {"cart": "Bart", "Books": "Books", "bokz": "Books", "xxxxxx": None, "": None, None: None}


def test_fuzzy_bound(spark):
    found = lookups.resolve_fuzzy(words(spark, "kitchenab", "kitchenabc"), "v", names(spark, "Kitchen"), "c")
    assert {r.v: r.c for r in found.collect()} == {"kitchenab": "Kitchen", "kitchenabc": None}


def test_regions(spark):
    found = lookups.resolve_region(words(spark, "Bombay", "bombay ", "Goa", "Lost", None), "v", spark.createDataFrame([("Bombay", "Mumbai"), ("Lost", "UNKNOWN")], "raw_label string, canonical string"), "c")
    assert {r.v: r.c for r in found.collect()} == {"Bombay": "Mumbai", "bombay ": "Mumbai", "Goa": None, "Lost": None, None: None}
    with pytest.raises(ValueError, match="no known region"):
        lookups.region_table(spark, {"x": "Nowhere"})


def test_frequent_labels(spark):
    rows = words(spark, *["home goods"] * 90, *["rare"] * 2, *[""] * 8)
    counts = lookups.value_counts(rows, "v")
    assert [r.label for r in lookups.frequent_labels(counts, 0.05).collect()] == ["Home Goods"]
    assert [r.label for r in lookups.frequent_labels(counts, 0.02).collect()] == ["Home Goods", "Rare"]
    assert lookups.frequent_labels(lookups.value_counts(rows.where("false"), "v"), 0.01).count() == 0
    with pytest.raises(ValueError, match="between"):
        lookups.frequent_labels(counts, 1.5)


def test_region_map_build(spark):
    existing = spark.createDataFrame([("Bombay", "Mumbai")], "raw_label string, canonical string")
    built = lookups.build_region_map(words(spark, "Mumbay", "Atlantis", "Bombay", " ", None), "v", existing, names(spark, "Mumbai", "Delhi"))
    assert [tuple(r) for r in built.collect()] == [("Atlantis", "UNKNOWN"), ("Bombay", "Mumbai"), ("Delhi", "Delhi"), ("Mumbai", "Mumbai"), ("Mumbay", "Mumbai")]


def test_product_vote(spark):
    rows = spark.createDataFrame([("mug", "Kitchen")] * 8 + [("mug", "Office")] * 2 + [("pen", "Office"), ("pen", "Books")] + [(None, "Books")], "product_name string, category string")
    assert [tuple(r) for r in lookups.product_categories(rows).collect()] == [("mug", "Kitchen", 0.8)]


def test_product_names(spark):
    got = {r.v: r.n for r in words(spark, "  iphone14", "USB_Chagrer", "samsung  galaxy S22", "T0y-Kitt", "", None).select("v", normalise_product_name(F.col("v")).alias("n")).collect()}
    assert got == {"  iphone14": "iPhone 14", "USB_Chagrer": "USB_Chagrer".replace("_", " "), "samsung  galaxy S22": "samsung galaxy S22", "T0y-Kitt": "Toy Kit", "": "", None: ""}


def orders(spark, *rows):
    made = [(o, p, c, q, 10.0, d, g, s, None, v, None) for o, p, c, q, d, g, s, v in rows]
    return spark.createDataFrame(made, CLEAN_SCHEMA)


@pytest.fixture
def small(spark):
    january, february = 1704067200, 1706745600
    return orders(
        spark,
        ("A", "mug", "Kitchen", 2, 0.1, "Delhi", january, 20.0), ("A", "pan", "Kitchen", 1, 0.3, "Delhi", january, 5.5), ("B", "pot", "Kitchen", 3, 0.0, None, february, 20.0),
        ("C", "pen", "Office", 9, 0.9, "Delhi", february, 1.0), ("D", "ink", None, 1, None, "Goa", february, 2.0), ("E", "cup", "Kitchen", 0, 0.2, "Goa", None, None),
    )


def test_monthly(small):
    assert [tuple(r) for r in aggregates.monthly_sales_summary(small).orderBy("month").collect()] == [("2024-01", 25.5, 3, 0.2, 1), ("2024-02", 23.0, 13, 0.45, 3)]


def test_products_ties_by_name(small):
    rows = [tuple(r)[:4] + (r.metric_type,) for r in aggregates.top_products_by_category(small, 2).orderBy("category", "metric_type", "rank").collect()]
    assert rows == [
        ("Kitchen", 1, "mug", 20.0, "revenue"), ("Kitchen", 2, "pot", 20.0, "revenue"), ("Kitchen", 1, "pot", 20.0, "units"), ("Kitchen", 2, "mug", 20.0, "units"),
        ("Office", 1, "pen", 1.0, "revenue"), ("Office", 1, "pen", 1.0, "units"),
    ]


def test_regions_and_categories(small):
    assert {tuple(r) for r in aggregates.region_wise_performance(small).collect()} == {("Delhi", 26.5, 12, 2, 13.25), ("Goa", 2.0, 1, 2, 1.0)}
    assert {tuple(r) for r in aggregates.top_categories(small).collect()} == {("Kitchen", 0.15, 3, 45.5), ("Office", 0.9, 1, 1.0)}


def test_anomalies(small):
    plain = aggregates.anomaly_records(small, 2).orderBy("rank").collect()
    assert [(r["rank"], r.order_id, r.anomaly_reason) for r in plain] == [(1, "A", "high_revenue"), (2, "B", "high_revenue")]
    both = aggregates.anomaly_records(small, 2, balanced=True).orderBy("rank").collect()
    assert [(r["rank"], r.order_id, r.anomaly_reason) for r in both] == [(1, "A", "high_revenue"), (2, "B", "high_revenue"), (3, "C", "high_discount")]


def test_all_aggregations_of_nothing_are_typed(spark, tmp_path):
    paths = aggregates.build_all_aggregations(spark.createDataFrame([], CLEAN_SCHEMA), str(tmp_path))
    for name, path in paths.items():
        table = spark.read.parquet(path)
        assert table.count() == 0 and tuple(table.columns) == AGGREGATE_COLUMNS[name]


def test_explore(spark, small):
    assert explore.dataset_summary(small).count() == 11
    assert [tuple(r) for r in explore.sum_by(small, "region", "revenue").collect()] == [("Delhi", 26.5), (None, 20.0), ("Goa", 2.0)]
    assert [r["count"] for r in explore.histogram(small.select("discount_percent"), "discount_percent", 3).orderBy("bin").collect()] == [3, 1, 1]
    assert explore.auto_chart(small.select("revenue")).count() > 0
    assert [tuple(r) for r in explore.reason_counts(small, "region").collect()][0] == ("Delhi", 3, "Delhi (3)")
    assert explore.filter_by_reasons(small, "region", ["Goa", "none"]).count() == 2
    assert explore.filter_by_reasons(small, "region", ["none"]).count() == 6 == explore.filter_by_reasons(small, "region", []).count()
    assert [r.category for r in explore.options(small, "category").collect()] == ["Kitchen", "Office"]
    with pytest.raises(ValueError, match="limit"):
        explore.best_sellers(small, "revenue", limit=0)


def test_generator_makes_every_slip_and_variant(spark):
    made = OrderGenerator(spark, seed=5)
    words = spark.range(4000).select(made.typo(F.lit("Big Lamp"), "w", 1.0).alias("w"))
    found = {r.w for r in words.distinct().collect()}
    kinds = {"Bi Lamp", "Bigg Lamp", "iBg Lamp", "big Lamp", "BigLamp", "Bi g Lamp", "Big kamp"}
    assert kinds - found == set() and len(found) > 100
    assert {len(w) for w in found} == {7, 8, 9}
    products = [r.p for r in spark.range(3000).select(made.product().alias("p")).collect()]
    assert 0.4 < sum(p.istitle() and " " in p for p in products) / 3000 < 0.9 and any(p.isupper() for p in products) and any("_" in p for p in products)
    again = [r.p for r in spark.range(3000).select(OrderGenerator(spark, seed=5).product().alias("p")).collect()]
    assert again == products


def test_generator_rates(spark):
    rows = OrderGenerator(spark, seed=6).rows(20_000).persist()
    share = lambda condition: rows.where(condition).count() / 20_000
    assert 0.005 < 1 - rows.select("order_id").distinct().count() / 20_000 < 0.02
    assert 0.08 < share("sale_date IN ('', 'NULL', 'N/A')") < 0.12 and 0.12 < share("customer_email IN ('', 'NULL', 'N/A')") < 0.17
    assert 0.11 < share("quantity IN ('0', '-1', '50', 'two', 'many', 'N/A', '3.5', '')") < 0.19
    clean = OrderGenerator(spark, seed=6, dirty=False).rows(2000)
    assert clean.where("sale_date = '' OR NOT quantity RLIKE '^[1-9][0-9]*$' OR customer_email NOT LIKE '%@%.%'").isEmpty()
    rows.unpersist()


def test_sorted_aggregates(spark, sf_dir):
    from sluicebox.operators import aggregates as A

    clean = spark.read.parquet(f"{sf_dir}/clean_sales.parquet")
    months = [r.month for r in A.monthly_sales_summary(clean).collect()]
    assert months == sorted(months)
    by = [(-r.total_revenue, r.region) for r in A.region_wise_performance(clean).collect()]
    assert by == sorted(by)
    shares = [(-r.avg_discount_percent, r.category) for r in A.top_categories(clean).collect()]
    assert shares == sorted(shares)


def test_long_lists_are_joined_as_short_ones_are_written_out(spark, monkeypatch):
    from sluicebox.operators import lookups as L

    values = ["Kitchen", "kichen", "Kitchn!", "Ofice", "", None, "zzz", "Bookss", "oks"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    regions = spark.createDataFrame([(i, v) for i, v in enumerate(["mumbay", "Bombay", "DEHLI", "x", None])], "i int, v string")
    short = [L.resolve_fuzzy(rows, "v", L.category_table(spark), "c").orderBy("i").collect(), L.resolve_region(regions, "v", L.region_table(spark), "c").orderBy("i").collect()]
    monkeypatch.setattr(L, "INLINE", 3)
    long = [L.resolve_fuzzy(rows, "v", L.category_table(spark), "c").orderBy("i").select("i", "v", "c").collect(), L.resolve_region(regions, "v", L.region_table(spark), "c").orderBy("i").select("i", "v", "c").collect()]
    assert short == long and [r.c for r in short[0]][:4] == ["Kitchen", "Kitchen", "Kitchen", "Office"]
