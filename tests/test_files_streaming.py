import json
import random
import subprocess

import pytest

from sluicebox import cli
from sluicebox.operators.cleaning import CleanConfig
from sluicebox.operators.generator import OrderGenerator
from sluicebox.plans import pipeline
from sluicebox.sources import files
from sluicebox.streaming import order_stream


def test_clean_run_from_csv(spark, tmp_path):
    source = tmp_path / "feed.csv"
    source.write_text(
        "order_id,product_name,category,quantity,unit_price,discount_percent,region,sale_date,customer_email\n"
        'O1,"Mug, ""big""",Kitchen,2,10,0,Mumbai,2024-01-05,a@b.de\nO1,Pan,Kitchen,1,5,0,Mumbai,2024-01-05,\nO2,NULL,Kitchen,1,5,0,Atlantis,2024-01-05,\n',
        encoding="utf-8",
    )
    clean, rejected = pipeline.clean_csv_to_parquet(spark, str(source), config=CleanConfig(as_of="2024-12-31"))
    rows = files.read_clean(spark, clean).collect()
    assert [(r.order_id, r.product_name, r.revenue) for r in rows] == [("O1", 'Mug, "big"', 20.0)]
    rejects = spark.read.option("header", True).csv(rejected)
    assert sorted((r.order_id, r.product_name, r.rejection_reason) for r in rejects.collect()) == [("O1", "Pan", "duplicate_order_id"), ("O2", "NULL", "unknown_region")]
    made = pipeline.aggregate_parquet(spark, clean, str(tmp_path / "out"))
    assert spark.read.parquet(made["monthly_sales_summary"]).collect()[0].total_revenue == 20.0
    assert [p.rsplit("/", 1)[1] for p in files.list_artefacts(str(tmp_path / "out"), ".parquet")] == ["monthly_sales_summary.parquet", "region_wise_performance.parquet", "top_categories.parquet", "top_products_by_category.parquet"]
    assert files.list_artefacts(str(tmp_path / "absent"), ".csv") == []


def test_round_trip_of_odd_text(spark, tmp_path):
    rows = OrderGenerator(spark, seed=1).rows(200)
    files.write_orders_csv(rows, str(tmp_path / "orders"))
    back, malformed = files.read_orders_csv(spark, str(tmp_path / "orders"))
    assert back.count() == 200 and back.columns == ["row_index", *rows.columns] and malformed.isEmpty()


HEADER = "order_id,product_name,category,quantity,unit_price,discount_percent,region,sale_date,customer_email\n"


def test_quoted_line_ends_and_quotes_in_rejects(spark, tmp_path):
    source = tmp_path / "feed.csv"
    source.write_bytes(("\ufeff" + HEADER + 'O1,"Mug\nbig ""x""",Kitchen,2,10,0,Mumbai,2024-01-05,a@b.de\r\n\nO2,"Pan, ""big""\n",Nowhere,1,5,0,Mumbai,2024-01-05,\nO3,Cup,Kitchen,1,5,0,Mumbai,2024-01-05\nO4,"a"b,Kitchen,1,5,0,Mumbai,2024-01-05,\nO5,Cup,Kitchen,1,5,0,Mumbai,2024-01-05,,,\n').encode())
    out = tmp_path / "elsewhere"
    clean, rejected = pipeline.clean_csv_to_parquet(spark, str(source), config=CleanConfig(as_of="2024-12-31"), output_dir=str(out))
    assert clean == str(out / "feed_clean.parquet") and rejected == str(out / "feed_rejected.csv")
    assert sorted((r.order_id, r.product_name) for r in files.read_clean(spark, clean).collect()) == [("O1", 'Mug\nbig "x"'), ("O3", "Cup")]
    orders, none = files.read_orders_csv(spark, rejected)
    assert [(r.order_id, r.product_name, r.category) for r in orders.collect()] == [("O2", 'Pan, "big"\n', "Nowhere")] and none.isEmpty()
    assert {r.rejection_reason for r in files.read_artefact(spark, rejected).collect()} == {"unknown_category"}
    bad = files.read_artefact(spark, files.malformed_path(rejected)).collect()
    assert sorted((r.row_index, r.reason) for r in bad) == [(3, "bad_quoting"), (4, "column_count")]


def test_files_are_numbered_by_path(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER + "".join(f"O{i},B{i},Kitchen,1,5,0,Mumbai,2024-01-05,\n" for i in range(199)))
    (tmp_path / "a.csv").write_text(HEADER + "O1,First,Kitchen,1,5,0,Mumbai,2024-01-05,\n")
    orders, _ = files.read_orders_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")])
    rows = orders.collect()
    assert sorted(r.row_index for r in rows) == list(range(200))
    assert {r.row_index: r.product_name for r in rows}[0] == "First"
    clean, _ = pipeline.clean_csv_to_parquet(spark, str(tmp_path), str(tmp_path / "out"), config=CleanConfig(as_of="2024-12-31"))
    assert [r.product_name for r in files.read_clean(spark, clean).where("order_id = 'O1'").collect()] == ["First"]
    (tmp_path / "c.csv").write_text("")
    assert files.read_orders_csv(spark, str(tmp_path / "c.csv"))[0].count() == 0


@pytest.mark.parametrize("size", [200, 1000, 100_000])
def test_records_over_blocks(spark, tmp_path, size):
    import csv

    rng = random.Random(size)
    rows = [[f"O{i}", *("".join(rng.choice(["ab", "\n", '"', ",", "\r\n", " é", "xyz" * 20]) for _ in range(rng.randint(1, 6))) for _ in range(2))] for i in range(300)]
    for name, part in (("a.csv", rows[:280]), ("b.csv", rows[280:])):
        with open(tmp_path / name, "w", encoding="utf-8", newline="") as out:
            csv.writer(out, lineterminator="\n").writerows([["order_id", "product_name", "category"], *part])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        orders, malformed = files.read_orders_csv(spark, str(tmp_path))
        got = [[r.order_id, r.product_name, r.category] for r in orders.orderBy("row_index").collect()]
        assert got == rows and [r.row_index for r in orders.orderBy("row_index").collect()] == list(range(300)) and malformed.isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_an_open_quote_over_many_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "O1,Cup,Kitchen,1,5,0,Mumbai,2024-01-05,\nO2,\"Cup,Kitchen\n" + "x,y\n" * 400)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        orders, malformed = files.read_orders_csv(spark, str(tmp_path))
        assert [r.order_id for r in orders.collect()] == ["O1"]
        bad = malformed.collect()
        assert {r.reason for r in bad} == {"bad_quoting"} and sum(r.record.count("x,y") for r in bad) == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lookups_reach_the_cleaner(spark, tmp_path):
    source = tmp_path / "feed.csv"
    source.write_text(HEADER + "O1,Cup,Kites,1,5,0,Mumbai,2024-01-05,\nO2,Cup,Kitchen,1,5,0,Gotham,2024-01-05,\n")
    folder = tmp_path / "lookups"
    folder.mkdir()
    reasons = lambda path: [r.rejection_reason for r in files.read_artefact(spark, path).collect()]
    config = CleanConfig(as_of="2024-12-31")
    assert sorted(reasons(pipeline.clean_csv_to_parquet(spark, str(source), config=config, lookups_dir=str(folder))[1])) == ["unknown_category", "unknown_region"]
    files.write_lookup(["Kitchen", "Kites"], str(folder / "common_categories.json"))
    files.write_lookup(["Gotham City", "Mumbai"], str(folder / "common_regions.json"))
    files.write_lookup({"Gotham": "Gotham City", "Mumbai": "Mumbai"}, str(folder / "region_map.json"))
    clean, rejected = pipeline.clean_csv_to_parquet(spark, str(source), config=config, lookups_dir=str(folder))
    assert sorted((r.category, r.region) for r in files.read_clean(spark, clean).collect()) == [("Kitchen", "Gotham City"), ("Kites", "Mumbai")]
    files.write_lookup({"Gotham": "Atlantis"}, str(folder / "region_map.json"))
    with pytest.raises(ValueError, match="no known region"):
        pipeline.clean_csv_to_parquet(spark, str(source), config=config, lookups_dir=str(folder))


def test_region_map_keeps_its_entries_and_a_failing_check_aborts(spark, tmp_path):
    source = tmp_path / "feed.csv"
    source.write_text(HEADER + "O1,Cup,Kitchen,1,5,0,Mumbay2,2024-01-05,\nO2,Cup,Kitchen,1,5,0,Atlantis,2024-01-05,\n")
    files.write_lookup({"Mumbay2": "Delhi"}, str(tmp_path / "region_map.json"))
    found = pipeline.build_region_lookup(spark, [str(source)], str(tmp_path / "region_map.json"))
    assert found["Mumbay2"] == "Delhi" and found["Atlantis"] == "UNKNOWN" and found["Delhi"] == "Delhi"
    with pytest.raises(subprocess.CalledProcessError):
        pipeline.update_lookups(spark, [str(source)], str(tmp_path), check=[str(tmp_path / "no_such_test.py")])


def test_lookup_files(spark, tmp_path):
    rows = OrderGenerator(spark, seed=2, dirty=False).rows(500)
    files.write_orders_csv(rows, str(tmp_path / "orders"))
    pipeline.update_lookups(spark, [str(tmp_path / "orders")], str(tmp_path))
    assert "Kitchen" in files.read_lookup_list(str(tmp_path / "common_categories.json"))
    assert json.loads((tmp_path / "region_map.json").read_text())["Bombay"] == "Mumbai"
    with pytest.raises(ValueError, match="no known region"):
        files.read_region_map(str(tmp_path / "region_map.json"), ["Nowhere"])


def test_command_line(spark, tmp_path):
    feed = str(tmp_path / "feed.csv")
    assert cli.main(["generate-data", "--rows", "300", "--output", feed]) == 0
    assert cli.main(["clean-data", "--input", feed, "--as-of", "2024-12-31"]) == 0
    assert cli.main(["build-aggregations", "--cleaned", str(tmp_path / "feed_clean.parquet"), "--output", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out/top_categories.parquet")).count() > 10


def test_streams(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/raw_sales.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/raw_sales.parquet").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for rows, name in ((order_stream.first_orders(raw, lateness="3650 days"), "first"), (order_stream.hourly_revenue(raw), "hourly")):
        order_stream.write_stream(rows, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    batch = order_stream.typed_stream(spark.read.parquet(f"{sf_dir}/raw_sales.parquet"))
    first = spark.read.parquet(str(tmp_path / "first"))
    assert first.count() == batch.select("order_id").distinct().count()
    assert 0 < spark.read.parquet(str(tmp_path / "hourly")).count()
