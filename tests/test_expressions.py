import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluicebox.functions import expressions as X


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t")).alias("v")).collect()]


def test_strings_lose_unicode_space(spark):
    assert values(spark, X.normalise_string, [" a b ", "\ta ", "　x ", "", None]) == ["a b", "a", "x", "", ""]


def test_numbers(spark):
    texts = ["3.5", "2.5", "two", "-1", "", None, " 4 ", "1e3", "1d", "inf", "NaN", "1,000", "0x10", ".5", "9" * 30]
    assert values(spark, X.clean_quantity, texts) == [4, 2, 0, 0, 0, 0, 4, 1000, 0, 0, 0, 0, 0, 0, 0]
    assert values(spark, X.clean_discount, ["0.5", "2.5", "-0.1", "x", None]) == [0.5, 1.0, 0.0, 0.0, 0.0]
    assert values(spark, X.clean_price, ["12.30", "$7", None]) == [12.3, 0.0, 0.0]


def test_email(spark):
    texts = [" A@D.com ", "a..b@d.com", "a.b@", "N/A", "", None, "x y@d.com", "a@b@c.de"]
    assert values(spark, X.clean_email, texts) == ["a@d.com", "a..b@d.com", None, None, None, None, None, None]


@pytest.mark.parametrize(
    ("text", "date"),
    [
        ("2023-01-05", (2023, 1, 5)), ("01/15/2023", (2023, 1, 15)), ("15-01-2023", (2023, 1, 15)), ("2023/12/31", (2023, 12, 31)), ("2023-1-5", (2023, 1, 5)), ("1/5/2023", (2023, 1, 5)),
        ("2024-02-29", (2024, 2, 29)), ("2023-02-29", None), ("12-31-1999", None), ("31/12/1999", None), ("2023-13-01", None), ("now", None), ("", None), (None, None),
        ("1600-01-01", None), ("0001-01-01", None), ("2300-01-01", None), (" 2023-01-05\t", (2023, 1, 5)), ("2023-01-05T00:00", None),
    ],
)
def test_dates(spark, text, date):
    assert values(spark, X.parse_order_date, [text]) == [dt.date(*date) if date else None]


def test_date_range_includes_both_ends(spark):
    texts = ["2004-06-30", "2004-06-29", "2025-06-30", "2025-07-01"]
    assert values(spark, lambda c: X.in_date_range(X.parse_order_date(c), F.lit("2024-06-30").cast("date")), texts) == [True, False, True, False]


def test_revenue_and_flag(spark):
    rows = spark.createDataFrame([(2.675, 1, 0.0), (100.0, 3, 0.81), (10.0, 1, 0.80), (1e30, 1, 0.0)], "p double, q bigint, d double")
    got = rows.select(X.order_revenue(F.col("p"), F.col("q"), F.col("d")), X.heavy_discount_flag(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(2.68, None), (57.0, "heavy_discount"), (2.0, None), (None, None)]


def test_titles_and_labels(spark):
    assert values(spark, X.title_case, ["men's wear", "HOME & garden", ""]) == ["Men'S Wear", "Home & Garden", ""]
    assert values(spark, X.file_label, ["top_products"]) == ["Top Products"]
    assert values(spark, X.fill_label, [None, "a"]) == ["UNKNOWN", "a"]
