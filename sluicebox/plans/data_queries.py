"""Queries of the general data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.operators.parse_rejects import SALES_FORMAT, parse_records, rejected_rows, valid_rows
from sluicebox.operators.timestamps import normalise_timestamps
from sluicebox.sources.tables import broadcast_if_small, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty records of raw_lines with the first reason that holds."""
    lines = table(spark, sf_dir, "raw_lines").select("line_id", "line")
    return rejected_rows(parse_records(lines, fields=None)).select("line_id", "reason")


def p5_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records of raw_lines, typed."""
    lines = table(spark, sf_dir, "raw_lines").select("line_id", "line")
    return valid_rows(parse_records(lines)).drop("line")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raw_sales row whose sale_date denotes exactly one instant, with that instant."""
    sales = table(spark, sf_dir, "raw_sales").select("row_id", "feed_id", "sale_date")
    feeds = table(spark, sf_dir, "feeds").select("feed_id", "tz_name").dropDuplicates(["feed_id"])
    dated = sales.where(F.col("sale_date").isNotNull()).join(broadcast_if_small(feeds), "feed_id", "left")
    found = normalise_timestamps(dated, "sale_date", "tz_name")
    return found.where(F.col("epoch_us").isNotNull()).select("row_id", "epoch_us")


QUERIES = {"p5_found": p5_found, "p5_valid": p5_valid, "p7_found": p7_found}

_FIELD = '"(?:[^"]|"")*"|[^",]*'
_VALUE = r"""trim(CASE WHEN f[{0}] LIKE '"%' THEN substr(f[{0}], 2, length(f[{0}]) - 2) ELSE f[{0}] END, ' ' || chr(9))"""
_NUMBER = r"regexp_matches({0}, '^[0-9]+(\.[0-9]+)?$')"

_RECORDS = rf"""
        WITH records AS (SELECT line_id, regexp_replace(line, '\r$', '') AS line FROM raw_lines),
        parsed AS (SELECT line_id, regexp_matches(line, '^(?:{_FIELD})(?:,(?:{_FIELD}))*$') AS quoted, regexp_extract_all(',' || line, ',({_FIELD})', 1) AS f FROM records),
        fields AS (SELECT *, {_VALUE.format(4)} AS quantity, {_VALUE.format(5)} AS price, {_VALUE.format(6)} AS discount FROM parsed),
        judged AS (
            SELECT *, CASE WHEN NOT quoted THEN 'bad_quoting' WHEN len(f) <> 10 THEN 'column_count' WHEN NOT regexp_matches(quantity, '^0*[1-9][0-9]*$') THEN 'bad_quantity'
                WHEN NOT {_NUMBER.format('price')} OR try_cast(price AS DOUBLE) <= 0 OR try_cast(price AS DOUBLE) >= 50000 THEN 'bad_unit_price'
                WHEN NOT {_NUMBER.format('discount')} OR try_cast(discount AS DOUBLE) > 1 THEN 'bad_discount_percent' END AS reason
            FROM fields)"""
_TEXT = r"""CASE WHEN f[{0}] LIKE '"%' THEN replace(substr(f[{0}], 2, length(f[{0}]) - 2), '""', '"') ELSE f[{0}] END AS {1}"""
_VALID = ", ".join(
    {"quantity": "CAST(quantity AS BIGINT) AS quantity", "unit_price": "CAST(price AS DOUBLE) AS unit_price", "discount_percent": "CAST(discount AS DOUBLE) AS discount_percent"}.get(name, _TEXT.format(i, name))
    for i, name in enumerate(SALES_FORMAT.columns, 1)
)

SQL: dict[str, str] = {
    "p5_found": f"{_RECORDS} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_valid": f"{_RECORDS} SELECT line_id, {_VALID} FROM judged WHERE reason IS NULL",
}
