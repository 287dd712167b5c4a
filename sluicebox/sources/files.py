"""Files in and out: order feeds in CSV, cleaned parquet, rejects, lookups in JSON, listings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.operators.lookups import UNKNOWN
from sluicebox.schemas import CLEAN_SCHEMA, RAW_COLUMNS, RAW_SCHEMA
from sluicebox.session import cut_lineage
from sluicebox.sources.records import header_of, read_records

#: Texts that a column scan for lookups takes for null.
NULL_TOKENS = ("", "NULL", "null", "N/A", "n/a", "NA", "NaN", "nan", "None", "<NA>", "#N/A")


def read_orders_csv(spark: SparkSession, paths: str | list[str], order: str = "row_index") -> tuple[DataFrame, DataFrame]:
    """Raw orders as text with their number (``order``), and the records that are none (order, record, reason).

    Orders have whatever known columns the files have; the empty field alone is null. Quoted fields may
    hold line ends; several files are numbered by path. The files are read once, to the checkpoint folder.
    """
    names = header_of(spark, paths)
    rows = cut_lineage(read_records(spark, paths, names, order))
    place = {name: i for i, name in reversed(list(enumerate(names)))}
    orders = rows.where("reason IS NULL").select(order, *[F.col(f"c{place[n]}").alias(n) for n in RAW_COLUMNS if n in place])
    return orders, rows.where("reason IS NOT NULL").select(order, "record", "reason")


def read_column_csv(spark: SparkSession, paths: list[str], column: str) -> DataFrame:
    """One column of several files, null tokens dropped, and records that can't be read left out."""
    names = header_of(spark, paths)
    if column not in names:
        raise ValueError(f"no column {column!r} in {names}")
    rows = read_records(spark, paths, names).where("reason IS NULL").select(F.col(f"c{names.index(column)}").alias(column))
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*NULL_TOKENS))


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned orders as stored, numbers as double where they may have been written otherwise."""
    rows = spark.read.parquet(path)
    casts = {"discount_percent": "double", "quantity": "bigint", "revenue": "double", "sale_date": "bigint"}
    return rows.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in rows.columns})


def read_artefact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).option("escape", '"').option("multiLine", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def write_clean(rows: DataFrame, path: str) -> None:
    """Snappy parquet of one fixed schema, also when there are no rows."""
    typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in CLEAN_SCHEMA.fields])
    typed.write.mode("overwrite").parquet(path)


def write_rejects(rows: DataFrame, path: str) -> None:
    write_orders_csv(rows, path)


def write_orders_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled and white space kept, so that it reads back as it is."""
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(**kept).csv(path)


def default_paths(input_csv: str, output_dir: str | None = None) -> tuple[str, str]:
    """Where the cleaned rows and the rejects of an input go; records that are no orders go beside the rejects."""
    source = Path(input_csv)
    folder = Path(output_dir) if output_dir else source.parent
    return str(folder / f"{source.stem}_clean.parquet"), str(folder / f"{source.stem}_rejected.csv")


def malformed_path(reject_path: str) -> str:
    """Where records that are no orders go."""
    return reject_path.removesuffix("_rejected.csv") + "_malformed.csv"


def list_artefacts(folder: str, suffix: str, leave_out: tuple[str, ...] = ("anomaly_records",)) -> list[str]:
    """Sorted files of a suffix; none if the folder is absent."""
    return sorted(str(p) for p in Path(folder).glob(f"*{suffix}") if p.stem not in leave_out) if Path(folder).is_dir() else []


def write_lookup(value: list[str] | dict[str, str], path: str) -> None:
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def read_lookup_list(path: str) -> list[str]:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise ValueError(f"{path} holds no list of strings")
    return sorted(set(value))


def read_region_map(path: str, regions: list[str]) -> dict[str, str]:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    if wrong := {v for v in value.values() if v not in {*regions, UNKNOWN}}:
        raise ValueError(f"{path} maps to no known region: {sorted(wrong)}")
    return value


def empty_orders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW_SCHEMA)
