"""Whole runs: clean a feed, build the aggregates, refresh the lookups."""

from __future__ import annotations

import logging
import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.operators import cleaning, explore, lookups
from sluicebox.operators.aggregates import build_all_aggregations
from sluicebox.session import cut_lineage
from sluicebox.sources import files

log = logging.getLogger("sluicebox")


def lookup_tables(spark: SparkSession, folder: str | None) -> tuple[DataFrame, DataFrame]:
    """Categories and region map: of the JSON files in ``folder``, and where one is absent the engine's own."""
    names, regions, mapping = lookups.CATEGORIES, list(lookups.REGIONS), None
    if folder:
        paths = {n: Path(folder) / f"{n}.json" for n in ("common_categories", "common_regions", "region_map")}
        if paths["common_categories"].exists():
            names = tuple(files.read_lookup_list(str(paths["common_categories"])))
        if paths["common_regions"].exists():
            regions = files.read_lookup_list(str(paths["common_regions"]))
        if paths["region_map"].exists():
            mapping = files.read_region_map(str(paths["region_map"]), regions)
    return lookups.category_table(spark, names), lookups.region_table(spark, mapping, regions)


def clean_csv_to_parquet(
    spark: SparkSession,
    input_csv: str | list[str],
    output_parquet: str | None = None,
    *,
    config: cleaning.CleanConfig,
    categories: DataFrame | None = None,
    regions: DataFrame | None = None,
    output_dir: str | None = None,
    lookups_dir: str | None = None,
) -> tuple[str, str | None]:
    """Clean a CSV feed of one or more files; returns where the cleaned rows and the rejects are (None if they aren't saved).

    The feed is parsed once and the judged rows are written once to the checkpoint folder; both outputs
    read them. Rejects keep their raw values. Records that are no orders (broken quoting, too many
    fields) go to a file of their own beside the rejects, with the reason.
    """
    first = input_csv if isinstance(input_csv, str) else input_csv[0]
    clean_path, reject_path = files.default_paths(first, output_dir)
    clean_path = output_parquet or clean_path
    raw, malformed = files.read_orders_csv(spark, input_csv)
    own = lookup_tables(spark, lookups_dir)
    judged = cut_lineage(cleaning.judge_orders(raw, own[0] if categories is None else categories, own[1] if regions is None else regions, config))
    files.write_clean(cleaning.clean_rows(judged), clean_path)
    metrics = cleaning.funnel_metrics(judged).collect()[0]
    log.info("rows %d, clean %d, rejected %d, kept %s %%", *metrics)
    if not config.save_rejected_rows:
        return clean_path, None
    files.write_rejects(cleaning.rejected_rows(judged), reject_path)
    if not malformed.isEmpty():
        files.write_rejects(malformed, files.malformed_path(reject_path))
        log.warning("records that are no orders: see %s", files.malformed_path(reject_path))
    return clean_path, reject_path


def aggregate_parquet(spark: SparkSession, clean_parquet: str, output_dir: str, *, top_products_limit: int = 10, anomaly_limit: int = 5) -> dict[str, str]:
    clean = files.read_clean(spark, clean_parquet)
    log.info("rows %s, orders %s, dates from %s to %s", *explore.extent(clean).collect()[0])
    return build_all_aggregations(clean, output_dir, top_products_limit=top_products_limit, anomaly_limit=anomaly_limit)


def build_label_lookup(spark: SparkSession, inputs: list[str], column: str, output: str, threshold: float = 0.01) -> list[str]:
    """The frequent labels of a column, written as JSON. A positive threshold bounds their number by its inverse."""
    counts = lookups.value_counts(files.read_column_csv(spark, inputs, column), column)
    found = [row.label for row in lookups.frequent_labels(counts, threshold).collect()]
    files.write_lookup(found, output)
    log.info("%s: %d labels", output, len(found))
    return found


def build_region_lookup(
    spark: SparkSession, inputs: list[str], output: str, mapping: dict[str, str] | None = None, unknown: str = lookups.UNKNOWN, regions: list[str] | None = None
) -> dict[str, str]:
    """The region map widened by the labels of the inputs, written as JSON.

    Entries of ``mapping``, else of an existing ``output``, else the engine's own, are kept; new labels
    are guessed among ``regions``, else the engine's own. More than MOST_LABELS labels are an error: a
    map read by people and held by every task isn't made of free text.
    """
    regions = list(lookups.REGIONS) if regions is None else regions
    if mapping is None and Path(output).exists():
        mapping = files.read_region_map(output, sorted({*regions, *lookups.REGIONS, unknown}))
    values = files.read_column_csv(spark, inputs, "region")
    canonical = spark.createDataFrame([(r,) for r in regions], "canonical string")
    own = lookups.region_table(spark, mapping, [*regions, unknown, *(mapping or {}).values()])
    built = lookups.build_region_map(values, "region", own, canonical, unknown).limit(MOST_LABELS + 1)
    found = {row.raw_label: row.canonical for row in built.collect()}
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different region labels")
    files.write_lookup(found, output)
    log.info("%s: %d labels", output, len(found))
    return found


#: Labels that a region map may have.
MOST_LABELS = 100_000


def update_lookups(
    spark: SparkSession,
    inputs: list[str],
    folder: str,
    category_threshold: float = 0.01,
    region_threshold: float = 0.01,
    unknown: str = lookups.UNKNOWN,
    check: list[str] | None = None,
) -> None:
    """Category list, region list, region map, each from the one before; then pytest with the arguments ``check``, if any. A failure ends the run."""
    build_label_lookup(spark, inputs, "category", f"{folder}/common_categories.json", category_threshold)
    regions = build_label_lookup(spark, inputs, "region", f"{folder}/common_regions.json", region_threshold)
    build_region_lookup(spark, inputs, f"{folder}/region_map.json", unknown=unknown, regions=sorted({*regions, *lookups.REGIONS}))
    if check is not None:
        subprocess.run([sys.executable, "-m", "pytest", *check], check=True)
