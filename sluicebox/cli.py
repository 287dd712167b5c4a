"""Command line: python -m sluicebox.cli COMMAND ..."""

from __future__ import annotations

import argparse
import datetime as dt
import logging

from sluicebox.operators.cleaning import CleanConfig
from sluicebox.operators.generator import OrderGenerator
from sluicebox.plans import pipeline
from sluicebox.session import build_session
from sluicebox.sources import files


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sluicebox", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    make = commands.add_parser("generate-data")
    make.add_argument("--rows", type=int, default=1000)
    make.add_argument("--output", required=True)
    make.add_argument("--clean", action="store_true")
    make.add_argument("--seed", type=int, default=0)
    clean = commands.add_parser("clean-data")
    clean.add_argument("--input", required=True, nargs="+")
    clean.add_argument("--lookups", help="folder of common_categories.json, common_regions.json and region_map.json")
    clean.add_argument("--output-dir")
    clean.add_argument("--chunk-size", type=int, default=100_000)
    clean.add_argument("--keep-zero-quantity", action="store_true")
    clean.add_argument("--no-save-rejected", action="store_true")
    clean.add_argument("--as-of", default=dt.date.today().isoformat())
    build = commands.add_parser("build-aggregations")
    build.add_argument("--cleaned", required=True)
    build.add_argument("--output", required=True)
    build.add_argument("--top-products-by-category", type=int, default=5)
    build.add_argument("--anomaly-limit", type=int, default=5)
    for name in ("build-category-lookup", "build-region-lookup"):
        lookup = commands.add_parser(name)
        lookup.add_argument("inputs", nargs="+")
        lookup.add_argument("--threshold", type=float, default=0.01)
        lookup.add_argument("--output", required=True)
    region = commands.add_parser("build-region-map")
    region.add_argument("inputs", nargs="+")
    region.add_argument("--output", required=True)
    region.add_argument("--unknown-label", default="UNKNOWN")
    update = commands.add_parser("update-lookups")
    update.add_argument("inputs", nargs="+")
    update.add_argument("--folder", required=True)
    update.add_argument("--category-threshold", type=float, default=0.01)
    update.add_argument("--region-threshold", type=float, default=0.01)
    update.add_argument("--unknown-label", default="UNKNOWN")
    update.add_argument("--skip-tests", action="store_true")
    update.add_argument("--pytest-args", nargs=argparse.REMAINDER, default=[])
    for command in commands.choices.values():
        command.add_argument("--log-level", default="INFO", choices=("DEBUG", "INFO", "WARNING", "ERROR"))
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    logging.basicConfig(format="%(asctime)s %(levelname)s %(message)s")
    logging.getLogger("sluicebox").setLevel(args.log_level)
    spark = build_session()
    if args.command == "generate-data":
        files.write_orders_csv(OrderGenerator(spark, seed=args.seed, dirty=not args.clean).rows(args.rows), args.output)
    elif args.command == "clean-data":
        config = CleanConfig(args.as_of, args.chunk_size, not args.keep_zero_quantity, not args.no_save_rejected)
        print(*pipeline.clean_csv_to_parquet(spark, args.input, config=config, output_dir=args.output_dir, lookups_dir=args.lookups))
    elif args.command == "build-aggregations":
        made = pipeline.aggregate_parquet(spark, args.cleaned, args.output, top_products_limit=args.top_products_by_category, anomaly_limit=args.anomaly_limit)
        print(*made.values(), sep="\n")
    elif args.command in ("build-category-lookup", "build-region-lookup"):
        pipeline.build_label_lookup(spark, args.inputs, args.command.split("-")[1], args.output, args.threshold)
    elif args.command == "build-region-map":
        pipeline.build_region_lookup(spark, args.inputs, args.output, unknown=args.unknown_label)
    else:
        pipeline.update_lookups(spark, args.inputs, args.folder, args.category_threshold, args.region_threshold, args.unknown_label, None if args.skip_tests else args.pytest_args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
