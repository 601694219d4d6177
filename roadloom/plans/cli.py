"""Command line: ``python -m roadloom.plans.cli <command> ...``."""

from __future__ import annotations

import argparse
import json
import math
import sys

from pyspark.sql import SparkSession

from roadloom.operators.canonicalize import Options, canonicalize
from roadloom.plans import catalog, validation
from roadloom.schema import RADII
from roadloom.sources import flatgeobuf, geojson


def radius_value(text: str) -> float:
    if text.lower() in ("n", "global", "infinity"):
        return math.inf
    value = float(text)
    if not (math.isfinite(value) and value > 0):
        raise argparse.ArgumentTypeError("a positive number, or n")
    return value


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="roadloom")
    commands = p.add_subparsers(dest="command")
    c = commands.add_parser("canonicalize", help="line features to a segment graph")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--no-split", action="store_true")
    c.add_argument("--preserve-source-ids", action="store_true")
    c.add_argument("--end-stub-min-ratio", type=float, default=0.0)
    for name in ("cleaning-profile", "source-dataset", "input-crs", "output-crs"):
        c.add_argument(f"--{name}")
    c = commands.add_parser("analyze", help="one analysis column of a segment graph")
    c.add_argument("--input", required=True)
    c.add_argument("--column", required=True)
    c.add_argument("--output")
    commands.add_parser("methods", help="the catalog of columns").add_argument("--output")
    for name in ("validate-depthmapx", "validate-depthmapx-angular", "validate-cityseer"):
        c = commands.add_parser(name)
        c.add_argument("--output")
        if name != "validate-cityseer":
            c.add_argument("--input", required=True)
            c.add_argument("--radius", type=radius_value, default=math.inf)
            c.add_argument("--mean-depth-column")
            c.add_argument("--choice-column")
        if name == "validate-depthmapx-angular":
            c.add_argument("--integration-column")
    commands.add_parser("help")
    return p


def _emit(value, path: str | None) -> None:
    text = json.dumps(value, indent=2) + "\n"
    if path:
        with open(path, "w") as f:
            f.write(text)
    else:
        sys.stdout.write(text)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = _parser()
    try:
        a = parser.parse_args(argv)
    except SystemExit as stop:
        return 1 if stop.code else 0
    if a.command in (None, "help"):
        parser.print_help()
        return 1 if a.command is None else 0
    spark = spark or SparkSession.builder.appName("roadloom").getOrCreate()
    try:
        if a.command == "canonicalize":
            options = Options(split_intersections=not a.no_split, preserve_source_ids=a.preserve_source_ids, end_stub_min_ratio=a.end_stub_min_ratio, cleaning_profile=a.cleaning_profile, source_dataset=a.source_dataset, input_crs=a.input_crs, output_crs=a.output_crs)
            made = canonicalize(geojson.read_features(spark, a.input), options)
            if a.output.lower().endswith(".fgb"):
                with open(a.output, "wb") as f:
                    f.write(flatgeobuf.to_flatgeobuf(made.network))
            else:
                with open(a.output, "w") as f:
                    f.write(geojson.to_geojson(made.network))
            _emit(made.metadata, f"{a.output}.metadata.json")
        elif a.command == "analyze":
            found = catalog.compute_column_by_name(geojson.read_network(spark, a.input), a.column)
            values = [r["value"] for r in found.values.orderBy("segment_index").toLocalIterator()]
            _emit({"column": found.column, "row_hash": found.row_hash, "feature_count": found.feature_count, "method": found.method, "status": found.status, "values": values}, a.output)
        elif a.command == "methods":
            rows = [r.asDict() for r in catalog.method_catalog(spark).orderBy("radius", "method", "measure").collect()]
            _emit({"radii": list(RADII), "methods": rows}, a.output)
        elif a.command == "validate-depthmapx":
            _emit(validation.validate_metric_csv(spark, a.input, a.radius, a.mean_depth_column, a.choice_column), a.output)
        elif a.command == "validate-depthmapx-angular":
            _emit(validation.validate_angular_csv(spark, a.input, a.radius, a.mean_depth_column, a.integration_column, a.choice_column), a.output)
        else:
            _emit(validation.validate_diamond(spark), a.output)
    except Exception as error:  # noqa: BLE001  the boundary of the program
        sys.stderr.write(f"{error}\n")
        parser.print_usage(sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
