"""Command line: ``analyze FILE`` and ``calibrate FOLDER``.

``analyze`` exits with 1 for a cascade, 0 for none, and 2 where the run could
not be monitored or the file not be read; ``calibrate`` with 0, or 2 where
there is nothing to calibrate from.
"""

from __future__ import annotations

import argparse
import dataclasses
import os
import sys

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Profile, Settings
from .operators.calibrate import calibrate
from .operators.drift import bag_drift
from .operators.report import analyze
from .operators.steps import densified
from .sources.ingest import read_files
from .sources.sinks import report_json, report_text


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="driftloom", description="Where did a chain of steps go off course?")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("analyze", help="analyse a .json or .jsonl file of steps")
    one.add_argument("file")
    one.add_argument("--json-out", help="write the report as JSON, too")
    one.add_argument("--threshold", type=float, help="drift threshold")
    one.add_argument("--profile", help="JSON file of thresholds")
    one.add_argument("--anchor", help="text to measure drift and coverage against")
    one.add_argument("--no-nli", action="store_true", help="drift only")
    many = sub.add_parser("calibrate", help="recommend a drift threshold from a folder of clean runs")
    many.add_argument("directory")
    many.add_argument("--percentile", type=float, default=95.0)
    many.add_argument("--name", default="calibrated")
    many.add_argument("--save", help="write the profile here")
    return parser.parse_args(argv)


def _profile(args: argparse.Namespace) -> Profile:
    """The thresholds asked for: of a file or the defaults, with those given one by one."""
    given = {"drift_threshold": args.threshold} if args.threshold is not None else {}
    return dataclasses.replace(Profile.load(args.profile) if args.profile else Profile(), **given)


def _analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        profile = _profile(args)
        steps, notes = read_files(spark, args.file)
        runs = spark.read.text(args.file, wholetext=True).select(F.col("_metadata.file_path").alias("run_id"))
        anchors = runs.select("run_id", F.lit("text").alias("kind"), F.array(F.lit(args.anchor)).alias("texts")) if args.anchor else None
        _, reports = analyze(steps, Settings(profile=profile), anchors, nli=not args.no_nli, notes=notes)
        report = reports.first()
    except (PySparkException, Py4JError, OSError, ValueError) as e:
        print(f"can't be read: {args.file}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    if report is None:
        print("no steps: no cascade detected")
        return 0
    print("CASCADE" if report.verdict else "no cascade")
    print(report_text(report))
    if args.json_out:
        with open(args.json_out, "w", encoding="utf-8") as f:
            f.write(report_json(report))
    return 2 if report.monitoring_failure else int(report.verdict)


def _calibrate(spark: SparkSession, args: argparse.Namespace) -> int:
    names = [n for n in sorted(os.listdir(args.directory)) if n.lower().endswith((".json", ".jsonl"))] if os.path.isdir(args.directory) else []
    if not names:
        print(f"no .json or .jsonl files in {args.directory}", file=sys.stderr)
        return 2
    steps, _ = read_files(spark, args.directory)
    found = calibrate(steps, bag_drift(densified(steps), buckets=128), args.percentile, args.name)
    print(f"{len(names)} clean runs, {found.n_measurements} drifts: mean {found.drift_mean}, deviation {found.drift_std}")
    print(f"drift threshold (p{found.percentile:g}): {found.profile.drift_threshold}")
    if args.save:
        found.profile.save(args.save)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments(argv)
    spark = spark or SparkSession.builder.appName("driftloom").getOrCreate()
    return (_analyze if args.command == "analyze" else _calibrate)(spark, args)


if __name__ == "__main__":
    sys.exit(main())
