"""What the jobs share: configuration, command line, logging."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def settings(name: str, **given: str) -> dict:
    """The job's small configuration file beside it, with what is given on top; an unknown or a missing name is an error."""
    return merged(json.loads(Path(__file__).with_name(f"{name}.json").read_text()), given)


def merged(config: dict, given: dict) -> dict:
    unknown = set(given) - set(config)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    config = config | given
    missing = sorted(k for k, v in config.items() if v is None)
    if missing:
        raise ValueError(f"settings without a value: {missing}")
    return config


def main(name: str, run: Callable[[SparkSession, dict], dict], argv: list[str] | None = None) -> int:
    """python -m jobs.<name> --tables PATH --output PATH [--config FILE] [--set KEY=JSON]: creates the session and stops it."""
    parser = argparse.ArgumentParser(prog=f"jobs.{name}")
    parser.add_argument("--tables", required=True, help="folder of the tables, as Spark reads it")
    parser.add_argument("--output", required=True, help="folder that the job writes to, as Spark writes it")
    parser.add_argument("--config", help="JSON file with settings that differ from the job's own")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=JSON", help="one setting")
    args = parser.parse_args(argv)
    given = json.loads(Path(args.config).read_text()) if args.config else {}
    given |= {k: json.loads(v) for k, v in (s.split("=", 1) for s in args.set)}
    config = settings(name, tables=args.tables, output=args.output, **given)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        print(json.dumps(run(spark, config)))
    finally:
        spark.stop()
    return 0
