"""What the jobs share: configuration, command line and session."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

LOG = logging.getLogger("loomgraph.jobs")


def config(name: str, given: str | None = None) -> dict:
    """The job's parameters: those of the file beside it, with the ones of a file that is named over them."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as file:
        own = json.load(file)
    if given:
        with open(given, encoding="utf-8") as file:
            more = json.load(file)
        if unknown := sorted(set(more) - set(own)):
            raise ValueError(f"unknown parameters in {given}: {', '.join(unknown)}")
        own |= more
    return own


def main(name: str, text: str, job: Callable, arguments: list[str] | None = None) -> int:
    """``python -m jobs.NAME TABLES OUT [--config FILE]``; the session is made and ended here alone."""
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog=f"jobs.{name}", description=text, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("tables", help="folder of the tables, <name>.parquet each")
    parser.add_argument("out", help="folder of the output")
    parser.add_argument("--config", help="a JSON file of parameters")
    own = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(f"loomgraph-{name}").getOrCreate()
    try:
        job(spark, own.tables, own.out, **config(name, own.config))
    finally:
        spark.stop()
    return 0
