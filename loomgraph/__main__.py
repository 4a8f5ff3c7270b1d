"""Command line: ``python -m loomgraph build ROOT OUT`` and ``python -m loomgraph check SPEC OUT``.

``build`` parses the codebases under ROOT (all, or those named by --target) and writes their graphs to OUT as
Parquet. ``check`` runs a question spec over the graphs in OUT; its exit code is 0 where all cases are as the spec
says, 1 where some aren't or a target has a fault, and 2 where there is nothing to check."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .plans import build, smoke
from .settings import Settings
from .sources import files


def built(spark: SparkSession, root: str, out: str, targets: list[str] | None) -> int:
    sources = files.source_files(spark, root)
    if targets:
        sources = sources.filter(F.col("target").isin(targets))
    if sources.isEmpty():
        print(f"no source files under {root}", file=sys.stderr)
        return 2
    made = build.build(spark, sources)
    files.write_graph(made.nodes, made.edges, made.meta, out)
    for r in files.read_graph(spark, out)[2].select("target", "node_count", "edge_count", F.size("parse_failures").alias("failed")).orderBy("target").limit(100).collect():
        print(f"{r.target}: {r.node_count} nodes, {r.edge_count} edges, {r.failed} files that couldn't be parsed")
    return 0


def checked(spark: SparkSession, spec: str, out: str, targets: list[str] | None, root: str | None) -> int:
    asked = files.questions(spark, spec)
    if targets:
        asked = asked.filter(F.col("target").isin(targets))
    if asked.isEmpty():
        print("no questions to check", file=sys.stderr)
        return 2
    nodes, _, meta = files.read_graph(spark, out)
    stale = None
    if root:
        disk = files.source_files(spark, root).select("target", F.col("path").alias("file"), F.substring(F.sha2("text", 256), 1, 16).alias("hash"))
        stale = graph.staleness(nodes.filter("type = 'file'").select("target", "file", "hash"), disk)
    cases, faults = smoke.checked(asked, nodes, meta, stale, Settings.read().max_nodes)
    cases = build.stored(spark, cases, "cases")
    wrong, broken = smoke.problems(cases).orderBy("target", "question_id").limit(100).collect(), faults.distinct().orderBy("target", "fault").limit(100).collect()
    total = smoke.rollup(cases).first()
    for r in broken:
        print(f"!! {r.target}: {r.fault}")
    for r in wrong:
        print(f"!! {r.target}: {r.question} - {r.problem}")
    print(f"{total.clean}/{total.checked} cases clean")
    return 1 if wrong or broken else 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    parts = parser.add_subparsers(dest="command", required=True)
    for name, first in (("build", "root"), ("check", "spec")):
        part = parts.add_parser(name)
        part.add_argument(first)
        part.add_argument("out")
        part.add_argument("--target", action="append", help="only this codebase (may be repeated)")
        if name == "check":
            part.add_argument("--root", help="folder of the codebases, to see whether graphs are stale")
    own = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if own.command == "build":
        return built(spark, own.root, own.out, own.target)
    return checked(spark, own.spec, own.out, own.target, own.root)


if __name__ == "__main__":
    sys.exit(main())
