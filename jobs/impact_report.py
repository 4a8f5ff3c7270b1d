"""Impact report: what a change of each function would touch.

Reads the graph of the tables (regions are files, nations classes, customers methods, suppliers functions; lineitems joined
with orders are call sites), walks from every function to all that call or contain it, and writes two tables, by the
file that holds the function:

``affected``  symbol, node, hop, parent: what is touched, how far away, and over what
``report``    symbol, name, callers, sites, affected, files, furthest, top_callers: a row for each function

Both are overwritten as a whole, so a run that is repeated, or that is tried again after it broke off, has the same result.

    python -m jobs.impact_report TABLES OUT [--config FILE]

Parameters: ``hops`` and ``rows`` bound the walk (a walk that they end is logged, and is an error), ``callers`` is how many
of the most frequent callers a row of the report names.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import combinators, graph, traverse
from loomgraph.plans import views
from loomgraph.plans.build import stored

from . import base

AFFECTED = "symbol string, node string, hop int, parent string, file string"
REPORT = "symbol string, name string, callers long, sites long, affected long, files long, furthest int, top_callers string, file string"


def run(spark: SparkSession, tables: str, out: str, *, hops: int, rows: int, callers: int) -> DataFrame:
    """Writes both tables and returns ``report``, read back."""
    nodes, out = views.nodes(spark, tables), out.rstrip("/")
    # Walk, counts and most frequent callers read the same edges, which are put together once.
    calls = stored(spark, graph.dedupe_edges(views.call_sites(spark, tables)).select("target", "frm", "to", "count"), "impact-calls")
    edges = calls.select("target", "frm", "to").unionByName(graph.contains_edges(nodes))
    functions = nodes.filter("type = 'function'")
    walk = traverse.reach(edges, functions.select("target", "id"), incoming=True, hops=hops, rows=rows)
    for hop, found in walk.hops:
        base.LOG.info("impact_report: %d rows at hop %d", found, hop)
    if not walk.complete:
        raise ValueError(f"the walk doesn't end within {hops} hops and {rows} rows")
    # A function's file is the end of its chain of containers.
    files = _files(nodes)
    touched = walk.rows.filter("hop > 0").select("target", F.col("seed").alias("symbol"), "node", "hop", "parent")
    touched = touched.join(files.withColumnRenamed("id", "symbol"), ["target", "symbol"])
    touched.select("symbol", "node", "hop", "parent", "file").write.mode("overwrite").partitionBy("file").parquet(f"{out}/affected")
    affected = spark.read.schema(AFFECTED).parquet(f"{out}/affected")
    base.LOG.info("impact_report: wrote %d rows to %s/affected", affected.count(), out)

    kinds = nodes.select(F.col("id").alias("node"), "type")
    sums = affected.join(kinds, "node").groupBy("symbol").agg(F.count(F.lit(1)).alias("affected"), F.count_if(F.col("type") == "file").alias("files"), F.max("hop").alias("furthest"))
    direct = calls.groupBy(F.col("to").alias("symbol")).agg(F.count(F.lit(1)).alias("callers"), F.sum("count").alias("sites"))
    most = combinators.top_k(calls.select(F.col("to").alias("symbol"), "frm", "count"), ["symbol"], [F.desc("count"), "frm"], callers)
    named = most.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "frm"))), lambda x: x["frm"]), ",").alias("top_callers"))
    own = functions.join(files, ["target", "id"]).select(F.col("id").alias("symbol"), "name", "file")
    rows_ = own.join(direct, "symbol", "left").join(sums, "symbol", "left").join(named, "symbol", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "sites", "affected", "files", "furthest")]
    rows_.select("symbol", "name", *zero, F.coalesce("top_callers", F.lit("")).alias("top_callers"), "file").write.mode("overwrite").partitionBy("file").parquet(f"{out}/report")
    report = spark.read.schema(REPORT).parquet(f"{out}/report")
    base.LOG.info("impact_report: read %s, wrote %d rows to %s/report", tables, report.count(), out)
    return report


def _files(nodes: DataFrame) -> DataFrame:
    """(target, id, file) of functions: the name of the file that their class stands in."""
    up = nodes.select("target", F.col("id").alias("parent"), F.col("parent").alias("above"))
    names = nodes.filter("type = 'file'").select("target", F.col("id").alias("above"), F.col("name").alias("file"))
    return nodes.filter("type = 'function'").select("target", "id", "parent").join(up, ["target", "parent"]).join(names, ["target", "above"]).select("target", "id", "file")


if __name__ == "__main__":
    sys.exit(base.main("impact_report", __doc__, run))
