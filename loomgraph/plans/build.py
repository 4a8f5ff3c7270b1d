"""From source files to a resolved graph, for all targets in one job."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import SCHEMA_VERSION
from ..functions.text import snippet
from ..operators import graph as G
from ..operators.resolve import resolve
from ..sources.parse import parse_files


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where a single machine runs everything is
    there one of our own; on a cluster without the setting a local folder would lose rows, so that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def stored(spark: SparkSession, frame: DataFrame, name: str, *by: str) -> DataFrame:
    """The frame as a table in the cluster's shared folder, so that several joins read it and none parses again. Rows that are
    read by their value of ``by`` (a text) are partitioned by it."""
    path = f"{shared_folder(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    frame.write.partitionBy(*by).parquet(path)
    return spark.read.schema(frame.schema).parquet(path).select(*frame.columns)


def stored_rows(spark: SparkSession, rows: DataFrame, name: str = "parsed") -> DataFrame:
    """Parsed rows as a table: each join reads rows of one kind, and many read them."""
    return stored(spark, rows, name, "kind")


def placed(rows: DataFrame) -> DataFrame:
    """Adds the place (seq) of rows that came n-th in their file."""
    return rows.withColumn("seq", F.struct(F.split("file", "/").alias("path"), "n"))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Nodes, the parsers' own edges, calls, references and failures of parsed rows, each with its place; calls and references
    with their file, too, which no join has to find then."""
    own = {"call": [F.col("file").alias("frm_file")], "ref": [F.col("file").alias("frm_file")]}
    return {k: placed(rows.filter(F.col("kind") == k)).select("target", "seq", *own.get(k, []), f"{k}.*") for k in ("node", "edge", "call", "ref", "failure")}


def meta(nodes: DataFrame, edges: DataFrame, failures: DataFrame) -> DataFrame:
    files = nodes.filter("type = 'file'")
    languages = G.language_counts(files)
    entry = F.struct("place", "language", "files")
    listed = languages.groupBy("target").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    listed = listed.select("target", F.col("l")[0]["language"].alias("language"), F.map_from_entries(F.transform("l", lambda x: F.struct(x["language"], x["files"]))).alias("languages"))
    counts = nodes.groupBy("target").agg(F.count(F.lit(1)).alias("node_count"))
    links = edges.groupBy("target").agg(F.count(F.lit(1)).alias("edge_count"))
    failed = failures.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("file", "error"))).alias("parse_failures"))
    none = F.array().cast("array<struct<file:string,error:string>>")
    own = G.graph_hash(files).join(listed, "target").join(counts, "target").join(links, "target", "left").join(failed, "target", "left")
    return own.select("target", F.lit(SCHEMA_VERSION).alias("schema_version"), "language", "languages", "hash", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.coalesce("parse_failures", none).alias("parse_failures"))


def build(spark: SparkSession, files: DataFrame) -> Graph:
    """The graph of files (target, path, text): parsed file by file, resolved in joins."""
    parts = tables(stored_rows(spark, parse_files(files)))
    nodes = parts["node"]
    edges = stored(spark, resolve(nodes, parts["edge"], parts["call"], parts["ref"]), "edges")
    return Graph(nodes, edges, meta(nodes, edges, parts["failure"]))


def snippets(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(target, id, snippet) of symbols, from the files' texts."""
    own = nodes.filter("type != 'file'").select("target", "id", F.col("file").alias("path"), "line_start", "line_end")
    return own.join(files.select("target", "path", "text"), ["target", "path"], "left").select("target", "id", snippet(F.col("text"), F.col("line_start"), F.col("line_end")).alias("snippet"))
