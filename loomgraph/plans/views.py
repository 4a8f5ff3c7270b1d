"""Graph views of relational tables, on which the catalogue's queries run.

Regions are files, nations classes, customers methods, suppliers functions, parts fields; lineitems joined
with orders are call sites from a customer to a supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = "t"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, prefix: str, key: str, label: str, type_: str, parent) -> DataFrame:
        id_ = F.concat(F.lit(prefix), F.col(key).cast("string"))
        seq = F.struct(F.lit({"R": 0, "N": 1, "C": 2, "S": 3, "P": 4}[prefix]).alias("part"), F.col(key).cast("long").alias("n"))
        return table(spark, sf_dir, name).select(
            F.lit(TARGET).alias("target"), id_.alias("id"), F.col(label).alias("name"), F.lit(type_).alias("type"), parent.cast("string").alias("parent"), seq.alias("seq")
        )

    def up(prefix: str, key: str):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    parts = [
        part("region", "R", "r_regionkey", "r_name", "file", F.lit(None)),
        part("nation", "N", "n_nationkey", "n_name", "class", up("R", "n_regionkey")),
        part("customer", "C", "c_custkey", "c_name", "method", up("N", "c_nationkey")),
        part("supplier", "S", "s_suppkey", "s_name", "function", up("N", "s_nationkey")),
        part("part", "P", "p_partkey", "p_name", "field", F.lit(None)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge inserts (target, frm, to, type, via, seq) of call sites; seq is total."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return own.select(
        F.lit(TARGET).alias("target"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("frm"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("to"),
        F.lit("calls").alias("type"), F.col("l_returnflag").alias("via"), F.struct("l_orderkey", "l_linenumber", "l_returnflag").alias("seq"),
    )


#: The same views in SQL.
NV = """nv AS (
  SELECT 'R' || r_regionkey AS id, r_name AS name, 'file' AS type, CAST(NULL AS VARCHAR) AS parent, 0 AS part, CAST(r_regionkey AS BIGINT) AS n FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'class', 'R' || n_regionkey, 1, CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_name, 'method', 'N' || c_nationkey, 2, c_custkey FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'function', 'N' || s_nationkey, 3, s_suppkey FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_name, 'field', NULL, 4, p_partkey FROM part)"""
CS = """cs AS (
  SELECT 'C' || o_custkey AS frm, 'S' || l_suppkey AS "to", 'calls' AS type, l_returnflag AS via, {'k': l_orderkey, 'l': l_linenumber, 'f': l_returnflag} AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EDGES = """edges AS (
  SELECT frm, "to", type, CAST(count(*) AS BIGINT) AS cnt, arg_min(via, seq) AS via, min(seq) AS seq FROM cs GROUP BY frm, "to", type)"""
