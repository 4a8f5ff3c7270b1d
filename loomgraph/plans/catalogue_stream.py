"""Stateful streams over the events table: sessions of users, and standing versions of what events touch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import state
from .build import shared_folder
from .views import table

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream: a pattern stands for a single file as well as for a folder of files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _run(spark: SparkSession, rows: DataFrame, name: str, schema: str, mode: str) -> DataFrame:
    path = f"{shared_folder(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    state.follow(rows, f"{path}/out", f"{path}/checkpoint", mode).awaitTermination()
    return state.written(spark, f"{path}/out", schema)


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e),
s AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM n GROUP BY user_id, session)
SELECT * FROM s WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def event_sessions(spark, sf_dir):
    """Sessions that are over when the stream ends: the watermark, an hour behind the last event, has passed them."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sums = [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")]
    own = state.sessions(events, ["user_id"], "ts", "30 minutes", "1 hour", sums)
    made = _run(spark, own, "sessions", "user_id long, start timestamp, end timestamp, n long, total double", "append")
    return made.select("user_id", F.col("start").cast("timestamp_ntz").alias("session_start"), F.col("end").cast("timestamp_ntz").alias("session_end"), "n", "total")


@query("""SELECT target, path, modified, hash FROM (SELECT event_type AS target, CAST(user_id AS VARCHAR) AS path, ts AS modified, coalesce(props, '') AS hash, event_id % 3 = 0 AS gone,
row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id % 3 = 0 DESC, coalesce(props, '') DESC) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE r = 1 AND NOT gone""")
def file_versions(spark, sf_dir):
    """A user is a file of the target that the event's type names, every third event its deletion."""
    events = _stream(spark, sf_dir, "events")
    files = events.select(F.col("event_type").alias("target"), F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("modified"), F.col("props").alias("hash"), (F.col("event_id") % 3 == 0).alias("deleted"))
    with state.state_store(spark):
        changes = _run(spark, state.versions(files, "1 day"), "versions", state.CHANGES, "update")
    return state.standing(changes).withColumn("modified", F.col("modified").cast("timestamp_ntz"))
