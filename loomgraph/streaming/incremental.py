"""Parsing of a growing source tree as a stream. Parsing is file-local, so each new file's rows stand on their own;
joins that resolve names run over the latest rows. Spark's file source remembers paths: a file that is written
again under its old path isn't read again, and one that goes isn't noticed; a new version needs a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.combinators import last_wins
from ..sources.files import with_targets
from ..sources.parse import parse_files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def parsed_stream(spark: SparkSession, root: str) -> DataFrame:
    """Parsed rows of files as they appear under a folder."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(root)
    return parse_files(with_targets(found, root))


def follow(spark: SparkSession, root: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes parsed rows to a table, each batch under its number; with ``once`` it ends when all files are read. A
    batch that is tried again overwrites what it had written."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = parsed_stream(spark, root).writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(rows: DataFrame) -> DataFrame:
    """Of each file the rows of the newest batch that has it."""
    newest = last_wins(rows.select("target", "file", "batch", F.col("batch").alias("last")).distinct(), ["target", "file"], "last").select("target", "file", "batch")
    return rows.join(newest, ["target", "file", "batch"], "left_semi").drop("batch")
