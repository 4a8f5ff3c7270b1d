"""Document index: the stored lexical index of a growing table of documents, kept up to date.

Follows the folder (or file) of ``documents`` as a stream: each run takes the files that came since the last one, which the
checkpoint remembers, and ends. Documents that are new, or whose text is another than before, are read into terms and
added to the index under the number of their batch; then the counts of terms are written, by language.

``index``       documents, postings and changes by batch, as ``loomgraph.streaming.index`` keeps them
``terms``       term, df, tf, idf by lang: in how many documents a term is, how often, and how much it tells
``checkpoint``  what was read

A run without new files writes ``terms`` anew with the same rows. A run that broke off is repeated: the batch that it was in
is overwritten. A file that is written again under its name isn't read again; a new version of a document comes in a new file, and
versions of one doc_id in two languages are two documents.

    python -m jobs.document_index TABLES OUT [--config FILE]

Parameter: ``files_per_batch`` bounds a batch.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.streaming import index

from . import base

TERMS = "term string, df long, tf long, idf double, lang string"


def run(spark: SparkSession, tables: str, out: str, *, files_per_batch: int) -> DataFrame:
    """Takes what is new, writes ``terms`` and returns it, read back."""
    out = out.rstrip("/")
    source = f"{tables.rstrip('/')}/documents.parquet"
    schema = spark.read.parquet(source).schema

    def take(batch: DataFrame, number: int) -> None:
        index.add(batch.select(F.col("lang").alias("target"), F.col("doc_id").alias("id"), "text"), f"{out}/index", number)
        for name in ("documents", "postings"):
            rows = batch.sparkSession.read.parquet(f"{out}/index/{name}/batch={number}").count()
            base.LOG.info("document_index: batch %d wrote %d rows of %s", number, rows, name)

    # As a pattern, which stands for a single file as well as for a folder of files.
    found = f"{source[:-1]}[{source[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(found)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    base.LOG.info("document_index: read %d new rows of %s", taken, source)
    own = index.terms(spark, f"{out}/index").withColumnRenamed("target", "lang").withColumn("idf", F.round("idf", 6))
    own.select("term", "df", "tf", "idf", "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{out}/terms")
    terms = spark.read.schema(TERMS).parquet(f"{out}/terms")
    base.LOG.info("document_index: wrote %d rows to %s/terms", terms.count(), out)
    return terms


if __name__ == "__main__":
    sys.exit(base.main("document_index", __doc__, run))
