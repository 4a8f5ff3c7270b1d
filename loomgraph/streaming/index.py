"""A stored lexical index of documents that grows batch by batch.

Under one folder stand three tables, each batch of documents under its number:

``documents``  target, id, hash, length: the versions that a batch brought
``postings``   target, term, id, tf, by ``bucket``, a hash range of terms
``changes``    target, term, df, tf: what a batch adds to the terms' counts, less what the versions that it replaces had

A document is (target, id); of several versions the one of the last batch counts. A version whose text is as it was adds
nothing, so work follows what is new: a batch reads the versions and postings of the documents that it changes, and
no other. A batch that is tried again overwrites what it had written and looks at earlier batches only, so it has the
same result. A question reads the buckets of its terms.

Cases: a null text is a document of no terms; a null target is ``und``; rows without an id can't be told apart and are
left out; of rows that share an id in a batch the one with the greatest text counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..functions.text import terms as text_terms
from ..operators import bm25
from ..operators.combinators import last_wins, top_k
from ..plans.build import stored

BUCKETS = 32
KINDS = {
    "documents": "target string, id {id}, hash string, length long, batch long",
    "postings": "target string, term string, id {id}, tf long, batch long, bucket int",
    "changes": "target string, term string, df long, tf long, batch long",
}


def read(spark: SparkSession, path: str, name: str, id_: str = "long", upto: int | None = None) -> DataFrame:
    """A table of the index, of the batches before ``upto``."""
    whole = spark.read.schema(KINDS[name].format(id=id_)).parquet(f"{path.rstrip('/')}/{name}")
    return whole if upto is None else whole.filter(F.col("batch") < upto)


def bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def latest(documents: DataFrame) -> DataFrame:
    return last_wins(documents, ["target", "id"], "batch")


def add(docs: DataFrame, path: str, number: int) -> None:
    """Adds a batch of documents (target, id, text) under its number."""
    spark, path = docs.sparkSession, path.rstrip("/")
    id_ = dict(docs.dtypes)["id"]
    own = docs.select(F.coalesce("target", F.lit("und")).alias("target"), "id", F.coalesce("text", F.lit("")).alias("text")).filter("id IS NOT NULL")
    own = own.groupBy("target", "id").agg(F.max("text").alias("text")).select("target", "id", content_hash(F.col("text")).alias("hash"), "text")
    known = latest(read(spark, path, "documents", id_, number)) if number else None
    if known is not None:
        # Only ids of the batch are looked up, and the texts of those that changed are read into terms.
        was = known.select("target", "id", F.col("hash").alias("was"), F.col("batch").alias("was_batch"))
        own = own.join(was, ["target", "id"], "left").filter("was IS NULL OR was != hash")
    else:
        own = own.withColumn("was_batch", F.lit(None).cast("long"))
    fresh = stored(spark, own.select("target", "id", "hash", "was_batch", text_terms(F.col("text")).alias("terms")), "index-batch")
    length = F.size("terms").cast("long").alias("length")
    fresh.select("target", "id", "hash", length).write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
    posted = fresh.select("target", "id", F.explode("terms").alias("term")).groupBy("target", "term", "id").agg(F.count(F.lit(1)).alias("tf"))
    dealt = posted.withColumn("bucket", bucket()).repartition("bucket").sortWithinPartitions("bucket", "target", "term", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={number}")
    new = spark.read.schema(f"target string, term string, id {id_}, tf long, bucket int").parquet(f"{path}/postings/batch={number}")
    changes = new.select("target", "term", F.lit(1).alias("df"), "tf")
    if number:
        replaced = fresh.filter("was_batch IS NOT NULL").select("target", "id", F.col("was_batch").alias("batch"))
        gone = read(spark, path, "postings", id_, number).join(replaced, ["target", "id", "batch"], "left_semi")
        changes = changes.union(gone.select("target", "term", F.lit(-1), -F.col("tf")))
    counts = changes.groupBy("target", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter("df != 0 OR tf != 0")
    counts.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")


def terms(spark: SparkSession, path: str, id_: str = "long") -> DataFrame:
    """(target, term, df, tf, idf) of all terms, from the batches' changes."""
    counts = read(spark, path, "changes").groupBy("target", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter("df > 0")
    n = latest(read(spark, path, "documents", id_)).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    own = counts.join(n, "target")
    return own.select("target", "term", "df", "tf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def search(questions: DataFrame, path: str, limit: int = 10, *, id_: str = "long", digits: int = 6) -> DataFrame:
    """The ``limit`` best documents (target, question_id, id, score, rank) of each question (target, question_id, question),
    by BM25 over the stored postings of the questions' terms."""
    spark = questions.sparkSession
    asked = stored(spark, bm25.query_terms(questions), "index-asked")
    buckets = [r.bucket for r in asked.select(bucket().alias("bucket")).distinct().collect()]
    current = latest(read(spark, path, "documents", id_))
    sized = stored(spark, current.select("target", "id", "length", "batch"), "index-lengths")
    posted = read(spark, path, "postings", id_).filter(F.col("bucket").isin(buckets)).join(asked.select("target", "term").distinct(), ["target", "term"], "left_semi")
    posted = posted.join(sized.select("target", "id", "batch"), ["target", "id", "batch"], "left_semi").select("target", "id", "term", "tf")
    totals = bm25.corpus(sized)
    df = read(spark, path, "changes").join(asked.select("target", "term").distinct(), ["target", "term"], "left_semi").groupBy("target", "term").agg(F.sum("df").alias("df"))
    n = F.greatest("n", F.lit(1))
    stats = df.join(totals, "target").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    found = bm25.scores(asked, posted, sized.drop("batch"), totals, stats)
    return top_k(found.withColumn("score", F.round("score", digits)), ["target", "question_id"], [F.desc("score"), "id"], limit)
