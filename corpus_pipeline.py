"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. toxicity: documents that the factorization machine rejects go.
2. near_duplicates: of each group of linked documents the one with the smallest doc_id stays.
3. substring_dedup: repeated passages leave the texts; a text that loses words is its kept words joined
   by one space, and n_chars is its new length. Documents stay, also one that loses all of its words.
4. decontamination: contaminated documents go.
5. packing: the pieces of what is left, in sequences.

All but the last return the columns of ``documents``. Each stage judges the texts that it is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common, decontaminate, neardup, packing, substrings
from loomgraph.llm import toxicity as toxic

#: SQL can express neither the learned stage nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted toxic go. A null or empty text has the bias alone; repeated rows are judged alike,
    and a table without labels or rows loses nothing."""
    machine = toxic.learn(docs, common.table(spark, sf_dir, "labels"))
    return toxic.clean(spark, docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: of its smallest doc_id (a null one only where it has no other), of rows that
    share the id that of one text; and each row without words. Rows with equal doc_id and text count once."""
    return neardup.clean(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows keep their place. A text that loses words is what stays, joined by one space (all of them: ""), and
    n_chars, where docs have it, its length; other texts, nulls among them, stay as they are. Rows that share a doc_id
    count as one document."""
    n_words, n_removed, kept = added = common.fresh(docs, "n_words", "n_removed", "kept")
    done = substrings.remove_repeats(spark, docs, added=tuple(added))
    cut = F.col(n_removed) > 0
    done = done.withColumn("text", F.when(cut, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        done = done.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.drop(n_words, n_removed, kept)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is contaminated go; rows of one doc_id are told apart by their texts. Nulls and empty texts stay,
    and without items all rows do."""
    return decontaminate.clean(spark, docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, nulls (the end token alone), empty texts and repeated rows included."""
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark).rstrip('/')}/loomgraph/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
