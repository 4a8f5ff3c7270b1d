"""A lexical index in blocks with their best scores, stored once for each version of a target's documents, such as its
graph's hash. Top-k reads the blocks that can hold one of the best documents, and no others.

Documents are put into blocks of about ``DOCUMENTS`` with others of nearly their length, so the scores of a block differ little
by length. Under one folder stand two tables by target and version:

``blocks``  term, block, n, best, posts: the documents of a block that have a term (id, part), their number and their greatest part
``totals``  n, avg_length; written last, so a version that it has is whole

A part is what one occurrence of a term in a question adds to a document's score, but for the term's idf. The sum of
a block's best parts bounds the scores of its documents, so a question's best documents are found in two steps: the
blocks with the greatest bounds give ``limit`` documents, the last of which is a floor, then all other blocks whose bound
reaches it are read. Columns that aren't needed aren't read, so bounds come without the documents; where few terms are asked for
the scan skips row groups without them.

Cases: a null text is a document of no terms; a null target is ``und``; rows without an id can't be told apart and are
left out; of rows that share an id the one with the greatest text counts. A version is taken as it is: to
replace one, write under another.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import BM25_B, BM25_K1
from ..functions.text import terms as text_terms
from . import bm25
from .combinators import top_k

DOCUMENTS = 128
#: Up to so many different terms of a batch of questions are handed to the scan as a filter.
PUSHED = 1_000
#: Blocks that are sent to all tasks at most.
SENT = 100_000
#: Bands of length in each doubling.
BANDS = 4
KEYS = ["target", "version"]
BLOCKS = "term string, block long, n long, best double, posts array<struct<id:{id},part:double>>, target string, version string"
TOTALS = "n long, avg_length double, target string, version string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write(docs: DataFrame, versions: DataFrame, path: str, *, k1: float = BM25_K1, b: float = BM25_B) -> None:
    """Indexes documents (target, id, text) of the versions (target, version) that the folder hasn't yet."""
    from ..plans.build import stored

    spark, path = docs.sparkSession, path.rstrip("/")
    named = versions.select(F.coalesce("target", F.lit("und")).alias("target"), "version").distinct()
    new = named.join(_read(spark, f"{path}/totals", TOTALS).select(*KEYS), KEYS, "left_anti")
    own = docs.select(F.coalesce("target", F.lit("und")).alias("target"), "id", F.coalesce("text", F.lit("")).alias("text")).filter("id IS NOT NULL").join(new, "target")
    # Only texts of ids that several rows share are sent to be compared.
    shared = stored(spark, own.groupBy(*KEYS, "id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"), "block-shared")
    several = own.join(shared, [*KEYS, "id"], "left_semi").groupBy(*KEYS, "id").agg(F.max("text").alias("text"))
    own = own.join(shared, [*KEYS, "id"], "left_anti").select(*KEYS, "id", "text").unionByName(several)
    # Terms as one text, since texts are smaller than arrays of them; terms have no spaces.
    terms = own.select(*KEYS, "id", text_terms(F.col("text")).alias("terms"))
    sized = stored(spark, terms.select(*KEYS, "id", F.size("terms").cast("long").alias("length"), F.concat_ws(" ", "terms").alias("terms")), "block-terms")
    totals = stored(spark, sized.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length")), "block-totals")
    band = F.floor(F.log2(F.greatest("length", F.lit(1))) * BANDS).alias("band")
    bands = sized.groupBy(*KEYS, band).agg(F.ceil(F.count(F.lit(1)) / DOCUMENTS).alias("parts"))
    lacks = F.when(F.col("avg_length") == 0, F.lit(1.0)).otherwise(F.col("avg_length"))
    norm = k1 * (1 - b + b * F.greatest("length", F.lit(1)) / lacks)
    placed = sized.withColumn("band", band).join(bands, [*KEYS, "band"]).join(totals.select(*KEYS, "avg_length"), KEYS)
    placed = placed.select(*KEYS, "id", "terms", norm.alias("norm"), (F.col("band") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    # Documents are sent once, to their block; what follows needs no exchange, and a file has the terms of its blocks in order.
    words = placed.filter("terms != ''").repartition(*KEYS, "block").select(*KEYS, "block", "id", "norm", F.explode(F.split("terms", " ")).alias("term"))
    counted = words.groupBy(*KEYS, "block", "term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("norm").alias("norm"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + F.col("norm"))
    blocks = counted.withColumn("part", part).groupBy(*KEYS, "block", "term")
    blocks = blocks.agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("best"), F.array_sort(F.collect_list(F.struct("id", "part"))).alias("posts"))
    blocks = blocks.select("term", "block", "n", "best", "posts", *KEYS).sortWithinPartitions(*KEYS, "term", "block")
    for frame, name in ((blocks, "blocks"), (totals.select("n", "avg_length", *KEYS), "totals")):
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{path}/{name}")


def search(questions: DataFrame, versions: DataFrame, path: str, limit: int = 10, *, id_: str = "long", digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` best documents (target, question_id, id, score, rank) of each question (target, question_id, question) as
    ``bm25.search`` finds them, and (target, question_id, blocks, read): of how many blocks of its terms it read how many."""
    from ..plans.build import stored

    spark, path = questions.sparkSession, path.rstrip("/")
    asked = bm25.query_terms(questions.withColumn("target", F.coalesce("target", F.lit("und"))))
    asked = stored(spark, asked.join(versions.select(F.coalesce("target", F.lit("und")).alias("target"), "version").distinct(), "target"), "block-asked")
    blocks = _read(spark, f"{path}/blocks", BLOCKS.format(id=id_))
    few = asked.select("term").distinct().limit(PUSHED + 1).collect()
    if len(few) <= PUSHED:
        blocks = blocks.filter(F.col("term").isin([r.term for r in few]))
    bounds = stored(spark, blocks.select(*KEYS, "term", "block", "n", "best").join(asked.select(*KEYS, "term").distinct(), [*KEYS, "term"], "left_semi"), "block-bounds")
    df = bounds.groupBy(*KEYS, "term").agg(F.sum("n").alias("df")).join(_read(spark, f"{path}/totals", TOTALS), KEYS)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = stored(spark, asked.join(df, [*KEYS, "term"]).select(*KEYS, "question_id", "term", (F.col("qtf") * idf).alias("weight")), "block-weights")

    own = [*KEYS, "question_id"]
    upper = weights.join(bounds, [*KEYS, "term"]).groupBy(*own, "block").agg(F.sum(F.col("weight") * F.col("best")).alias("bound"), F.max("n").alias("n"), F.count(F.lit(1)).alias("lists"))
    upper = stored(spark, upper, "block-upper")
    # A block has as many documents as its longest list at least, so blocks up to limit documents are enough for a floor.
    before = Window.partitionBy(*own).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    first = top_k(upper, own, [F.desc("bound"), "block"], limit).withColumn("held", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("held") < limit)
    first = stored(spark, first.select(*own, "block", "lists"), "block-first")

    def scored(chosen: DataFrame) -> DataFrame:
        wanted = chosen.select(*own, "block").join(weights, own)
        some = chosen.select(*KEYS, "block").distinct()
        some = F.broadcast(some) if some.limit(SENT + 1).count() <= SENT else some
        posts = blocks.select(*KEYS, "term", "block", "posts").join(some, [*KEYS, "block"], "left_semi")
        hit = wanted.join(posts, [*KEYS, "term", "block"]).select(*own, "weight", F.explode("posts").alias("p"))
        return hit.groupBy(*own, F.col("p.id").alias("id")).agg(F.sum(F.col("weight") * F.col("p.part")).alias("score")).withColumn("score", F.round("score", digits))

    best = stored(spark, top_k(scored(first), own, [F.desc("score"), "id"], limit), "block-best")
    floors = best.filter(F.col("rank") == limit).select(*own, F.col("score").alias("floor"))
    # Scores are rounded, so a bound that is less than a step below the floor may still tie with it.
    rest = upper.join(first.select(*own, "block"), [*own, "block"], "left_anti").join(floors, own).filter(F.col("bound") >= F.col("floor") - 10.0**-digits)
    rest = stored(spark, rest.select(*own, "block", "lists"), "block-rest")
    found = top_k(best.drop("rank").unionByName(scored(rest)), own, [F.desc("score"), "id"], limit)
    read = first.unionByName(rest).groupBy(*own).agg(F.sum("lists").alias("read"))
    reads = upper.groupBy(*own).agg(F.sum("lists").alias("blocks")).join(read, own).select("target", "question_id", "blocks", "read")
    return found.select("target", "question_id", "id", "score", "rank"), reads
