"""Lexical retrieval: postings, BM25, prefix expansion, weighted top matches. Built-in expressions only.

Everything is a set of rows keyed by ``target``: postings are aggregated before they are shuffled, scores
join the (few) query terms to postings by term, and top-k is a ranked window that limits rows before the
exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BM25_B, BM25_K1, DEFAULT_TYPE_WEIGHT, EXPAND_PREFIX, EXPAND_TERMS, HINT_BOOST, LEXICAL_MIN, LEXICAL_RELATIVE, LEXICAL_STRONG, TYPE_WEIGHTS
from ..functions.text import terms as text_terms
from .combinators import top_k


def postings(docs: DataFrame, keep_stopwords: bool = False) -> DataFrame:
    """(target, id, term, tf) of documents (target, id, text)."""
    return docs.select("target", "id", F.explode(text_terms(F.col("text"), keep_stopwords)).alias("term")).groupBy("target", "id", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(posted: DataFrame, docs: DataFrame) -> DataFrame:
    """(target, id, length), 0 for documents without terms."""
    sums = posted.groupBy("target", "id").agg(F.sum("tf").alias("length"))
    return docs.select("target", "id").join(sums, ["target", "id"], "left").withColumn("length", F.coalesce("length", F.lit(0)))


def text_lengths(docs: DataFrame) -> DataFrame:
    """(target, id, length) of documents (target, id, text), without their terms being counted or sent; 0 without an id."""
    size = F.when(F.col("id").isNotNull(), F.greatest(F.size(text_terms(F.col("text"))), F.lit(0))).otherwise(0)
    return docs.groupBy("target", "id").agg(F.sum(size).cast("long").alias("length"))


def corpus(sized: DataFrame) -> DataFrame:
    return sized.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))


def term_stats(posted: DataFrame, totals: DataFrame) -> DataFrame:
    """(target, term, df, idf)."""
    df = posted.groupBy("target", "term").agg(F.count(F.lit(1)).alias("df"))
    n = F.greatest("n", F.lit(1))
    return df.join(totals, "target").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("target", "term", "df", "idf")


def query_terms(questions: DataFrame, keep_stopwords: bool = False) -> DataFrame:
    """(target, question_id, term, qtf) of questions (target, question_id, question)."""
    tokens = questions.select("target", "question_id", F.explode(text_terms(F.col("question"), keep_stopwords)).alias("term"))
    return tokens.groupBy("target", "question_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def expand(terms: DataFrame, vocabulary: DataFrame, prefix: int = EXPAND_PREFIX, per_term: int = EXPAND_TERMS) -> DataFrame:
    """Query terms, and for each that no document has (of ``prefix`` characters at least) up to ``per_term``
    vocabulary terms with its prefix, or shorter ones that begin it; nearest in length first. Prefixes meet
    in equi-joins on columns, so the vocabulary is never scanned for each term."""
    vocab = vocabulary.select("target", F.col("term").alias("hit")).distinct()
    unknown = terms.filter(F.length("term") >= prefix).join(vocab.select("target", F.col("hit").alias("term")), ["target", "term"], "left_anti")
    long_ = vocab.filter(F.length("hit") >= prefix).withColumn("head", F.substring("hit", 1, prefix))
    hits = unknown.withColumn("head", F.substring("term", 1, prefix)).join(long_, ["target", "head"])
    heads = F.array(*(F.substring("term", 1, k) for k in range(1, prefix)))
    short = vocab.filter(F.length("hit") < prefix).withColumn("head", F.col("hit"))
    hits = hits.unionByName(unknown.withColumn("head", F.explode(heads)).join(short, ["target", "head"]))
    near = top_k(hits, ["target", "question_id", "term"], [F.abs(F.length("hit") - F.length("term")), "hit"], per_term)
    added = near.select("target", "question_id", F.col("hit").alias("term"), "qtf")
    return terms.unionByName(added).groupBy("target", "question_id", "term").agg(F.sum("qtf").alias("qtf"))


def scores(terms: DataFrame, posted: DataFrame, sized: DataFrame, totals: DataFrame, stats: DataFrame, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(target, question_id, id, score) of documents with a query term; a term counts as often as the query has it."""
    lacks = F.when(F.coalesce("avg_length", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("avg_length"))
    norm = sized.join(totals, "target").select("target", "id", (k1 * (1 - b + b * F.greatest("length", F.lit(1)) / lacks)).alias("norm"))
    hit = terms.join(stats.select("target", "term", "idf"), ["target", "term"]).join(posted, ["target", "term"]).join(norm, ["target", "id"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + F.col("norm"))
    return hit.groupBy("target", "question_id", "id").agg(F.sum(part).alias("score")).filter("score > 0")


def vocabulary(docs: DataFrame, keep_stopwords: bool = False) -> DataFrame:
    """(target, term) of all documents; a document's own repeats go before anything is shuffled."""
    return docs.select("target", F.explode(F.array_distinct(text_terms(F.col("text"), keep_stopwords))).alias("term")).distinct()


def score_documents(terms: DataFrame, docs: DataFrame, *, b: float = BM25_B, keep_stopwords: bool = False) -> DataFrame:
    """``scores`` of query terms (target, question_id, term, qtf) over documents (target, id, text). Documents are read
    into terms once; their lengths are the terms' number, and only terms that a question has are counted and shuffled."""
    from ..plans.build import stored

    terms = stored(docs.sparkSession, terms, "query-terms")
    read = stored(docs.sparkSession, docs.select("target", "id", text_terms(F.col("text"), keep_stopwords).alias("terms")), "terms")
    sized = read.groupBy("target", "id").agg(F.sum(F.greatest(F.size("terms"), F.lit(0))).cast("long").alias("length"))
    totals = corpus(sized)
    asked = terms.select("target", "term").distinct()
    posted = read.select("target", "id", F.explode("terms").alias("term")).join(asked, ["target", "term"], "left_semi").groupBy("target", "id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return scores(terms, posted, sized, totals, term_stats(posted, totals), b=b)


def search(questions: DataFrame, docs: DataFrame, limit: int = 10, *, b: float = BM25_B, keep_stopwords: bool = False, digits: int = 6) -> DataFrame:
    """The ``limit`` best documents of each question. Scores are rounded before they are ranked, so the order doesn't
    depend on the order of a sum; ties go to the smaller id."""
    found = score_documents(query_terms(questions, keep_stopwords), docs, b=b, keep_stopwords=keep_stopwords)
    return top_k(found.withColumn("score", F.round("score", digits)), ["target", "question_id"], [F.desc("score"), "id"], limit)


def weighted(found: DataFrame, types: DataFrame, hints: DataFrame | None, limit: int, order: str = "seq") -> DataFrame:
    """Scores times the weight of the node's type (twice where the question hints at it); nothing where the best
    is under the minimum, else those near enough to the best. Adds best and confidence.

    types: (target, id, type, seq); hints: (question_id, type)."""
    weights = F.create_map(*(F.lit(x) for pair in TYPE_WEIGHTS.items() for x in pair))
    own = found.join(types, ["target", "id"]).withColumn("score", F.col("score") * F.coalesce(F.try_element_at(weights, F.col("type")), F.lit(DEFAULT_TYPE_WEIGHT)))
    if hints is not None:
        own = own.join(hints.withColumn("_hinted", F.lit(True)), ["question_id", "type"], "left")
        own = own.withColumn("score", F.when(F.col("_hinted"), F.col("score") * HINT_BOOST).otherwise(F.col("score"))).drop("_hinted")
    from pyspark.sql import Window

    own = own.withColumn("score", F.round("score", 6)).withColumn("best", F.max("score").over(Window.partitionBy("question_id")))
    own = own.filter((F.col("best") >= LEXICAL_MIN) & (F.col("score") >= F.greatest(F.lit(LEXICAL_MIN), F.col("best") * LEXICAL_RELATIVE)))
    own = own.withColumn("confidence", F.when(F.col("best") >= LEXICAL_STRONG, "MEDIUM").otherwise("LOW"))
    return top_k(own, ["question_id"], [F.desc("score"), order], limit)
