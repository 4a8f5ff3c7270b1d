"""Scalar functions and text operators over the text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blockmax, bm25, combinators
from ..streaming import index
from .build import shared_folder, stored
from .views import TARGET, table

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
#: RE2 has no look-ahead, so humps are first parted by underscores.
PIECES = r"regexp_extract_all(regexp_replace(regexp_replace({w}, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([A-Z])([0-9])', '\1_\2', 'g'), '[A-Z]+[a-z0-9]*|[a-z0-9]+')"


def tokens_sql(name: str, source: str, id_: str, text: str, stop: bool = True) -> str:
    """A CTE (id, term) with a row for each token of a text column."""
    pieces = PIECES.format(w="w")
    keep = f" AND term NOT IN ({STOP})" if stop else ""
    return f"""{name} AS (SELECT id, term FROM (
  SELECT id, unnest(list_concat([lower(w)], [lower(x) for x in {pieces}])) AS term FROM (
    SELECT {id_} AS id, unnest(regexp_extract_all(coalesce({text}, ''), '[A-Za-z_][A-Za-z0-9_]*|\\d+')) AS w FROM {source}))
  WHERE length(term) >= 2{keep})"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.lit(TARGET).alias("target"), F.col("doc_id").alias("id"), "text")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS INT) AS lines FROM documents")
def count_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.count_lines(F.col("text")).alias("lines"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(string_split(string_split(text, '{')[1], chr(10))[1], '\s+', ' ', 'g')), 1, 160) AS signature FROM documents")
def first_line_sig(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_line_signature(F.col("text")).alias("signature"))


@query(r"SELECT page_id, replace(replace(url, '/', '\'), '\', '/') AS posix, regexp_replace('./' || url, '^[./]+', '') AS bare FROM pages")
def posix_path(spark, sf_dir):
    back = F.replace("url", F.lit("/"), F.lit("\\"))
    return table(spark, sf_dir, "pages").select("page_id", X.posix(back).alias("posix"), X.without_leading_dots(F.concat(F.lit("./"), "url")).alias("bare"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), m AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM l)
SELECT doc_id, CASE WHEN len(p) >= 2 THEN array_to_string(p[2:4], chr(10)) ELSE '[line range out of bounds]' END AS snippet FROM m""")
def snippet_slice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), F.lit(2), F.lit(4)).alias("snippet"))


@query("SELECT p_partkey, array_to_string(list_concat([lower(w)], [lower(x) for x in " + PIECES.format(w="w") + "]), ' ') AS pieces FROM (SELECT p_partkey, string_split(p_name, ' ')[1] || upper(substr(string_split(p_name, ' ')[2], 1, 1)) || substr(string_split(p_name, ' ')[2], 2) || upper(substr(p_type, 1, 2)) || upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) AS w FROM part)")
def split_identifier(spark, sf_dir):
    parts = F.split("p_name", " ")
    word = F.concat(F.element_at(parts, 1), F.initcap(F.element_at(parts, 2)), F.upper(F.substring("p_type", 1, 2)), F.initcap("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.split_identifier(word), " ").alias("pieces"))


@query("WITH " + tokens_sql("k", "pages", "page_id", "html") + " SELECT id AS page_id, term, CAST(count(*) AS BIGINT) AS tf FROM k GROUP BY id, term")
def html_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "pages").select(F.lit(TARGET).alias("target"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return bm25.postings(docs).select(F.col("id").alias("page_id"), "term", "tf")


@query("WITH " + tokens_sql("k", "documents", "doc_id", "text") + " SELECT id AS doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM k GROUP BY id, term")
def tokenize_tf(spark, sf_dir):
    return bm25.postings(_docs(spark, sf_dir)).select(F.col("id").alias("doc_id"), "term", "tf")


STATS = "WITH " + tokens_sql("k", "documents", "doc_id", "text") + """, p AS (SELECT id, term, count(*) AS tf FROM k GROUP BY id, term),
l AS (SELECT d.doc_id AS id, coalesce(sum(p.tf), 0) AS len FROM documents d LEFT JOIN p ON p.id = d.doc_id GROUP BY 1),
c AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l), s AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM c) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term)"""


@query(STATS + " SELECT CAST((SELECT n FROM c) AS BIGINT) AS n, round((SELECT avg_len FROM c), 6) AS avg_length, CAST((SELECT count(*) FROM s) AS BIGINT) AS terms")
def doc_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    terms = bm25.vocabulary(docs).agg(F.count(F.lit(1)).alias("terms"))
    return bm25.corpus(bm25.text_lengths(docs)).crossJoin(terms).select("n", F.round("avg_length", 6).alias("avg_length"), "terms")


@query(STATS + " SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM s")
def idf(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    posted = bm25.postings(docs)
    return bm25.term_stats(posted, bm25.corpus(bm25.text_lengths(docs))).select("term", "df", F.round("idf", 6).alias("idf"))


BENCH = tokens_sql("b", "benchmark", "item_id", "text") + ", q AS (SELECT id AS qid, term, count(*) AS qtf FROM b GROUP BY id, term)"


def _scores(b: float, digits: int = 6) -> str:
    return f"r AS (SELECT qid, p.id, round(sum(qtf * s.idf * p.tf * 2.5 / (p.tf + 1.5 * (1 - {b} + {b} * greatest(l.len, 1) / (SELECT avg_len FROM c)))), {digits}) AS score FROM q JOIN s USING (term) JOIN p USING (term) JOIN l ON l.id = p.id GROUP BY qid, p.id)"


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.lit(TARGET).alias("target"), F.col("item_id").alias("question_id"), F.col("text").alias("question"))


TOP_FIVE = STATS + f", {BENCH}, {_scores(0.75)} SELECT qid AS item_id, id AS doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 5"


@query(TOP_FIVE)
def bm25_topk(spark, sf_dir):
    found = bm25.search(_questions(spark, sf_dir), _docs(spark, sf_dir), 5)
    return found.select(F.col("question_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query(TOP_FIVE)
def stored_index_topk(spark, sf_dir):
    """The same from a stored index that took the documents in two batches, the odd ids with other texts at first."""
    docs, path = _docs(spark, sf_dir), f"{shared_folder(spark)}/loomgraph/index-{uuid.uuid4().hex}"
    index.add(docs.withColumn("text", F.when(F.col("id") % 2 == 0, F.col("text")).otherwise("an older version")), path, 0)
    index.add(docs, path, 1)
    found = index.search(_questions(spark, sf_dir), path, 5)
    return found.select(F.col("question_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query(TOP_FIVE)
def block_index_topk(spark, sf_dir):
    """The same from an index in blocks, which is asked to take its version a second time and has it already."""
    docs, path = _docs(spark, sf_dir), f"{shared_folder(spark)}/loomgraph/blocks-{uuid.uuid4().hex}"
    versions = spark.createDataFrame([(TARGET, "1")], "target string, version string")
    for _ in range(2):
        blockmax.write(docs, versions, path)
    found, _ = blockmax.search(_questions(spark, sf_dir), versions, path, 5)
    return found.select(F.col("question_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


KINDS = "CASE lang WHEN 'en' THEN 'function' WHEN 'de' THEN 'class' WHEN 'fr' THEN 'macro' ELSE 'note' END"


@query(STATS + f", {BENCH}, {_scores(0.4, 12)}, w AS (SELECT qid, id, round(score * CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.9 WHEN 'fr' THEN 0.6 ELSE 0.7 END * CASE WHEN qid % 2 = 0 AND lang = 'de' THEN 2.0 ELSE 1.0 END, 6) AS score FROM r JOIN documents ON doc_id = id WHERE score > 0), m AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM w) SELECT qid AS item_id, id AS doc_id, score, confidence, CAST(rank AS INT) AS rank FROM (SELECT qid, id, score, CASE WHEN best >= 3.0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m WHERE best >= 0.8 AND score >= greatest(0.8, best * 0.35)) WHERE rank <= 5")
def lexical_weighted(spark, sf_dir):
    """Languages stand for kinds of symbols; even questions hint at classes."""
    docs, questions = _docs(spark, sf_dir), _questions(spark, sf_dir)
    found = bm25.score_documents(bm25.query_terms(questions), docs, b=0.4)
    kind = F.when(F.col("lang") == "en", "function").when(F.col("lang") == "de", "class").when(F.col("lang") == "fr", "macro").otherwise("note")
    types = table(spark, sf_dir, "documents").select(F.lit(TARGET).alias("target"), F.col("doc_id").alias("id"), kind.alias("type"), F.col("doc_id").alias("seq"))
    hints = questions.filter("question_id % 2 = 0").select("question_id", F.lit("class").alias("type"))
    out = bm25.weighted(found, types, hints, 5)
    return out.select(F.col("question_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "confidence", "rank")


@query(STATS + ", " + tokens_sql("b", "(SELECT item_id, text FROM benchmark)", "item_id", "text") + """, q AS (SELECT id AS qid, term || 'zz' AS term, count(*) AS qtf FROM b GROUP BY 1, 2),
u AS (SELECT * FROM q WHERE term NOT IN (SELECT term FROM s) AND length(term) >= 4),
h AS (SELECT qid, u.term, qtf, s.term AS hit, row_number() OVER (PARTITION BY qid, u.term ORDER BY abs(length(s.term) - length(u.term)), s.term) AS r FROM u JOIN s ON starts_with(s.term, substr(u.term, 1, 4)) OR starts_with(u.term, substr(s.term, 1, 4))),
a AS (SELECT qid, term, qtf FROM q UNION ALL SELECT qid, hit, qtf FROM h WHERE r <= 4)
SELECT qid AS item_id, term, CAST(sum(qtf) AS BIGINT) AS qtf FROM a GROUP BY qid, term""")
def prefix_expand(spark, sf_dir):
    vocabulary = stored(spark, bm25.vocabulary(_docs(spark, sf_dir)), "vocabulary")
    terms = bm25.query_terms(_questions(spark, sf_dir)).withColumn("term", F.concat("term", F.lit("zz")))
    return bm25.expand(terms, vocabulary).select(F.col("question_id").alias("item_id"), "term", "qtf")


@query(r"""SELECT conv_id, turn, coalesce(CASE WHEN turn % 4 = 0 THEN 'ANSWER: ' || trim(text, ' ' || chr(10)) WHEN turn % 4 = 1 THEN trim(text, ' ' || chr(10)) WHEN turn % 4 = 2 THEN trim(text, ' ' || chr(10) || ':') ELSE trim(text, ' ' || chr(10)) END, '') AS answer FROM (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS text FROM conversations)""")
def normalize_answer(spark, sf_dir):
    """Texts wrapped as leaked completions: a quoted and a real ANSWER, a think block, a preamble, none."""
    body = F.trim("text", F.lit(" \n"))
    shape = F.col("turn") % 4
    raw = F.when(shape == 0, F.concat(F.lit("plan: say ANSWER: x\nANSWER: "), body)).when(shape == 1, F.concat(F.lit("<think>a\nb</think> "), body)).when(shape == 2, F.concat(F.lit("Let me think: \n"), body)).otherwise(body)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalize_answer(raw).alias("answer"))


@query("SELECT doc_id, q || chr(10) || 'd' || doc_id || chr(10) || 'function declaration' || CASE WHEN source = '' THEN '' ELSE chr(10) || source END AS document FROM (SELECT doc_id, source, source || '.d' || doc_id AS q FROM documents)")
def symbol_document(spark, sf_dir):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    none = F.lit(None).cast("string")
    text = X.document_for(F.concat_ws(".", "source", name), name, F.lit("function_declaration"), none, F.lit(""), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("document"))


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents) WHERE rank <= 3")
def top_per_group(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return combinators.top_k(own, ["source"], [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id", "rank")
