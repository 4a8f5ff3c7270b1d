"""Retrieval layers, vectors and answer checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import ROLE_EXPAND, ROLE_WORDS
from ..operators import context, retrieve, semantic
from .views import TARGET, nodes, table

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


ROLES = ", ".join(f"('{w}', '{t}')" for w, r in ROLE_WORDS.items() for t in ROLE_EXPAND.get(r, (r,)))


@query(f"""WITH roles(word, type) AS (VALUES {ROLES}), t AS (SELECT conv_id * 100 + turn AS id, unnest(regexp_extract_all(lower('which ' || CASE turn % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'property' ELSE 'hooks' END || ' ' || coalesce(text, '')), '[a-z_]+')) AS word FROM conversations)
SELECT DISTINCT id AS question_id, type FROM t JOIN roles USING (word)""")
def type_hints(spark, sf_dir):
    shape = F.col("turn") % 3
    word = F.when(shape == 0, "method").when(shape == 1, "property").otherwise("hooks")
    questions = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.concat_ws(" ", F.lit("which"), word, "text").alias("question"))
    return retrieve.type_hints(questions)


def _nation_nodes(spark, sf_dir):
    """Nations as classes with their customers of the first thousand as members entry<n>."""
    all_ = nodes(spark, sf_dir).filter("type IN ('class', 'method')")
    name = F.when(F.col("type") == "class", F.concat(F.lit("Nation"), F.substring("id", 2, 9))).otherwise(F.concat(F.lit("entry"), F.col("seq.n").cast("string")))
    extra = {"signature": "string", "doc": "string", "arity": "int"}
    return all_.withColumn("name", name).withColumns({c: F.lit(None).cast(t) for c, t in extra.items()}).withColumn("file", F.col("parent"))


def _asked(spark, sf_dir):
    """A question for each customer: an own member, one of another nation, none at all, or an unknown owner."""
    own = table(spark, sf_dir, "customer")
    shape = F.col("c_custkey") % 4
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey")
    dot = F.when(shape == 0, F.concat(F.lit("Nation"), nation.cast("string"), F.lit(".entry"), key)).when(shape == 1, F.concat(F.lit("Nation"), ((nation + 1) % 25).cast("string"), F.lit(".entry"), key)).when(shape == 2, F.concat(F.lit("Nation"), nation.cast("string"), F.lit(".nothing"), key)).otherwise(F.concat(F.lit("Lib.entry"), key))
    return own.select(F.lit(TARGET).alias("target"), F.col("c_custkey").alias("question_id"), F.concat(F.lit("what does "), dot, F.lit(" do?")).alias("question"))


@query("SELECT c_custkey AS question_id, 'C' || c_custkey AS id FROM customer WHERE c_custkey % 4 = 0")
def qualified_match(spark, sf_dir):
    own = _nation_nodes(spark, sf_dir)
    names = retrieve.by_qualified_name(own, retrieve.qualified_names(own))
    hits, _ = retrieve.qualified_layer(_asked(spark, sf_dir), own, names)
    return hits.select("question_id", "id")


@query("""SELECT c_custkey AS question_id, CASE c_custkey % 4 WHEN 1 THEN '`entry' || c_custkey || '` exists in this codebase but not as a member of `Nation' || ((c_nationkey + 1) % 25) || '`.'
ELSE '`Nation' || c_nationkey || '` exists in this codebase but it has no member named `nothing' || c_custkey || '`.' END AS reason FROM customer WHERE c_custkey % 4 IN (1, 2)""")
def qualified_refuse(spark, sf_dir):
    own = _nation_nodes(spark, sf_dir)
    names = retrieve.by_qualified_name(own, retrieve.qualified_names(own))
    _, refused = retrieve.qualified_layer(_asked(spark, sf_dir), own, names)
    return refused.select("question_id", "reason")


@query("""SELECT c_custkey AS question_id, 'The question names `useCart' || c_custkey || '`' || CASE WHEN c_custkey % 3 = 2 THEN ', `auth_x' || c_custkey || '`' ELSE '' END || ', and no symbol with that name exists in this codebase.' AS reason FROM customer WHERE c_custkey % 3 > 0""")
def named_miss(spark, sf_dir):
    own = _nation_nodes(spark, sf_dir)
    key = F.col("c_custkey").cast("string")
    miss = F.when(F.col("c_custkey") % 3 == 0, F.lit("Nation natioN entrY nothing")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("useCart"), key)).otherwise(F.concat(F.lit("useCart"), key, F.lit(" or auth_x"), key, F.lit(" or useCart"), key))
    asked = table(spark, sf_dir, "customer").select(F.lit(TARGET).alias("target"), F.col("c_custkey").alias("question_id"), F.concat(F.lit("where is "), miss, F.lit(" ?")).alias("question"))
    return retrieve.named_misses(asked, own, retrieve.qualified_names(own)).select("question_id", "reason")


@query("""SELECT c_custkey AS question_id, id FROM (SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN ['N' || c_nationkey, 'C' || c_custkey] WHEN 1 THEN ['N' || c_nationkey] ELSE [] END) AS id FROM customer)""")
def exact_match(spark, sf_dir):
    """Even where both are named, a role word narrows the hits; other case doesn't match."""
    own = _nation_nodes(spark, sf_dir)
    nation, member = F.concat(F.lit("Nation"), F.col("c_nationkey").cast("string")), F.concat(F.lit("entry"), F.col("c_custkey").cast("string"))
    shape = F.col("c_custkey") % 3
    text = F.when(shape == 0, F.concat_ws(" ", nation, F.lit("and"), member)).when(shape == 1, F.concat_ws(" ", F.lit("class"), nation, F.lit("and"), member)).otherwise(F.concat_ws(" ", F.lower(nation), F.upper(member)))
    asked = table(spark, sf_dir, "customer").select(F.lit(TARGET).alias("target"), F.col("c_custkey").alias("question_id"), text.alias("question"))
    return retrieve.exact_layer(asked, own, retrieve.type_hints(asked)).select("question_id", "id")


@query(None)
def close_matches(spark, sf_dir):
    """Names close to the words of the parts' brands; SQL has no matching-blocks ratio."""
    own = table(spark, sf_dir, "part").select(F.lit(TARGET).alias("target"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.lit("function").alias("type"), F.lit(None).cast("string").alias("parent"), F.col("p_partkey").alias("seq"))
    asked = table(spark, sf_dir, "nation").select(F.lit(TARGET).alias("target"), F.col("n_nationkey").alias("question_id"), F.concat_ws(" ", F.lit("find"), F.lower("n_name"), F.lit("almond_antique")).alias("question"))
    found = retrieve.suggestions(asked, own, own.select("target", "id", F.col("name").alias("qualified")))
    return found.select("question_id", F.array_join("suggestions", ",").alias("suggestions"))


@query("""WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT qid, vec_id, round(CASE WHEN list_dot_product(q.e, q.e) = 0 OR list_dot_product(v.e, v.e) = 0 THEN 0.0 ELSE list_cosine_similarity(q.e, v.e) END, 6) AS score FROM q, v)
SELECT qid AS question_id, vec_id AS id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5 AND score > 0""")
def cosine_topk(spark, sf_dir):
    """Vectors whose id is divisible by 100 are the stated set of questions."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    asked = own.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("vector").alias("question_vector"))
    return semantic.cosine_top_k(asked, own.select(F.col("vec_id").alias("id"), "vector")).select("question_id", "id", "score", "rank")


@query("""WITH l AS (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY c_nationkey), q AS (SELECT s_suppkey, c_nationkey, k, s_suppkey % 5 AS shape FROM supplier JOIN l ON s_nationkey = c_nationkey)
SELECT s_suppkey AS question_id, CASE shape WHEN 0 THEN 'qualified' WHEN 1 THEN 'qualified-miss' WHEN 2 THEN 'named-symbol-miss' WHEN 3 THEN 'exact' ELSE 'none' END AS strategy,
CASE WHEN shape IN (0, 3) THEN 'HIGH' ELSE 'NONE' END AS confidence,
CASE shape WHEN 1 THEN '`Nation' || c_nationkey || '` exists in this codebase but it has no member named `nothing`.'
WHEN 2 THEN 'The question names `useCart' || s_suppkey || '`, and no symbol with that name exists in this codebase.' WHEN 4 THEN 'No symbol in the knowledge graph matched this question.' END AS reason,
CASE shape WHEN 0 THEN 'C' || k WHEN 3 THEN 'N' || c_nationkey || ',C' || k END AS ids FROM q""")
def layered_retrieve(spark, sf_dir):
    """The whole layered retrieval over nations and customers, with a question for each supplier whose nation has
    customers: a member, an unknown member, an unknown symbol, two exact names, or nothing. Suggestions, which have no SQL
    form, are ``retrieve_layers``'."""
    least = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("k"))
    own = table(spark, sf_dir, "supplier").join(least, F.col("s_nationkey") == F.col("c_nationkey"))
    nation, member, shape = F.concat(F.lit("Nation"), F.col("c_nationkey")), F.concat(F.lit("entry"), F.col("k")), F.col("s_suppkey") % 5
    text = (
        F.when(shape == 0, F.concat(F.lit("what does "), nation, F.lit("."), member, F.lit(" do?"))).when(shape == 1, F.concat(F.lit("what does "), nation, F.lit(".nothing do?")))
        .when(shape == 2, F.concat(F.lit("where is useCart"), F.col("s_suppkey"), F.lit(" ?"))).when(shape == 3, F.concat_ws(" ", nation, F.lit("and"), member)).otherwise(F.lit("zq vk"))
    )
    asked = own.select(F.lit(TARGET).alias("target"), F.col("s_suppkey").alias("question_id"), text.alias("question"))
    matches, outcome = retrieve.retrieve(asked, _nation_nodes(spark, sf_dir))
    return _with_ids(matches, outcome).select("question_id", "strategy", "confidence", "reason", "ids")


def _with_ids(matches, outcome):
    ids = matches.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("ids"))
    return outcome.join(ids, "question_id", "left")


@query("""SELECT n_nationkey AS question_id, 'f' || md5('k' || n_nationkey) AS suggestions FROM nation""")
def refusal_suggestions(spark, sf_dir):
    """What a refusal offers: nations are symbols named by a digest, customers have short names, and each nation's question
    spells its own with the first two letters changed, which is close to that one alone and begins like none."""
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("key")).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey"))))
    texts = {"file": "string", "signature": "string", "doc": "string", "parent": "string"}
    name = F.when(F.startswith("key", F.lit("c")), F.concat(F.lit("row"), F.substring("key", 2, 9))).otherwise(F.concat(F.lit("f"), F.md5("key")))
    all_ = own.select(F.lit(TARGET).alias("target"), F.col("key").alias("id"), name.alias("name"), F.lit("function").alias("type"), F.col("key").alias("seq")).withColumns({c: F.lit(None).cast(t) for c, t in texts.items()})
    spelled = F.concat(F.lit("z_"), F.substring(F.md5(F.concat(F.lit("k"), F.col("n_nationkey"))), 2, 31))
    asked = table(spark, sf_dir, "nation").select(F.lit(TARGET).alias("target"), F.col("n_nationkey").alias("question_id"), F.concat(F.lit("is "), spelled, F.lit(" ok")).alias("question"))
    _, outcome = retrieve.retrieve(asked, all_)
    return outcome.select("question_id", F.array_join("suggestions", ",").alias("suggestions"))


@query(None)
def retrieve_layers(spark, sf_dir):
    """The whole layered retrieval over all nations and customers, with a question for each nation that has
    customers: a member, an unknown member, an unknown symbol, exact names, words of names, or nothing."""
    own = _nation_nodes(spark, sf_dir)
    least = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("k"))
    nation, member, shape = F.concat(F.lit("Nation"), F.col("c_nationkey")), F.concat(F.lit("entry"), F.col("k")), F.col("c_nationkey") % 6
    text = (
        F.when(shape == 0, F.concat(F.lit("what does "), nation, F.lit("."), member, F.lit(" do?"))).when(shape == 1, F.concat(F.lit("what does "), nation, F.lit(".nothing do?")))
        .when(shape == 2, F.concat(F.lit("where is useCart"), F.col("k"), F.lit(" ?"))).when(shape == 3, F.concat_ws(" ", nation, F.lit("and"), member))
        .when(shape == 4, F.concat_ws(" ", F.lower(nation), F.lit("members"))).otherwise(F.lit("zzqx vvkw"))
    )
    asked = least.select(F.lit(TARGET).alias("target"), F.col("c_nationkey").alias("question_id"), text.alias("question"))
    matches, outcome = retrieve.retrieve(asked, own)
    rows = _with_ids(matches, outcome)
    return rows.select("question_id", "strategy", "confidence", "reason", "ids", F.array_join("suggestions", ",").alias("suggestions"))


def _answers(spark, sf_dir):
    """Assistant turns with a citation: right, of other lines, or of another file; and a name: real or invented."""
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant' AND text IS NOT NULL")
    key = F.col("conv_id") * 100 + F.col("turn")
    shape = F.col("turn") % 4
    cite = F.when(shape == 1, F.lit(".\\src\\a.py#L1-9")).when(shape == 3, F.lit("src/a.py#L2-3")).otherwise(F.lit("src/b.py # L1 - 9"))
    name = F.when(F.col("conv_id") % 2 == 0, F.lit("`Shop.sell`")).otherwise(F.lit("`Ghost.walk` `a.py`"))
    return own.select(key.alias("question_id"), F.lit(TARGET).alias("target"), F.concat_ws(" ", "text", cite, name).alias("answer"))


def _answer_blocks(spark, sf_dir):
    return _answers(spark, sf_dir).select("question_id", "target", F.lit(1).alias("rank"), F.lit("src/a.py::Shop").alias("id"), F.lit("sell").alias("name"), F.lit("Shop.sell").alias("qualified"), F.lit("src/a.py").alias("file"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"))


ASSISTANT = "a AS (SELECT conv_id * 100 + turn AS question_id, conv_id, turn FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)"


@query(f"""WITH {ASSISTANT} SELECT question_id, 'fabricated_range' AS kind, CASE WHEN turn % 4 = 3 THEN 'The answer cites `src/a.py#L2-3`, which is not one of the real graph ranges — likely a subdivided or invented location.'
ELSE 'The answer cites `src/b.py#L1-9`, but that file was not part of the facts provided.' END AS message FROM a WHERE turn % 4 <> 1""")
def verify_ranges(spark, sf_dir):
    return context.fabricated(_answers(spark, sf_dir), _answer_blocks(spark, sf_dir)).select("question_id", "kind", "message")


@query(f"""WITH {ASSISTANT} SELECT question_id, 'The answer uses none of the real names it was given (e.g. `Shop.sell`), so it may have renamed or substituted the symbol.' AS message FROM a JOIN conversations c USING (conv_id, turn) WHERE a.conv_id % 2 = 1 AND NOT contains(c.text, 'sell')""")
def verify_renamed(spark, sf_dir):
    return context.renamed(_answers(spark, sf_dir), _answer_blocks(spark, sf_dir)).select("question_id", "message")


def _shop(spark):
    """A graph of one class with a member, and its qualified names."""
    rows = [(TARGET, "src/a.py", "a.py", "file", None, "src/a.py", 0), (TARGET, "src/a.py::Shop", "Shop", "class", "src/a.py", "src/a.py", 1), (TARGET, "src/a.py::Shop::sell", "sell", "method", "src/a.py::Shop", "src/a.py", 2)]
    own = spark.createDataFrame(rows, "target string, id string, name string, type string, parent string, file string, seq int")
    return own, retrieve.qualified_names(own)


@query(f"""WITH {ASSISTANT} SELECT question_id, kind, severity, message FROM (
SELECT a.question_id, 'invented_symbol' AS kind, 'warning' AS severity, 'The answer mentions `Ghost.walk`, which does not exist in the knowledge graph under that name.' AS message FROM a WHERE conv_id % 2 = 1 AND turn % 8 <> 5
UNION ALL SELECT a.question_id, 'renamed_symbol', 'error', 'The answer uses none of the real names it was given (e.g. `Shop.sell`), so it may have renamed or substituted the symbol.' FROM a JOIN conversations c USING (conv_id, turn) WHERE a.conv_id % 2 = 1 AND NOT contains(c.text, 'sell')
UNION ALL SELECT question_id, 'fabricated_range', 'error', CASE WHEN turn % 4 = 3 THEN 'The answer cites `src/a.py#L2-3`, which is not one of the real graph ranges — likely a subdivided or invented location.'
ELSE 'The answer cites `src/b.py#L1-9`, but that file was not part of the facts provided.' END FROM a WHERE turn % 4 <> 1)""")
def verify_invented(spark, sf_dir):
    """All checks of an answer, against the names of a graph and of the facts; some questions' facts name ``Ghost.walk`` as
    a caller, so it isn't invented there."""
    caller = F.when((F.col("question_id") % 100) % 8 == 5, F.array(F.struct(F.lit("Ghost.walk").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    none = F.array().cast("array<struct<name:string>>")
    blocks = _answer_blocks(spark, sf_dir).withColumns({"callers": caller, "callees": none, "renders": none, "rendered_by": none})
    return context.verify(_answers(spark, sf_dir), blocks, *_shop(spark)).select("question_id", "kind", "severity", "message")


@query(f"WITH {ASSISTANT} SELECT question_id, CASE WHEN turn % 4 <> 1 OR (conv_id % 2 = 1 AND NOT contains(text, 'sell')) THEN 'error' ELSE 'warning' END AS worst FROM a JOIN conversations c USING (conv_id, turn) WHERE turn % 4 <> 1 OR conv_id % 2 = 1")
def worst_severity(spark, sf_dir):
    answers, blocks = _answers(spark, sf_dir), _answer_blocks(spark, sf_dir)
    known = context.known_names(*_shop(spark))
    found = context.fabricated(answers, blocks).union(context.renamed(answers, blocks)).union(context.invented(answers, known))
    return found.groupBy("question_id").agg(context.worst_severity().alias("worst"))


@query("SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) - count(DISTINCT CASE WHEN (quality = 0) = (toxic = 0) THEN doc_id END) AS BIGINT) AS clean FROM labels")
def smoke_rollup(spark, sf_dir):
    """labels as a question spec: quality 0 must be refused, toxic 1 stands for a refusal."""
    from ..plans.smoke import rollup

    own = table(spark, sf_dir, "labels").select(F.lit(TARGET).alias("target"), F.col("doc_id").cast("string").alias("question"), (F.col("quality") == 0).alias("must_refuse"), (F.col("toxic") == 0).alias("answered"))
    return rollup(own)


