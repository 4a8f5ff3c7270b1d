"""State of graphs, question specs, and what models say about them, over the relational tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import context, graph, rollups, semantic
from . import answers, smoke
from .build import Graph
from .catalogue_graph import QUALIFIED, _with
from .catalogue_search import ASSISTANT, _answer_blocks, _answers, _nation_nodes, _shop
from .views import NV, TARGET, call_sites, nodes, table

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


@query(_with(NV, QUALIFIED) + """SELECT l_orderkey, l_linenumber, l_partkey, id, coalesce(qualified, id) AS label FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'gone' ELSE 'S' END || l_suppkey AS id FROM lineitem) LEFT JOIN qn USING (id)""")
def symbol_labels(spark, sf_dir):
    """Suppliers of lineitems by their qualified names; those of returned ones aren't in the graph and keep their id."""
    own = table(spark, sf_dir, "lineitem").withColumn("id", F.concat(F.when(F.col("l_returnflag") == "R", "gone").otherwise("S"), "l_suppkey"))
    ids = own.select(F.lit(TARGET).alias("target"), "id", "l_orderkey", "l_linenumber", "l_partkey")
    return graph.labels(ids, graph.qualified_names(nodes(spark, sf_dir))).select("l_orderkey", "l_linenumber", "l_partkey", "id", "label")


@query("""WITH d AS (SELECT s_nationkey AS nation, 'S' || min(s_suppkey) AS id FROM supplier GROUP BY 1),
m AS (SELECT o_orderkey % 100 AS q, o_custkey AS place, coalesce(d.id, 'C' || o_custkey) AS id FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN d ON d.nation = c_nationkey)
SELECT q AS question_id, id, min(place) AS rank FROM m GROUP BY q, id""")
def preferred_definitions(spark, sf_dir):
    """Matches that are prototypes (customers) give way to the first function (supplier) of their name (the nation)."""
    def part(name, prefix, key, nation, type_):
        return table(spark, sf_dir, name).select(F.lit(TARGET).alias("target"), F.concat(F.lit(prefix), F.col(key)).alias("id"), F.col(nation).cast("string").alias("name"), F.lit(type_).alias("type"), F.col(key).alias("seq"))

    own = part("customer", "C", "c_custkey", "c_nationkey", "function_declaration").unionByName(part("supplier", "S", "s_suppkey", "s_nationkey", "function"))
    matches = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("question_id"), F.lit(TARGET).alias("target"), F.col("o_custkey").alias("rank"), F.concat(F.lit("C"), "o_custkey").alias("id"))
    return graph.prefer_definitions(matches, own).select("question_id", "id", "rank")


@query("SELECT DISTINCT o_custkey + 10 AS target FROM orders WHERE o_custkey + 10 NOT IN (SELECT c_custkey FROM customer)")
def missing_targets(spark, sf_dir):
    """Targets that questions (orders) name and no graph (customer) has."""
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 10).alias("target"))
    return smoke.missing_targets(asked, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target")))


@query("""WITH s AS (SELECT source, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id % 7 = 0 THEN 'unverifiable' WHEN l.quality = 0 THEN 'changed' END AS status, coalesce(length(text), 0) < 40 AS short FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT source AS target, CAST(count(*) FILTER (WHERE status = 'missing') AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE status = 'unverifiable') AS BIGINT) AS unverifiable, CAST(count(*) FILTER (WHERE status = 'changed') AS BIGINT) AS changed,
CAST(count(*) FILTER (WHERE short) AS INT) AS failed, count(status) > 0 AS is_stale FROM s GROUP BY source""")
def graph_status(spark, sf_dir):
    """Sources as graphs whose files are the documents; short ones couldn't be parsed, labels are what is on disk."""
    own = table(spark, sf_dir, "documents").withColumn("file", F.concat(F.lit("d"), "doc_id"))
    stored = own.select(F.col("source").alias("target"), "file", F.when(F.col("doc_id") % 7 != 0, "1").alias("hash"))
    disk = table(spark, sf_dir, "labels").join(own.select("doc_id", "source", "file"), "doc_id").select(F.col("source").alias("target"), "file", F.col("quality").cast("string").alias("hash"))
    short = F.when(F.coalesce(F.length("text"), F.lit(0)) < 40, F.struct("file", F.lit("too short").alias("error")))
    meta = own.groupBy(F.col("source").alias("target")).agg(F.collect_list(short).alias("parse_failures"))
    return graph.status(meta, graph.staleness(stored, disk))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)
SELECT source AS target, lang AS language, CAST(n AS BIGINT) AS files FROM c WHERE ends_with(source, '1') UNION ALL SELECT source, min(lang), CAST(sum(n) AS BIGINT) FROM c WHERE NOT ends_with(source, '1') GROUP BY source""")
def graph_languages(spark, sf_dir):
    """Languages of graphs: as meta lists them where it does, else all file nodes under the one that it names."""
    own = table(spark, sf_dir, "documents").select(F.col("source").alias("target"), "lang", F.lit("file").alias("type"))
    counted = own.groupBy("target", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("target").agg(F.min("lang").alias("language"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("languages"))
    meta = counted.withColumn("languages", F.when(F.endswith("target", F.lit("1")), F.col("languages")))
    return graph.languages(meta, own).select("target", F.explode("languages").alias("language", "files"))


@query("""SELECT doc_id, CASE WHEN toxic = 0 THEN 'answered a question that must be refused' ELSE 'refused a question that has an answer' END AS problem FROM labels WHERE (quality = 0) = (toxic = 0)""")
def spec_problems(spark, sf_dir):
    """Labels as a question spec: quality 0 must be refused, toxic 1 stands for a refusal."""
    own = table(spark, sf_dir, "labels").select(F.lit(TARGET).alias("target"), "doc_id", F.col("doc_id").cast("string").alias("question"), (F.col("quality") == 0).alias("must_refuse"), (F.col("toxic") == 0).alias("answered"))
    return smoke.problems(own).select("doc_id", "problem")


@query("""SELECT c_custkey AS question_id, unnest(CASE c_custkey % 4 WHEN 0 THEN ['C' || c_custkey, 'N' || c_nationkey] WHEN 1 THEN ['C' || c_custkey] WHEN 2 THEN ['N' || c_nationkey] ELSE [] END) AS id, unnest(CASE c_custkey % 4 WHEN 0 THEN [1, 2] WHEN 3 THEN [] ELSE [1] END) AS rank FROM customer""")
def model_names(spark, sf_dir):
    """Names in a model's reply: a member and its owner, a member under an owner that isn't one, one name twice, or none that is known."""
    own = _nation_nodes(spark, sf_dir)
    key, nation = F.col("c_custkey").cast("string"), F.concat(F.lit("Nation"), F.col("c_nationkey"))
    member, shape = F.concat(F.lit("entry"), key), F.col("c_custkey") % 4
    names = F.when(shape == 0, F.array(F.concat_ws(".", nation, member), nation)).when(shape == 1, F.array(F.concat(F.lit("Ghost."), member))).when(shape == 2, F.array(nation, F.concat(F.lit("Ghost."), nation))).otherwise(F.array(F.lit("nobody"), F.lit("Nation"), F.lit("")))
    reply = F.concat(F.lit("Sure: "), F.to_json(names), F.lit(' or ["other"]'))
    replies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), F.lit(TARGET).alias("target"), reply.alias("reply"))
    by_name = graph.by_qualified_name(own, graph.qualified_names(own))
    return semantic.named_nodes(semantic.names_in_reply(replies), by_name, own).select("question_id", "id", "rank")


FOUND = f"""{ASSISTANT}, f AS (SELECT a.question_id, 'renamed_symbol' AS kind, 'The answer uses none of the real names it was given (e.g. `Shop.sell`), so it may have renamed or substituted the symbol.' AS message FROM a JOIN conversations c USING (conv_id, turn) WHERE a.conv_id % 2 = 1 AND NOT contains(c.text, 'sell')
UNION ALL SELECT question_id, 'fabricated_range', CASE WHEN turn % 4 = 3 THEN 'The answer cites `src/a.py#L2-3`, which is not one of the real graph ranges — likely a subdivided or invented location.' ELSE 'The answer cites `src/b.py#L1-9`, but that file was not part of the facts provided.' END FROM a WHERE turn % 4 <> 1
UNION ALL SELECT question_id, 'invented_symbol', 'The answer mentions `Ghost.walk`, which does not exist in the knowledge graph under that name.' FROM a WHERE conv_id % 2 = 1)"""


def _found(spark, sf_dir):
    none = F.array().cast("array<struct<name:string>>")
    blocks = _answer_blocks(spark, sf_dir).withColumns({c: none for c in ("callers", "callees", "renders", "rendered_by")})
    answers = _answers(spark, sf_dir)
    # Empty answers, and those of questions without facts, have no findings.
    more = answers.select((-F.col("question_id")).alias("question_id"), "target", "answer").unionByName(answers.withColumn("answer", F.lit("")))
    return context.verify(answers.unionByName(more), blocks, *_shop(spark))


@query(f"""WITH {FOUND} SELECT question_id, string_agg('- **' || kind || '**: ' || message, chr(10) ORDER BY kind, message) AS issues FROM f GROUP BY question_id""")
def findings_summary(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("question_id").agg(context.summarize().alias("issues"))


@query(f"""WITH {FOUND}, g AS (SELECT question_id, string_agg('- **' || kind || '**: ' || message, chr(10) ORDER BY kind, message) AS issues, bool_or(kind <> 'invented_symbol') AS bad FROM f GROUP BY question_id)
SELECT question_id, 'The answer breaks the rules:' || chr(10) || 'PREVIOUS ANSWER:' || chr(10) || 'answer ' || question_id || chr(10) || 'PROBLEMS:' || chr(10) || issues || chr(10) || 'Write it again with the given names and locations only.' AS correction FROM g WHERE bad""")
def answer_corrections(spark, sf_dir):
    """What a second try is told, for answers whose findings hold an error."""
    ids = _answers(spark, sf_dir).select("question_id")
    prompts, answers = ids.withColumn("prompt", F.lit("p")), ids.withColumn("answer", F.concat(F.lit("answer "), "question_id"))
    return context.corrections(prompts, answers, _found(spark, sf_dir)).select("question_id", "correction")


def _says(prompts: list[str]) -> list[str]:
    """A stand-in for a model: names what it is given for members, nothing of it for questions with two names until it is told
    what is wrong, and repeats refusals."""
    out = []
    for prompt in prompts:
        if wrong := re.search(r"PREVIOUS ANSWER:.*e\.g\. `([^`]+)`", prompt, re.S):
            out.append(f"ANSWER: see `{wrong[1]}`")
        elif names := re.search(r"NAMES \(.*?\): `([^`]+)`", prompt):
            out.append("ANSWER: it does things" if "QUESTION: Nation" in prompt else f"<think>so</think> ANSWER: it is `{names[1]}`")
        else:
            out.append(re.search(r"ANSWER: .*", prompt)[0])
    return out


@query("""WITH l AS (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY c_nationkey), q AS (SELECT s_suppkey, c_nationkey, k, s_suppkey % 4 AS shape FROM supplier JOIN l ON s_nationkey = c_nationkey)
SELECT s_suppkey AS question_id, CASE shape WHEN 0 THEN 'qualified' WHEN 1 THEN 'exact' WHEN 2 THEN 'named-symbol-miss' ELSE 'none' END AS strategy, shape < 2 AS answered,
CASE shape WHEN 0 THEN 'ANSWER: it is `Nation' || c_nationkey || '.entry' || k || '`' WHEN 1 THEN 'ANSWER: see `Nation' || c_nationkey || '`' ELSE 'ANSWER: Not found in the knowledge graph for t.' END AS answer, shape = 1 AS retried, CAST(NULL AS VARCHAR) AS issues FROM q""")
def answered_questions(spark, sf_dir):
    """A batch from retrieval to checked answers: a member, two names (whose first answer names neither and is asked for again),
    a symbol that isn't there, and nothing."""
    least = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("k"))
    own = table(spark, sf_dir, "supplier").join(least, F.col("s_nationkey") == F.col("c_nationkey"))
    nation, member, shape = F.concat(F.lit("Nation"), F.col("c_nationkey")), F.concat(F.lit("entry"), F.col("k")), F.col("s_suppkey") % 4
    text = (
        F.when(shape == 0, F.concat(F.lit("what does "), nation, F.lit("."), member, F.lit(" do?"))).when(shape == 1, F.concat_ws(" ", nation, F.lit("and"), member))
        .when(shape == 2, F.concat(F.lit("where is useCart"), F.col("s_suppkey"), F.lit(" ?"))).otherwise(F.lit("zq vk"))
    )
    asked = own.select(F.lit(TARGET).alias("target"), F.col("s_suppkey").alias("question_id"), text.alias("question"), F.lit(False).alias("must_refuse"))
    all_ = _nation_nodes(spark, sf_dir).withColumns({"language": F.lit("python"), "line_start": F.lit(1), "line_end": F.lit(2), "is_async": F.lit(False)})
    edges = graph.with_external(graph.dedupe_edges(call_sites(spark, sf_dir)), all_)
    done = answers.answered(asked, Graph(all_, edges, None), _says)
    return done.select("question_id", "strategy", "answered", "answer", "retried", "issues")


@query("""SELECT source, lang, CAST(GROUPING(source, lang) AS INT) AS level, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS total, true AS distinct_near, true AS median_near FROM documents GROUP BY CUBE (source, lang)""")
def document_cube(spark, sf_dir):
    """Documents by source and language and all coarser sets: exact numbers, and whether sketches of distinct texts and of lengths
    are within three times their errors of what the rows say."""
    own = table(spark, sf_dir, "documents").select("source", "lang", F.md5("text").alias("text"), "n_chars")
    made = rollups.cube(rollups.finest(own, ["source", "lang"], "text", "n_chars"), ["source", "lang"], (0.5,)).alias("m")
    few = F.count(F.lit(1)) < 40  # where a row is more than the error
    lower, upper = (F.when(few, end("n_chars")).otherwise(F.percentile("n_chars", q)) for end, q in ((F.min, 0.45), (F.max, 0.55)))
    exact = own.cube("source", "lang").agg(F.grouping_id().alias("level"), F.count_distinct("text").alias("values"), lower.alias("lower"), upper.alias("upper")).alias("e")
    same = (F.col("m.level") == F.col("e.level")) & F.col("m.source").eqNullSafe(F.col("e.source")) & F.col("m.lang").eqNullSafe(F.col("e.lang"))
    near = F.abs(F.col("distinct_values") - F.col("values")) <= 3 * 1.04 / 64 * F.col("values") + 1
    median = F.col("quantiles")[0].between(F.floor("lower"), F.ceil("upper"))
    return made.join(exact, same).select("m.source", "m.lang", F.col("m.level").cast("int").alias("level"), "n", "total", near.alias("distinct_near"), median.alias("median_near"))
