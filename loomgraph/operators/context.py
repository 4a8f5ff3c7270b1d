"""Context blocks around matches, the prompts built from them, checks of answers, and drawings.

A block is a row: the node, its qualified name and snippet, and arrays of structs (in edge order) for callers,
callees, children, renders and rendered_by. Neighbour lists are aggregated for matched nodes only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CITED, DOT_EDGE, DOT_HEAD, DOT_NODE, EDGES_PER_NODE, EDGE_STYLE, INVENTED, NO_FILE, OTHER_FILE, OTHER_LINES, RENAMED, SEVERITIES, SOURCE_SUFFIXES, TYPE_STYLE
from ..functions.text import endpoints_text, escape_dot, without_leading_dots
from .combinators import first_wins
from .graph import endpoints

#: Neighbour lists of a block: the edges' type, whether the block is where they end, and the list's name.
SIDES = (("calls", True, "callers"), ("calls", False, "callees"), ("renders", False, "renders"), ("renders", True, "rendered_by"))


def neighbours(edges: DataFrame, ids: DataFrame, nodes: DataFrame, qualified: DataFrame) -> DataFrame:
    """(target, id, callers, callees, renders, rendered_by, children) of nodes (target, id), null where there are none, in
    one pass over the edges: each is looked at from both of its ends, and what meets a node is gathered by it."""
    ends = F.array(F.struct(F.col("to").alias("id"), F.col("frm").alias("other"), F.lit(True).alias("ends")), F.struct(F.col("frm").alias("id"), F.col("to").alias("other"), F.lit(False).alias("ends")))
    own = edges.filter(F.col("type").isin("calls", "renders", "contains"))
    own = own.select("target", "type", "seq", "resolution" if "resolution" in edges.columns else F.lit(None).cast("string").alias("resolution"), "count", F.inline(ends))
    own = own.filter("type != 'contains' OR NOT ends").join(ids, ["target", "id"], "left_semi")
    inner = nodes.select("target", F.col("id").alias("other"), F.col("seq").alias("inner_seq"), F.col("name").alias("inner_name"))
    full = endpoints(own, "other", nodes, qualified).join(inner, ["target", "other"], "left")
    end = F.struct("seq", "name", "node_id", "node_type", "resolution", F.col("count").cast("long").alias("count"))

    def listed(wanted: Column, item: Column) -> Column:
        # Sorted by the items' own order and once: array_sort asks a comparator for each two items, which costs most of a block.
        found = F.collect_list(F.when(wanted, item))
        return F.when(F.size(found) > 0, F.sort_array(found))

    lists = [listed((F.col("type") == type_) & (F.col("ends") == ending), end).alias(name) for type_, ending, name in SIDES]
    child = F.struct(F.col("inner_seq").alias("seq"), F.col("inner_name").alias("name"), F.col("node_type").alias("type"))
    lists.append(listed((F.col("type") == "contains") & F.col("node_id").isNotNull(), child).alias("children"))
    return full.groupBy("target", "id").agg(*lists)


def context_blocks(matches: DataFrame, nodes: DataFrame, edges: DataFrame, qualified: DataFrame, snippets: DataFrame | None = None) -> DataFrame:
    """One block for each match (question_id, target, rank, id, ...)."""
    ids = matches.select("target", "id").distinct()
    up = nodes.select("target", F.col("id").alias("parent"), F.col("name").alias("parent_name"), F.col("type").alias("parent_type"))
    blocks = matches.join(nodes, ["target", "id"]).join(qualified, ["target", "id"], "left").join(up, ["target", "parent"], "left")
    blocks = blocks.join(neighbours(edges, ids, nodes, qualified), ["target", "id"], "left")
    if snippets is not None:
        return blocks.join(snippets, ["target", "id"], "left")
    return blocks.withColumn("snippet", F.lit(NO_FILE))


def _line(label: str, value: Column, given: Column) -> Column:
    return F.when(given, F.concat(F.lit(label), value))


def block_text(blocks: DataFrame) -> DataFrame:
    """Adds ``facts``: the block as lines of a prompt."""
    kids = F.array_join(F.transform("children", lambda c: F.concat(c["name"], F.lit(" ("), c["type"], F.lit(")"))), ", ")

    def some(name: str) -> Column:
        return F.coalesce(F.size(name) > 0, F.lit(False))

    def text(name: str, present: Column | None = None) -> Column:
        return F.length(F.coalesce(name, F.lit(""))) > 0

    lines = [
        F.concat(F.lit("### "), F.upper(F.replace("type", F.lit("_"), F.lit(" "))), F.lit(" `"), "qualified", F.lit("`")),
        F.concat(F.lit("FILE: "), "file", F.lit("  LINES: "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")),
        _line("LANGUAGE: ", F.col("language"), text("language")),
        _line("SIGNATURE: ", F.col("signature"), text("signature")),
        _line("DOC COMMENT: ", F.col("doc"), text("doc")),
        F.when(F.coalesce("is_async", F.lit(False)), F.lit("ASYNC: yes")),
        F.when(F.col("parent_name").isNotNull(), F.concat(F.lit("DEFINED INSIDE: "), "parent_type", F.lit(" `"), "parent_name", F.lit("`"))),
        F.concat(F.lit("```\n"), "snippet", F.lit("\n```")),
        _line("CALLED BY: ", endpoints_text(F.col("callers")), some("callers")),
        _line("CALLS: ", endpoints_text(F.col("callees")), some("callees")),
        _line("CONTAINS: ", kids, some("children")),
        _line("RENDERS (JSX): ", endpoints_text(F.col("renders")), some("renders")),
        _line("RENDERED BY: ", endpoints_text(F.col("rendered_by")), some("rendered_by")),
    ]
    return blocks.withColumn("facts", F.concat_ws("\n", *lines))


def prompts(questions: DataFrame, retrievals: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question_id, target, prompt): the facts of the question's blocks in order and the rules for an answer, or
    the refusal to give."""
    block = F.struct("rank", "qualified", "name", "file", "line_start", "line_end", "facts")
    own = block_text(blocks).groupBy("question_id").agg(F.array_sort(F.collect_list(block)).alias("b"))

    def listed(value) -> Column:
        return F.array_join(F.transform("b", value), ", ")

    names = listed(lambda x: F.concat(F.lit("`"), x["qualified"], F.lit("`")))
    ranges = F.array_join(F.transform("b", lambda x: F.concat(x["file"], F.lit("#L"), x["line_start"].cast("string"), F.lit("-"), x["line_end"].cast("string"))), "; ")
    answer = F.concat_ws(
        "\n",
        F.concat(F.lit("Answer from the parsed facts about the codebase '"), "target", F.lit("' alone.")),
        F.concat(F.lit("NAMES (copy them as they are): "), names),
        F.concat(F.lit("LOCATIONS (cite no others): "), ranges),
        F.lit("Call targets are marked [internal] for this codebase, [local] for values of an enclosing scope, [external] for libraries."),
        F.concat(F.lit("QUESTION: "), "question"),
        F.lit("FACTS:"),
        F.array_join(F.transform("b", lambda x: x["facts"]), "\n\n"),
        F.lit("Format:\nANSWER: <explanation>\nFILE: <path>\nLINE: <start>-<end>\nor, for several places, LOCATIONS: with lines - <path>#L<start>-<end> (<role>)"),
    )
    reason = F.col("reason").isNotNull()
    near = F.array_join(F.transform("suggestions", lambda s: F.concat(F.lit("`"), s, F.lit("`"))), ", ")
    refusal = F.concat_ws(
        "\n",
        F.concat(F.lit("The question about the codebase '"), "target", F.lit("' was: "), "question"),
        F.lit("No symbol of the knowledge graph matches. Reply with exactly this:"),
        F.concat(F.lit("ANSWER: Not found in the knowledge graph for "), "target", F.lit(".")),
        F.when(reason, F.concat(F.lit("Reason: "), "reason")),
        F.when(F.size("suggestions") > 0, F.concat(F.lit("Closest symbols that do exist: "), near)),
    )
    joined = questions.select("target", "question_id", "question").join(retrievals.select("question_id", "reason", "suggestions"), "question_id").join(own, "question_id", "left")
    return joined.select("question_id", "target", F.when(F.col("b").isNotNull(), answer).otherwise(refusal).alias("prompt"))


def corrections(prompt: DataFrame, answers: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, prompt, answer, correction) for answers with errors: what a second try is told."""
    issues = found.groupBy("question_id").agg(summarize().alias("issues"), F.bool_or(F.col("severity") == "error").alias("bad")).filter("bad")
    text = F.concat_ws("\n", F.lit("The answer breaks the rules:"), F.lit("PREVIOUS ANSWER:"), "answer", F.lit("PROBLEMS:"), "issues", F.lit("Write it again with the given names and locations only."))
    return prompt.join(answers, "question_id").join(issues, "question_id").select("question_id", "prompt", "answer", text.alias("correction"))


RANGE = r"(?U)([\w./\\-]+\.\w+)\s*#\s*L(\d+)\s*-\s*(\d+)"
TICKED = r"(?U)`([A-Za-z_][\w.]*)`"
#: Tasks to which the answers that mention one name are dealt.
DEALT = 64


def summarize() -> Column:
    """Findings of a group as a list, by kind and message."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "message"))), lambda f: F.concat(F.lit("- **"), f["kind"], F.lit("**: "), f["message"])), "\n")


def worst_severity() -> Column:
    order = F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair))
    return F.max_by("severity", order[F.col("severity")])


def renamed(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Answers (question_id, answer) that hold no name of any of their blocks."""
    used = F.contains("answer", F.col("name")) | F.contains("answer", F.col("qualified"))
    own = answers.join(blocks.select("question_id", "rank", "name", "qualified"), "question_id")
    own = own.groupBy("question_id").agg(F.bool_or(used).alias("used"), F.min_by("qualified", "rank").alias("first")).filter("NOT used")
    message = F.concat(F.lit(RENAMED[0]), "first", F.lit(RENAMED[1]))
    return own.select("question_id", F.lit("renamed_symbol").alias("kind"), F.lit("error").alias("severity"), message.alias("message"))


def cited_ranges(answers: DataFrame) -> DataFrame:
    """(question_id, raw_file, file, first, last) of each ``path#Lx-y`` in answers."""
    groups = F.arrays_zip(*(F.regexp_extract_all("answer", F.lit(RANGE), F.lit(k)).alias(n) for k, n in ((1, "raw_file"), (2, "a"), (3, "z"))))
    own = answers.select("question_id", F.explode(groups).alias("c")).select("question_id", "c.raw_file", F.col("c.a").alias("a"), F.col("c.z").alias("z"))
    return own.select("question_id", "raw_file", without_leading_dots(F.col("raw_file")).alias("file"), F.col("a").cast("int").alias("first"), F.col("z").cast("int").alias("last"))


def fabricated(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Cited ranges that no block has."""
    given = blocks.select("question_id", without_leading_dots(F.col("file")).alias("file"), F.col("line_start").cast("int").alias("first"), F.col("line_end").cast("int").alias("last")).distinct()
    files = given.select("question_id", "file").distinct().withColumn("known_file", F.lit(True))
    asked = answers.join(blocks.select("question_id").distinct(), "question_id", "left_semi")
    own = cited_ranges(asked).join(given, ["question_id", "file", "first", "last"], "left_anti").join(files, ["question_id", "file"], "left")
    cited = F.concat(F.lit(CITED), "raw_file", F.lit("#L"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    message = F.when(F.col("known_file").isNull(), F.concat(cited, F.lit(OTHER_FILE))).otherwise(
        F.concat(cited, F.lit(OTHER_LINES))
    )
    return own.select("question_id", F.lit("fabricated_range").alias("kind"), F.lit("error").alias("severity"), message.alias("message"))


def known_names(nodes: DataFrame, qualified: DataFrame) -> DataFrame:
    """(target, known): names, files and qualified names of a graph."""
    return nodes.select("target", F.col("name").alias("known")).union(nodes.select("target", "file")).union(qualified.select("target", "qualified")).distinct()


def invented(answers: DataFrame, known: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Dotted names in back ticks of answers (question_id, target, answer) that nothing known explains.
    ends: further known names of a question (question_id, known)."""
    tokens = answers.select("question_id", "target", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(TICKED), F.lit(1)))).alias("token"))
    tokens = tokens.filter(F.contains("token", F.lit("."))).filter(~reduce(lambda a, b: a | b, (F.endswith(F.lower("token"), F.lit(s)) for s in SOURCE_SUFFIXES)))
    last = F.element_at(F.split("token", r"\."), -1)
    owner = F.regexp_replace("token", r"\.[^.]*$", "")
    parts = (F.col("token"), owner, last, F.get(F.split("token", r"\."), 0))
    # A name that very many answers mention is looked up once, and its answers are dealt to several tasks.
    names = tokens.select("target", "token").distinct()
    for part in parts:
        names = names.withColumn("known", part).join(known, ["target", "known"], "left_anti")
    names = names.select("target", "token", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))).alias("deal"))
    tokens = tokens.withColumn("deal", F.pmod(F.xxhash64("question_id"), F.lit(DEALT))).join(names, ["target", "token", "deal"], "left_semi")
    if ends is not None:
        for part in parts:
            tokens = tokens.withColumn("known", part).join(ends, ["question_id", "known"], "left_anti")
    message = F.concat(F.lit(INVENTED[0]), "token", F.lit(INVENTED[1]))
    return tokens.select("question_id", F.lit("invented_symbol").alias("kind"), F.lit("warning").alias("severity"), message.alias("message"))


def verify(answers: DataFrame, blocks: DataFrame, nodes: DataFrame, qualified: DataFrame) -> DataFrame:
    """Findings (question_id, kind, severity, message) of answers (question_id, target, answer); none for an empty
    answer or one without blocks."""
    asked = answers.filter(F.length("answer") > 0).join(blocks.select("question_id").distinct(), "question_id", "left_semi")
    ends = None
    for side in ("callers", "callees", "renders", "rendered_by"):
        part = blocks.select("question_id", F.explode(F.transform(side, lambda e: e["name"])).alias("known"))
        ends = part if ends is None else ends.union(part)
    ends = ends.union(blocks.select("question_id", "qualified")).distinct()
    return renamed(asked, blocks).union(fabricated(asked, blocks)).union(invented(asked, known_names(nodes, qualified), ends))


def _style(table: dict, key: Column, k: int, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for name, v in table.items() for x in (name, v[k]))), key), F.lit(default))


def node_statement(key: Column, label: Column, type_: Column, focus: Column) -> Column:
    shape, fill = _style(TYPE_STYLE, type_, 0, "ellipse"), _style(TYPE_STYLE, type_, 1, "#ffffff")
    colour, pen = F.when(focus, "#1a73e8").otherwise("#5f6368"), F.when(focus, "2.4").otherwise("1.0")
    return F.format_string(DOT_NODE, escape_dot(key), escape_dot(label), shape, fill, colour, pen)


def edge_statement(a: Column, b: Column, label: Column, resolution: Column) -> Column:
    style, colour = _style(EDGE_STYLE, resolution, 0, "solid"), _style(EDGE_STYLE, resolution, 1, "#5f6368")
    return F.format_string(DOT_EDGE, escape_dot(a), escape_dot(b), escape_dot(label), style, colour, colour)


def _numbered(ends: Column, part: int) -> Column:
    return F.transform(ends, lambda e, at: F.struct(F.lit(part).alias("part"), at.alias("at"), e.alias("e")))


def dot_statements(blocks: DataFrame, most: int = EDGES_PER_NODE) -> DataFrame:
    """(question_id, place, statement): nodes and edges around the blocks (a stored table: they are read for each
    side), each once, in the order of blocks, then
    callers, callees (``most`` of each), renders and what renders them."""
    focus = blocks.select("question_id", F.col("id").alias("key"), F.lit(True).alias("is_focus")).distinct()
    own = blocks.select(
        "question_id", F.struct("rank", F.lit(0).alias("part"), F.lit(0).alias("at"), F.lit(0).alias("kind")).alias("place"), F.col("id").alias("key"),
        F.concat("qualified", F.lit("\\n<"), "type", F.lit(">")).alias("label"), "type", F.lit(True).alias("focus"),
    )
    sides = [_numbered(F.slice(side, 1, most) if part < 3 else F.col(side), part) for part, side in enumerate(("callers", "callees", "renders", "rendered_by"), 1)]
    none = F.array().cast(f"array<struct<part:int,at:int,e:{blocks.schema['callers'].dataType.elementType.simpleString()}>>")
    e = blocks.select("question_id", "rank", F.col("id").alias("self"), F.inline(F.concat(*(F.coalesce(s, none) for s in sides))))
    known, callee, out = F.col("e.node_id").isNotNull(), F.col("part") == 2, F.col("part").isin(2, 3)
    e = e.withColumn("key", F.when(known, F.col("e.node_id")).otherwise(F.concat(F.lit("ext::"), "e.name"))).join(focus, ["question_id", "key"], "left")
    unknown = F.when(callee, F.concat("e.name", F.lit("\n<"), "e.resolution", F.lit(">"))).otherwise(F.col("e.name"))
    lit = callee & F.coalesce("is_focus", F.lit(False)) & known
    other = F.when(F.col("part") < 3, "external").otherwise("component")
    place, after = (F.struct("rank", "part", "at", F.lit(kind).alias("kind")).alias("place") for kind in (0, 1))
    stmts = own.union(e.select("question_id", place, "key", F.when(known, F.col("e.name")).otherwise(unknown), F.when(known, F.col("e.node_type")).otherwise(other), lit))
    a, b = F.when(out, F.col("self")).otherwise(F.col("key")), F.when(out, F.col("key")).otherwise(F.col("self"))
    edges = e.select("question_id", after, a.alias("a"), b.alias("b"), F.when(F.col("part") < 3, "calls").otherwise("renders").alias("label"), F.col("e.resolution").alias("resolution"))
    nodes = first_wins(stmts, ["question_id", "key"], ["place"])
    nodes = nodes.select("question_id", "place", node_statement(F.col("key"), F.col("label"), F.col("type"), F.col("focus")).alias("statement"))
    edges = first_wins(edges, ["question_id", "a", "b", "label"], ["place"])
    return nodes.union(edges.select("question_id", "place", edge_statement(F.col("a"), F.col("b"), F.col("label"), F.col("resolution"))))


def drawings(blocks: DataFrame) -> DataFrame:
    """(question_id, dot): a Graphviz text for each question."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "statement"))), lambda s: s["statement"]), "\n")
    return dot_statements(blocks).groupBy("question_id").agg(F.concat(F.lit(DOT_HEAD), body, F.lit("\n}")).alias("dot"))
