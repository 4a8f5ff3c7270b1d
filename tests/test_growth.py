"""Rows that plans make, by their own counts: none grows with the square of a group."""

import difflib
import random

from pyspark.sql import functions as F

from jobs import impact_report
from loomgraph.operators import context, cycles, intervals, resolve, retrieve, traverse

SYMBOLS = "target string, id string, name string, type string, parent string, file string, arity int, seq long"


def most_rows(frame):
    """The rows of a frame, and the most rows that one operator of its plan has made."""
    rows = frame.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        made, children = plan.metrics().get("numOutputRows"), plan.children()
        own = made.get().value() if made.isDefined() else 0
        return max([own, *(walk(children.apply(i)) for i in range(children.size()))])

    return rows, walk(frame._jdf.queryExecution().executedPlan())


def test_sites_do_not_meet_all_members_of_a_name(spark):
    """a type with very many members of one name."""
    n = 400
    nodes = spark.createDataFrame([("t", "T", "Shop", "class", None, None, None, 0)] + [("t", f"m{i}", "sell", "method", "T", None, i % 4, i + 1) for i in range(n)], SYMBOLS)
    sites = spark.createDataFrame([("t", f"s{i}", "Shop", "sell", i % 5, f"m{i % 6}") for i in range(n)], "target string, site string, owner string, name string, argc int, exclude string")
    rows, most = most_rows(resolve.member_of_type(sites, nodes))

    def want(i):
        own = [j for j in range(n) if j != i % 6]
        return f"m{next((j for j in own if j % 4 == i % 5), own[0])}"

    assert {r.site: r.found for r in rows} == {f"s{i}": want(i) for i in range(n)}
    assert most <= 3 * n


def test_sites_do_not_meet_all_kinds_of_a_name(spark):
    """a name of many types, arities and files; every soft filter decides somewhere."""
    n, rnd, order = 300, random.Random(6), ("method", "function", "constructor")
    types = ["method", "function", "function_declaration", "constructor", "class"]
    own = [("t", f"p{i}", "get" if i % 5 else f"rare{i % 4 if i % 10 else i}", rnd.choice(types if i % 3 else types[2:]), None, f"f{rnd.randrange(12)}", rnd.choice([None, *range(25)]), rnd.randrange(10**6) * n + i) for i in range(n)]
    asked = [("t", f"s{i}", own[i][2], own[i][5] if i % 7 else None, own[i][1] if i % 4 else None, own[i][6] if i % 3 else rnd.choice([None, 3, 99])) for i in range(n)]
    sites = spark.createDataFrame(asked, "target string, site string, name string, frm_file string, exclude string, argc int")
    rows, most = most_rows(resolve.lookup(sites, spark.createDataFrame(own, SYMBOLS), order))

    def want(name, file, exclude, argc):
        left = [p for p in own if p[2] == name]

        def soft(test):
            return [p for p in left if test(p)] or left

        left = soft(lambda p: p[1] != exclude)
        left = soft(lambda p: argc is None or p[6] == argc)
        if any(p[3] == "function" for p in left):
            left = [p for p in left if p[3] != "function_declaration"]
        ambiguous = len(left) > 1
        left = soft(lambda p: p[3] in order)
        left = soft(lambda p: p[5] == file)
        return min(left, key=lambda p: (order.index(p[3]) if p[3] in order else 3, p[7]))[1], ambiguous

    assert {r.site: (r.found, r.ambiguous) for r in rows} == {s[1]: want(*s[2:]) for s in asked}
    assert most <= 4 * n


def test_suggestions_that_nobody_reads_are_not_looked_up(spark):
    """the comparison of words with all names stays out of a plan that reads no suggestions, and in one that does. This held
    before F1's change, too."""
    nodes = spark.createDataFrame([("t", f"m{i}", f"entry{i}", "method", None, None, None, i) for i in range(3)], SYMBOLS).selectExpr("*", "CAST(NULL AS STRING) AS signature", "CAST(NULL AS STRING) AS doc")
    asked = spark.createDataFrame([("t", 1, "where is useCart1 ?"), ("t", 2, "entry2")], "target string, question_id long, question string")
    _, outcome = retrieve.retrieve(asked, nodes)

    def compares(frame):
        return "levenshtein" in frame._jdf.queryExecution().optimizedPlan().toString()

    read = outcome.select("question_id", "strategy", "reason")
    assert compares(outcome) and not compares(read)
    assert {r.question_id: r.strategy for r in read.collect()} == {1: "named-symbol-miss", 2: "exact"}


def test_pairs_do_not_meet_all_that_an_end_knows(spark):
    """many pairs from one start that reaches very many nodes."""
    seen, n = [], 300
    edges = [("t", "R", "N")] + [("t", "N", f"C{i:03}") for i in range(n)] + [("t", f"C{i:03}", f"S{i % 100:03}") for i in range(n)]
    pairs = [("t", "R", f"S{i:03}") for i in range(100)]

    def keep(frame, name):
        rows, most = most_rows(frame)
        seen.append(most)
        return spark.createDataFrame(rows, frame.schema)

    schema = "target string, frm string, to string"
    found, complete = traverse.shortest_paths(spark.createDataFrame(edges, schema), spark.createDataFrame(pairs, schema), keep=keep)
    assert complete and {(r.to, r.length, tuple(r.path)) for r in found.collect()} == {(f"S{i:03}", 3, ("R", "N", f"C{i:03}", f"S{i:03}")) for i in range(100)}
    assert max(seen) <= 3 * len(edges)


def test_places_do_not_meet_all_ranges_around_them(spark):
    """very many ranges over the same places."""
    n = 300
    ranges = spark.createDataFrame([("f", i % 3, 255 + i % 2, i) for i in range(n)], "file string, line_start int, line_end int, id int")
    places = spark.createDataFrame([("f", i) for i in range(n)], "file string, line int")
    rows, most = most_rows(intervals.innermost(places, ranges, ["file"]))

    def want(at):
        held = [(255 + i % 2 - i % 3, -(i % 3), i) for i in range(n) if i % 3 <= at <= 255 + i % 2]
        return min(held)[2] if held else None

    assert {r.line: r.id for r in rows} == {at: want(at) for at in range(n)}
    # A place is a row for each of 32 levels.
    assert most <= 32 * n


def test_words_do_not_meet_all_names_that_differ_in_digits(spark):
    """very many words and names that end in numbers, a few of which are close."""
    n, rnd = 300, random.Random(5)
    names = sorted({f"entry{rnd.randrange(10**5, 10**6)}" for _ in range(n)} | {"entry123450", "entry912345", "entry12345", "total"})
    words = sorted({f"useCart{rnd.randrange(10**4, 10**5)}" for _ in range(n)} | {"useCart12345", "entr", "totl9"})
    pools = spark.createDataFrame([("t", 0, name) for name in names], "target string, pool int, known string")
    rows, most = most_rows(retrieve.close_names(spark.createDataFrame([("t", w) for w in words], "target string, word string"), pools))
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.word, []).append(r.known)
    want = {w: difflib.get_close_matches(w, names, n=3, cutoff=0.6) for w in words}
    assert got == {w: found for w, found in want.items() if found} and len(got["useCart12345"]) == 3
    assert most <= 20 * n


def test_answers_that_mention_one_name_are_dealt_to_several_tasks(spark):
    """all answers hold the same names, known and unknown."""
    n = 400
    answers = spark.createDataFrame([("t", i, "`Ghost.walk` `Shop.sell` `lost.sell` `a.py`" if i else "`Own.end`") for i in range(n)], "target string, question_id long, answer string")
    known = spark.createDataFrame([("t", "Shop"), ("t", "sell"), ("u", "Ghost")], "target string, known string")
    ends = spark.createDataFrame([(1, "Ghost.walk"), (2, "walk"), (3, "Shop")], "question_id long, known string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = context.invented(answers, known).withColumn("task", F.spark_partition_id()).collect()
        less = context.invented(answers, known, ends).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    ghosts = [r.task for r in found if "Ghost.walk" in r.message]
    assert len(found) == n and len(ghosts) == n - 1 and len(set(ghosts)) > 1
    assert {r.question_id for r in less} == set(range(n)) - {1, 2}


def test_neighbours_are_sorted_without_a_comparator(spark):
    """lists of very many callers are in edge order, by the order of their items and each sorted once. With a
    comparator each two items cost a call."""
    n, rnd = 300, random.Random(14)
    seqs = [None, *range(1, n)]
    rnd.shuffle(seqs)
    rows = [("t", f"C{i:03}", "S", "calls", 1 + i % 3, seqs[i]) for i in range(n)]
    edges = spark.createDataFrame(rows, "target string, frm string, to string, type string, count long, seq long")
    nodes = spark.createDataFrame([("t", "S", "sell", "function", None, None, None, 0)] + [("t", f"C{i:03}", f"c{i}", "method", None, None, None, i) for i in range(0, n, 2)], SYMBOLS)
    qualified = nodes.selectExpr("target", "id", "name AS qualified")
    found = context.neighbours(edges, nodes.filter("id = 'S'").select("target", "id"), nodes, qualified)
    got = found.collect()
    order = sorted(range(n), key=lambda i: (seqs[i] is not None, seqs[i] or 0))
    want = [(f"c{i}" if i % 2 == 0 else f"C{i:03}", "internal" if i % 2 == 0 else "external", 1 + i % 3) for i in order]
    assert [(e.name, e.resolution, e["count"]) for e in got[0].callers] == want and len(got) == 1
    assert all(got[0][side] is None for side in ("callees", "renders", "rendered_by", "children"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "sort_array" in plan


def test_rounds_of_page_rank_do_not_sort_edges(spark):
    """ranks are looked up by hash in every round."""
    seen = []

    def keep(frame, name):
        if name == "ranks":
            seen.append(frame._jdf.queryExecution().sparkPlan().toString())
        return spark.createDataFrame(frame.collect(), frame.schema)

    edges = spark.createDataFrame([("t", "a", "b"), ("t", "b", "a"), ("t", "c", "a")], "target string, frm string, to string")
    nodes = spark.createDataFrame([("t", x) for x in "abc"], "target string, id string")
    ranks, made, _ = cycles.page_rank(edges, nodes, rounds=2, keep=keep)
    assert made == 2 and abs(sum(r["rank"] for r in ranks.collect()) - 1) < 1e-9
    assert len(seen) == 1 and seen[0].count("ShuffledHashJoin") >= 2


def test_impact_report_puts_its_edges_together_once(spark, tmp_path, monkeypatch):
    """walk, counts and most frequent callers read edges that stand in a table."""
    kept, was = [], impact_report.stored
    monkeypatch.setattr(impact_report, "stored", lambda session, frame, name: kept.append(name) or was(session, frame, name))
    report = impact_report.run(spark, "/root/testdata/sf0.001", str(tmp_path), hops=4, rows=10**6, callers=3)
    assert kept == ["impact-calls"] and report.count() == 10


def test_sites_meet_few_symbols_of_a_name(spark):
    """what a site meets of a name doesn't grow with the name's arities and files."""
    nodes = spark.createDataFrame([("t", f"p{i}", "get", "method" if i % 2 else "function", None, f"f{i % 9}", i % 40, i) for i in range(400)], SYMBOLS)
    sites = nodes.selectExpr("target", "id AS site", "name", "file AS frm_file", "id AS exclude", "arity AS argc")
    found = resolve.lookup(sites, nodes, ("method", "function")).collect()
    assert len(found) == 400 and all(r.found not in (None, r.site) and r.ambiguous for r in found)
    asked = sites.selectExpr("target", "concat('=', name) AS _name", "frm_file", "argc").distinct()
    known = resolve._candidates(asked, nodes, ("method", "function")).collect()
    assert len(known) == 360 and max(sum(map(len, r[level])) for r in known for level in resolve.LEVELS) == 6


def shuffled_rows(frame):
    """The rows of a frame, and how many rows its plan has shuffled; an exchange that is read again counts once."""
    rows = frame.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        if kind == "ReusedExchangeExec":
            return 0
        made, children = plan.metrics().get("shuffleRecordsWritten"), plan.children()
        return (made.get().value() if made.isDefined() else 0) + sum(walk(children.apply(i)) for i in range(children.size()))

    return rows, walk(frame._jdf.queryExecution().executedPlan())


def test_sites_are_shuffled_twice_however_many_rules_there_are(spark):
    """very many callers that ask the same few things; the caller is left out where it has the name that it calls."""
    n = 2000
    nodes = spark.createDataFrame(
        [("t", "T", "Shop", "class", None, "a", None, 0)] + [("t", f"m{i}", f"sell{i % 2}", "method", "T", "a", None, i + 1) for i in range(4)] + [("t", f"g{i}", "get", "function", None, "ab"[i], None, i + 9) for i in range(2)], SYMBOLS
    )
    shapes = [("any", None, "m3"), ("sell1", "Shop", None), ("sell0", "Map", None), ("get", None, None), ("lost", None, None)]
    calls = [("t", f"f{i}", *shapes[i % 5], i % 10 == 4, True, None, "ab"[i % 2], i) for i in range(n)] + [("t", "m1", "sell1", "Shop", None, False, True, None, "a", n), ("t", "g1", "get", None, None, False, True, None, "b", n + 1)]
    made = resolve.call_edges(spark.createDataFrame(calls, "target string, frm string, name string, owner string, resolved string, local boolean, receiver boolean, argc int, frm_file string, seq int"), nodes)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, moved = shuffled_rows(made)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    got = {r.frm: (r.to, r.resolution, r.via, r.ambiguous) for r in rows}
    want = {f"f{i}": [("m3", "internal", None, None), ("m1", "internal", "Shop", None), ("Map.sell0", "external", None, None), (f"g{i % 2}", "internal", None, True), ("lost", "local" if i % 10 == 4 else "external", None, None)][i % 5] for i in range(n)}
    assert moved <= 3 * n
    assert got == want | {"m1": ("m3", "internal", "Shop", None), "g1": ("g0", "internal", None, None)}
