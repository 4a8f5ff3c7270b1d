"""Parsers, resolution, retrieval, context and checks on a small order system in four languages."""

import json

import pytest
from pyspark.sql import functions as F
from sources import FILES, PYTHON

from loomgraph.operators import context, graph, retrieve
from loomgraph.plans import build, smoke
from loomgraph.sources import files as sources
from loomgraph.sources.parse import parse_text


def parsed(path):
    target, _, text = next(f for f in FILES if f[1] == path)
    language = {"py": "python", "java": "java", "c": "c", "js": "javascript"}[target]
    sink = parse_text(path, language, text)
    assert not sink.failures
    return sink, {n["id"].partition("::")[2]: n for n in sink.nodes[1:]}


def calls(sink, end):
    return [(c["name"], c["owner"], c["receiver"], c["local"], c["argc"]) for c in sink.calls if c["frm"].endswith(end)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "target string, path string, text string")


@pytest.fixture(scope="module")
def built(spark, files):
    return build.build(spark, files)


@pytest.fixture(scope="module")
def edges(built):
    return {(r.frm, r.to, r.type): r for r in built.edges.collect()}


def test_python_symbols():
    sink, nodes = parsed("py/ledger.py")
    kinds = {k: n["type"] for k, n in nodes.items()}
    assert kinds == {
        "LIMIT": "constant", "Entry": "class", "Entry::key": "field", "Entry::amount": "field", "Ledger": "class", "Ledger::add/3": "method", "Ledger::check/2": "method",
        "Ledger::check/2::inner/0": "function", "Helper": "class", "Helper::clean/1": "method", "main/0": "function",
    }
    assert nodes["Entry::amount"]["value_type"] == "int" and nodes["Entry"]["doc"] == "One line."
    assert nodes["Ledger::check/2"]["is_async"] and nodes["Ledger::add/3"]["signature"] == "def add(self, entry, *, force=False)"
    assert calls(sink, "add/3") == [("check", "Ledger", False, False, 2), ("add", None, True, False, 2), ("clean", "Helper", True, False, 2)]
    assert calls(sink, "check/2") == [("inner", None, False, False, 0)] and calls(sink, "inner/0") == [("deep", None, False, False, 1)]
    assert calls(sink, "ledger.py") == [("main", None, False, False, 0)]
    assert [r["name"] for r in sink.refs] == ["BaseLedger", "dataclasses", "json"]
    assert ("dataclass", "decorated_by") in [(e["to"], e["type"]) for e in sink.edges]


def test_python_syntax_error_keeps_the_file():
    sink, nodes = parsed("py/broken.py")
    assert not nodes and "line 1" in sink.nodes[0]["parse_error"]


def symbols_of(path, language, text):
    from loomgraph.sources.parse import parse_text

    sink = parse_text(path, language, text)
    assert not sink.failures
    return [(n["name"], n["type"], n["line_start"], n["line_end"]) for n in sink.nodes[1:]], [(c["frm"].rpartition("::")[2], c["name"]) for c in sink.calls]


def test_c_declarators():
    text = """int (*fp)(int);
void (*table[3])(void);
typedef int (*callback)(int);
typedef unsigned long size;
int x, *y = 0, z[3];
int (*rows)[3];
static int *p(void);
__attribute__((unused)) static int h(void) { return p(); }
int old(a, b)
int a;
char b;
{
  return h();
}
int after(int q) __attribute__((noinline));
int last(void) { return 0; }
struct S { int (*cmp)(int); char n[3], *m; };
int aligned __attribute__((aligned(8))) = 3;
extern int each(int (*callback)(int), int n);
"""
    found, calls_ = symbols_of("a.c", "c", text)
    assert found == [
        ("h", "function", 8, 8), ("old", "function", 9, 14), ("last", "function", 16, 16), ("x", "global", 5, 5), ("y", "global", 5, 5), ("z", "global", 5, 5), ("p", "function_declaration", 7, 7),
        ("after", "function_declaration", 15, 15), ("aligned", "global", 18, 18), ("each", "function_declaration", 19, 19), ("S", "struct", 17, 17), ("n", "field", 17, 17), ("m", "field", 17, 17), ("size", "typedef", 4, 4),
    ]
    assert calls_ == [("h/0", "p"), ("old/0", "h")]


def test_java_text_blocks():
    found, calls_ = symbols_of("A.java", "java", 'class A {\n String s = """\n  { "x" \\""" }\n  """;\n int n;\n void f(int a) { g(); }\n}\n')
    assert found == [("A", "class", 1, 7), ("s", "field", 2, 4), ("n", "field", 5, 5), ("f", "method", 6, 6)] and calls_ == [("f/1", "g")]


def test_javascript_default_exports():
    found, _ = symbols_of("b.jsx", "javascript", "export default function App() { return <Box/>; }\n")
    assert found == [("App", "component", 1, 1)]
    found, calls_ = symbols_of("b.jsx", "javascript", "export default async function () { return go(); }\n")
    assert found == [("b", "function", 1, 1)] and calls_ == [("b/0", "go")]
    assert symbols_of("c.js", "javascript", "export default function* gen() { yield 1; }\nexport default class Foo { m() {} }\n")[0] == [("gen", "function", 1, 1), ("Foo", "component", 2, 2), ("m", "method", 2, 2)]


@pytest.mark.parametrize("root", ["code/team/code", "c++", "team.d"])
def test_targets_under_odd_roots(spark, tmp_path, root):
    place = tmp_path / root
    (place / "shop/lib").mkdir(parents=True)
    (place / "shop/lib/a.py").write_text("x = 1\n")
    (place / "team").mkdir(exist_ok=True)
    (place / "team/b.c").write_text("int x;\n")
    for spelled in (str(place), f"{place}/", f"file://{place}"):
        got = {(r.target, r.path) for r in sources.source_files(spark, spelled).collect()}
        assert got == {("shop", "shop/lib/a.py"), ("team", "team/b.c")}


def test_command_line_builds_and_checks(spark, tmp_path, capsys):
    from loomgraph import __main__ as command

    root, out, spec = tmp_path / "code", str(tmp_path / "graphs"), tmp_path / "spec.txt"
    (root / "shop").mkdir(parents=True)
    (root / "shop/a.py").write_text("class Till:\n    def total(self):\n        return 1\n")
    (root / "bad").mkdir()
    (root / "bad/b.py").write_text("def x(:\n")
    assert command.main(["build", str(tmp_path / "code"), out]) == 0 and "shop: 3 nodes" in capsys.readouterr().out
    spec.write_text("[shop]\nwhat does Till.total do?\nwhere is useNothing? (must refuse)\n")
    assert command.main(["check", str(spec), out, "--root", str(root)]) == 0 and "2/2 cases clean" in capsys.readouterr().out
    (root / "shop/a.py").write_text("class Till:\n    pass\n")
    assert command.main(["check", str(spec), out, "--root", str(root)]) == 1 and "shop: stale graph" in capsys.readouterr().out
    spec.write_text("[shop]\nwhere is useNothing?\n[gone]\nwhat is x?\n")
    assert command.main(["check", str(spec), out]) == 1
    said = capsys.readouterr().out
    assert "gone: no graph" in said and "0/1 cases clean" in said
    assert command.main(["check", str(spec), out, "--target", "other"]) == 2


def test_settings():
    from loomgraph.settings import Settings

    assert Settings.read({}) == Settings()
    own = Settings.read({"LOOMGRAPH_RETRIES": "7", "LOOMGRAPH_SEMANTIC": "OFF", "LOOMGRAPH_MAX_NODES": ' "3" '})
    assert (own.retries, own.semantic, own.max_nodes) == (7, "off", 3)
    with pytest.raises(ValueError):
        Settings.read({"LOOMGRAPH_SEMANTIC": "some"})


def test_vectors_languages_status_and_second_answers(spark, tmp_path):
    from loomgraph.operators import graph, semantic
    from loomgraph.plans import smoke

    hashes = spark.createDataFrame([("a", "h1"), ("b", "h2")], "target string, hash string")
    vectors = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0])], "target string, id string, vector array<double>")
    path = str(tmp_path / "vectors")
    for _ in range(2):  # a write that is tried again leaves one copy
        sources.write_vectors(vectors, hashes, "m1", path)
    sources.write_vectors(vectors.filter("target = 'a'"), hashes, "m2", path)
    cache = sources.read_vectors(spark, path)
    assert sorted((r.target, r.id) for r in sources.vectors_for(cache, hashes, "m1").collect()) == [("a", "x"), ("b", "y")]
    newer = spark.createDataFrame([("a", "h9"), ("b", "h2")], "target string, hash string")
    assert [r.id for r in sources.vectors_for(cache, newer, "m1").collect()] == ["y"]

    meta = spark.createDataFrame(
        [("a", "python", {"python": 2, "c": 1}, [("f", "e")]), ("b", "java", None, []), ("c", None, {}, None)], "target string, language string, languages map<string,bigint>, parse_failures array<struct<file:string,error:string>>"
    )
    nodes = spark.createDataFrame([("b", "f1", "file"), ("b", "f2", "file"), ("b", "n", "class")], "target string, id string, type string")
    assert {r.target: r.languages for r in graph.languages(meta, nodes).collect()} == {"a": {"python": 2, "c": 1}, "b": {"java": 2}, "c": {}}
    stale = spark.createDataFrame([("b", "x", "missing"), ("b", "y", "changed"), ("b", "z", "changed")], "target string, file string, status string")
    assert {r.target: (r.missing, r.changed, r.failed, r.is_stale) for r in graph.status(meta, stale).collect()} == {"a": (0, 0, 1, False), "b": (1, 2, 0, True), "c": (0, 0, 0, False)}
    assert [r.target for r in smoke.missing_targets(spark.createDataFrame([("a",), ("q",), ("q",)], "target string"), meta).collect()] == ["q"]

    prompts = spark.createDataFrame([("1", "t", "p1"), ("2", "t", "p2")], "question_id string, target string, prompt string")
    answers = spark.createDataFrame([("1", "t", "first"), ("2", "t", "fine")], "question_id string, target string, answer string")
    found = spark.createDataFrame([("1", "k", "error", "m"), ("2", "k", "warning", "w")], "question_id string, kind string, severity string, message string")
    got = smoke.corrected(prompts, answers, found, lambda texts: [f"again after {'first' in t}" for t in texts]).collect()
    assert sorted((r.question_id, r.answer, r.retried) for r in got) == [("1", "again after True", True), ("2", "fine", False)]

    replies = spark.createDataFrame([("1", "t", 'I choose ["Shop.sell", "gone", "sell", "Shop"] ["x"]'), ("2", "t", "none")], "question_id string, target string, reply string")
    symbols = spark.createDataFrame([("t", "s", "Shop", "class", 1), ("t", "m", "sell", "method", 2), ("t", "m2", "sell", "method", 3)], "target string, id string, name string, type string, seq int")
    by_name = spark.createDataFrame([("t", "Shop.sell", "m"), ("t", "Shop", "s")], "target string, qualified string, id string")
    chosen = semantic.named_nodes(semantic.names_in_reply(replies), by_name, symbols).collect()
    assert sorted((r.question_id, r["rank"], r.id) for r in chosen) == [("1", 1, "m"), ("1", 2, "s")]
    named = graph.labels(spark.createDataFrame([("t", "m"), ("t", "lib.x")], "target string, id string"), by_name.select("target", "id", "qualified"))
    assert sorted(r.label for r in named.collect()) == ["Shop.sell", "lib.x"]


def test_a_batch_of_a_stream_that_is_tried_again_is_there_once(spark, tmp_path):
    from loomgraph.streaming import incremental

    root, out = tmp_path / "code", str(tmp_path / "rows")
    (root / "py").mkdir(parents=True)
    (root / "py/a.py").write_text("def only():\n    pass\n")
    for state in ("one", "two"):  # another checkpoint runs batch 0 again
        assert incremental.follow(spark, str(root), out, str(tmp_path / state)).awaitTermination(120)
    assert spark.read.parquet(out).filter("kind = 'node'").count() == 2


def test_java_symbols():
    sink, nodes = parsed("java/store/Store.java")
    assert {k: n["type"] for k, n in nodes.items()} == {
        "Store": "class", "Store::items": "field", "Store::a": "field", "Store::b": "field", "Store::Store/1": "constructor", "Store::find/1": "method", "Store::find/2": "method",
        "Store::reset/1": "method", "Store::Kind": "enum", "Store::Kind::rank/0": "method",
    }
    assert nodes["Store"]["doc"] == "Keeps items." and (nodes["Store::find/2"]["line_start"], nodes["Store::find/2"]["line_end"]) == (20, 26)
    assert nodes["Store::items"]["value_type"] == "Map"
    assert calls(sink, "find/2") == [("find", "Store", False, False, 1), ("copy", "Item", True, False, 0)]
    assert [(r["name"], r["type"]) for r in sink.refs] == [("BaseStore", "extends"), ("Closeable", "implements"), ("Iterable", "implements"), ("Item", "implements"), ("java.util.Map", "imports"), ("java.util.HashMap", "imports")]
    sink, _ = parsed("java/Desk.java")
    assert calls(sink, "serve/1") == [("Store", "Store", False, False, 1), ("find", "Store", True, False, 1), ("find", "Store", True, False, 2), ("find", "Client", True, False, 1), ("max", "Math", True, False, 2), ("serve", "Desk", False, False, 1), ("println", None, True, False, 1)]


def test_c_symbols():
    sink, nodes = parsed("c/pool.h")
    assert {k: n["type"] for k, n in nodes.items()} == {
        "pool_take/2": "function_declaration", "pool_count/0": "function_declaration", "pool_log/2": "function_declaration", "pool": "struct", "pool::name": "field",
        "pool::slots": "field", "pool::used": "field", "color": "enum", "color::RED": "enum_constant", "color::GREEN": "enum_constant", "pool_t": "typedef", "POOL_MAX": "macro", "POOL_SIZE": "macro",
    }
    assert nodes["pool_take/2"]["doc"] == "Takes one." and (nodes["POOL_SIZE"]["line_start"], nodes["POOL_SIZE"]["line_end"]) == (8, 9)
    assert [r["name"] for r in sink.refs] == ["item.h"] and [e["to"] for e in sink.edges if e["type"] == "includes"] == ["stddef.h"]
    sink, nodes = parsed("c/pool.c")
    assert list(nodes) == ["pool_count/0", "pool_take/2", "total", "spare"]
    assert calls(sink, "pool_take/2") == [("hook", None, True, False, 1), ("pool_count", None, False, False, 0), ("helper", None, False, False, 2)]


def test_javascript_symbols():
    sink, nodes = parsed("js/Table.jsx")
    assert {k: n["type"] for k, n in nodes.items()} == {"API_URL": "constant", "loadRows/1": "function", "useRows/0": "hook", "useRows/0::reload/0": "function", "Table": "component", "Table::render/0": "method", "Table::sort/1": "method"}
    assert nodes["loadRows/1"]["is_async"] and nodes["loadRows/1"]["signature"] == "export async function loadRows(page)"
    assert (nodes["useRows/0::reload/0"]["line_start"], nodes["useRows/0::reload/0"]["line_end"]) == (14, 16)
    assert calls(sink, "loadRows/1") == [("fetch", None, False, False, 1), ("encode", None, False, False, 1), ("json", None, True, False, 0)]
    assert calls(sink, "useRows/0") == [("useState", None, False, False, 1), ("useCallback", None, False, False, 2)]
    assert calls(sink, "reload/0") == [("setRows", None, False, True, 1), ("loadRows", None, False, True, 1)]
    assert calls(sink, "render/0")[0][:3] == ("sort", None, False) and calls(sink, "sort/1") == [("replace", None, True, False, 2)]
    assert [(r["name"], r["type"]) for r in sink.refs] == [("React.Component".rpartition(".")[2], "extends"), ("Row", "renders"), ("./Row", "imports")]
    sink, nodes = parsed("js/Row.js")
    assert [(n["name"], n["type"]) for n in nodes.values()] == [("Row", "component")]


def test_structural_invariants(built):
    nodes = built.nodes
    assert nodes.count() == nodes.select("target", "id").distinct().count()
    assert nodes.filter("type != 'file' AND (line_start < 1 OR line_end < line_start OR parent IS NULL)").count() == 0
    assert nodes.filter("id LIKE '%\\\\\\\\%' OR file LIKE '%notes%'").count() == 0
    inner = built.edges.filter("resolution = 'internal'")
    assert inner.join(nodes.select("target", F.col("id").alias("to")), ["target", "to"], "left_anti").count() == 0
    assert built.edges.groupBy("target", "frm", "to", "type").count().filter("count > 1").count() == 0


def test_resolution(edges):
    def to(frm, end, type_="calls"):
        return next((e for (f, t, k), e in edges.items() if f.endswith(frm) and t.endswith(end) and k == type_), None)

    assert to("Desk::serve/1", "Store::find/1").via == "Store" and to("Desk::serve/1", "Store::find/2").via == "Store"
    assert to("Desk::serve/1", "Client.find").resolution == "external" and to("Desk::serve/1", "Math.max").external
    assert to("Desk::serve/1", "Store::Store/1").resolution == "internal" and to("Desk::serve/1", "Desk::serve/1").via == "Desk"
    assert to("Store::find/2", "Store::find/1") is not None and to("Store::find/2", "Store::find/2") is None
    assert to("Ledger::add/3", "Ledger::check/2").via == "Ledger" and to("Ledger::add/3", "Helper::clean/1") is not None
    assert to("Ledger::add/3", "Ledger::add/3") is None or not to("Ledger::add/3", "Ledger::add/3").via
    assert to("pool_take/2", "c/pool.c::pool_count/0") is not None and to("pool_take/2", "hook").external
    assert to("c/pool.h::pool_count/0", "c/pool.c::pool_count/0", "defined_by") is not None
    assert to("c/pool.c", "c/pool.h", "includes").resolution == "internal" and to("c/pool.h", "item.h", "includes").external
    assert to("reload/0", "setRows").resolution == "local" and to("reload/0", "loadRows/1").resolution == "internal"
    assert to("Table::render/0", "js/Row.js::Row/0", "renders").resolution == "internal"
    assert to("js/Table.jsx", "js/Row.js", "imports") is not None and to("js/Table.jsx", "react", "imports").external
    assert to("java/Desk.java", "Store::Store/1", "imports") is None and to("java/Desk.java", "java/store/Store.java::Store", "imports") is not None


def test_meta_and_names(built):
    meta = {r.target: r for r in built.meta.collect()}
    assert set(meta) == {"py", "java", "c", "js"} and meta["py"].languages == {"python": 2} and len(meta["c"].hash) == 16
    names = {r.id: r.qualified for r in graph.qualified_names(built.nodes).collect()}
    assert names["py/ledger.py::Ledger::check/2::inner/0"] == "Ledger.check.inner" and names["java/store/Store.java::Store::Kind::rank/0"] == "Store.Kind.rank"
    by_name = graph.by_qualified_name(built.nodes, graph.qualified_names(built.nodes)).filter("qualified = 'Store.find'").collect()
    assert [r.id for r in by_name] == ["java/store/Store.java::Store::find/2"]


QUESTIONS = [
    (1, "py", "What does Ledger.add do?", False, "qualified"), (2, "py", "What does Ledger.remove do?", True, "qualified-miss"), (3, "py", "What does Helper.check do?", True, "qualified-miss"),
    (4, "js", "Where is useBasket defined?", True, "named-symbol-miss"), (5, "js", "What does useRows return?", False, "exact"), (6, "c", "What does pool_take do?", False, "exact"),
    (7, "java", "where do we copy the other item?", False, "lexical"), (8, "c", "zzz qqq?", True, "none"), (9, "c", "which macro is POOL_MAX?", False, "exact"), (10, "py", "which hook is Ledger?", False, None),
]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([q[:4] for q in QUESTIONS], "question_id int, target string, question string, must_refuse boolean")


@pytest.fixture(scope="module")
def retrieved(spark, built, files, asked):
    matches, rows = retrieve.retrieve(asked.select("target", "question_id", "question"), built.nodes, snippets=build.snippets(built.nodes, files))
    return build.stored(spark, matches, "m"), build.stored(spark, rows, "r")


def test_layers(asked, retrieved):
    matches, rows = retrieved
    got = {r.question_id: r for r in rows.collect()}
    assert len(got) == len(QUESTIONS)
    for n, _, _, _, strategy in QUESTIONS:
        assert strategy is None or got[n].strategy == strategy, (n, got[n])
    assert got[1].confidence == "HIGH" and got[8].confidence == "NONE" and got[8].suggestions
    assert got[2].reason == "`Ledger` exists in this codebase but it has no member named `remove`."
    assert got[3].reason == "`check` exists in this codebase but not as a member of `Helper`."
    assert got[4].reason == "The question names `useBasket`, and no symbol with that name exists in this codebase."
    found = {(r.question_id, r["rank"]): r.id for r in matches.collect()}
    assert found[(6, 1)] == "c/pool.c::pool_take/2" and (6, 2) not in found
    assert found[(1, 1)] == "py/ledger.py::Ledger::add/3"
    results = smoke.run(asked.filter("question_id < 10"), rows)
    assert smoke.problems(results).count() == 0 and smoke.rollup(results).first().asDict() == {"checked": 9, "clean": 9}


def test_blocks_prompts_checks_and_drawings(spark, built, files, asked, retrieved):
    matches, rows = retrieved
    qualified = graph.qualified_names(built.nodes)
    blocks = build.stored(spark, context.context_blocks(matches, built.nodes, built.edges, qualified, build.snippets(built.nodes, files)), "b")
    own = {r.question_id: r for r in blocks.filter("rank = 1").collect()}
    assert own[1].snippet.startswith("    def add(self, entry") and [e.name for e in own[1].callees][0] == "Ledger.check"
    assert [e.name for e in own[1].callers] == ["Ledger.add", "main"] and own[1].parent_name == "Ledger"
    prompts = {r.question_id: r.prompt for r in context.prompts(asked, rows, blocks).collect()}
    assert len(prompts) == len(QUESTIONS) and "CALLED BY: Ledger.add [internal], main [internal]" in prompts[1] and "py/ledger.py#L17-20" in prompts[1]
    assert "ANSWER: Not found in the knowledge graph for py." in prompts[2]
    answers = spark.createDataFrame(
        [(1, "py", "`Ledger.add` at .\\py\\ledger.py#L17-20 calls `Ledger.check` in `ledger.py`"), (5, "js", "something at js/Table.jsx#L1-2 and other.js#L3-4, `Ghost.walk`"), (6, "c", ""), (8, "c", "no blocks")],
        "question_id int, target string, answer string",
    )
    found = context.verify(answers, blocks, built.nodes, qualified)
    kinds = sorted((r.question_id, r.kind, r.severity) for r in found.collect())
    assert kinds == [(5, "fabricated_range", "error"), (5, "fabricated_range", "error"), (5, "invented_symbol", "warning"), (5, "renamed_symbol", "error")]
    assert found.groupBy("question_id").agg(context.worst_severity().alias("w")).first().w == "error"
    again = context.corrections(context.prompts(asked, rows, blocks), answers, found).collect()
    assert [r.question_id for r in again] == [5] and "- **renamed_symbol**" in again[0].correction
    dots = {r.question_id: r.dot for r in context.drawings(blocks).collect()}
    assert dots[1].startswith("digraph G {") and '"py/ledger.py::main/0" -> "py/ledger.py::Ledger::add/3" [label="calls", style=solid' in dots[1]


def test_files_graphs_and_questions(spark, built, tmp_path):
    root = tmp_path / "code"
    for _, path, text in FILES:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "js/node_modules").mkdir()
    (root / "js/node_modules/x.js").write_text("f()")
    (root / "py/bad.py").write_bytes(b"x = '\xff'\r\ny = 1\r\n")
    found = sources.source_files(spark, str(root))
    assert sorted(r.path for r in found.collect()) == sorted([p for _, p, _ in FILES if not p.endswith(".txt")] + ["py/bad.py"])
    assert found.filter("path = 'py/bad.py'").first().text == "x = '�'\ny = 1\n"
    assert {r.target for r in sources.codebases(found).collect()} == {"py", "java", "c", "js"}
    stale = graph.staleness(spark.createDataFrame([("t", "a", "1"), ("t", "b", None), ("t", "c", "2"), ("t", "d", "3")], "target string, file string, hash string"), spark.createDataFrame([("t", "a", "1"), ("t", "b", "x"), ("t", "c", "9")], "target string, file string, hash string"))
    assert {r.file: r.status for r in stale.collect()} == {"b": "unverifiable", "c": "changed", "d": "missing"}
    out = str(tmp_path / "graph")
    sources.write_graph(*built, out)
    nodes, edges, meta = sources.read_graph(spark, out)
    assert (nodes.count(), edges.count(), meta.count()) == (built.nodes.count(), built.edges.count(), 4)
    documents = {r.target: json.loads(r.json) for r in sources.graph_json(*built).collect()}
    py = documents["py"]
    assert py["nodes"][0]["id"] == "py/broken.py" and py["nodes"][0]["parent"] is None and "arity" not in py["nodes"][0]
    assert py["meta"]["languages"] == {"python": 2} and {"from", "to", "type", "external", "resolution", "count"} <= set(py["edges"][0])
    (tmp_path / "g.json").write_text(json.dumps(py))
    nodes, edges, meta = sources.load_graph_json(spark, str(tmp_path / "g.json"))
    assert (nodes.count(), edges.count(), meta.first().target) == (len(py["nodes"]), len(py["edges"]), "py")
    spec = tmp_path / "q.txt"
    spec.write_text("# head\nno target?\n[py]\nWhat is Ledger?   # note\nWhat is x?  (must refuse)\nnot a question\n\n[js]\n# a comment?\nWho? (MUST refuse)\n")
    got = [(r.target, r.question, r.must_refuse) for r in sources.questions(spark, str(spec)).orderBy("question_id").collect()]
    assert got == [("py", "What is Ledger?", False), ("py", "What is x?", True), ("js", "Who?", True)]


def test_models_are_called_in_batches(spark):
    frame = spark.range(70).select(F.concat(F.lit("t"), "id").alias("text")).coalesce(1)
    got = sources.mapped(frame, "text", "answer", lambda texts: [f"{len(texts)}" for _ in texts]).groupBy("answer").count().collect()
    assert {r.answer: r["count"] for r in got} == {"32": 64, "6": 6}


def test_stream_of_files(spark, tmp_path):
    from loomgraph.streaming import incremental

    root = tmp_path / "code"
    (root / "py").mkdir(parents=True)
    (root / "py/ledger.py").write_text(PYTHON)
    out = str(tmp_path / "rows")
    for text in (None, "def only():\n    pass\n"):
        if text:
            (root / "py/second.py").write_text(text)
        query = incremental.follow(spark, str(root), out, str(tmp_path / "state"))
        assert query.awaitTermination(120) and query.exception() is None
    rows = incremental.latest(spark.read.parquet(out))
    names = {r.name for r in rows.filter("kind = 'node'").select("node.name").collect()}
    assert {"Ledger", "only", "second.py"} <= names


def test_file_references_meet_firsts(spark):
    """Ten thousand files of one name, and references by path ends, names and stems, against a look at all files."""
    import random

    from loomgraph.operators import resolve

    rnd = random.Random(2)
    files = [(f"d{k}/lib/index.js", k * 7919 % 10_007) for k in range(10_000)] + [("a/b/util.py", 20_000), ("b/util.py", 20_001), ("util.c", 3), ("a/.env", 5), ("c/env", 4), ("x/a.b.js", 9)]
    specs = ["./index", "lib/index.js", "d77/lib/index.js", "../util", "b/util.py", "a/b/util.py", "util.h", ".env", "env", "a.b", "a.b.js", "", "./", "none", "x\\a.b.js", "lib/index", None] + [f"d{rnd.randrange(10_000)}/lib/index.js" for _ in range(20)]

    def stem_of(name):
        return name[: name.rindex(".")] if "." in name[1:] else name

    def first(spec):
        spec = (spec or "").replace("\\", "/").lstrip("./")
        base = spec.rpartition("/")[2]
        ends = [(seq, f) for f, seq in files if spec and (f == spec or f.endswith("/" + spec))]
        like = [(seq, f) for f, seq in files if spec and (f.rpartition("/")[2] == base or stem_of(f.rpartition("/")[2]) == stem_of(base))]
        return min(ends or like, default=(0, None))[1]

    refs = spark.createDataFrame([("t", str(k), s) for k, s in enumerate(specs)] + [("u", "x", "index.js")], "target string, site string, spec string")
    rows = resolve.file_refs(refs, spark.createDataFrame([("t", *f) for f in files], "target string, id string, seq int")).collect()
    assert {(r.target, r.site): r.found for r in rows} == {("t", str(k)): first(s) for k, s in enumerate(specs)} | {("u", "x"): None}
    assert len(rows) == len(specs) + 1


def test_semantic_ways(spark):
    """Vectors first, a model's choice for what they leave, one of them alone, or none."""
    nodes = spark.createDataFrame([("t", "f", "f.py", "file", None, "f.py", 0), ("t", "a", "Alpha", "class", "f", "f.py", 1), ("t", "b", "beta", "function", "a", "f.py", 2), ("t", "c", "gamma", "function", "f", "f.py", 3)], "target string, id string, name string, type string, parent string, file string, seq int")
    nodes = nodes.withColumns({"signature": F.lit(None).cast("string"), "doc": F.lit(None).cast("string")})
    asked = spark.createDataFrame([("t", 1, "zq vk"), ("t", 2, "xw qq"), ("t", 3, "zq jj")], "target string, question_id int, question string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    near = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0])], "question_id int, question_vector array<double>")

    def choose(prompts):
        assert all("SYMBOLS (3):" in p and "Alpha.beta (function, f.py)" in p for p in prompts)
        return ['Well: ["gamma", "Ghost", "Alpha.beta"] []' if "xw" in p else '["Alpha", "gamma"]' if "jj" in p else "none" for p in prompts]

    def found(semantic, **how):
        matches, rows = retrieve.retrieve(asked, nodes, semantic=semantic, **how)
        ids = {}
        for r in matches.orderBy("question_id", "rank").collect():
            ids.setdefault(r.question_id, []).append(r.id)
        strategies = {r.question_id: r.strategy for r in rows.collect()}
        assert {q: s for q, s in strategies.items() if s == "semantic"}.keys() == ids.keys()
        return ids

    both = {"vectors": vectors, "question_vectors": near, "choose": choose}
    assert found("auto", **both) == {1: ["a", "b"], 2: ["c", "b"], 3: ["a", "c"]}
    assert found("embeddings", **both) == {1: ["a", "b"]}
    assert found("llm", **both) == {2: ["c", "b"], 3: ["a", "c"]}
    assert found("off", **both) == {} and found("auto") == {}
    with pytest.raises(ValueError, match="semantic is one of"):
        retrieve.retrieve(asked, nodes, semantic="some")


def test_calls_are_tried_again(spark):
    state = {"failed": False}

    def call(texts):
        if not state["failed"]:
            state["failed"] = True
            raise RuntimeError("busy")
        return [t.upper() for t in texts]

    frame = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    assert [r.said for r in sources.mapped(frame, "text", "said", call, retries=1).collect()] == ["A", "B"]

    def never(texts):
        raise RuntimeError("gone")

    with pytest.raises(Exception, match="gone"):
        sources.mapped(frame, "text", "said", never, retries=2).collect()
