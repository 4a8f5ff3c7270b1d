"""Close names against ``difflib`` over all names."""

import difflib
import random
import re

from loomgraph.operators import retrieve
from loomgraph.plans import catalogue
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def nearest(word, names):
    return difflib.get_close_matches(word, list(names), n=3, cutoff=0.6)


def offered(question, qualified, bare, limit=5):
    """Qualified names before bare ones, word by word; else the first names."""
    found = []
    for word in re.findall(r"[A-Za-z_]\w*", question):
        for pool in (qualified, bare):
            found += [k for k in (nearest(word, pool) if len(word) > 2 else []) if k not in found]
    return (found or sorted(qualified))[:limit]


def test_close_names_are_difflib(spark):
    rnd = random.Random(9)
    stems = ["cart", "Cart", "total", "user_id", "naïve", "日本", "x", "a" * 30, "ab" * 120, "get", "tes", "É"]
    names = {t: {rnd.choice(stems) + rnd.choice(["", ".", "_"]) + rnd.choice(stems) + rnd.choice(["", "1", "12", "99"]) for _ in range(150)} for t in ("a", "b")} | {"c": {"only"}}
    words = {"cart", "Carttotal", "total1", "naive", "usr_id", "zzz", "日本日本", "a" * 25, "ab" * 110, "getcart12", "tac", "x", "toatl_cart"} | {rnd.choice(sorted(names["a"]))[::-1] for _ in range(20)}
    pools = spark.createDataFrame([(t, len(n) % 2, n) for t, own in names.items() for n in own], "target string, pool int, known string")
    asked = spark.createDataFrame([(t, w) for t in ("a", "b", "c", "d") for w in sorted(words) * 2], "target string, word string")
    got = {}
    for r in retrieve.close_names(asked, pools).orderBy("rank").collect():
        got.setdefault((r.target, r.word, r.pool), []).append(r.known)
    want = {(t, w, p): nearest(w, [n for n in own if len(n) % 2 == p]) for t, own in names.items() for w in words for p in (0, 1)}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 30


def test_suggestions_are_brute_force(spark):
    rnd = random.Random(4)
    symbols = [("t", f"i{k}", rnd.choice(["load", "save", "send", "lead"]) + rnd.choice(["Cart", "Card", "Order"]), rnd.choice(["function", "file"])) for k in range(40)] + [("u", "z", "solo", "function")]
    nodes = spark.createDataFrame(symbols, "target string, id string, name string, type string")
    qualified = nodes.select("target", "id", F.concat(F.lit("Shop."), "name").alias("qualified"))
    asked = [("t", 1, "where is laodCart or saveCrad?"), ("t", 2, "Shop.sendOrdr"), ("t", 3, "qqqq zzzz"), ("u", 4, "is it so"), ("v", 5, "load"), ("t", 6, "")]
    rows = retrieve.suggestions(spark.createDataFrame(asked, "target string, question_id int, question string"), nodes, qualified).collect()
    bare = {t: {n for x, _, n, kind in symbols if x == t and kind != "file"} for t in "tuv"}
    assert {r.question_id: r.suggestions for r in rows} == {i: offered(q, {f"Shop.{n}" for n in bare[t]}, bare[t]) for t, i, q in asked}


def test_the_query_is_brute_force(spark):
    names = {r.p_name.replace(" ", "_") for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_name").collect()}
    rows = catalogue.queries()["close_matches"](spark, DATA).collect()
    nations = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{DATA}/nation.parquet").collect()}
    assert {r.question_id: r.suggestions.split(",") for r in rows} == {k: offered(f"find {n.lower()} almond_antique", names, names) for k, n in nations.items()}
