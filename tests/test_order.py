"""Components, ranks, innermost ranges and last states against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cycles, intervals

EDGES = "target string, frm string, to string"


def test_components_are_mutual_reach(spark):
    rnd = random.Random(6)
    edges = [(t, f"n{rnd.randrange(30):02}", f"n{rnd.randrange(30):02}") for t, m in (("a", 38), ("b", 60)) for _ in range(m)]
    edges += [("c", f"k{i}", f"k{(i + 1) % 9}") for i in range(9)] + [("c", "k3", "tail"), ("c", "tail", "tail"), ("c", None, "k1"), ("c", "only", "only")] + [("d", f"p{i}", f"p{i + 1}") for i in range(7)] + edges[:3]
    near = {}
    for t, a, b in edges:
        if a is not None:
            near.setdefault((t, a), set()).add((t, b))
            near.setdefault((t, b), set())

    def reached(start):
        seen, todo = {start}, [start]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    ways = {x: reached(x) for x in near}
    want = {(*x, min(y for y in ways[x] if x in ways[y])[1]) for x in near}
    rows = cycles.strongly_connected(spark.createDataFrame(edges, EDGES)).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert max(sum(c == x[2] for c in [w[2] for w in want]) for x in want) > 5
    assert cycles.strongly_connected(spark.createDataFrame([], EDGES)).count() == 0


def test_page_rank_is_the_iteration(spark):
    rnd = random.Random(3)
    names = [("a", f"n{k}") for k in range(12)] + [("b", "x"), ("b", "y"), ("c", "alone"), ("a", None)]
    edges = [("a", f"n{rnd.randrange(9)}", f"n{rnd.randrange(12)}") for _ in range(30)] + [("b", "x", "y"), ("b", "x", "gone"), ("b", None, "x")]
    own = {t: [n for x, n in names if x == t and n] for t in "abc"}
    links = {t: [(a, b) for x, a, b in edges if x == t and a in own[t] and b in own[t]] for t in own}

    def stepped(t, ranks):
        out = {n: sum(a == n for a, _ in links[t]) for n in ranks}
        lost = sum(r for n, r in ranks.items() if not out[n])
        return {n: 0.15 / len(ranks) + 0.85 * (sum(ranks[a] / out[a] for a, b in links[t] if b == n) + lost / len(ranks)) for n in ranks}

    ranks = {t: dict.fromkeys(n, 1 / len(n)) for t, n in own.items()}
    for _ in range(7):
        ranks = {t: stepped(t, r) for t, r in ranks.items()}
    frames = spark.createDataFrame(edges, EDGES), spark.createDataFrame(names, "target string, id string")
    got, made, _ = cycles.page_rank(*frames, rounds=7)
    assert made == 7 and {(r.target, r.node): r.rank for r in got.collect()} == pytest.approx({(t, n): x for t, r in ranks.items() for n, x in r.items()})
    got, made, moved = cycles.page_rank(*frames, rounds=30, within=1e-3)
    assert made < 30 and moved <= 1e-3 and got.groupBy("target").agg(F.sum("rank").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_innermost_ranges(spark):
    rnd = random.Random(5)
    ranges = [(rnd.choice("fg"), s := rnd.randrange(60), s + rnd.choice([0, 1, 3, 7, 20, 64, -2]), f"r{k:02}") for k in range(50)]
    ranges += [("f", 10, 20, "twin b"), ("f", 10, 20, "twin a"), ("h", 0, 2**31 - 1, "all"), ("f", None, 9, "null"), (None, 1, 99, "no key"), ("h", 5, 5, "five"), ("h", 2**30 - 1, 2**30 + 5, "far"), ("f", -3, 4, "minus")]
    points = [(k, rnd.choice("fgx"), rnd.randrange(-2, 130)) for k in range(300)] + [(900, "h", 5), (901, "h", 2**31 - 1), (902, "h", 0), (903, "h", 2**30), (904, "f", None), (905, None, 5), (906, "h", 6), (907, "f", 15), (907, "f", 15)]
    got = intervals.innermost(spark.createDataFrame(points, "k int, file string, line long"), spark.createDataFrame(ranges, "file string, line_start long, line_end long, id string"), ["file"]).collect()

    def best(file, line):
        fits = [(b - a, -a, i) for f, a, b, i in ranges if file and f == file and a is not None and line is not None and 0 <= a <= line <= b]
        return min(fits)[2] if fits else None

    whole = [p for p in points if p[0] not in (904, 905)]
    assert sorted(map(str, ((r.k, r.file, r.line, r.id) for r in got if r.k not in (904, 905)))) == sorted(str((k, f, n, best(f, n))) for k, f, n in whole)
    assert [r.id for r in got if r.k in (904, 905)] == [None, None]


@pytest.mark.parametrize("rows", [1_000_000, 7])
def test_last_states(spark, rows):
    rnd = random.Random(8)
    states = [(rnd.choice(["hot", "b"]), rnd.randrange(80), k, f"s{k}") for k in range(60)] + [("hot", 40, 100 + k, f"tie{k}") for k in range(20)] + [("late", 99, 1, "z"), (None, 1, 2, "n"), ("b", None, 3, "m")]
    asked = [(k, rnd.choice(["hot", "hot", "hot", "b", "late", "none"]), rnd.randrange(-5, 110)) for k in range(200)] + [(900, None, 5), (901, "hot", None), (902, "hot", 40), (902, "hot", 40)]
    left, right = spark.createDataFrame(asked, "k int, key string, at long"), spark.createDataFrame(states, "key string, at long, n int, state string")
    got = intervals.as_of(left, right, ["key"], "at", "n", rows=rows)

    def last(key, at):
        fits = [(t, n, s) for x, t, n, s in states if None not in (x, t, key, at) and x == key and t <= at]
        return max(fits)[1:] if fits else (None, None)

    assert got.columns == ["key", "at", "k", "n", "state"]
    assert sorted(map(str, ((r.k, r.key, r.at, r.n, r.state) for r in got.collect()))) == sorted(str((k, x, t, *last(x, t))) for k, x, t in asked)
    with pytest.raises(ValueError, match="both sides: k"):
        intervals.as_of(left, right.withColumn("k", F.lit(1)), ["key"], "at", "n")
    assert intervals.as_of(left, right.limit(0), ["key"], "at", "n").filter("n IS NOT NULL").count() == 0
