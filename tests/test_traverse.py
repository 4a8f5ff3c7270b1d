"""Walks against breadth-first search on random graphs with cycles, hubs and nulls."""

import random
from collections import deque

import pytest

from loomgraph.operators import traverse

EDGES = "target string, frm string, to string"


def graph(seed, n=40, m=90):
    rnd = random.Random(seed)
    out = [(t, f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for t in ("a", "b") for _ in range(m)]
    out += [("a", "n0", f"h{k}") for k in range(30)] + out[:5] + [("a", None, "n1"), ("a", "n1", None), ("b", "n3", "n3")]
    return out


def distances(edges, target, start):
    near, out, queue = {}, {start: 0}, deque([start])
    for t, a, b in edges:
        if t == target and a is not None and b is not None:
            near.setdefault(a, set()).add(b)
    while queue:
        at = queue.popleft()
        for b in near.get(at, ()):
            if b not in out:
                out[b] = out[at] + 1
                queue.append(b)
    return out, near


@pytest.mark.parametrize(("hub", "incoming"), [(100_000, True), (7, False)])
def test_reach_is_breadth_first(spark, hub, incoming):
    edges = graph(1)
    seeds = [(t, f"n{k}") for t in ("a", "b") for k in range(0, 40, 3)] + [("a", "nowhere"), ("a", None), ("a", "n0")]
    found = traverse.reach(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, "target string, id string"), incoming=incoming, hub=hub)
    assert found.complete
    turned = [(t, b, a) for t, a, b in edges] if incoming else edges
    want = {}
    for t, s in set(seeds) - {("a", None)}:
        far, near = distances(turned, t, s)
        for node, hop in far.items():
            before = [a for a in near if node in near[a] and far.get(a) == hop - 1]
            want[t, s, node] = (hop, min(before) if hop else None)
    rows = found.rows.collect()
    assert {(r.target, r.seed, r.node): (r.hop, r.parent) for r in rows} == want and len(rows) == len(want)
    assert sum(n for _, n in found.hops) == len(want)


def test_bounds_are_reported(spark):
    edges = spark.createDataFrame([("a", f"n{k}", f"n{k + 1}") for k in range(6)], EDGES)
    seeds = spark.createDataFrame([("a", "n0")], "target string, id string")
    short = traverse.reach(edges, seeds, hops=3)
    assert (short.hops, short.complete) == ([(0, 1), (1, 1), (2, 1), (3, 1)], False)
    few = traverse.reach(edges, seeds, rows=3)
    assert (len(few.hops), few.complete) == (3, False)
    assert traverse.reach(edges, seeds, hops=6).complete and traverse.reach(edges, seeds).hops[-1] == (6, 1)
    assert traverse.reach(edges, seeds.limit(0)).rows.count() == 0


@pytest.mark.parametrize("hub", [4])
def test_shortest_paths_are_breadth_first(spark, hub):
    edges = graph(2, n=60, m=100)
    rnd = random.Random(4)
    pairs = [(t, f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for t in ("a", "b") for _ in range(40)] + [("a", "n0", "n0"), ("a", "n0", "h5"), ("a", "x", "n1"), ("a", None, "n1")]
    rows, complete = traverse.shortest_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, EDGES), hub=hub)
    want = {}
    for t, a, b in set(pairs):
        far, near = distances(edges, t, a)
        if a is None or b not in far:
            continue
        back, _ = distances([(x, q, p) for x, p, q in edges], t, b)
        path = [a]
        while path[-1] != b:
            path.append(min(x for x in near[path[-1]] if back.get(x) == back[path[-1]] - 1))
        want[t, a, b] = (far[b], path)
    assert complete and {(r.target, r.frm, r.to): (r.length, r.path) for r in rows.collect()} == want
    assert max(n for n, _ in want.values()) > 4
    short, complete = traverse.shortest_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, EDGES), hops=2)
    assert not complete and {(r.target, r.frm, r.to): r.length for r in short.collect()} == {k: n for k, (n, _) in want.items() if n <= 2}
