"""Walks over many edges: what a symbol reaches or is reached from, and shortest paths.

A walk is a frontier that is joined with the edges once a hop. What a hop finds is first reduced to one row for each
(seed, node), then freed of what was seen before by an anti-join, and written; so no hop repeats an earlier one's work and
a lost executor costs rereads only. Nodes with very many edges (hubs) are dealt to parts: their edges by the far
end, and frontier rows at a hub to all of its parts, so no task holds all edges of one node. Bounds on hops and rows
are the caller's, and ``Reach.complete`` says whether one of them ended the walk.

Edges and seeds are rows of (target, ...), so one walk serves many codebases.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of a node from which on it is dealt to parts, and edges of a part.
HUB = 100_000
#: Most rows of a table of hubs that is broadcast.
SENT = 100_000
ROW = ["target", "seed", "node", "hop", "parent"]
PAIR = ["target", "frm", "to"]


class Reach(NamedTuple):
    """``rows`` (target, seed, node, hop, parent): each node once for each seed, at its least distance, with the smallest
    node before it on a shortest walk (null for the seed itself). ``hops`` (hop, found) counts them; ``complete`` is False
    where the hops or rows allowed weren't enough."""

    rows: DataFrame
    hops: list[tuple[int, int]]
    complete: bool


def _kept(spark: SparkSession, keep: Callable[[DataFrame, str], DataFrame] | None):
    from ..plans.build import stored

    return keep or (lambda frame, name: stored(spark, frame, name))


def dealt_edges(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], hub: int = HUB) -> tuple[DataFrame, DataFrame | None]:
    """Edges (target, at, to, part), each once, and the hubs (target, at, parts), or None where there are none."""
    own = keep(edges.select("target", F.col("frm").alias("at"), "to").filter("at IS NOT NULL AND to IS NOT NULL").distinct(), "walk-edges")
    degrees = own.groupBy("target", "at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub)
    hubs = keep(degrees.select("target", "at", F.ceil(F.col("n") / hub).cast("int").alias("parts")), "hubs")
    n = hubs.count()
    if not n:
        return own.withColumn("part", F.lit(0)), None
    hubs = F.broadcast(hubs) if n <= SENT else hubs
    part = F.coalesce(F.pmod(F.xxhash64("to"), F.col("parts")).cast("int"), F.lit(0))
    return keep(own.join(hubs, ["target", "at"], "left").select("target", "at", "to", part.alias("part")), "dealt-edges"), hubs


def step(frontier: DataFrame, edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """(target, seed, node, parent) one edge further than the frontier (target, seed, node), each (seed, node) once."""
    at = frontier.select("target", "seed", F.col("node").alias("at"))
    if hubs is None:
        at = at.withColumn("part", F.lit(0))
    else:
        parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        at = at.join(hubs, ["target", "at"], "left").select("target", "seed", "at", F.explode(parts).alias("part"))
    return at.join(edges, ["target", "at", "part"]).groupBy("target", "seed", F.col("to").alias("node")).agg(F.min("at").alias("parent"))


def reach(edges: DataFrame, seeds: DataFrame, *, incoming: bool = False, hops: int | None = None, rows: int | None = None, hub: int = HUB, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Reach:
    """What the seeds (target, id) reach over edges (target, frm, to); with ``incoming`` what reaches them. At most ``hops``
    edges far, and no further hop once ``rows`` rows are found. A seed is at distance 0 from itself, whether edges know
    it or not; nulls take no part."""
    keep = _kept(edges.sparkSession, keep)
    if incoming:
        edges = edges.select("target", F.col("to").alias("frm"), F.col("frm").alias("to"))
    edges, hubs = dealt_edges(edges, keep, hub)
    start = seeds.select("target", F.col("id").alias("seed")).filter("seed IS NOT NULL").distinct()
    frontier = keep(start.select("target", "seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), F.lit(None).cast(start.schema["seed"].dataType).alias("parent")), "hop-0")
    levels, found = [frontier], [(0, frontier.count())]
    while found[-1][1]:
        if (hops is not None and found[-1][0] >= hops) or (rows is not None and sum(n for _, n in found) >= rows):
            more = step(frontier, edges, hubs).join(_seen(levels), ["target", "seed", "node"], "left_anti")
            return Reach(_union(levels), found, more.isEmpty())
        hop = found[-1][0] + 1
        new = step(frontier, edges, hubs).join(_seen(levels), ["target", "seed", "node"], "left_anti")
        frontier = keep(new.withColumn("hop", F.lit(hop)).select(*ROW), f"hop-{hop}")
        found.append((hop, frontier.count()))
        levels.append(frontier)
    return Reach(_union(levels), [x for x in found if x[1]], True)


def _union(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _seen(levels: list[DataFrame]) -> DataFrame:
    return _union([level.select("target", "seed", "node") for level in levels])


def shortest_paths(edges: DataFrame, pairs: DataFrame, *, hops: int | None = None, hub: int = HUB, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, bool]:
    """(target, frm, to, length, path) of pairs (target, frm, to) that a walk joins, and False where ``hops`` ended the search.
    The path is the array of its nodes; of several shortest ones the one whose nodes are smallest from the start.

    Both ends walk in turn, the one with the smaller frontier first, until they meet, so a pair costs two walks of half the
    length. A pair that hasn't met before meets where both walks are at their last hop, so only those rows are compared, from the
    end that knows fewer nodes of its pairs."""
    keep = _kept(edges.sparkSession, keep)
    left = keep(pairs.select(*PAIR).filter("frm IS NOT NULL AND to IS NOT NULL").distinct(), "pairs")
    ahead, back = dealt_edges(edges, keep, hub), dealt_edges(edges.select("target", F.col("to").alias("frm"), F.col("frm").alias("to")), keep, hub)
    sides = []
    for end, ways in (("frm", ahead), ("to", back)):
        first = keep(left.select("target", F.col(end).alias("seed")).distinct().select("target", "seed", F.col("seed").alias("node"), F.lit(0).alias("hop")), f"{end}-0")
        sides.append({"end": end, "ways": ways, "levels": [first], "size": first.count(), "depth": 0})
    done, complete = [], True
    while True:
        depth = sides[0]["depth"] + sides[1]["depth"]
        first, second = sorted(sides, key=lambda s: _meetings(left, s))
        both = left.join(_last(first), ["target", first["end"]]).join(_last(second), ["target", second["end"], "node"])
        # Where the halves of the path meet: as far from the end as that walk has come.
        met = keep(both.select(*PAIR).distinct().select(*PAIR, F.lit(depth).alias("length"), F.lit(sides[0]["depth"]).alias("cut")), f"met-{depth}")
        done.append(met)
        left = keep(left.join(met, PAIR, "left_anti"), f"left-{depth}")
        if left.isEmpty() or not (sides[0]["size"] and sides[1]["size"]):
            break
        if hops is not None and depth >= hops:
            complete = False
            break
        side = min(sides, key=lambda s: s["size"])
        # Only seeds that still have an open pair go on.
        going = side["levels"][-1].join(left.select("target", F.col(side["end"]).alias("seed")).distinct(), ["target", "seed"], "left_semi")
        new = step(going, *side["ways"]).join(_seen(side["levels"]), ["target", "seed", "node"], "left_anti")
        side["depth"] += 1
        level = keep(new.select("target", "seed", "node", F.lit(side["depth"]).alias("hop")), f"{side['end']}-{side['depth']}")
        side["levels"].append(level)
        side["size"] = level.count()
    return _spelled(keep(_union(done), "lengths"), ahead[0], *map(_known, sides), keep), complete


def _last(side: dict) -> DataFrame:
    return side["levels"][-1].select("target", F.col("seed").alias(side["end"]), "node")


def _meetings(left: DataFrame, side: dict) -> int:
    """How many rows open pairs make with the last hop of one end."""
    pairs = left.groupBy("target", F.col(side["end"]).alias("seed")).agg(F.count(F.lit(1)).alias("pairs"))
    nodes = side["levels"][-1].groupBy("target", "seed").agg(F.count(F.lit(1)).alias("nodes"))
    return pairs.join(nodes, ["target", "seed"]).agg(F.sum(F.col("pairs").cast("double") * F.col("nodes"))).first()[0] or 0


def _known(side: dict) -> DataFrame:
    return _union(side["levels"]).select("target", F.col("seed").alias(side["end"]), "node", F.col("hop").alias(f"{side['end']}_hop"))


def _spelled(lengths: DataFrame, edges: DataFrame, first: DataFrame, second: DataFrame, keep) -> DataFrame:
    """Paths of pairs (target, frm, to, length, cut). All nodes of shortest paths, by their place: those at the cut that both
    walks know at the right distance, before them those that the first walk knows, after them those of the second. Hops are
    keys of the joins, and edges meet pairs of nodes, so a pair never meets all that an end knows, or all edges of a node."""
    edges, place = edges.select("target", "at", "to"), [*PAIR, "length", "place", "node"]
    split = lengths.select(*PAIR, "length", F.col("cut").alias("place"))
    halves = [("frm", first, F.col("place")), ("to", second, F.col("length") - F.col("place"))]

    def within(layer: DataFrame, end: str, known: DataFrame, hop: Column, keys: list[str]) -> DataFrame:
        return layer.withColumn(f"{end}_hop", hop).join(known, ["target", end, *keys, f"{end}_hop"]).drop(f"{end}_hop")

    def rows(end: str, known: DataFrame, hop: Column) -> float:
        pairs = split.groupBy("target", end, hop.alias(f"{end}_hop")).agg(F.count(F.lit(1)).alias("pairs"))
        nodes = known.groupBy("target", end, f"{end}_hop").agg(F.count(F.lit(1)).alias("nodes"))
        return pairs.join(nodes, ["target", end, f"{end}_hop"]).agg(F.sum(F.col("pairs").cast("double") * F.col("nodes"))).first()[0] or 0

    fewer, more = sorted(halves, key=lambda half: rows(*half))
    middle = keep(within(within(split, *fewer, []), *more, ["node"]).select(*place), "middle")
    most = lengths.agg(F.max("cut").alias("cut"), F.max(F.col("length") - F.col("cut")).alias("rest"), F.max("length").alias("length")).first()
    nodes = middle
    ways = [
        (most.cut or 0, "frm", first, F.col("place"), -1, "before", edges.select("target", F.col("to").alias("node"), F.col("at").alias("next"))),
        (most.rest or 0, "to", second, F.col("length") - F.col("place"), 1, "after", edges.select("target", F.col("at").alias("node"), F.col("to").alias("next"))),
    ]
    for steps, end, known, hop, by, name, beside in ways:
        layer = middle
        for _ in range(steps):
            here = layer.withColumn("place", F.col("place") + by)
            # One edge from its end a path goes there, so no edge but that one is read.
            near = here.filter(hop == 0).withColumn("next", F.col(end)).join(beside, ["target", "node", "next"], "left_semi").drop("node").withColumnRenamed("next", "node").select(*place)
            far = here.filter(hop > 0).join(beside, ["target", "node"]).drop("node").withColumnRenamed("next", "node")
            layer = keep(near.unionByName(within(far, end, known, hop, ["node"]).select(*place)).distinct(), name)
            nodes = nodes.unionByName(layer)
    paths = lengths.select(*PAIR, "length", F.col("frm").alias("last"), F.array("frm").alias("path"))
    steps = edges.select("target", F.col("at").alias("last"), F.col("to").alias("node"))
    for k in range(1, (most.length or 0) + 1):
        near = paths.filter(F.col("length") >= k).join(nodes.filter(F.col("place") == k).drop("place"), [*PAIR, "length"]).join(steps, ["target", "last", "node"], "left_semi")
        longer = near.groupBy(*PAIR, "length", "path").agg(F.min("node").alias("last")).select(*PAIR, "length", "last", F.concat("path", F.array("last")).alias("path"))
        paths = keep(paths.filter(F.col("length") < k).unionByName(longer), "paths")
    return paths.select(*PAIR, "length", "path")
