"""Cycles and importance in graphs of many edges: strongly connected components, and PageRank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traverse import _kept, _union, reach

#: Rounds in which nodes without a way in or out go before the rest is coloured.
TRIMS = 3
#: Rounds of PageRank that are planned as one, each in the partitioning of the one before it.
TOGETHER = 5
NODE = ["target", "node"]


def strongly_connected(edges: DataFrame, *, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(target, node, component) of all ends of edges (target, frm, to); a component is named by its smallest node. Two nodes
    share one if each reaches the other. Nulls take no part; an edge from a node to itself says nothing.

    In turn: nodes that no edge enters or leaves are components of their own and go. Each other node takes the smallest
    node that reaches it as its colour, which spreads along edges from what changed. A component lies within one colour,
    and a node whose colour is itself is reached back, over edges of that colour, by its component alone; so each colour yields
    one component, found by a backward walk of all colours at once. What is left goes round again."""
    keep = _kept(edges.sparkSession, keep)
    links = keep(edges.select("target", "frm", "to").filter("frm IS NOT NULL AND to IS NOT NULL").distinct(), "scc-links")
    nodes = keep(links.select("target", F.col("frm").alias("node")).union(links.select("target", "to")).distinct(), "scc-nodes")
    links, done = links.filter("frm != to"), []
    while not nodes.isEmpty():
        for _ in range(TRIMS):
            inner = links.select("target", F.col("frm").alias("node")).distinct().join(links.select("target", F.col("to").alias("node")).distinct(), NODE, "left_semi")
            inner = keep(inner, "scc-inner")
            alone = keep(nodes.join(inner, NODE, "left_anti"), "scc-alone")
            if alone.isEmpty():
                break
            done.append(alone.withColumn("component", F.col("node")))
            nodes, links = inner, keep(_within(links, inner), "scc-links")
        if nodes.isEmpty():
            break
        colours = _colours(nodes, links, keep)
        ends = [colours.select("target", F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("frm", "to")]
        same = links.join(ends[0], ["target", "frm"]).join(ends[1], ["target", "to"]).filter("frm_colour = to_colour")
        roots = colours.filter("node = colour").select("target", F.col("node").alias("id"))
        found = keep(reach(same, roots, incoming=True, keep=keep).rows.select("target", "node", F.col("seed").alias("component")), "scc-found")
        done.append(found)
        nodes = keep(nodes.join(found, NODE, "left_anti"), "scc-nodes")
        links = keep(_within(links, nodes), "scc-links")
    return _union(done) if done else nodes.withColumn("component", F.col("node"))


def _within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("frm", "to"):
        links = links.join(nodes.select("target", F.col("node").alias(end)), ["target", end], "left_semi")
    return links.select("target", "frm", "to")


def _colours(nodes: DataFrame, links: DataFrame, keep) -> DataFrame:
    """(target, node, colour): the smallest node that reaches a node, itself included."""
    colours = news = nodes.select("target", "node", F.col("node").alias("colour"))
    while True:
        sent = news.select("target", F.col("node").alias("frm"), "colour").join(links, ["target", "frm"]).groupBy("target", F.col("to").alias("node")).agg(F.min("colour").alias("new"))
        news = keep(colours.join(sent, NODE).filter("new < colour").select("target", "node", F.col("new").alias("colour")), "scc-news")
        if news.isEmpty():
            return colours
        after = colours.join(news.withColumnRenamed("colour", "new"), NODE, "left")
        colours = keep(after.select("target", "node", F.coalesce("new", "colour").alias("colour")), "scc-colours")


def page_rank(edges: DataFrame, nodes: DataFrame, *, rounds: int = 20, damping: float = 0.85, within: float = 0.0, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, int, float]:
    """(target, node, rank) of nodes (target, id) after ``rounds`` rounds, or fewer once all ranks of a round together moved by
    no more than ``within`` in each target; how many were made, and how far the last one moved them. A target's ranks add up to 1.

    A node's rank goes to the ends of its edges (target, frm, to) by equal parts, repeated edges by their number; that of
    nodes without edges goes to all. Edges with an end that isn't a node take no part. Some rounds are planned
    together: ranks come out of one in the partitioning of the next one's join, and the edges' exchange is used again."""
    keep = _kept(edges.sparkSession, keep)
    known = keep(nodes.select("target", F.col("id").alias("node")).filter("node IS NOT NULL").distinct(), "rank-nodes")
    links = edges.groupBy("target", "frm", "to").agg(F.count(F.lit(1)).alias("times")).filter("frm IS NOT NULL AND to IS NOT NULL")
    links = keep(_weighted(links, known), "rank-links")
    out = links.groupBy("target", "frm").agg(F.sum("times").alias("out"))
    links = keep(links.join(out, ["target", "frm"]).select("target", F.col("frm").alias("node"), "to", (F.col("times") / F.col("out")).alias("part")), "rank-parts")
    sizes = known.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    leads = links.select(*NODE).distinct().withColumn("leads", F.lit(True))
    own = keep(known.join(sizes, "target").join(leads, NODE, "left").select(*NODE, "n", F.coalesce("leads", F.lit(False)).alias("leads")), "rank-own")
    ranks, made, moved = own.select(*NODE, (1 / F.col("n")).alias("rank")), 0, float("inf")
    while made < rounds and moved > within:
        before = ranks
        for _ in range(min(TOGETHER, rounds - made) if not within else 1):
            before, made = ranks, made + 1
            # Ranks are looked up by hash: a sort of all edges in each round would cost more than the rest of it.
            given = ranks.hint("shuffle_hash").join(links, NODE).groupBy("target", F.col("to").alias("node")).agg(F.sum(F.col("rank") * F.col("part")).alias("given"))
            lost = own.filter("NOT leads").join(ranks, NODE).groupBy("target").agg(F.sum("rank").alias("lost"))
            whole = own.join(given, NODE, "left").join(lost, "target", "left")
            given, lost = F.coalesce("given", F.lit(0.0)), F.coalesce("lost", F.lit(0.0))
            ranks = whole.select(*NODE, ((1 - damping) / F.col("n") + damping * (given + lost / F.col("n"))).alias("rank"))
        ranks = keep(ranks, "ranks")
        if within:
            far = ranks.join(before.withColumnRenamed("rank", "was"), NODE).groupBy("target").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("far"))
            moved = far.agg(F.max("far").alias("far")).first().far or 0.0
    return ranks, made, moved


def _weighted(links: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("frm", "to"):
        links = links.join(nodes.select("target", F.col("node").alias(end)), ["target", end], "left_semi")
    return links.select("target", "frm", "to", "times")
