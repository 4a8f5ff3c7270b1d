"""URL filters: host and path rules first, then gradient-boosted trees on lexical features.

A rule is a host and a path; it fits its host and all subdomains where the url's path starts with the
rule's, and the longest fitting rule wins. Urls that a rule decides are the labelled ones; the trees learn
from at most ``SAMPLE`` of them (a documented bound): different urls, half of them of either verdict and chosen by a
hash, each with as much weight as there are rows that it stands for. So neither a url with very many rows nor a
rare verdict drives the others out. The trees judge what no rule decides.

Features: length, lengths and depth of host and path, share of digits, entropy, numbers of parameters, hyphens and dots,
and shares of blocked urls among labelled ones that have a part in common with the url: the suffix of two labels of its
host (smoothed towards the mean), the one of three (smoothed towards that of two), the ending of its path
(what stands after the last dot of the last name) and the first name in it (both towards the mean). The last label alone
isn't one of them: it says more about where rules were written than about a url. Shares are counted over all labelled urls
in Spark and joined to the urls, so no list of suffixes is held by the driver. While the trees are fitted, a url's shares
leave out all labelled urls of its own host, as urls that are to be judged mostly are of hosts without a rule.
Trees are grown on histograms of the features' quantiles.

Cases: a null url or one without "://" has an empty host and path, fits no rule and is judged by the
trees like any other text. Without labelled urls of both kinds every undecided url is allowed. Repeated
rows give repeated results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (rule's host and path, verdict): fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE = 5_000
TREES = 40
DEPTH = 3
RATE = 0.2
BINS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule and ruled (the rule's verdict) of each page, by built-in functions."""
    url = F.col("url").cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(cast(url AS string), instr(cast(url AS string), '://') + 3)")).otherwise("")
    own = pages.select("page_id", url.alias("url")).withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    own = own.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path).drop("_rest")
    found = verdict = None
    for rule, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((F.col("host") == rule[:at]) | F.col("host").endswith("." + rule[:at])) & F.col("path").startswith(rule[at:])
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return own.withColumn("rule", none if found is None else found).withColumn("ruled", none if verdict is None else verdict)


#: Parts of a url that shares are counted of.
PARTS = ("two", "three", "ending", "name")
SHARES = tuple(f"{part}_share" for part in PARTS)
#: Labelled urls that the wider share counts for.
SMOOTH = 10


def with_parts(ruled: DataFrame) -> DataFrame:
    """Adds the parts of each url: suffixes of two and three labels of its host (the whole of a shorter one), the ending
    of its path and the first name in it."""
    last = F.element_at(F.split("path", "/"), -1)
    ending = F.when(F.contains(last, F.lit(".")), F.lower(F.substring_index(last, ".", -1))).otherwise("")
    return ruled.withColumns({"two": F.substring_index("host", ".", -2), "three": F.substring_index("host", ".", -3), "ending": ending, "name": F.coalesce(F.get(F.split("path", "/"), 1), F.lit(""))})


def smoothed(n, bad, towards):
    return (bad + SMOOTH * towards) / (n + SMOOTH)


def listed(urls: DataFrame, *more: str) -> DataFrame:
    """(part, value, ...) of each url, a row for each of its parts."""
    pairs = F.array(*(F.struct(F.lit(part).alias("part"), F.col(part).alias("value")) for part in PARTS))
    return urls.select(F.explode(pairs).alias("p"), *more).select("p.part", "p.value", *more)


def counts(labelled: DataFrame, *more: str) -> DataFrame:
    """How many labelled urls, and blocked ones, have a part (and a host, if named), all parts in one pass."""
    return labelled.groupBy("part", "value", *more).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("bad"))


def with_counts(urls: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """Adds <part>_n and <part>_bad of each part; ``small`` says whether the table was counted to be small."""
    for part in PARTS:
        own = table.filter(F.col("part") == part).select(F.col("value").alias(part), F.col("n").alias(f"{part}_n"), F.col("bad").alias(f"{part}_bad"))
        urls = urls.join(F.broadcast(own) if small else own, part, "left").na.fill(0, [f"{part}_n", f"{part}_bad"])
    return urls


def with_shares(counted: DataFrame, mean: float) -> DataFrame:
    """The shares, from numbers of labelled urls and blocked ones (<part>_n, <part>_bad)."""
    two = smoothed(F.col("two_n"), F.col("two_bad"), F.lit(mean))
    others = [smoothed(F.col(f"{part}_n"), F.col(f"{part}_bad"), F.lit(mean)) for part in ("ending", "name")]
    return counted.withColumns(dict(zip(SHARES, (two, smoothed(F.col("three_n"), F.col("three_bad"), two), *others), strict=True)))


def lexical() -> list:
    """The features of a url (url, host, path) that are built-in expressions, in their order; entropy comes after them."""
    url = F.coalesce("url", F.lit(""))
    query = F.when(F.contains(url, F.lit("?")), F.expr("substring(url, instr(url, '?') + 1)")).otherwise("")

    def times(text, signs: str):
        return F.length(text) - F.length(F.translate(text, signs, ""))

    longest = F.array_max(F.transform(F.split("host", r"\."), F.length))
    values = [F.length(url), F.length("host"), F.length("path"), times(F.col("path"), "/"), times(url, "0123456789") / F.greatest(F.length(url), F.lit(1)), times(query, "=&"), times(F.col("host"), "-"), times(F.col("host"), "."), longest]
    return [v.cast("double") for v in values]


def entropy(url: str) -> float:
    counts = np.array(list(Counter(url).values()), float) / len(url) if url else np.ones(1)
    return float(-(counts * np.log2(counts)).sum())


class Trees:
    """Gradient-boosted trees for the logistic loss, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        weight = np.ones(len(y)) if weight is None else weight / weight.mean()
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        p = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        self.start, self.trees, z, b = float(np.log(p / (1 - p))), [], np.zeros(len(y)), self.binned(x)
        z += self.start
        for _ in range(trees):
            q = 1 / (1 + np.exp(-z))
            tree = self._grow(b, weight * (y - q), weight * q * (1 - q), weight, depth, rate)
            self.trees.append(tree)
            z += self._leaf(tree, b)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    @staticmethod
    def _grow(b, g, h, weight, depth, rate):
        """(feature, bin, value) of each node of a complete tree; feature -1 ends a branch."""
        nodes, rows = {0: (-1, 0, 0.0)}, {0: np.arange(len(b))}
        for node in range((1 << (depth + 1)) - 1):
            own = rows.pop(node, None)
            if own is None:
                continue
            total_g, total_h = g[own].sum(), h[own].sum() + 1.0
            nodes[node] = (-1, 0, rate * total_g / total_h)
            if node >= (1 << depth) - 1:
                continue
            best = (1e-6, None)
            for j in range(b.shape[1]):
                size = int(b[:, j].max()) + 1
                left_g, left_h = np.cumsum(np.bincount(b[own, j], g[own], size)), np.cumsum(np.bincount(b[own, j], h[own], size))
                n = np.cumsum(np.bincount(b[own, j], weight[own], size))
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h) - total_g**2 / total_h
                gain[(n < 5) | (n[-1] - n < 5)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, k))
            if best[1]:
                j, k = best[1]
                nodes[node] = (j, k, nodes[node][2])
                rows[2 * node + 1], rows[2 * node + 2] = own[b[own, j] <= k], own[b[own, j] > k]
        return nodes

    @staticmethod
    def _leaf(tree, b):
        at = np.zeros(len(b), int)
        for node in sorted(tree):
            j, k, _ = tree[node]
            if j >= 0:
                here = at == node
                at[here] = np.where(b[here, j] <= k, 2 * node + 1, 2 * node + 2)
        value = np.zeros(max(tree) + 1)
        value[list(tree)] = [v for _, _, v in tree.values()]
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        z = self.start + sum((self._leaf(t, b) for t in self.trees), np.zeros(len(b)))
        return 1 / (1 + np.exp(-z))


def matrix(lexical_: list, shares: list, urls: list) -> np.ndarray:
    """Rows of features: lexical ones, shares and entropy."""
    n = len(urls)
    return np.column_stack([np.array(lexical_, float).reshape(n, -1), np.array(shares, float).reshape(n, len(SHARES)), np.array([entropy(u or "") for u in urls], float)])


class Judge:
    """Trees and the mean share of blocked urls; allows all where there is nothing to learn."""

    def __init__(self, mean: float, trees: Trees | None):
        self.mean, self.trees = mean, trees

    def blocked(self, x: np.ndarray) -> np.ndarray:
        return self.trees.probability(x) if self.trees and len(x) else np.zeros(len(x))


def learn(spark: SparkSession, ruled: DataFrame, sample: int = SAMPLE) -> tuple[Judge, DataFrame, bool]:
    """The judge, the counts of all parts (with_parts' columns are there), and whether these are few."""
    labelled, h = ruled.filter("ruled IS NOT NULL"), F.xxhash64("url")
    different = {r.ruled: (r.urls, r.n) for r in labelled.groupBy("ruled").agg(F.approx_count_distinct("url").alias("urls"), F.count(F.lit(1)).alias("n")).collect()}
    every = sum(n for _, n in different.values())
    mean = different.get("block", (0, 0))[1] / max(every, 1)
    table = common.written(spark, counts(listed(labelled, "ruled")), "url-parts")
    small = table.count() <= common.SENT_ROWS
    if not 0 < mean < 1:
        return Judge(0.0, None), table, small
    chosen = None
    for verdict, (urls, n) in sorted(different.items()):
        # Of all different urls about the wanted number and some more, so few are counted and sorted.
        share = min(1.0, 1.5 * (sample // 2) / max(urls, 1))
        own = labelled.filter((F.col("ruled") == verdict) & (F.pmod(h, F.lit(1_000_003)) < share * 1_000_003))
        once = own.groupBy("url", "host", "path", *PARTS, "ruled").agg(F.count(F.lit(1)).alias("rows")).withColumn("h", F.xxhash64("url")).orderBy("h", "url").limit(sample // 2)
        once = once.withColumn("all", F.lit(n))
        chosen = once if chosen is None else chosen.unionByName(once)
    chosen = common.written(spark, chosen, "url-sample")
    # What a url's own host has of its parts is left out; these are no more rows than the sample has parts.
    asked = F.broadcast(listed(chosen, "host").distinct())
    of_host = common.written(spark, counts(listed(labelled, "host", "ruled").join(asked, ["part", "value", "host"], "left_semi"), "host"), "url-hosts")
    counted = with_counts(chosen, table, small)
    for part in PARTS:
        own = of_host.filter(F.col("part") == part).select(F.col("value").alias(part), "host", F.col("n").alias("own_n"), F.col("bad").alias("own_bad"))
        counted = counted.join(F.broadcast(own), [part, "host"], "left").na.fill(0, ["own_n", "own_bad"])
        counted = counted.withColumns({f"{part}_n": F.col(f"{part}_n") - F.col("own_n"), f"{part}_bad": F.col(f"{part}_bad") - F.col("own_bad")}).drop("own_n", "own_bad")
    rows = with_shares(counted, mean).select("url", "h", "ruled", "rows", "all", F.array(*lexical()).alias("lexical"), F.array(*SHARES).alias("shares")).orderBy("ruled", "h", "url").collect()
    sums = Counter()
    for r in rows:
        sums[r.ruled] += r.rows
    weight = np.array([r.rows * r["all"] / sums[r.ruled] for r in rows])
    x = matrix([r.lexical for r in rows], [r.shares for r in rows], [r.url for r in rows])
    return Judge(mean, Trees(x, np.array([r.ruled == "block" for r in rows], float), weight)), table, small


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of the trees; null where a rule decides)."""
    common.small_batches(spark)
    ruled = with_parts(with_rules(pages, rules))
    learned, table, small = learn(spark, ruled, sample)
    sent = spark.sparkContext.broadcast(learned)  # bounded by the number of trees
    open_ = with_shares(with_counts(ruled.filter("ruled IS NULL"), table, small), learned.mean)
    open_ = open_.select("page_id", "host", "path", "rule", "url", F.array(*lexical()).alias("lexical"), F.array(*SHARES).alias("shares"))

    def run(batches):
        for batch in batches:
            score = sent.value.blocked(matrix(*(batch.column(c).to_pylist() for c in ("lexical", "shares", "url"))))
            said = np.where(score >= 0.5, "block", "allow")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = dict(ruled.dtypes)["page_id"]
    judged = open_.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
    decided = ruled.filter("ruled IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return decided.unionByName(judged)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, common.table(spark, sf_dir, "pages").select("page_id", "url"))
