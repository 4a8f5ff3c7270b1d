"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded, hash-chosen sample (``SAMPLE`` vectors, a parameter); every row is
indexed in a leaf. A query keeps a priority queue of nodes by the distance to their centres: the nearest is
taken, an inner node puts its children into the queue, a leaf is visited. How many leaves are visited is
calibrated on all rows: the true neighbours of ``TRIALS`` queries are found by brute force, one pass over
the rows, and visits widen until they hold ``RECALL`` of them. Queries then meet the rows of the leaves
that they visit: leaves next to each other in the tree share a shard of about ``SPLIT`` rows, and a leaf
with more rows (say, of one vector) is split over shards of its own by a salt, and a shard that more than
``ASKED`` queries visit meets them in parts, so no task holds more than that. Distances are exact.

Cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows with
a null vec_id or with another number of components than most rows have. Of rows that share a vec_id the
nearest counts, and none is a neighbour of its own vec_id. Ties go to the smaller vec_id. With fewer
candidates than ``k`` all are returned. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 10
SAMPLE = 20_000
BRANCHES = 8
LEAF = 40
TRIALS = 64
RECALL = 0.95
#: Rows of a shard.
SPLIT = 4_096
#: Queries that meet a shard in one task.
ASKED = 4_096


class Tree:
    """Centres of all nodes, children of inner nodes, and the numbers of leaves."""

    def __init__(self, x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [x.mean(0) if len(x) else np.zeros(0)], {}, {}
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            parts = self._parts(x[own], branches, rng) if len(own) > leaf else []
            if len(parts) < 2:
                self.leaf[node] = len(self.leaf)
                continue
            self.children[node] = np.arange(len(self.centres), len(self.centres) + len(parts))
            for part in parts:
                self.centres.append(x[own[part]].mean(0))
                todo.append((len(self.centres) - 1, own[part]))
        self.centres = np.array(self.centres)

    @staticmethod
    def _parts(x: np.ndarray, branches: int, rng) -> list[np.ndarray]:
        """k-means; no empty part, and none at all where all vectors are the same."""
        centres = np.unique(x[rng.choice(len(x), min(branches, len(x)), replace=False)], axis=0)
        for _ in range(8):
            near = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
            centres = np.array([x[near == k].mean(0) for k in range(len(centres)) if (near == k).any()])
        near = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        return [p for k in range(len(centres)) if len(p := np.flatnonzero(near == k))]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf to which each vector goes down the tree."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node in self.leaf:
                out[own] = self.leaf[node]
            elif len(own):
                below = self.children[node]
                c = self.centres[below]
                near = (-2 * x[own] @ c.T + (c**2).sum(1)).argmin(1)
                todo += [(int(below[k]), own[near == k]) for k in range(len(below))]
        return out

    def leaves(self, query: np.ndarray):
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node in self.leaf:
                yield self.leaf[node]
            else:
                below = self.children[node]
                far = ((self.centres[below] - query) ** 2).sum(1)
                for d, child in zip(far.tolist(), below.tolist(), strict=True):
                    heapq.heappush(queue, (d, child))


def _valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    size = own.filter("size(vec) > 0").groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # not a number is more than infinity
    return own.filter(F.col("vec_id").isNotNull() & (F.size("vec") == (size["size"] if size else 0))).filter(finite & F.exists("vec", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(query: np.ndarray, query_id: int, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k nearest rows but the query's own, and their distances."""
    far = np.sqrt(((x - query) ** 2).sum(1))
    far[ids == query_id] = np.inf
    if len(far) > 4 * k:
        edge = np.partition(far, k - 1)[k - 1]
        some = np.flatnonzero(far <= edge)
    else:
        some = np.arange(len(far))
    some = some[np.lexsort((ids[some], far[some]))][:k]
    some = some[np.isfinite(far[some])]
    return some, far[some]


def _indexed(tree):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            leaf = tree.value.leaf_of(x) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], ["vec_id", "vec", "leaf"])

    return run


ROWS = "vec_id long, vec array<double>"
FOUND = "query_id long, vec_id long, score double, leaf long"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0)] * 4
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)], ["query_id", "vec_id", "score", "leaf"])


def _brute(trials: list[tuple[int, np.ndarray]], k: int):
    """The k nearest of each batch to each trial query."""

    def run(batches):
        for batch in batches:
            ids, x, leaf = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy()
            rows = []
            for query_id, query in trials if len(ids) else []:
                own, far = _nearest(query, query_id, ids, x, k)
                rows.append((np.full(len(own), query_id), ids[own], far, leaf[own]))
            yield _found(rows)

    return run


def top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, ranked."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.min("leaf").alias("leaf"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def calibrated(tree: Tree, index: DataFrame, trials: list[tuple[int, np.ndarray]], k: int, recall: float) -> int:
    """The fewest visits that hold this share of the trials' true neighbours."""
    true: dict[int, list[int]] = {}
    for r in top(index.mapInArrow(_brute(trials, k), FOUND), k).select("query_id", "leaf").collect():
        true.setdefault(r.query_id, []).append(r.leaf)
    visits = []
    for query_id, query in trials:
        order = {leaf: i for i, leaf in enumerate(tree.leaves(query))}
        visits += [order[leaf] + 1 for leaf in true.get(query_id, [])]
    return int(np.quantile(visits, recall, method="higher")) if visits else 1


class Shards:
    """Where the rows of each leaf are: the first shard and how many. Leaves are numbered along the tree."""

    def __init__(self, counts: dict[int, int], split: int = SPLIT):
        self.counts, self.first, self.parts, self.n, held = counts, {}, {}, 0, 0
        for leaf in sorted(counts):
            if counts[leaf] > split:
                self.n += held > 0
                self.first[leaf], self.parts[leaf] = self.n, -(-counts[leaf] // split)
                self.n, held = self.n + self.parts[leaf], 0
                continue
            if held and held + counts[leaf] > split:
                self.n, held = self.n + 1, 0
            self.first[leaf], self.parts[leaf] = self.n, 1
            held += counts[leaf]


def _placed(shards):
    """Adds its shard to each row of the index."""

    def run(batches):
        own = shards.value
        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            salts = common.mixed(ids.astype(np.int64).view(np.uint64)).tolist()
            shard = [own.first[f] + s % own.parts[f] for f, s in zip(leaf, salts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64())], ["vec_id", "vec", "leaf", "shard"])

    return run


def _visits(tree, shards, visits: int, k: int):
    """A row for each query and shard, with the leaves that the query visits there."""

    def run(batches):
        own = shards.value
        for batch in batches:
            at, ids, shard_of, leaves_of = [], [], [], []
            for n, (query_id, query) in enumerate(zip(batch.column(0).to_pylist(), _matrix(batch.column(1)), strict=True)):
                met, where = 0, {}
                for i, leaf in enumerate(tree.value.leaves(query)):
                    if i >= visits and met > 2 * k:
                        break
                    met += own.counts.get(leaf, 0)
                    for shard in range(own.first[leaf], own.first[leaf] + own.parts[leaf]) if leaf in own.first else ():
                        where.setdefault(shard, []).append(leaf)
                at += [n] * len(where)
                ids += [query_id] * len(where)
                shard_of += where
                leaves_of += where.values()
            queries = batch.column(1).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), queries, pa.array(shard_of, pa.int64()), pa.array(leaves_of, pa.list_(pa.int64()))], ["query_id", "query", "shard", "leaves"])

    return run


def _searched(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and queries.num_rows:
            ids, x, leaf = rows.column("vec_id").to_numpy(), _matrix(rows.column("vec")), rows.column("leaf").to_numpy()
            order = np.argsort(leaf, kind="stable")
            ids, x, leaf = ids[order], x[order], leaf[order]
            for query_id, query, leaves in zip(queries.column("query_id").to_pylist(), _matrix(queries.column("query")), queries.column("leaves").to_pylist(), strict=True):
                own = np.flatnonzero(np.isin(leaf, leaves))
                near, far = _nearest(query, query_id, ids[own], x[own], k)
                near = own[near]
                out.append((np.full(len(near), query_id), ids[near], far, leaf[near]))
        return pa.Table.from_batches([_found(out)])

    return run


def search(spark: SparkSession, embeddings: DataFrame, *, k: int = K, every: int = 100, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row whose id is divisible by ``every``."""
    common.small_batches(spark)
    rows = _valid(embeddings)
    n = rows.count()
    h = F.xxhash64("vec_id", F.lit(1))
    chosen = rows.filter(F.pmod(h, F.lit(1_000_003)) < min(1.0, 1.05 * sample / max(n, 1)) * 1_000_003)
    learned = chosen.orderBy(h, "vec").limit(sample).select("vec").collect()
    if not learned:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(np.array([r.vec for r in learned]))
    sent = spark.sparkContext.broadcast(tree)  # bounded by the sample
    index = common.written(spark, rows.mapInArrow(_indexed(sent), f"{ROWS}, leaf long"), "vectors")
    queries = index.filter(F.col("vec_id") % every == 0)
    trials = [(r.vec_id, np.array(r.vec)) for r in queries.orderBy(h, "vec").limit(TRIALS).collect()]
    visits = calibrated(tree, index, trials, k, recall)
    counts = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}  # bounded by the number of leaves
    shards = spark.sparkContext.broadcast(Shards(counts))
    asked = queries.select("vec_id", "vec").mapInArrow(_visits(sent, shards, visits, k), "query_id long, query array<double>, shard long, leaves array<long>")
    asked = common.written(spark, asked, "visits")
    placed = index.mapInArrow(_placed(shards), f"{ROWS}, leaf long, shard long")
    parts = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("long").alias("parts"))
    # A shard without visitors has no row here and stays out.
    placed = placed.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    asked = asked.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts"))).drop("parts")
    found = placed.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(_searched(k), FOUND)
    return top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, common.table(spark, sf_dir, "embeddings"))
