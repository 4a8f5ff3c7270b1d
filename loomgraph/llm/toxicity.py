"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words (A-Z lower-cased) and their stems (first ``STEMS``
bytes), hashed to ``BITS`` bits. The machine's score is
``w0 + sum of w[i] + sum over pairs of <v[i], v[j]>``, so a pair of terms can count for more than the two
alone; the pairs' sum costs one pass (``((sum v)**2 - sum v**2) / 2``). Terms carry weights if their
counts in toxic and clean learning texts differ by more than chance (a likelihood ratio of ``MIN_RATIO``
at least), or if they do so together with another: among the texts that hold one term with weights, or that
the machine scores alike, the labels of those with the term differ from what the machine expects of them. So
a word that is as common in clean as in toxic texts counts where its company decides, and wrong labels aren't
learned by heart through rare words. The pairs are looked through again with what they added, ``ROUNDS``
times at most. Pairs of which neither term shows alone are tested as pairs against that machine: all pairs that meet in
``MET`` learning rows, however often or seldom each of the two is; fewer rows show nothing by themselves. Fitted by Adam on the logistic loss with weight decay.

Learning takes a sample of at most ``SAMPLE`` labelled rows, chosen by a hash of doc_id; this bound is a
parameter and the only thing that the broadcast of labels holds. Every text is scored whole.

Cases: a null or empty text has no terms and gets the bias alone. Labels that are null, or whose document
is missing, are left out; without any learning rows every score is 0. A doc_id labelled twice counts
twice. Repeated rows give repeated results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 18
STEMS = (6, 5, 4)
FACTORS = 4
SAMPLE = 6000
MIN_RATIO = 16.0
STRATA = 8
ROUNDS = 3
MET = 10
EPOCHS = 30
SCORES = "doc_id long, score double"


def terms(text: bytes | None) -> np.ndarray:
    """The hashed distinct words and stems of a text, sorted."""
    words = set(common.plain_words(text))
    for n in STEMS:
        words |= {w[:n] + b"*" for w in words if len(w) > n}
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - BITS)).astype(np.int32)


class Machine:
    """A factorization machine; ``place`` maps a hashed term to its row of weights, 0 for none."""

    def __init__(self, place: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.place, self.bias, self.linear, self.factors = place, bias, linear, factors

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the texts with these terms."""
        sizes = np.array([len(r) for r in rows])
        at = self.place[np.concatenate([*rows, np.zeros(0, np.int32)])]
        own = np.repeat(np.arange(len(rows)), sizes)[at > 0]
        return _probability(self.bias, self.linear, self.factors, own, at[at > 0], len(rows))[0]


def _probability(bias, linear, factors, own, at, n):
    z = bias + np.bincount(own, linear[at], n)
    sums = np.stack([np.bincount(own, factors[at, k], n) for k in range(factors.shape[1])], 1)
    squares = np.bincount(own, (factors[at] ** 2).sum(1), n)
    z += 0.5 * ((sums**2).sum(1) - squares)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), sums


def likelihood_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """G-squared of each hashed term: how far its presence depends on the label."""
    sizes = np.array([len(r) for r in rows])
    flat, toxic = np.concatenate(rows), np.repeat(labels > 0, sizes)
    n, n1 = len(rows), float((labels > 0).sum())
    all_df = np.bincount(flat, minlength=1 << BITS).astype(float)
    df1 = np.bincount(flat[toxic], minlength=1 << BITS).astype(float)
    out = np.zeros(1 << BITS)
    for seen, total, part in ((df1, n1, all_df), (all_df - df1, n - n1, all_df), (n1 - df1, n1, n - all_df), (n - n1 - all_df + df1, n - n1, n - all_df)):
        expected = total * part / n
        out += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0)
    return out


def companions(rows: list[np.ndarray], labels: np.ndarray, used: np.ndarray, p: np.ndarray, min_ratio: float = MIN_RATIO) -> np.ndarray:
    """Terms whose labels differ from the probabilities ``p`` among the rows of one used term, or of one of
    ``STRATA`` ranges of p. The ratio grows with the number of groups, so no more terms pass by chance."""
    names, flat = np.unique(np.concatenate(rows), return_inverse=True)
    sizes = np.array([len(r) for r in rows])
    first = np.cumsum(sizes) - sizes
    stratum = np.searchsorted(np.sort(p), p) * STRATA // len(p)
    at = np.full(1 << BITS, -1)
    at[used] = np.arange(len(used))
    holds = at[names][flat]
    own, holds = np.repeat(np.arange(len(rows)), sizes)[holds >= 0], holds[holds >= 0]
    by = np.argsort(holds, kind="stable")
    groups = [np.flatnonzero(stratum == k) for k in range(STRATA)]
    groups += np.split(own[by], np.cumsum(np.bincount(holds, minlength=len(used)))[:-1]) if len(used) else []
    best = np.zeros(len(names))
    for g in groups:
        n = sizes[g]
        here = flat[np.repeat(first[g] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        df = np.bincount(here, minlength=len(names)).astype(float)
        toxic, expected = (np.bincount(here, np.repeat(x[g], n), len(names)) for x in (labels, p))
        df, toxic, expected, some = df[df > 1], toxic[df > 1], expected[df > 1], np.flatnonzero(df > 1)
        expected = np.clip(expected, 0.5, df - 0.5)
        ratio = sum(2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / e), 0) for seen, e in ((toxic, expected), (df - toxic, df - expected)))
        best[some] = np.maximum(best[some], ratio)
    return names[best >= min_ratio + 2 * np.log(len(groups))]


def interacting(rows: list[np.ndarray], labels: np.ndarray, p: np.ndarray, min_ratio: float = MIN_RATIO) -> np.ndarray:
    """Terms of pairs whose labels, where both are there, differ from the probabilities ``p``, among all pairs that meet in
    ``MET`` rows; terms of the same rows (words and their stems, mostly) are one.

    No bound on how often a term comes says whether it is looked at, only one that loses no pair: the ratio of a pair is
    at most twice the sum of -ln p over its toxic rows, where they are more than expected, or of -ln(1 - p) over its clean
    rows, where those are. So a term over all of whose rows both sums are too small has no pair that passes."""
    names, flat = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    df = np.bincount(flat, minlength=len(names))
    # Terms of equal rows have equal sums of the rows' numbers.
    draw = np.random.default_rng(1).integers(1 << 63, size=len(rows), dtype=np.uint64)
    same = np.add.reduceat(draw[row[np.argsort(flat, kind="stable")]], np.cumsum(df) - df) if len(names) else np.zeros(0, np.uint64)
    often = np.flatnonzero(df >= MET)
    _, first, group = np.unique(same[often], return_index=True, return_inverse=True)
    if len(first) < 2:
        return names[:0]
    bar = min_ratio + 2 * np.log(len(first) * (len(first) - 1) / 2)
    p = np.clip(p, 1e-12, 1 - 1e-12)
    most = np.maximum(*(np.bincount(flat, weight[row], len(names)) for weight in (np.where(labels > 0, -np.log(p), 0), np.where(labels > 0, 0, -np.log(1 - p)))))
    able = np.flatnonzero(most[often[first]] >= bar / 2)
    n = len(able)
    if n < 2:
        return names[:0]
    at = np.full(len(names), -1)
    at[often[first[able]]] = np.arange(n)
    there = at[flat] >= 0
    term, row = at[flat[there]], row[there]
    order = np.lexsort((term, row))
    term, row = term[order], row[order]
    ends, places = np.searchsorted(row, np.arange(len(rows)), "right"), np.argsort(term, kind="stable")
    starts = np.searchsorted(term[places], np.arange(n + 1))
    weight, toxic_row, found = p[row], labels[row] > 0, np.zeros(len(first), bool)
    for i in range(n):
        own = places[starts[i] : starts[i + 1]]
        size = ends[row[own]] - own - 1  # the terms after it in each of its rows
        here = np.repeat(own + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        others = term[here] - (i + 1)
        met = np.bincount(others)
        some = np.flatnonzero(met >= MET)
        if not len(some):
            continue
        toxic, expected = (np.bincount(o, w, len(met))[some] for o, w in ((others[toxic_row[here]], None), (others, weight[here])))
        met = met[some]
        expected = np.clip(expected, 0.5, met - 0.5)
        ratio = 2 * sum(np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / e), 0) for seen, e in ((toxic, expected), (met - toxic, met - expected)))
        high = some[ratio >= bar]
        if len(high):
            found[able[np.append(high + i + 1, i)]] = True
    return names[often[found[group]]]


def fit(rows: list[np.ndarray], labels: np.ndarray, *, factors: int = FACTORS, min_ratio: float = MIN_RATIO, rounds: int = ROUNDS, **how) -> Machine:
    if not len(rows):
        return Machine(np.zeros(1 << BITS, np.int32), -30.0, np.zeros(1), np.zeros((1, factors)))
    used = np.flatnonzero(likelihood_ratio(rows, labels) >= min_ratio)
    machine = _fitted(rows, labels, used, factors, **how)
    more = np.union1d(used, interacting(rows, labels, machine.score(rows), min_ratio)).astype(np.int64)
    if len(more) > len(used):
        used, machine = more, _fitted(rows, labels, more, factors, **how)
    for _ in range(rounds):
        more = np.union1d(used, companions(rows, labels, used, machine.score(rows), min_ratio))
        if len(more) == len(used):
            break
        used, machine = more, _fitted(rows, labels, more, factors, **how)
    return machine


def _fitted(rows: list[np.ndarray], labels: np.ndarray, used: np.ndarray, factors: int, *, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 3e-4, seed: int = 7) -> Machine:
    """A machine whose used terms carry weights."""
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    rng = np.random.default_rng(seed)
    mean = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    w = [np.array([np.log(mean / (1 - mean))]), np.zeros(len(used) + 1), rng.normal(0, 0.01, (len(used) + 1, factors))]
    first, second, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    at_all = [place[r][place[r] > 0] for r in rows]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 256):
            part = order[k : k + 256]
            at = np.concatenate([at_all[i] for i in part])
            own = np.repeat(np.arange(len(part)), [len(at_all[i]) for i in part])
            p, sums = _probability(w[0][0], w[1], w[2], own, at, len(part))
            g = (p - labels[part]) / len(part)
            pair = g[own, None] * (sums[own] - w[2][at])
            grads = [np.array([g.sum()]), np.bincount(at, g[own], len(w[1])) + decay * w[1] / 10, np.stack([np.bincount(at, pair[:, f], len(w[1])) for f in range(factors)], 1) + decay * w[2]]
            step += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                w[i] = w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-6) * (0.2 if i == 2 else 1)
    w[1][0], w[2][0] = 0, 0
    return Machine(place, float(w[0][0]), w[1], w[2])


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _term_rows(batches):
    for batch in batches:
        blobs = [terms(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), batch.column(2)], ["h", "terms", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """From the texts of at most ``sample`` labelled rows outside the held-out fold."""
    able = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter(~F.coalesce(_held_out(), F.lit(True)) & F.col("toxic").isNotNull())
    n = able.count()
    h = F.xxhash64("doc_id")
    share = min(1.0, 1.1 * sample / max(n, 1))
    chosen = able.withColumn("h", h).filter(F.pmod(F.col("h"), F.lit(1_000_003)) < share * 1_000_003)
    chosen = chosen.orderBy("h", "toxic").limit(sample)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).join(F.broadcast(chosen), "doc_id")
    rows = own.select("h", "text", "toxic").mapInArrow(common.trimmed(_term_rows), "h long, terms binary, toxic int").orderBy("h", "toxic", "terms").limit(sample).collect()
    return fit([np.frombuffer(r.terms, np.int32) for r in rows], np.array([r.toxic for r in rows], float))


def _scored(machine, size: int = 512):
    def run(batches):
        own = machine.value
        for batch in batches:
            out = [own.score([terms(t.as_py()) for t in batch.slice(at, size).column(1)]) for at in range(0, batch.num_rows, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*out, np.zeros(0)]))], ["doc_id", "score"])

    return run


def score(spark: SparkSession, docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, from its text alone."""
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(machine)  # bounded by 2**BITS terms
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(common.trimmed(_scored(sent)), SCORES)
    return own.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(spark: SparkSession, docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns, in one pass."""
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(machine)

    def run(batches, size: int = 512):
        for batch in batches:
            out = [sent.value.score([terms(t) for t in batch.slice(at, size).column("text").cast(pa.binary()).to_pylist()]) for at in range(0, batch.num_rows, size)]
            yield batch.filter(pa.array(np.concatenate([*out, np.zeros(0)]) < 0.5))

    return docs.mapInArrow(common.trimmed(run), docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(spark, docs, learn(docs, common.table(spark, sf_dir, "labels")))
