"""SimHash near-duplicates by anchor points of a covering code.

A text's fingerprint has a bit set where over half of its word shingles' hashes (XXH64) have it, repeats counted.
Two fingerprints link when they differ in at most ``THRESHOLD`` bits.

Anchors are the words of a covering code: pairs of words of the perfect binary Golay code of 23 bits, over the
first 46 bits of a fingerprint. Every 23 bits are within 3 bits of exactly one Golay word, so each fingerprint
has one home anchor at its covering radius of 3 and 3. A fingerprint that differs from another by i bits in the first
half and j in the second is within 3 + i and 3 + j of the other's home; so fingerprints are replicated to every
anchor within covering radius plus threshold, and it is enough to compare those at home at an anchor with all that
came there. A fingerprint goes to about 61 of 16.8 million anchors, whatever the number of fingerprints. Words at a
distance are looked up by the syndrome of the 23 bits in a table of all error patterns, which follows from the
generator polynomial.

Equal fingerprints are one row from the start. An anchor of more than ``UNIT`` rows is a grid of tasks: its
fingerprints are dealt to parts, and each part of those at home meets each part of all of them, so no task
holds more than two parts. A task sends no pairs but the edges of the forest that its links span, so a dense group
sends no more rows than it received. The forests' components are joined over all anchors.

Cases: a null or empty text, or one without words, has the fingerprint zero, and links like any other; a text of fewer
words than a shingle has its whole sequence as one. Rows that share a doc_id each keep their row and link by their own
text. A null doc_id counts only where its component has no other id. An empty table gives no rows. Other columns are
ignored. A long text is hashed by blocks of shingles.
"""

from __future__ import annotations

from functools import cache, partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .neardup import Forest, components

SHINGLE = 3
SEED = 42
THRESHOLD = 2
#: The Golay code: bits of a word, of what is left after the message, covering radius, and its generator polynomial
#: x**11 + x**10 + x**6 + x**5 + x**4 + x**2 + 1.
BITS, CHECK, RADIUS, GENERATOR = 23, 11, 3, 0b110001110101
#: Most rows of an anchor, and of a part of one, that one task compares.
UNIT = 1 << 16
#: Pairs that are compared at once, and rows of an anchor's task that are gathered before anchors are compared.
PAIRS = 1 << 21
GATHERED = 1 << 16
_BLOCK = 1 << 16
HASH = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a number of 64 bits."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return HASH(b" ".join(words))
    total, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False))
    for k in range(0, total, _BLOCK):
        size = min(_BLOCK, total - k)
        hashes = np.fromiter(map(HASH, islice(shingles, size)), "<u8", size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed number) of each document."""
    common.small_batches(spark)

    def run(batches):
        for batch in batches:
            own = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(common.trimmed(run), "doc_id long, fp long")


class Golay:
    """Syndromes of 23 bits, and the error patterns of each syndrome by weight: those within the covering radius come
    first (exactly one), then each weight up to ``radius + threshold``."""

    def __init__(self, threshold: int = THRESHOLD):
        self.high = np.array([self._rest(v << CHECK) for v in range(1 << (BITS - CHECK))], np.int64)
        weights = range(RADIUS + threshold + 1)
        errors = np.array([sum(1 << i for i in bits) for w in weights for bits in combinations(range(BITS), w)], np.int64)
        weight = np.bitwise_count(errors).astype(np.int64)
        of = self.syndrome(errors)
        order = np.lexsort((errors, weight, of))
        self.errors = errors[order]
        self.first = np.searchsorted(of[order], np.arange((1 << CHECK) + 1))
        #: upto[k]: how many patterns of a syndrome are within radius + k.
        self.upto = np.stack([np.bincount(of[weight <= RADIUS + k], minlength=1 << CHECK) for k in range(threshold + 1)])

    @staticmethod
    def _rest(value: int) -> int:
        for bit in range(BITS - 1, CHECK - 1, -1):
            if value >> bit & 1:
                value ^= GENERATOR << (bit - CHECK)
        return value

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        return self.high[values >> CHECK] ^ (values & ((1 << CHECK) - 1))

    def words(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the code words that the patterns at these places make of the values."""
        return (values ^ self.errors[at]) >> CHECK


@cache
def golay(threshold: int) -> Golay:
    return Golay(threshold)


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the fingerprint, anchor, whether it is the home) of all replicas of fingerprints (unsigned)."""
    code, mask = golay(threshold), np.uint64((1 << BITS) - 1)
    halves = [(fps & mask).astype(np.int64), (fps >> np.uint64(BITS) & mask).astype(np.int64)]
    first, second = (code.syndrome(h) for h in halves)
    own, near, home = [], [], []
    for k in range(threshold + 1):
        # Words at radius + k exactly in the first half, within radius + what is left in the second.
        skip = code.upto[k - 1][first] if k else np.zeros(len(fps), np.int64)
        many = code.upto[k][first] - skip
        others = code.upto[threshold - k][second]
        size = many * others
        row = np.repeat(np.arange(len(fps)), size)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        i, j = np.divmod(place, others[row])
        a = code.words(halves[0][row], code.first[first[row]] + skip[row] + i)
        b = code.words(halves[1][row], code.first[second[row]] + j)
        own.append(row)
        near.append(a << (BITS - CHECK) | b)
        home.append((i == 0) & (j == 0) if k == 0 else np.zeros(len(row), bool))
    return np.concatenate(own), np.concatenate(near), np.concatenate(home)


def _replicas(threshold: int):
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), 4096):
                part = fps[k : k + 4096]
                own, near, home = anchors(part.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(part[own]), pa.array(home)], ["anchor", "fp", "home"])

    return run


def _counts(threshold: int, coarse: bool):
    """How many fingerprints come to anchors, by the anchor or by its first half alone; each task adds up its own."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fps), 1 << 14):
                near = anchors(fps[k : k + (1 << 14)], threshold)[1]
                names, n = np.unique(near >> (BITS - CHECK) if coarse else near, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return run


def _pairs(starts: np.ndarray, ends: np.ndarray, left: np.ndarray, left_group: np.ndarray, fps: np.ndarray, threshold: int):
    """Places (left, other) of linked fingerprints: each of ``left`` meets the rows of its group."""
    size = ends[left_group] - starts[left_group]
    upto = np.cumsum(size)
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        own = np.repeat(np.arange(a, b), size[a:b])
        other = np.arange(len(own)) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b]) + starts[left_group[own]]
        hit = np.flatnonzero(np.bitwise_count(fps[left[own]] ^ fps[other]) <= threshold)
        hit = hit[fps[left[own[hit]]] != fps[other[hit]]]
        if len(hit):
            yield left[own[hit]], other[hit]
        a = b


def _forest(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, member: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the forest that the links of some whole anchors span; rows are in order of the anchor's key."""
    cuts = np.flatnonzero(np.r_[True, np.diff(keys) != 0])
    group = np.cumsum(np.r_[True, np.diff(keys) != 0]) - 1
    # Within a group the rows that count as members come first.
    order = np.lexsort((~member, group))
    fps, home, member = fps[order], home[order], member[order]
    ends = cuts + np.bincount(group[member], minlength=len(cuts))
    left = np.flatnonzero(home & (ends[group] - cuts[group] > 0))
    names, known = {}, Forest(0)
    for a, b in _pairs(cuts, ends, left, group[left], fps, threshold):
        both = np.unique(np.stack([np.minimum(fps[a], fps[b]), np.maximum(fps[a], fps[b])], 1), axis=0)
        for x, y in both.tolist():
            for v in (x, y):
                if v not in names:
                    names[v] = len(names)
                    known.up.append(names[v])
            known.join(names[x], names[y])
    values = np.array(list(names), np.uint64)
    roots = np.array([known.root(i) for i in range(len(values))], np.int64)
    linked = np.flatnonzero(roots != np.arange(len(roots)))
    return values[linked].view(np.int64), values[roots[linked]].view(np.int64)


def _compared(threshold: int):
    """Edges of anchors whose rows (anchor, part, fp, home, member) come together; some anchors are compared at once."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def done(parts, last: bool):
            keys, fps, home, member = (np.concatenate([p[i] for p in parts]) for i in range(4))
            cut = len(keys) if last else int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            rest = [(keys[cut:], fps[cut:], home[cut:], member[cut:])] if cut < len(keys) else []
            a, b = _forest(keys[:cut], fps[:cut], home[:cut], member[:cut], threshold) if cut else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]), rest

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, cell, fp, home, member = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append((anchor.astype(np.int64) << 32 | cell, fp.view(np.uint64), home, member))
            size += batch.num_rows
            if size >= GATHERED:
                made, held = done(held, False)
                size = sum(len(p[0]) for p in held)
                yield made
        if held:
            yield done(held, True)[0]

    return run


def crowded(spark: SparkSession, fps: DataFrame, unit: int = UNIT, threshold: int = THRESHOLD) -> DataFrame | None:
    """(anchor, parts) of anchors that more than ``unit`` fingerprints come to, and how many parts they have. Anchors are
    counted by their first half at first, of which there are 4,096; if none of those is crowded, no anchor is."""
    kind = "anchor int, n long"
    coarse = fps.mapInArrow(_counts(threshold, True), kind).groupBy("anchor").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first()
    if (coarse.n or 0) <= unit:
        return None
    exact = fps.mapInArrow(_counts(threshold, False), kind).groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > unit)
    return common.written(spark, exact.select("anchor", F.ceil(F.col("n") / unit).cast("int").alias("parts")), "crowded")


def links(spark: SparkSession, fps: DataFrame, *, threshold: int = THRESHOLD, unit: int = UNIT) -> DataFrame:
    """Edges (a, b) whose components are those of all links between different fingerprints (fp)."""
    sent = fps.select("fp").mapInArrow(_replicas(threshold), "anchor int, fp long, home boolean")
    whole = sent.select("anchor", F.lit(0).alias("cell"), "fp", "home", F.lit(True).alias("member"))
    many = crowded(spark, fps.select("fp"), unit, threshold)
    if many is not None:
        many = common.sent_if_small(many)
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        others = F.sequence(F.lit(0), F.col("parts") - 1)
        large = sent.join(many, "anchor")
        at_home = large.filter("home").select("anchor", F.explode(F.transform(others, lambda j: part * F.col("parts") + j)).alias("cell"), "fp", "home", F.lit(False).alias("member"))
        there = large.select("anchor", F.explode(F.transform(others, lambda i: i * F.col("parts") + part)).alias("cell"), "fp", F.lit(False).alias("home"), F.lit(True).alias("member"))
        whole = whole.join(many, "anchor", "left_anti").unionByName(at_home).unionByName(there)
    dealt = whole.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    return dealt.mapInArrow(common.trimmed(_compared(threshold)), "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, *, shingle: int = SHINGLE, threshold: int = THRESHOLD, unit: int = UNIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id that links reach) of each document."""
    own = common.written(spark, fingerprints(spark, docs, shingle), "fingerprints")
    classes = common.written(spark, own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprint_classes")
    roots = components(spark, links(spark, classes, threshold=threshold, unit=unit)).withColumnRenamed("node", "fp")
    ids = classes.join(roots, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = classes.join(roots, "fp").join(ids, "root").select("fp", "component_id")
    alone = classes.filter("n > 1").join(roots, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    # Fingerprints of a single document without links need no row.
    known = common.sent_if_small(common.written(spark, linked.unionByName(alone), "fingerprint_components"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(known, "fp", "left").select("doc_id", digits.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, common.table(spark, sf_dir, "documents"))
