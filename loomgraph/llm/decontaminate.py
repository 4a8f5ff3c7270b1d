"""Benchmark decontamination by a prefix-filtered set join.

An item's window (13 consecutive words; a shorter item is one window) is a set of word shingles, each
with its offset. A window stands in a document only if all of its shingles do, so by the prefix filter
for full containment one shingle is enough to find it: the rarest over all documents.

One pass reads every text and keeps where shingles of items may stand, by a Bloom filter of the items'
shingles. What it lets through is counted over all documents and joined with the windows' rarest
shingles; the join bounds the window's start by its offset and by the document's length. Each candidate
is verified: shingles at offsets that cover all words of the window must stand in the document at these
places. All of this is joins of Spark, so items and documents are both spread; a shingle that very many
documents hold makes many rows on one side only, which Spark's skew join splits.

Only the filter goes to the driver, and from there to all: 2 ** ``FILTER_BITS[1]`` bits (32 MB) at most, whatever
the benchmark holds. With more items it lets more places through, which the join drops.

Shingles are compared as 64-bit hashes. A window's places are taken for its words if several shingles agree,
so a single collision doesn't make a hit unless the other words are there too.

Cases: a null or empty text has no words, no hits and is clean. An item without words is left out; an
item text that occurs twice counts for both ids; items without an id count as one, which isn't spelled in
items_sha256. Repeated document rows give repeated result rows. Null ids stay null. Empty tables give no
rows (documents) or no hits (benchmark). Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
SHINGLE = 5
PLACES = "doc_id long, text_hash long, n_words long, places binary, grams binary"
FLAT = "doc_id long, text_hash long, n_words long, place long, gram long"
WINDOWS = "item string, window binary, size int, k int, grams array<long>"
#: Least and most bits of the filter, as powers of two, and bits for each shingle between these.
FILTER_BITS = (20, 28)
BITS_EACH = 64
#: Bits of a row of the filter: those of Spark's bitmap functions.
ROW_BITS = 1 << 15
DOC = ["doc_id", "text_hash"]


def grams_of(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of the shingles of k words; shingles of different lengths have different hashes."""
    return common.mixed(common.rolling(common.word_values(words, len(words)), k) + np.uint64(k))


def _windows(window: int, shingle: int):
    """Each window of each item (once an item), with the hashes of all of its shingles."""

    def rows(item, text):
        words = common.plain_words(text)
        if not (size := min(window, len(words))):
            return
        k, seen = min(shingle, size), set()
        grams = grams_of(words, k).view(np.int64)
        for at in range(len(words) - size + 1):
            own = xxhash.xxh3_128_digest(b" ".join(words[at : at + size]))
            if own not in seen:
                seen.add(own)
                yield item, own, size, k, grams[at : at + size - k + 1]

    def batch(held):
        types = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        columns = list(zip(*held, strict=True)) if held else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item", "window", "size", "k", "grams"])

    def run(batches):
        held = []
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in rows(item, text):
                    held.append(row)
                    if len(held) >= 5_000:
                        yield batch(held)
                        held = []
        yield batch(held)

    return common.trimmed(run)


class Filter:
    """A Bloom filter of two probes over the shingles of all items."""

    def __init__(self, windows: DataFrame):
        sizes = windows.groupBy("k").agg(F.sum(F.size("grams")).alias("n")).collect()
        least, most = FILTER_BITS
        self.lengths = sorted(r.k for r in sizes)
        self.bits = min(most, max(least, math.ceil(math.log2(BITS_EACH * max(1, sum(r.n for r in sizes))))))
        raw = np.zeros(1 << (self.bits - 3), np.uint8)
        probes = F.explode(F.array(*(F.shiftrightunsigned("gram", 64 - self.bits - s) % (1 << self.bits) for s in (0, 32))))
        grams = windows.select(F.explode("grams").alias("gram")).select(probes.alias("bit"))
        rows = grams.groupBy(F.expr(f"bit div {ROW_BITS}").alias("row")).agg(F.bitmap_construct_agg(F.col("bit") % ROW_BITS).alias("set"))
        for r in rows.collect():
            raw[r.row * ROW_BITS // 8 : (r.row + 1) * ROW_BITS // 8] = np.frombuffer(bytes(r.set), np.uint8)
        self.raw = raw

    def may_have(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), bool)
        for s in (0, 32):
            bit = (grams >> np.uint64(64 - self.bits - s)) & np.uint64((1 << self.bits) - 1)
            out &= (self.raw[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def _places(sent):
    """Places in each text where shingles of items may stand."""

    def run(batches):
        own = sent.value
        for batch in batches:
            n, places, found = [], [], []
            for text in batch.column(2).to_pylist():
                words = common.plain_words(text)
                at, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for k in own.lengths:
                    all_ = grams_of(words, k)
                    at.append(np.flatnonzero(own.may_have(all_)))
                    grams.append(all_[at[-1]])
                n.append(len(words))
                places.append(np.concatenate(at).astype("<i8").tobytes())
                found.append(np.concatenate(grams).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(places, pa.binary()), pa.array(found, pa.binary())], ["doc_id", "text_hash", "n_words", "places", "grams"])

    return common.trimmed(run)


def _flat(batches):
    """One row for each place."""
    for batch in batches:
        raw = batch.column(3).to_pylist()
        row = pa.array(np.repeat(np.arange(len(raw)), [len(p) // 8 for p in raw]))
        at, grams = (pa.array(np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8")) for c in (3, 4))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in range(3)), at, grams], ["doc_id", "text_hash", "n_words", "place", "gram"])


def _same(left: str, right: str, names: list[str]):
    condition = F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))
    for n in names:
        condition &= F.col(f"{left}.{n}") == F.col(f"{right}.{n}")
    return condition


def occurrences(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash and n_words of each document; doc_id, text_hash, start, size and item of each window of an
    item that stands in a document."""
    common.small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string").cast("binary"))
    windows = common.written(spark, items.mapInArrow(_windows(window, shingle), WINDOWS), "windows")
    sent = spark.sparkContext.broadcast(Filter(windows))  # 2 ** FILTER_BITS[1] bits at most
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    places = common.written(spark, own.mapInArrow(_places(sent), PLACES), "places")
    flat = common.written(spark, places.filter(F.length("places") > 0).mapInArrow(_flat, FLAT), "shingles")

    once = windows.groupBy("window").agg(F.first("size").alias("size"), F.first("k").alias("k"), F.first("grams").alias("grams"))
    parts = once.select("window", "size", F.size("grams").alias("n"), F.posexplode("grams").alias("offset", "gram"))
    counts = flat.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    rarest = parts.join(counts, "gram").groupBy("window").agg(F.count(F.lit(1)).alias("there"), F.first("n").alias("n"), F.min(F.struct("times", "gram", "offset")).alias("least"))
    prefix = rarest.filter("there = n").select("window", "least.gram", "least.offset").join(once.drop("gram"), "window")
    # Shingles at every k-th offset and at the last one cover the window's words.
    checked = F.expr("array_distinct(array_append(sequence(0, size - k, k), size - k))")
    prefix = prefix.select("gram", "offset", "window", "size", F.transform(checked, lambda o: F.struct(o.alias("o"), F.get("grams", o).alias("g"))).alias("checks"))
    start = (F.col("place") - F.col("offset")).alias("start")
    found = flat.join(prefix, "gram").select(*DOC, "n_words", start, "window", "size", "checks").filter("start >= 0 AND start + size <= n_words").drop("n_words").distinct()
    wanted = found.select(*DOC, "start", "window", "size", F.size("checks").alias("n"), F.explode("checks").alias("check"))
    wanted = wanted.withColumns({"place": F.col("start") + F.col("check.o"), "gram": F.col("check.g")}).drop("check")
    there = wanted.alias("w").join(flat.alias("f"), _same("w", "f", ["text_hash", "place", "gram"]), "left_semi")
    verified = there.groupBy(*DOC, "start", "window", "size", "n").agg(F.count(F.lit(1)).alias("found")).filter("found = n")
    owners = windows.select("window", "item").distinct()
    return places.select(*DOC, "n_words"), verified.join(owners, "window").select(*DOC, "start", "size", "item")


JUDGED = ["doc_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash (xxhash64), n_words, n_hit (words inside any window), n_items, items_sha256 and contaminated of each document."""
    all_docs, found = occurrences(spark, docs, benchmark, **options)
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    ids = F.collect_set("item")
    # Spans in order of their starts: each adds what reaches beyond those before it.
    beyond = lambda seen, s: F.greatest(s["end"] - F.greatest(seen["end"], s["start"]), F.lit(0).cast("long"))
    step = lambda seen, s: F.struct(F.greatest(seen["end"], s["end"]).alias("end"), (seen["total"] + beyond(seen, s)).alias("total"))
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    by_doc = found.groupBy(*DOC).agg(spans.alias("spans"), ids.alias("ids"), F.max(F.col("item").isNull().cast("int")).alias("unnamed"))
    by_doc = by_doc.select(*DOC, F.aggregate("spans", none, step)["total"].alias("n_hit"), (F.size("ids") + F.col("unnamed")).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"))
    joined = all_docs.alias("d").join(by_doc.alias("h"), _same("d", "h", ["text_hash"]), "left")
    n_hit = F.coalesce("h.n_hit", F.lit(0).cast("long"))
    return joined.select(
        "d.doc_id", "d.text_hash", "d.n_words", n_hit.alias("n_hit"), F.coalesce("h.n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("h.items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("d.n_words"))).alias("contaminated"),
    )


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; rows of one id are told apart by their texts."""
    bad = decontaminate(spark, docs, benchmark, **options).filter("contaminated").select(*DOC).distinct()
    bad = common.sent_if_small(common.written(spark, bad, "contaminated"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.text_hash"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("text_hash")
