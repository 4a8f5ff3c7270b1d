"""What the operators share: tables, written intermediate results, words and rolling hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word in the contract's ASCII rule: everything up to 0x7F but 0-9 and a-z, after A-Z are lower-cased.
_PLAIN = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)
#: Odd 64-bit base of the rolling polynomial.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


#: Rows and bytes of a batch that goes to Python. Texts may be long, and each batch stands in memory several times.
BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds batches to Python by rows and by bytes in this session, unless they are smaller already. Spark reads
    both settings when a plan is run, so they stay set."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the frame's columns."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only where one machine runs everything is there one of our own: on a
    cluster a local folder would lose rows, so a missing setting is an error there."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "/tmp/checkpoints"
        context.setCheckpointDir(named)
    return named


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again: lineage ends here, and a lost
    executor costs only a reread. The shuffle files before it are no longer needed, so the driver is
    asked to collect what refers to them."""
    path = f"{shared_dir(spark).rstrip('/')}/loomgraph/{name}-{uuid.uuid4().hex}"
    schema = frame.schema
    frame.write.parquet(path)
    del frame
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


#: Most rows of a table of keys that is broadcast: 16 MB of two numbers each.
SENT_ROWS = 1_000_000


def sent_if_small(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast where it is counted to be small; else Spark deals out both sides."""
    return F.broadcast(keys) if keys.count() <= SENT_ROWS else keys


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and returns the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return text.translate(_PLAIN).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``: bytes.split() splits at exactly these six bytes."""
    return text.split() if text else []


def word_values(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial's value over all 64 bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp values of every window of k words: sum of v[i+j] * BASE**(k-1-j) mod 2**64, put
    together from windows of powers of two; one value for each start, n - k + 1 in all."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    out, width, bit = None, 0, 1
    part = values
    while True:
        if k & bit:
            if out is None:
                out, width = part, bit
            else:  # the part stands before what has been put together
                size = min(len(part), len(out) - bit) if len(out) > bit else 0
                out = part[:size] * np.uint64(pow(BASE, width, 1 << 64)) + out[bit : bit + size]
                width += bit
        bit <<= 1
        if bit > k:
            break
        half = bit >> 1
        part = part[:-half] * np.uint64(pow(BASE, half, 1 << 64)) + part[half:]
    return out[: n - k + 1]


#: Most buckets that a task deals rows to at once, and most partitions of a shuffle by bucket.
FAN = 4_096
PARTITIONS = 20_000


class Buckets:
    """Equal ranges of 64-bit hashes, about ``each`` of ``total`` hashes in one. Where they are more than ``FAN``,
    rows are dealt to coarse ranges first and from there to the buckets, so a task sends at most ``FAN`` rows each
    time that it has gathered enough: rows sent are in proportion to the hashes, at any number of buckets."""

    def __init__(self, total: int, each: int, least: int = 1):
        n = max(least, total // each + 1)
        self.per = -(-n // FAN)
        self.coarse = -(-n // self.per)
        self.n = self.coarse * self.per

    def parts(self, hashes: np.ndarray, fine: bool):
        """(bucket or coarse range, places of its hashes in their order) of hashes in any order."""
        of = (((hashes >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32)).astype(np.int64)
        of = of if fine else of // self.per
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[order], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=len(order) > 0):
            yield int(of[order[a]]), order[a:b]

    def dealt(self, sent: DataFrame, column: str, again, schema: str) -> DataFrame:
        """Rows by bucket in as many partitions as there are buckets; ``again`` deals rows of coarse ranges."""
        if self.per > 1:
            sent = sent.repartition(min(self.coarse, PARTITIONS), column).mapInArrow(again, schema)
        return sent.repartition(min(self.n, PARTITIONS), column)


def trim() -> None:
    """Gives freed memory back to the system, where the platform can: Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What a Python worker keeps from task to task.
_kept: dict = {}


def kept(key, make):
    """make()'s result, made once in a Python worker, until a function of another operator runs there."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def trimmed(function, keep: bool = False):
    """A function over Arrow batches that gives memory back when it is done; unless ``keep`` is set, what the
    worker keeps goes first."""

    def over_batches(batches):
        if not keep:
            _kept.clear()
        try:
            yield from function(batches)
        finally:
            trim()

    return over_batches
