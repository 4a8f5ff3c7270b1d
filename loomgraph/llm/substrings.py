"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark.

Each task hashes every window of its texts, keeps the earliest place of each hash and marks its other
places at once, so a passage that fills a task's texts leaves one record. The records are dealt to
buckets by ranges of the hash, in blobs (less than 8 bytes of hash and about one of place for each window), and
each bucket marks all places of a hash but the earliest. Marks are gathered by groups of documents (of
about ``TOGETHER``, or ``GATHERED`` words) and return to them, where overlapping windows merge into maximal
removal intervals. The number of buckets follows the amount of text, so a bucket's size is bounded, and many
buckets are dealt in two rounds, so blobs stay large; a hot window has one record for each task at most.

Two different windows share a 64-bit value with probability n**2 / 2**65 for n windows: 1e-3 for 1e8.

Cases: a null or empty text has no words and keeps "". Texts shorter than a window keep all words. Of
equal windows the one with the smaller doc_id stays, in one document the earlier. A null doc_id counts
as the smallest. Rows that share a doc_id count as one document: equal windows at the same start of two
of them don't remove each other, and what is removed at a start is removed in each of them. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 20
#: Windows that a task hashes before it sends them on, and that a bucket holds on average.
FLUSH = 800_000
BUCKET = 1_000_000
TOGETHER = 2_000
GATHERED = 500_000
NULL_ID = -(1 << 63)
#: ``hashes`` of marks that a task has made (``made``) holds their group of documents.
SENT = "bucket long, docs binary, counts binary, starts binary, hashes binary, made boolean"
MARKED = "owners long, docs binary, counts binary, starts binary"
MARKS = "doc_id long, starts binary"


def squeezed(a: np.ndarray, kind: str = "<i4") -> bytes:
    """Differences of numbers, by byte planes, compressed."""
    own = a.astype(kind)
    planes = np.diff(own, prepend=own.dtype.type(0)).view(np.uint8).reshape(-1, own.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueezed(raw: bytes, kind: str = "<i4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def packed(hashes: np.ndarray) -> bytes:
    """Hashes in their order: their least one, and the differences from it by byte planes, compressed. Those of a narrow
    range have the same high bytes."""
    low = hashes.min() if len(hashes) else np.uint64(0)
    planes = np.ascontiguousarray((hashes - low).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return int(low).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8:]), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel() + np.uint64(int.from_bytes(raw[:8], "little"))


def later_places(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the places whose hash has an earlier (document, start)."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return np.zeros(0, np.int64)
    member = np.zeros(len(order), bool)
    member[1:] |= same
    member[:-1] |= same
    own = order[member]
    own = own[np.lexsort((starts[own], docs[own], hashes[own]))]
    first = np.concatenate([[True], hashes[own][1:] != hashes[own][:-1]])
    head = own[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return own[(docs[own] != docs[head]) | (starts[own] != starts[head])]


def _runs(docs: np.ndarray) -> tuple[bytes, bytes]:
    """Documents of places in order, and how many places each has."""
    new = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return squeezed(docs[new], "<i8"), squeezed(np.diff(np.append(new, len(docs))))


def _places(docs: bytes, counts: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The inverse: documents and starts of places."""
    return np.repeat(unsqueezed(docs, "<i8"), unsqueezed(counts)), unsqueezed(starts)


def _by_owners(docs: np.ndarray, starts: np.ndarray, groups: int):
    """(group of documents, places of its documents) of marked places."""
    owners = (common.mixed(docs.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((starts, docs, owners))
    owners, docs, starts = owners[order], docs[order], starts[order]
    cuts = np.flatnonzero(np.diff(owners, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(docs)], strict=len(docs) > 0):
        yield int(owners[a]), *_runs(docs[a:b]), squeezed(starts[a:b])


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = [pa.int64()] + [pa.binary()] * 4 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "docs", "counts", "starts", "hashes", "made"])


def _blobs(buckets: common.Buckets, docs: np.ndarray, starts: np.ndarray, hashes: np.ndarray, fine: bool):
    """A row for each bucket, or coarse range of them, that has some of the places."""
    for bucket, own in buckets.parts(hashes, fine):
        yield _sent([(bucket, *_runs(docs[own]), squeezed(starts[own]), packed(hashes[own]), False)])


def _hashed(window: int, buckets: common.Buckets, groups: int):
    def flush(parts: list[tuple[int, np.ndarray]]):
        parts.sort(key=lambda p: p[0])
        sizes = np.array([len(h) for _, h in parts], np.int64)
        docs = np.repeat(np.array([d for d, _ in parts], np.int64), sizes)
        starts = (np.arange(len(docs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        hashes = np.concatenate([h for _, h in parts])
        parts.clear()
        later = later_places(hashes, docs, starts)
        yield _sent([(o % buckets.coarse, *places, o.to_bytes(8, "little"), True) for o, *places in _by_owners(docs[later], starts[later], groups)])
        order = np.argsort(hashes, kind="stable")  # of equal hashes the first is the earliest
        firsts = np.ones(len(order), bool)
        firsts[1:] = hashes[order][1:] != hashes[order][:-1]
        own = np.sort(order[firsts])
        yield from _blobs(buckets, docs[own], starts[own], hashes[own], buckets.per == 1)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                words = common.space_words(text.as_py())
                if len(words) >= window:
                    hashes = common.mixed(common.rolling(common.word_values(words, len(words)), window))
                    doc = doc.as_py()
                    parts.append((NULL_ID if doc is None else doc, hashes))
                    held += len(hashes)
                    if held >= FLUSH:
                        yield from flush(parts)
                        held = 0
        if parts:
            yield from flush(parts)

    return common.trimmed(run)


def _again(buckets: common.Buckets):
    """Deals the places of coarse ranges to their buckets; marks that tasks have made pass through."""

    def flush(parts):
        docs, starts, hashes = (np.concatenate(c) for c in zip(*parts, strict=True))
        yield from _blobs(buckets, docs, starts, hashes, True)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, d, c, s, h, made in zip(*(batch.column(n).to_pylist() for n in ("bucket", "docs", "counts", "starts", "hashes", "made")), strict=True):
                if made:
                    yield _sent([(int.from_bytes(h, "little") % buckets.n, d, c, s, h, True)])
                    continue
                parts.append((*_places(d, c, s), unpacked(h)))
                held += len(parts[-1][0])
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return common.trimmed(run)


def _marked(groups: int):
    def run(bucket: pa.Table) -> pa.Table:
        """A bucket's later places, by group of documents; marks that tasks have made pass through."""
        rows, docs, starts, hashes = [], [], [], []
        for d, c, s, h, made in zip(*(bucket.column(n) for n in ("docs", "counts", "starts", "hashes", "made")), strict=True):
            if made.as_py():
                rows.append((int.from_bytes(h.as_py(), "little"), d.as_py(), c.as_py(), s.as_py()))
            else:
                own = _places(d.as_py(), c.as_py(), s.as_py())
                docs.append(own[0])
                starts.append(own[1])
                hashes.append(unpacked(h.as_py()))
        if hashes:
            docs, starts, hashes = np.concatenate(docs), np.concatenate(starts), np.concatenate(hashes)
            later = later_places(hashes, docs, starts)
            rows += _by_owners(docs[later], starts[later], groups)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table({n: pa.array(c, pa.binary() if k else pa.int64()) for k, (n, c) in enumerate(zip(("owners", "docs", "counts", "starts"), columns, strict=True))})

    def trimmed(bucket: pa.Table) -> pa.Table:
        out = run(bucket)
        common.trim()
        return out

    return trimmed


def _gathered(owned: pa.Table) -> pa.Table:
    """All marks of a group's documents, one row for each document."""
    parts = [_places(*(x.as_py() for x in row)) for row in zip(*(owned.column(n) for n in ("docs", "counts", "starts")), strict=True)]
    docs, starts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    cuts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    blobs = [squeezed(starts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(docs)], strict=True)]
    return pa.table({"doc_id": pa.array(docs[cuts], pa.int64()), "starts": pa.array(blobs, pa.binary())})


def repeated_windows(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id (null as the smallest long) and a blob of the starts of windows that also start earlier."""
    common.small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    volume = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    words = (volume.bytes or 0) // 6
    buckets, groups = common.Buckets(words, BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions"))), max(volume.n // TOGETHER, words // GATHERED) + 1
    sent = own.mapInArrow(_hashed(window, buckets, groups), SENT)
    marked = buckets.dealt(sent, "bucket", _again(buckets), SENT).groupBy("bucket").applyInArrow(_marked(groups), MARKED)
    return marked.groupBy("owners").applyInArrow(_gathered, MARKS)


def _cut(window: int, names: list[str], made: list[str], starts_of: str):
    def run(batches):
        for batch in batches:
            removed, words_of, kept_of = [], [], []
            for text, blob in zip(batch.column("text"), batch.column(starts_of), strict=True):
                words = common.space_words((t := text.as_py()) and t.encode())
                gone = np.zeros(len(words) + 1, np.int32)
                if blob.as_py() is not None:
                    starts = unsqueezed(blob.as_py())
                    starts = starts[starts <= len(words) - window]
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + window, -1)
                keep = np.cumsum(gone)[:-1] == 0
                words_of.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                kept_of.append(b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)]).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(words_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_of, pa.string())], [*names, *made])

    return common.trimmed(run)


#: Names of the columns that remove_repeats adds.
ADDED = ("n_words", "n_removed", "kept")


def remove_repeats(spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, added: tuple[str, ...] = ADDED) -> DataFrame:
    """The documents with their number of words, of removed words, and the words that stay, joined by one space,
    under the names in ``added``; columns of docs with these names give way."""
    docs = docs.drop(*added)
    key, starts = common.fresh(docs, "_key", "_starts")
    marks = common.written(spark, repeated_windows(spark, docs, window), "marks")
    marks = marks.select(F.col("doc_id").alias(key), F.col("starts").alias(starts))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    joined = keyed.join(marks.hint("shuffle_hash"), key, "left").drop(key)
    schema = T.StructType([*docs.schema, *(T.StructField(n, k()) for n, k in zip(added, (T.LongType, T.LongType, T.StringType), strict=True))])
    return joined.mapInArrow(_cut(window, docs.columns, list(added), starts), schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(spark, docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
