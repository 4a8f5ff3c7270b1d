"""Packing by cutting stock: column generation over a histogram of piece lengths.

Documents may be cut freely, so each is cut at places that depend on its own length alone: full blocks
of ``capacity``, then a part whose length is a multiple of ``unit`` (the largest that fits), then a tail
shorter than ``unit``. This leaves a histogram of at most ``unit - 1`` tail lengths and ``capacity /
unit`` part lengths, whatever the corpus holds, and each piece's checksum is known in the one pass that
tokenizes. Tails are first packed into bundles of one unit; bundles then join the parts of one unit.

Either level is a cutting-stock problem: a linear program over patterns (how many pieces of each length
share a bin), solved by column generation with a revised simplex, where a knapsack dynamic program
prices new patterns. Pattern counts are rounded down; what is left of the demand (less than one bin for
each basic pattern) is packed first-fit decreasing into patterns of its own. Pieces are ranked within
their length and the ranks are dealt to the patterns in turn. Ranking counts first by (length, salt),
so a length that holds a third of all pieces is split over many tasks.

Cases: a null or empty text has the end token only. Repeated rows (also of one doc_id) are packed as
documents of their own. Null ids stay null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
UNIT = 64
END = 2
#: Words of a generation whose ids a worker keeps, about 150 bytes each; it keeps two.
CACHED_WORDS = 150_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind int, size int, salt long"
#: Pieces of one length and salt, which are ranked together, where that length has all pieces.
RANKED = 2_000


def cuts(n: int, capacity: int, unit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at = len(out) * capacity
    if part := (n - at) // unit * unit:
        out.append((at, part))
    if n > at + part:
        out.append((at + part, n - at - part))
    return out


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) of words. The tokenizer cuts a text at white space and between a
    letter or digit and a full stop or comma, and lower-cases it, so a text's ids are those of its words in
    turn, except where a text may hold the spelling of a special token."""

    #: Stands between words that are tokenized together; no word without "<|" has its id.
    SEPARATOR = "<|endoftext|>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.separator = vocabulary[self.SEPARATOR]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words without "<|". Words that weren't asked for in a whole generation are forgotten."""
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        new = []
        for word in words:
            if word not in self:
                if (ids := self.old.get(word)) is None:
                    new.append(word)
                else:
                    self[word] = ids
        letters, others = [], []
        for word in new:
            (letters if word.isalpha() else others).append(word)
        for part in _parts(letters):
            ids = self._joined("\n", part)
            if not self._cut(part, ids, np.flatnonzero(self.ends[ids]) + 1, 0):  # some word is more than one piece to the tokenizer
                others += part
        for part in _parts(others):
            ids = self._joined(self.SEPARATOR, part)
            self._cut(part, ids, np.flatnonzero(np.append(ids, self.separator) == self.separator), 1)
        return list(map(self.__getitem__, words))

    def _joined(self, separator: str, part: list[str]) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([separator.join(part)], add_special_tokens=False)[0].ids, "<u4")

    def _cut(self, part: list[str], ids: np.ndarray, cut: np.ndarray, skip: int) -> bool:
        """Keeps each word's ids where there are as many cuts as words."""
        if len(cut) != len(part):
            return False
        raw, at = ids.tobytes(), 0
        for word, end in zip(part, (4 * cut).tolist(), strict=True):
            self[word] = raw[at:end]
            at = end + 4 * skip
        return True

    def of(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text. Words are split and numbered by Arrow; Python sees each distinct one once."""
        odd = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=r"([a-z0-9])([.,]+)(\s|$)", replacement=r"\1 \2\3")
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            plain = pc.if_else(pa.array(mask), "", plain)
        words = pc.ascii_split_whitespace(plain)
        coded = words.flatten().dictionary_encode()
        known = self.learn(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), "<u4")
        at = coded.indices.to_numpy()
        n = sizes[at]
        after = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[at] - after[:-1], n) + np.arange(after[-1])]
        bounds = after[words.offsets.to_numpy()]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in odd.tolist():
            out[k] = self.whole(texts[k].as_py())
        return out


def _parts(words: list, size: int = 4000) -> list:
    return [words[k : k + size] for k in range(0, len(words), size)]


def _grouped(batches, most: int):
    """Batches put together to about this many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tokenized(path: str, capacity: int, unit: int, salts: int):
    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ids, end = common.kept(("word ids", path), lambda: WordIds(path)), np.array([END], "<u4").tobytes()
        count = 0  # so that rows that are alike in all else are dealt to several salts, too
        for group in _grouped(batches, 2 << 20):
            rows: list[tuple] = []
            for chunk in group.to_batches():
                texts = pc.fill_null(chunk.column(1), "")
                for doc, own in zip(chunk.column(0).to_pylist(), ids.of(texts), strict=True):
                    raw = memoryview(own.tobytes() + end)
                    n = len(raw) // 4
                    for start, length in cuts(n, capacity, unit):
                        crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                        kind, size = (1, length // unit) if length % unit == 0 else (0, length)
                        count += 1
                        rows.append((doc, start, length, crc, n, kind, size, (crc ^ count * 0x9E3779B1) % salts))
            yield _batch(rows)

    return common.trimmed(run, keep=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "size", "salt"]
    types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest pattern that fits, by dynamic programming over the filled size."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = np.flatnonzero(sizes <= c)
        if len(fits):
            worth = best[c - sizes[fits]] + prices[fits]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], last[c] = worth[k], fits[k]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional counts for the least number of bins; stops when the bound
    of the dual prices is within gap of it."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(200 * m):
        inverse = np.linalg.inv(basis)
        x = np.clip(inverse @ demand, 0, None)
        prices = np.ones(m) @ inverse
        worth, pattern = knapsack(prices, sizes, capacity)
        if worth <= 1 + gap:
            break
        column = inverse @ pattern
        able = column > 1e-9
        ratio = np.where(able, x / np.where(able, column, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = pattern
    return basis, np.clip(np.linalg.solve(basis, demand), 0, None)


def cutting_stock(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: pieces}) of each pattern; the pieces add up to the histogram exactly."""
    sizes = np.array(sorted((s for s, n in histogram.items() if n), reverse=True), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    patterns, counts = column_generation(sizes, left.astype(float), capacity)
    out: list[tuple[int, dict[int, int]]] = []
    for k in np.argsort(-counts):
        column = np.rint(patterns[:, k]).astype(np.int64)
        used = np.flatnonzero(column)
        times = int(min([int(counts[k] + 1e-9), *(left[used] // column[used])]))
        if times > 0:
            out.append((times, {int(sizes[i]): int(column[i]) for i in used}))
            left[used] -= times * column[used]
    bins: list[list[int]] = []
    for size, n in zip(sizes.tolist(), left.tolist(), strict=True):
        for _ in range(n):
            for own in bins:
                if own[0] >= size:
                    break
            else:
                bins.append(own := [capacity])
            own[0] -= size
            own.append(size)
    for own in bins:
        out.append((1, {s: own[1:].count(s) for s in set(own[1:])}))
    return out


class Deal:
    """Finds the bin of the piece with a rank within its size: ranks are dealt to patterns in turn."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]]):
        self.bins, self.by_size = 0, {}
        for times, pattern in patterns:
            for size, per in pattern.items():
                runs = self.by_size.setdefault(size, [[], [], [], 0])
                runs[0].append(runs[3])
                runs[1].append(per)
                runs[2].append(self.bins)
                runs[3] += times * per
            self.bins += times
        self.by_size = {s: tuple(np.array(x, np.int64) for x in r[:3]) for s, r in self.by_size.items()}

    def bin_of(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(size), np.int64)
        for s in np.unique(size):
            here = size == s
            firsts, per, base = self.by_size[int(s)]
            run = np.searchsorted(firsts, rank[here], "right") - 1
            out[here] = base[run] + (rank[here] - firsts[run]) // per[run]
        return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """The pieces of all documents with their sequence and place; see the module."""
    common.small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string")))
    volume = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    salts = int((volume.n + (volume.b or 0) // capacity) * 2 // RANKED) + 1
    pieces = common.written(spark, own.mapInArrow(_tokenized(tokenizer, capacity, unit, salts), PIECES), "pieces")
    group = ["kind", "size", "salt"]
    counts = pieces.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    histogram: tuple[dict, dict] = {}, {}
    for r in counts.groupBy("kind", "size").agg(F.sum("n").alias("n")).collect():
        histogram[r.kind][r["size"]] = r.n
    tails = Deal(cutting_stock(histogram[0], unit))
    parts_of_one = histogram[1].get(1, 0)
    whole = Deal(cutting_stock(histogram[1] | {1: parts_of_one + tails.bins}, capacity // unit))

    before = Window.partitionBy("kind", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*group).orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(offsets, group).withColumn("rank", F.col("rank") + F.col("base"))

    def deal(batches):
        for batch in batches:
            kind, size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kind", "size", "rank"))
            size, rank = size.copy(), rank.copy()
            tail = kind == 0
            rank[tail] = parts_of_one + tails.bin_of(size[tail], rank[tail])
            size[tail] = 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(whole.bin_of(size, rank))], [*names, "sequence_id"])

    dealt = ranked.mapInArrow(deal, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
