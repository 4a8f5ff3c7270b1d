"""N-gram Jaccard join with signature trees.

A document's set is its distinct word shingles; documents with equal sets form a class at once. Shingles
are dealt to buckets by hash ranges, where the number of classes that hold each is counted; shingles of a
single class can't be shared and are dropped. A class that links with another shares at least
``similarity`` of its own shingles, so classes with fewer shared ones are done. For the others the prefix
filter applies: in the order of (count, hash), two sets that link share one of each set's first
``n - ceil(similarity * n) + 1`` shingles, unshared ones included. Classes that share a prefix shingle
form candidate components, which no link leaves.

Links are found by signature trees: leaves are token bitmaps, inner nodes hold the OR of their children's, the
range of sizes and the most tokens that fall on a bit already set. The dual traversal drops a pair of nodes if
the overlap that their bitmaps and sizes allow is less than the least that a link needs, or if all below
them is one component already. What remains is verified on the tokens. A component of at most ``TOGETHER``
classes is one tree. A larger one is cut into subtrees by size and least token; their roots are rows, the
dual traversal of the roots tells which subtrees meet, and each such pair is traversed by a task of its own, so
no task holds more than two subtrees' classes. As a shortcut, classes of a large component are compared with a few
pivots first (salted, so its rows stay spread), and subtrees that one pivot links with don't meet; without it (``pivots``
of 0) the result is the same.

``document_links`` counts links instead, and there no pair is left out because it is connected already: every
pair of classes that the bounds allow is verified.

Sets are compared as 64-bit hashes; classes are told apart by a 64-bit digest and the size.

Cases: a null or empty text has no shingles and is linked with nothing; a text of fewer words than a
shingle has its whole sequence as one. Rows that share a doc_id each keep their row. A null doc_id counts
only where its component has no other id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .substrings import FLUSH, GATHERED, packed, squeezed, unpacked, unsqueezed

SHINGLE = 5
SIMILARITY = 75  # per cent
#: Shingles of a bucket. Each class costs 8 bytes in each bucket that it reaches, so larger buckets (for
#: executors with more memory) move less.
BUCKET = 2_000_000
GROUP = 2_000
#: Classes of one tree, and of one task.
TOGETHER = 512
PIVOTS = 4
SIGNATURE = 2_048
#: Bits of the root of a subtree, whose classes may have many tokens together.
ROOT = 16_384
FANOUT = 8
TABLES = "kind int, owners long, ids binary, sizes binary, counts binary, hashes binary, dfs binary, texts binary"
LIVE = "class long, n long, least long, tokens binary, prefix array<long>"
NAMES = ["kind", "owners", "ids", "sizes", "counts", "hashes", "dfs", "texts"]
ROOTS = "candidate long, chunk long, signature binary, excess long, low long, high long, most long, label long"


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = common.space_words(text.lower() if text else None)
    size = min(k, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    values = common.mixed(common.rolling(common.word_values(words, len(words)), size))
    return np.unique(values if size == k else common.mixed(values + np.uint64(size)))


def _name(own: np.ndarray) -> int | None:
    """The class of a set; None for an empty one."""
    return xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own)) - (1 << 63) if len(own) else None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    types = [pa.int32(), pa.int64()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)


def _runs(classes: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    new = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    return squeezed(classes[new], "<i8"), squeezed(sizes[new]), squeezed(np.diff(np.append(new, len(classes))))


def _blobs(buckets: common.Buckets, classes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, fine: bool):
    for bucket, own in buckets.parts(hashes, fine):
        yield _rows([(1, bucket, *_runs(classes[own], sizes[own]), packed(hashes[own]), None, None)])


def _hashed(k: int, buckets: common.Buckets):
    """kind 0: doc_id, size, class and text_hash of documents; kind 1: a bucket's shingles by class."""

    def flush(docs, sets):
        if docs:
            ids, sizes, classes, texts = zip(*docs, strict=True)
            null = np.array([i is None for i in ids])
            have = np.array([c is not None for c in classes])
            numbers = (np.array([x or 0 for x in column], "<i8").tobytes() for column in (ids, classes, texts))
            ids, classes, texts = numbers
            yield _rows([(0, len(docs) % buckets.coarse, ids, squeezed(np.array(sizes)), null.tobytes(), classes, have.tobytes(), texts)])
        if sets:
            names = sorted(sets)  # numbers in order are sent as small differences
            n = np.array([len(sets[c]) for c in names], np.int64)
            classes, sizes = np.repeat(np.array(names, np.int64), n), np.repeat(n, n)
            yield from _blobs(buckets, classes, sizes, np.concatenate([sets[c] for c in names]), buckets.per == 1)

    def run(batches):
        docs, sets, held = [], {}, 0
        for batch in batches:
            for doc, text, digest in zip(*batch.columns, strict=True):
                own = shingles(text.as_py(), k)
                name = _name(own)
                docs.append((doc.as_py(), len(own), name, digest.as_py()))
                if name is not None and name not in sets:
                    sets[name] = own
                    held += len(own)
                if held >= FLUSH or len(docs) >= 50_000:
                    yield from flush(docs, sets)
                    docs, sets, held = [], {}, 0
        yield from flush(docs, sets)

    return common.trimmed(run)


def _again(buckets: common.Buckets):
    """Deals the shingles of coarse ranges to their buckets; documents pass through."""

    def flush(parts):
        yield from _blobs(buckets, *(np.concatenate(c) for c in zip(*parts, strict=True)), True)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in NAMES), strict=True):
                kind, owner, ids, sizes, counts, hashes, *_ = row
                if kind == 0:
                    yield _rows([(0, owner * buckets.per, *row[2:])])
                    continue
                n = unsqueezed(counts)
                parts.append((np.repeat(unsqueezed(ids, "<i8"), n), np.repeat(unsqueezed(sizes), n), unpacked(hashes)))
                held += len(parts[-1][2])
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return common.trimmed(run)


def _shared(groups: int):
    def run(bucket: pa.Table) -> pa.Table:
        """Documents pass through; shingles of two classes at least go on, by group of classes."""
        out, parts = [], []
        for row in zip(*(bucket.column(n) for n in NAMES), strict=True):
            kind, owners, ids, sizes, counts, hashes, *_ = own = tuple(x.as_py() for x in row)
            if kind == 0:
                out.append(own)
            else:
                n = unsqueezed(counts)
                parts.append((np.repeat(unsqueezed(ids, "<i8"), n), np.repeat(unsqueezed(sizes), n), unpacked(hashes)))
        if parts:
            classes, sizes, hashes = (np.concatenate([p[i] for p in parts]) for i in range(3))
            parts.clear()
            order = np.argsort(hashes, kind="stable")
            same = hashes[order][1:] == hashes[order][:-1]
            member = np.zeros(len(order), bool)
            member[1:] |= same
            member[:-1] |= same
            own = order[member]
            own = own[np.lexsort((classes[own], hashes[own]))]
            new = np.ones(len(own), bool)
            new[1:] = (hashes[own][1:] != hashes[own][:-1]) | (classes[own][1:] != classes[own][:-1])
            own = own[new]  # one row for each class and hash
            if len(own):
                first = np.flatnonzero(np.concatenate([[True], hashes[own][1:] != hashes[own][:-1]]))
                df = np.diff(np.append(first, len(own)))
                df = np.repeat(df, df)
                own, df = own[df > 1], df[df > 1]
                holders = (common.mixed(classes[own].view(np.uint64)) % np.uint64(groups)).astype(np.int64)
                order = np.lexsort((hashes[own], classes[own], holders))
                own, df, holders = own[order], np.minimum(df[order], 255).astype(np.uint8), holders[order]
                cuts = np.flatnonzero(np.diff(holders, prepend=-1))
                for a, b in zip(cuts, np.append(cuts[1:], len(own)), strict=len(own) > 0):
                    part = own[a:b]
                    out.append((1, int(holders[a]), *_runs(classes[part], sizes[part]), packed(hashes[part]), df[a:b].tobytes(), None))
        table = pa.Table.from_batches([_rows(out)])
        common.trim()
        return table

    return run


def _live(per_cent: int):
    def run(owned: pa.Table) -> pa.Table:
        """Classes that may link: their shared tokens, rarest first, and their prefix."""
        parts = []
        for ids, sizes, counts, hashes, dfs in zip(*(owned.column(n).to_pylist() for n in NAMES[2:7]), strict=True):
            n = unsqueezed(counts)
            parts.append((np.repeat(unsqueezed(ids, "<i8"), n), np.repeat(unsqueezed(sizes), n), unpacked(hashes), np.frombuffer(dfs, np.uint8)))
        classes, sizes, hashes, dfs = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((hashes, dfs, classes))
        cuts = np.flatnonzero(np.concatenate([[True], classes[order][1:] != classes[order][:-1]]))
        rows = []
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            n, own = int(sizes[order[a]]), hashes[order[a:b]]
            least = -(-per_cent * n // 100)
            if len(own) >= least:
                rows.append((int(classes[order[a]]), n, int(own.min() >> np.uint64(1)), own.tobytes(), own[: len(own) - least + 1].view(np.int64)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        table = pa.table({c: pa.array(v, t) for c, v, t in zip(("class", "n", "least", "tokens", "prefix"), columns, types, strict=True)})
        del parts, classes, sizes, hashes, dfs, order, rows, columns
        common.trim()
        return table

    return run


class Forest:
    """Union-find over small numbers; the root is the smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


class Sets:
    """Token sets of a component as numbers from 0, and overlaps of one with others."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], per_cent: int):
        self.n, self.per_cent = sizes, per_cent
        self.count = np.array([len(t) for t in tokens], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        _, flat = np.unique(np.concatenate(tokens), return_inverse=True)
        self.flat, self.width = flat.astype(np.int64), int(flat.max()) + 1
        self.mark = np.zeros(self.width, bool)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others link with i."""
        mine = self.flat[self.first[i] : self.first[i + 1]]
        self.mark[mine] = True
        if len(others) == len(self.n):
            overlap = np.add.reduceat(self.mark[self.flat].astype(np.int64), self.first[:-1])
        else:
            size = self.count[others]
            start = np.cumsum(size) - size
            at = np.repeat(self.first[others] - start, size) + np.arange(int(size.sum()))
            overlap = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), start)
        self.mark[mine] = False
        return 100 * overlap >= self.per_cent * (self.n[i] + self.n[others] - overlap)


class Tree:
    """Nodes of each level, from leaves (in the given order) to a root. A node has the OR of the bitmaps below it, the
    most tokens of a leaf that fall on a bit already set, the least size, the most tokens, and the range of labels."""

    def __init__(self, signature, excess, sizes, most, low, high, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, [(signature, excess, sizes, most, low, high)]
        while len(self.levels[-1][0]) > 1:
            s, e, n, c, low, high = self.levels[-1]
            at = np.arange(0, len(s), fanout)
            self.levels.append((np.bitwise_or.reduceat(s, at), np.maximum.reduceat(e, at), np.minimum.reduceat(n, at), np.maximum.reduceat(c, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    @classmethod
    def of_sets(cls, sets: Sets, order: np.ndarray, labels: np.ndarray, bits: int = SIGNATURE) -> Tree:
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        dense = np.zeros((len(order), bits), bool)
        dense[np.repeat(where, sets.count), sets.flat % bits] = True
        signature = np.packbits(dense, axis=1).view(np.uint64)
        return cls(signature, sets.count[order] - dense.sum(1), sets.n[order], sets.count[order], labels[order], labels[order])

    def pairs(self, per_cent: int, most_pairs: int = 100_000, itself: bool = False):
        """Pairs of leaves (places in the order) that no bound rules out, some at a time; with ``itself`` also those of
        a leaf with itself. The traversal goes down from the root with itself; pairs of nodes wait in pieces, the
        deepest first, so few are held."""
        waiting = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        child = np.arange(self.fanout)
        while waiting:
            depth, a, b = waiting.pop()
            s, e, n, c, low, high = self.levels[depth]
            one = (low[a] == high[a]) & (low[a] == low[b]) & (low[b] == high[b])  # linked already
            a, b = a[~one], b[~one]
            overlap = np.bitwise_count(s[a] & s[b]).sum(1, dtype=np.int64) + np.minimum(e[a], e[b])
            overlap = np.minimum(overlap, np.minimum(c[a], c[b]))
            keep = (100 + per_cent) * overlap >= per_cent * (n[a] + n[b])
            a, b = a[keep], b[keep]
            if not depth:
                yield (a, b) if itself else (a[a != b], b[a != b])
                continue
            below, step = len(self.levels[depth - 1][0]), max(1, most_pairs // self.fanout**2)
            for k in range(0, len(a), step):
                x = np.repeat(a[k : k + step, None] * self.fanout + child, self.fanout, axis=1).ravel()
                y = np.tile(b[k : k + step, None] * self.fanout + child, self.fanout).ravel()
                real = (x < below) & (y < below) & (x <= y)
                waiting.append((depth - 1, x[real], y[real]))


def _least_token(sets: Sets) -> np.ndarray:
    """The least token of each set, after mixing: sets that share most tokens often share it."""
    return np.minimum.reduceat(sets.flat * 0x9E3779B1 % 0xFFFFFFFB, sets.first[:-1])


def _by_first(a: np.ndarray, b: np.ndarray):
    """(place, the places paired with it) of pairs."""
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    cuts = np.flatnonzero(np.diff(a, prepend=-1))
    for x, y in zip(cuts, np.append(cuts[1:], len(a)), strict=len(a) > 0):
        yield int(a[x]), b[x:y]


def forest(sizes: np.ndarray, tokens: list[np.ndarray], per_cent: int = SIMILARITY, labels: np.ndarray | None = None, found: list | None = None) -> np.ndarray:
    """The number of the first linked set, over any number of links, for each set; the dual traversal of their
    signature tree finds the links. Sets of one label (0 or more) are linked from the start. ``found`` gathers
    the number of links that joined two components."""
    sets, known = Sets(sizes, tokens, per_cent), Forest(len(sizes))
    first: dict[int, int] = {}
    for i, label in enumerate(labels.tolist() if labels is not None else ()):
        if label >= 0:
            known.join(first.setdefault(label, i), i)

    def roots() -> np.ndarray:
        return np.array([known.root(i) for i in range(len(sizes))], np.int64)

    joined, root = 0, roots()
    order = np.lexsort((sizes, _least_token(sets), root))
    for a, b in Tree.of_sets(sets, order, root).pairs(per_cent):
        a, b = order[a], order[b]
        apart = root[a] != root[b]
        for i, others in _by_first(a[apart], b[apart]):
            others = np.array([j for j in others.tolist() if known.root(j) != known.root(i)], np.int64)
            if len(others):
                for j in others[sets.linked(i, others)].tolist():
                    joined += known.root(i) != known.root(j)
                    known.join(i, j)
        root = roots()
    if found is not None:
        found.append(joined)
    return root


def link_counts(sizes: np.ndarray, tokens: list[np.ndarray], weights: np.ndarray, sides: np.ndarray | None = None, per_cent: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """How many other sets each set links with, and the sum of their weights. With ``sides``, only links
    between different sides count."""
    sets, everyone = Sets(sizes, tokens, per_cent), np.arange(len(sizes))
    # The tree drops pairs of one label: those of one side, or else each set with itself alone.
    labels = everyone if sides is None else sides.astype(np.int64)
    counts, weighed = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    least = _least_token(sets)
    order = np.lexsort((sizes, least) if sides is None else (sizes, least, labels))
    for a, b in Tree.of_sets(sets, order, labels).pairs(per_cent):
        for i, others in _by_first(order[a], order[b]):
            near = others[sets.linked(i, others)]
            counts[i] += len(near)
            weighed[i] += weights[near].sum()
            counts[near] += 1
            weighed[near] += weights[i]
    return counts, weighed


def _counted(per_cent: int):
    def run(group: pa.Table) -> pa.Table:
        """Links of one chunk's classes, or of those of two chunks with each other."""
        n, weights = (group.column(c).to_numpy().astype(np.int64) for c in ("n", "weight"))
        tokens = [np.frombuffer(t.as_py(), np.uint64) for t in group.column("tokens")]
        sides = group.column("first").to_numpy()
        counts, weighed = link_counts(n, tokens, weights, None if sides.all() else sides, per_cent)
        found = np.flatnonzero(counts)
        if len(n) > 100:
            common.trim()
        return pa.table({"class": group.column("class").take(pa.array(found)), "classes": pa.array(counts[found]), "others": pa.array(weighed[found])})

    return run


def _trees(per_cent: int):
    def run(group: pa.Table) -> pa.Table:
        names = group.column("class").to_numpy()
        _, once = np.unique(names, return_index=True)  # a subtree against itself comes once
        names = names[once]
        tokens, label = group.column("tokens"), group.column("label").fill_null(-1).to_numpy()[once]
        _, label_no = np.unique(label, return_inverse=True)
        labels = np.where(label < 0, -1, label_no)
        root = forest(group.column("n").to_numpy()[once].astype(np.int64), [np.frombuffer(tokens[int(i)].as_py(), np.uint64) for i in once], per_cent, labels)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(names[linked], pa.int64()), "b": pa.array(names[root[linked]], pa.int64())})

    return run


def _root_of(bits: int):
    def run(group: pa.Table) -> pa.Table:
        """The root of a subtree as a row."""
        tokens = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
        together, excess = np.zeros(bits, bool), 0
        for own in tokens:
            at = np.unique(own % np.uint64(bits)).astype(np.int64)
            together[at] = True
            excess = max(excess, len(own) - len(at))
        n = group.column("n").to_numpy()
        row = {"candidate": group.column("candidate")[0].as_py(), "chunk": group.column("chunk")[0].as_py(), "signature": np.packbits(together).tobytes(), "excess": excess}
        row |= {"low": int(n.min()), "high": int(n.max()), "most": max(map(len, tokens)), "label": group.column("label")[0].as_py()}
        kinds = {"signature": pa.binary()}
        return pa.table({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()})

    return run


def _meeting(per_cent: int):
    def run(roots: pa.Table) -> pa.Table:
        """Pairs of a component's subtrees that the dual traversal of their roots doesn't rule out."""
        label = roots.column("label").fill_null(-1).to_numpy()
        low, most = roots.column("low").to_numpy().astype(np.int64), roots.column("most").to_numpy().astype(np.int64)
        order = np.lexsort((roots.column("signature").to_numpy(zero_copy_only=False), low, label))
        signature = np.frombuffer(b"".join(roots.column("signature").to_pylist()), np.uint64).reshape(roots.num_rows, -1)[order]
        # An unlabelled subtree meets itself, so its labels are no single one.
        first, last = np.where(label < 0, -2, label)[order], label[order]
        tree = Tree(signature, roots.column("excess").to_numpy().astype(np.int64)[order], low[order], most[order], first, last)
        chunk, parts = roots.column("chunk").to_numpy()[order], list(tree.pairs(per_cent, itself=True))
        i, j = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        same = pa.array(np.full(len(i), roots.column("candidate")[0].as_py()), pa.int64())
        return pa.table({"candidate": same, "i": pa.array(chunk[i], pa.int64()), "j": pa.array(chunk[j], pa.int64())})

    return run


def _subtrees(spark: SparkSession, live: DataFrame, together: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """Classes (candidate, chunk, class, n, tokens, label, ...) of large components cut into subtrees of one label by size
    and least token, and the pairs (candidate, i, j) of subtrees that meet. Sizes of one band differ by less than a
    link allows; a least token that very many classes share is cut by their hashes."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / per_cent))).cast("long") if per_cent < 100 else F.col("n")
    placed = live.withColumns({"band": band, "none": F.coalesce("label", F.lit(-1).cast("long"))})
    key = ["candidate", "none", "band"]
    for part, by in (("part", F.xxhash64("least")), ("slice", F.xxhash64("class"))):
        counts = common.sent_if_small(common.written(spark, placed.groupBy(*key).agg(F.count(F.lit(1)).alias("m")), "counts"))
        placed = placed.join(counts, key).withColumn(part, F.pmod(by, F.ceil(F.col("m") * 2 / together).cast("long"))).drop("m")
        key = [*key, part]
    placed = placed.withColumn("chunk", F.xxhash64(*key)).drop("none", "band", "part", "slice", "least")
    placed = common.written(spark, placed, "subtrees")
    roots = placed.groupBy("candidate", "chunk").applyInArrow(_root_of(ROOT), ROOTS)
    return placed, roots.groupBy("candidate").applyInArrow(_meeting(per_cent), "candidate long, i long, j long")


def _contracted(batches):
    """Star edges of the forest that a partition's edges span."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    a, b = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    known = Forest(len(names))
    for i, j in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        known.join(i, j)
    root = np.array([known.root(i) for i in range(len(names))], np.int64)
    linked = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(names[linked], pa.int64()), pa.array(names[root[linked]], pa.int64())], ["a", "b"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of each node that has an edge (a, b).

    Partitions are contracted first; then each node takes the smallest root among its neighbours, and
    roots follow the roots that they had, until nothing changes."""
    edges = common.written(spark, edges.select("a", "b").mapInArrow(_contracted, "a long, b long"), "edges")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    labels = common.written(spark, labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("next"))
        after = step.join(jump, "new", "left").select("node", "root", F.least("new", F.coalesce("next", "new")).alias("new"))
        after = common.written(spark, after, "labels")
        changed = after.filter("root != new").limit(1).count()
        labels = after.select("node", F.col("new").alias("root"))
        if not changed:
            return labels


def _pivot_links(per_cent: int):
    def run(batches):
        for batch in batches:
            near = []
            for n, tokens, pivot_n, pivot in zip(*(batch.column(c) for c in ("n", "tokens", "pivot_n", "pivot_tokens")), strict=True):
                if pivot_n.as_py() is None:
                    near.append(False)
                    continue
                overlap = len(np.intersect1d(np.frombuffer(tokens.as_py(), np.uint64), np.frombuffer(pivot.as_py(), np.uint64), assume_unique=True))
                near.append(100 * overlap >= per_cent * (n.as_py() + pivot_n.as_py() - overlap))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "n", "least", "tokens", "candidate", "label", "pivot")), pa.array(near, pa.bool_())], ["class", "n", "least", "tokens", "candidate", "label", "pivot", "near"])

    return run


def _large(spark: SparkSession, live: DataFrame, together: int, per_cent: int, pivots: int) -> DataFrame:
    """Links (a, b) within candidate components that are too large for one task."""
    salts, links = 64, None
    live = live.withColumn("label", F.lit(None).cast("long"))
    for _ in range(pivots):
        free = live.filter("label IS NULL")
        chosen = free.groupBy("candidate").agg(F.min_by(F.struct("class", "n", "tokens"), F.xxhash64("class")).alias("p"))
        chosen = chosen.select("candidate", F.col("p.class").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.tokens").alias("pivot_tokens"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        joined = live.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(salts)).cast("int")).join(chosen, ["candidate", "salt"], "left")
        near = joined.mapInArrow(_pivot_links(per_cent), "class long, n long, least long, tokens binary, candidate long, label long, pivot long, near boolean")
        label = F.coalesce("label", F.when(F.col("near"), F.col("pivot")))
        # A class that is linked to two pivots links their groups.
        also = F.when(F.col("near") & F.col("label").isNotNull(), F.col("pivot"))
        live = common.written(spark, near.select("class", "n", "least", "tokens", "candidate", label.alias("label"), also.alias("also")), "pivoted")
        more = live.filter("also IS NOT NULL").select(F.col("label").alias("a"), F.col("also").alias("b")).distinct()
        links = more if links is None else links.union(more)
        live = live.drop("also")
    placed, pairs = _subtrees(spark, live, together, per_cent)
    sides = pairs.withColumn("chunk", F.explode(F.array_distinct(F.array("i", "j"))))
    tasks = placed.join(sides, ["candidate", "chunk"]).select("candidate", "i", "j", "class", "n", "tokens", "label")
    found = tasks.groupBy("candidate", "i", "j").applyInArrow(_trees(per_cent), "a long, b long")
    found = found.union(live.filter("label IS NOT NULL").select(F.col("class").alias("a"), F.col("label").alias("b")))
    return found if links is None else links.union(found)


def _candidates(spark: SparkSession, docs: DataFrame, shingle: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and class of documents; classes that may link, with their candidate component and the
    number of its classes (m)."""
    common.small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.xxhash64("text"))
    volume = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    words = (volume.bytes or 0) // 6
    buckets = common.Buckets(words, BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(volume.n // GROUP, words // GATHERED) + 1
    sent = buckets.dealt(own.mapInArrow(_hashed(shingle, buckets), TABLES), "owners", _again(buckets), TABLES)
    shared = common.written(spark, sent.groupBy("owners").applyInArrow(_shared(groups), TABLES), "shared")

    live = common.written(spark, shared.filter("kind = 1").groupBy("owners").applyInArrow(_live(per_cent), LIVE), "live")
    prefixes = live.select("class", F.explode("prefix").alias("token"))
    heads = prefixes.groupBy("token").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    stars = prefixes.join(heads, "token").filter("class != head").select(F.col("class").alias("a"), F.col("head").alias("b")).distinct()
    candidates = components(spark, stars).select(F.col("node").alias("class"), F.col("root").alias("candidate"))
    sizes = candidates.groupBy("candidate").agg(F.count(F.lit(1)).alias("m"))
    grouped = live.drop("prefix").join(candidates.join(sizes, "candidate"), "class").select("class", "n", "least", "tokens", "candidate", "m")
    return shared.filter("kind = 0").mapInArrow(_documents, "doc_id long, n_shingles long, class long, text_hash long"), common.written(spark, grouped, "grouped")


def near_duplicates(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each document."""
    return linked(spark, docs, **how).select("doc_id", "n_shingles", "component_id")


def linked(spark: SparkSession, docs: DataFrame, *, shingle: int = SHINGLE, per_cent: int = SIMILARITY, together: int = TOGETHER, pivots: int = PIVOTS) -> DataFrame:
    """``near_duplicates`` with each document's text_hash (xxhash64 of its text), and the class that names its
    component (root; null for a text without words)."""
    all_docs, grouped = _candidates(spark, docs, shingle, per_cent)
    none = F.lit(None).cast("long").alias("label")
    small = grouped.filter(F.col("m") <= together)
    links = small.select("candidate", "class", "n", "tokens", none).groupBy("candidate").applyInArrow(_trees(per_cent), "a long, b long")
    links = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    large = grouped.filter(F.col("m") > together).drop("m")
    if not large.isEmpty():
        # Written, so that no task runs two Python workers.
        links = links.union(components(spark, common.written(spark, _large(spark, large, together, per_cent, pivots), "large_links")))
    links = common.written(spark, links, "links")

    classes = all_docs.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(links.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = rooted.select("class", "root").join(ids, "root").select("class", "root", "component_id")
    result = all_docs.join(by_class, "class", "left")
    return result.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "root")


def repeated_rows(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """doc_id and text_hash of the rows that are near duplicates of another row that stays: of each component the
    row of the smallest doc_id stays (a null one only where there is no other; of rows that share the id, the one
    of the smallest text_hash)."""
    rows = common.written(spark, linked(spark, docs, **how).select("doc_id", "text_hash", "root"), "linked").filter("root IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    stays = rows.groupBy("root").agg(F.min(order).alias("s")).select("root", F.col("s.doc_id").alias("s_id"), F.col("s.text_hash").alias("s_hash"))
    stays = common.written(spark, stays, "stays")  # so that the join is one of two tables, which Spark splits where a root is common
    gone = ~(F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")))
    return rows.join(stays, "root").filter(gone).select("doc_id", "text_hash").distinct()


def clean(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """One row of each component, and each row without words; of rows with equal doc_id and text one stays. All
    columns are kept. Rows that share a doc_id are told apart by their texts."""
    names = common.fresh(docs, "_id", "_hash", "_times", "_place")
    id_, hash_, times, place = names
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), hash_: F.xxhash64("text")})
    gone = common.sent_if_small(common.written(spark, repeated_rows(spark, docs, **how), "repeated"))
    left = _without(keyed, gone, id_, hash_)
    again = keyed.groupBy(id_, hash_).agg(F.count(F.lit(1)).alias(times)).filter(F.col(times) > 1)
    again = common.sent_if_small(common.written(spark, again.select(F.col(id_).alias("doc_id"), F.col(hash_).alias("text_hash")), "again"))
    # Only rows that repeat another as it is are numbered, so no other text is dealt out.
    several = left.alias("l").join(again.alias("r"), F.col(f"l.{id_}").eqNullSafe(F.col("r.doc_id")) & (F.col(f"l.{hash_}") == F.col("r.text_hash")), "left_semi")
    one = several.withColumn(place, F.row_number().over(Window.partitionBy(id_, hash_).orderBy("text"))).filter(F.col(place) == 1).drop(place)
    return _without(left, again, id_, hash_).unionByName(one).drop(id_, hash_)


def _without(keyed: DataFrame, gone: DataFrame, id_: str, hash_: str) -> DataFrame:
    same = F.col(f"l.{id_}").eqNullSafe(F.col("r.doc_id")) & (F.col(f"l.{hash_}") == F.col("r.text_hash"))
    return keyed.alias("l").join(gone.alias("r"), same, "left_anti")


def document_links(spark: SparkSession, docs: DataFrame, *, shingle: int = SHINGLE, per_cent: int = SIMILARITY, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_shingles, class_id (the smallest doc_id with an equal set), n_classes (other classes that its
    class links with) and n_links (other documents that it links with, those of its class included)."""
    all_docs, grouped = _candidates(spark, docs, shingle, per_cent)
    classes = all_docs.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("weight"))
    classes = common.written(spark, classes, "classes")
    none = F.lit(None).cast("long").alias("label")
    placed = common.written(spark, grouped.join(classes.select("class", "weight"), "class"), "placed")
    small = placed.filter(F.col("m") <= together).select("candidate", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "class", "n", "tokens", "weight", F.lit(True).alias("first"))
    cut, pairs = _subtrees(spark, placed.filter(F.col("m") > together).select("candidate", "class", "n", "least", "tokens", "weight", none), together, per_cent)
    sides = pairs.withColumn("chunk", F.explode(F.array_distinct(F.array("i", "j"))))
    large = cut.join(sides, ["candidate", "chunk"]).select("candidate", "i", "j", "class", "n", "tokens", "weight", (F.col("chunk") == F.col("i")).alias("first"))
    found = small.unionByName(large).groupBy("candidate", "i", "j").applyInArrow(_counted(per_cent), "class long, classes long, others long")
    found = found.groupBy("class").agg(F.sum("classes").alias("classes"), F.sum("others").alias("others"))
    by_class = classes.join(found, "class", "left").select(
        "class", "class_id", F.coalesce("classes", F.lit(0)).alias("n_classes"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    result = all_docs.join(by_class, "class", "left")
    return result.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_classes", F.lit(0)).alias("n_classes"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _documents(batches):
    for batch in batches:
        for ids, sizes, null, classes, have, texts in zip(*(batch.column(n).to_pylist() for n in NAMES[2:]), strict=True):
            none, have = np.frombuffer(null, bool), np.frombuffer(have, bool)
            columns = [pa.array(np.frombuffer(ids, "<i8"), mask=none), pa.array(unsqueezed(sizes).astype(np.int64)), pa.array(np.frombuffer(classes, "<i8"), mask=~have), pa.array(np.frombuffer(texts, "<i8"))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "text_hash"])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, common.table(spark, sf_dir, "documents"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_links(spark, common.table(spark, sf_dir, "documents"))
