"""Fill-in-middle and SimHash near-duplicates against brute force, on odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import fim, simhash
from test_operators import DOCS, SPACE, corpus, extra, lower

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    odd = ["<P>", "a <S", "a <S> b", "x <M > y", "<<P>", "\n\n", " a", "a ", "é <M> ü", "a b", "漢字 かな\t😀 <P >", "<" * 50, "\x00 \x01"]
    rows = corpus() + [(5000 + k, t, "en", "s", 1) for k, t in enumerate(odd)] + [(None, "no id here at all", "en", "s", 1), (7, "a second row of one id", "en", "s", 1), (7, "a second row of one id", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS), rows


def step_by_step(text):
    state, made = fim.BEGIN, []
    for byte in text:
        kind = int(fim.CLASS[byte])
        made.append(state * 6 + kind)
        state = int(fim.NEXT[state, kind])
    return made


def test_moves_are_those_of_the_automaton(monkeypatch):
    rnd = random.Random(3)
    for block in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(fim, "BLOCK", block)
        for _ in range(60):
            text = "".join(rnd.choices(["<", "P", "S", "M", ">", " ", "\n", "é", "漢", "x", "<P>"], k=rnd.randrange(0, 30))).encode()
            made = step_by_step(text)
            assert fim.counted(text).tolist() == np.bincount(np.array(made, int), minlength=30).tolist()
            units = UNIT.findall(text.decode())
            assert int(fim.counted(text)[fim.STARTS_UNIT].sum()) == len(units)
            assert int(fim.counted(text)[fim.STARTS_CODE].sum()) == len(text.decode())
            assert int(fim.counted(text)[fim.ENDS_SENTINEL].sum()) == len(re.findall(rb"<[PSM]>", text))
            for k in range(len(units) + 1):
                before = "".join(units[:k])
                assert fim.located(text, [k, len(units)]) == [(len(before.encode()), len(before)), (len(text), len(text.decode()))]
    assert (fim.AFTER[:, :] == np.array([[fim.NEXT[fim.NEXT[s, a], b] for b in range(6)] for a in range(6) for s in [fim.WORD]]).reshape(6, 6)).all()
    assert all(fim.NEXT[fim.NEXT[s, a], b] == fim.AFTER[a, b] for s in range(5) for a in range(6) for b in range(6))


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_is_brute_force(spark, docs):
    frame, rows = docs
    got = fim.transform(spark, extra(frame)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [expected(r[0], r[1]) for r in rows]
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    assert {r[2] for r in want} == {"plain", "spm", "psm"}
    back = sorted((str(r.doc_id), r.back) for r in got)
    assert back == sorted((str(r[0]), r[1] or "") for r in rows)


def test_fill_in_middle_of_rates_and_nothing(spark, docs):
    frame, rows = docs
    assert {r.form for r in fim.transform(spark, frame, rate=0).select("form").collect()} == {"plain"}
    assert {r.form for r in fim.transform(spark, frame, rate=100, suffix_first=0).select("form").collect()} == {"plain", "psm"}
    assert fim.transform(spark, spark.createDataFrame([], DOCS)).collect() == []
    text = "wörd <x " * 300_000
    made = fim.transform(spark, spark.createDataFrame([(1, text), (2, text), (3, text)], "doc_id long, text string"))
    for r in made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        assert tuple(r)[:6] == expected(r.doc_id, text) and r.back == text


def print_of(text):
    words = SPACE.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, n):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def wanted(rows):
    """(doc_id, fingerprint, component_id) by comparing all rows with all."""
    prints = [print_of(r[1]) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots, least = components(linked, len(rows)), {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[roots[i]] = min(least.get(roots[i], r[0]), r[0])
    return [(r[0], f"{prints[i]:016x}", least.get(roots[i])) for i, r in enumerate(rows)]


@pytest.mark.parametrize("unit", [1 << 16, 3])
def test_simhash_is_brute_force(spark, docs, unit, monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 50)
    frame, rows = docs
    rnd = random.Random(5)
    words = [f"k{i}" for i in range(400)]
    base = rnd.choices(words, k=350)
    near = []
    for k in range(60):  # a group of near copies, a chain of them, and far ones
        own = list(base)
        for _ in range(k % 6):
            own[rnd.randrange(len(own))] = "other"
        near.append((9000 + k, " ".join(own), "en", "s", 1))
    rows = rows + near
    frame = spark.createDataFrame(rows, DOCS)
    got = [tuple(r) for r in simhash.near_duplicates(spark, extra(frame), unit=unit).collect()]
    want = wanted(rows)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(1 for d, _, c in want if c != d) > 20


def test_simhash_of_nothing_and_nulls(spark):
    assert simhash.near_duplicates(spark, spark.createDataFrame([], DOCS)).collect() == []
    rows = [(3, None), (2, ""), (9, " \n"), (None, "a b c d"), (None, "a b c d"), (4, "x")]
    got = simhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted(rows)))


@pytest.mark.parametrize("unit", [1 << 16, 40])
def test_links_of_fingerprints_are_all_links(spark, unit, monkeypatch):
    """Random fingerprints, balls of near ones around some, and chains; anchors as grids of parts too."""
    monkeypatch.setattr(simhash, "GATHERED", 500)
    monkeypatch.setattr(simhash, "PAIRS", 1000)
    rng = np.random.default_rng(7)
    values = set(rng.integers(0, 1 << 62, 300).tolist())
    for center in rng.integers(0, 1 << 62, 6).tolist():
        for size in (1, 1, 2, 2, 2, 3):
            for _ in range(12):
                values.add(center ^ sum(1 << int(b) for b in rng.choice(64, size, replace=False)))
    at = int(rng.integers(0, 1 << 62))
    for k in range(0, 64, 2):  # a chain of steps of two bits
        at ^= 3 << k
        values.add(at)
    values = sorted(values)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    edges = simhash.links(spark, spark.createDataFrame([(v,) for v in signed], "fp long"), unit=unit).collect()
    place = {v: i for i, v in enumerate(signed)}
    assert all((values[place[r.a]] ^ values[place[r.b]]).bit_count() <= 64 for r in edges)
    want = components([(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2], len(values))
    assert components([(place[r.a], place[r.b]) for r in edges], len(values)) == want
    assert max(np.bincount(want)) >= 32


def test_the_code_covers():
    code = simhash.golay(2)
    assert (code.upto[0] == 1).all()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    row, near, home = simhash.anchors(x)
    at = dict(zip(row[home].tolist(), near[home].tolist(), strict=True))
    row, near, _ = simhash.anchors(y)
    there = set(zip(row.tolist(), near.tolist(), strict=True))
    assert len(at) == len(x) and all((i, a) in there for i, a in at.items())
