"""The index in blocks against the exhaustive search."""

import random

from loomgraph.operators import blockmax, bm25

DOCS, ASKED, VERSIONS = "target string, id long, text string", "target string, question_id long, question string", "target string, version string"


def made(seed):
    """Documents of two targets: common words everywhere, rare ones in a few, lengths from 0 to 400 words."""
    rnd = random.Random(seed)
    words = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(1500):
        n = rnd.choice([0, 3, 3, 8, 20, 20, 60, 400])
        rows.append(("a" if i % 5 else None, i, " ".join(words[min(int(rnd.paretovariate(0.6)) - 1, 299)] for _ in range(n))))
    rows += [("a", 7, "zebra word0"), ("a", 7, None), ("a", None, "word1 word2"), ("a", 9001, "quokka word0"), ("a", 9002, "quokka word0"), ("a", 9003, None)]
    questions = [("a", q, " ".join(rnd.choice(words[:80]) for _ in range(rnd.randrange(1, 7)))) for q in range(40)]
    questions += [(None, 50, "word0 word3"), ("a", 51, "quokka"), ("a", 52, "quokka word0 word0"), ("a", 53, "nothing"), ("a", 54, None), ("gone", 55, "word0"), ("a", 56, "")]
    return rows, questions


def plain(rows, questions):
    """What the exhaustive search is given: one text an id, targets named."""
    best = {}
    for t, i, x in rows:
        if i is not None:
            key = (t or "und", i)
            best[key] = max(best.get(key, ""), x or "")
    return [(t, i, x) for (t, i), x in best.items()], [(t or "und", q, x) for t, q, x in questions]


def test_blocks_find_what_all_documents_would(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockmax, "DOCUMENTS", 8)
    rows, questions = made(4)
    docs, asked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(questions, ASKED)
    versions = spark.createDataFrame([("a", "07"), (None, "x")], VERSIONS)
    path = str(tmp_path / "index")
    blockmax.write(docs, versions, path)
    whole, named = plain(rows, questions)
    for limit in (1, 5, 10_000):
        want = bm25.search(spark.createDataFrame(named, ASKED), spark.createDataFrame(whole, DOCS), limit).collect()
        found, reads = blockmax.search(asked, versions, path, limit)
        assert sorted(map(tuple, found.select("target", "question_id", "id", "score", "rank").collect())) == sorted((r.target, r.question_id, r.id, r.score, r["rank"]) for r in want)
        counts = {(r.target, r.question_id): (r.blocks, r.read) for r in reads.collect()}
        assert set(counts) == {(r.target, r.question_id) for r in want}
        assert all(0 < read <= blocks for blocks, read in counts.values())
        if limit == 1:
            assert sum(r for _, r in counts.values()) < 0.6 * sum(b for b, _ in counts.values())
    monkeypatch.setattr(blockmax, "PUSHED", 0)
    assert blockmax.search(asked, versions, path, 5)[0].count() == sum(1 for r in bm25.search(spark.createDataFrame(named, ASKED), spark.createDataFrame(whole, DOCS), 5).collect())


def test_a_version_is_built_once_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "index")
    one, two = (spark.createDataFrame(x, VERSIONS) for x in ([("a", "1")], [("a", "2"), ("b", "1")]))
    blockmax.write(spark.createDataFrame([("a", 1, "alpha"), ("b", 2, "alpha")], DOCS), one, path)
    blockmax.write(spark.createDataFrame([("a", 5, "alpha")], DOCS), one, path)
    blockmax.write(spark.createDataFrame([("a", 8, "alpha"), ("b", 9, "alpha")], DOCS), two, path)
    asked = spark.createDataFrame([("a", 1, "alpha"), ("b", 2, "alpha")], ASKED)
    assert [r.id for r in blockmax.search(asked, one, path)[0].collect()] == [1]
    assert sorted(r.id for r in blockmax.search(asked, two, path)[0].collect()) == [8, 9]


def test_empty_tables(spark, tmp_path):
    versions = spark.createDataFrame([("a", "1")], VERSIONS)
    asked = spark.createDataFrame([("a", 1, "alpha")], ASKED)
    assert blockmax.search(asked, versions, str(tmp_path / "none"))[0].count() == 0
    blockmax.write(spark.createDataFrame([], DOCS), versions, str(tmp_path / "empty"))
    found, reads = blockmax.search(asked, versions, str(tmp_path / "empty"))
    assert found.count() == 0 and reads.count() == 0
    assert blockmax.search(spark.createDataFrame([], ASKED), versions, str(tmp_path / "empty"))[0].count() == 0
