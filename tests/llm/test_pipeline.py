"""The corpus pipeline, stage by stage against brute force on its own inputs, and the registered queries."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, PLAIN, components, kept_words, labelled, lower

import __spark_entry__
import corpus_pipeline
from loomgraph.llm import toxicity

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small folder of documents, labels and benchmark items with toxic texts, copies, passages and nulls."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(21)
    rows, labels = labelled(600, 22)
    passage = " ".join(f"p{i}" for i in range(60))
    item = " ".join(f"q{i}" for i in range(30))
    for i in range(40):
        own = [f"x{rnd.randrange(500)}" for _ in range(70)]
        rows.append((2000 + i, " ".join(own + passage.split() if i % 3 == 0 else own), "en", "s", 1))
    for i in range(10):
        rows.append((3000 + i, rows[600 + i][1] + " tail", "en", "s", 1))
        rows.append((3100 + i, rows[600 + i][1], "en", "s", 1))
    rows += [(4000, f"start {item} end", "en", "s", 1), (4001, None, None, None, None), (4002, "", "en", "s", 0), (4003, "one", "en", "s", 3)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}

    clean = STAGES["toxicity"](spark, docs, tables)
    assert clean.columns == docs.columns
    machine = toxicity.learn(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    judged = {r.doc_id: r.predicted for r in toxicity.score(spark, docs, machine).collect()}
    texts = {r.doc_id: r for r in clean.collect()}
    assert set(texts) == {d for d, p in judged.items() if not p} and len(texts) < len(before)
    assert all(texts[d] == before[d] for d in texts)

    single = STAGES["near_duplicates"](spark, clean, tables)
    assert single.columns == docs.columns
    want = components({d: r.text for d, r in texts.items()})
    left = {r.doc_id: r for r in single.collect()}
    assert set(left) == {d for d, (_, c) in want.items() if c == d}

    cut = STAGES["substring_dedup"](spark, single, tables)
    assert cut.columns == docs.columns
    kept = {r.doc_id: r for r in cut.collect()}
    brute = kept_words({d: r.text for d, r in left.items()}, 20)
    assert set(kept) == set(left)
    for d, (_, gone, text) in brute.items():
        assert kept[d].text == (text if gone else left[d].text)
        assert kept[d].n_chars == (len(text) if gone else left[d].n_chars)
    assert any(gone for _, gone, _ in brute.values())

    decontaminated = STAGES["decontamination"](spark, cut, tables)
    assert decontaminated.columns == docs.columns
    assert set(kept) - {r.doc_id for r in decontaminated.collect()} == {4000}


def test_run_packs_what_is_left(spark, tables):
    pytest.importorskip("public_tokenizers")
    got = corpus_pipeline.run(spark, tables).collect()
    ids = {r.doc_id for r in got}
    assert 4000 not in ids and 3105 not in ids and 4001 in ids
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(got[0].asDict())


def test_repeated_rows_keep_one(spark, tables):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 1)] * 2 + [(1, "other words of the same id here", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1)], DOCS)
    got = STAGES["near_duplicates"](spark, docs, tables).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a b c d e f g"), (1, "other words of the same id here")]


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, tables):
    base = [f"b{i}" for i in range(60)]
    a, near, third = " ".join(base), " ".join([*base[:59], "c"]), " ".join([*base[:58], "d", "e"])
    rows = [(1, a), (2, near), (2, "words of its own that no other row has at all"), (3, "x1 x2 x3 x4 x5 x6"), (3, "X1 x2 x3 x4 x5 x6"), (4, None), (4, ""), (4, "")]
    rows += [(5, " ".join(f"f{i}" for i in range(60))), (5, " ".join([*(f"f{i}" for i in range(59)), "g"]))]
    rows += [(None, third), (None, "some text without any id of its own"), (None, "some text without any id of its own"), (6, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = STAGES["near_duplicates"](spark, docs, tables)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    five = [t for i, t in left if i == 5]
    assert len(five) == 1 and (5, five[0]) in rows
    three = [t for i, t in left if i == 3]
    assert len(three) == 1 and lower(three[0]) == "x1 x2 x3 x4 x5 x6"
    want = [(1, a), (2, rows[2][1]), (3, three[0]), (4, None), (4, ""), (5, five[0]), (None, rows[11][1])]
    assert sorted(left, key=str) == sorted(want, key=str)


def test_copies_of_another_id_go_whatever_rows_share_an_id(spark, tables):
    text, other = "t1 t2 t3 t4 t5 t6 t7", "o1 o2 o3 o4 o5 o6 o7"
    rows = [(0, text), (1, other), (1, text), (None, text), (None, "lonely words without an id of their own")]
    got = STAGES["near_duplicates"](spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), tables).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)


CLASHING = ("kept", "n_words", "n_removed", "_id", "_kept", "_key", "_starts", "_hash", "_times", "_place", "class", "root", "text_hash", "contaminated", "l", "d")


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_tables(spark, tables, name):
    """No rows; columns whose names the stages use; repeated rows, null ids, null, empty and very long texts."""
    stage = STAGES[name]
    long_ = " ".join(f"l{i % 7000}" for i in range(60_000))
    rows = [(1, "a b c d e f g h")] * 3 + [(None, "n1 n2 n3 n4 n5 n6"), (None, None), (2, None), (2, ""), (3, long_), (4, "\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    if name == "packing":
        pytest.importorskip("public_tokenizers")
        assert stage(spark, docs.filter("false"), tables).count() == 0
        pieces = stage(spark, docs, tables).collect()
        assert sum(r.start == 0 for r in pieces) == len(rows)
        return
    none = stage(spark, docs.filter("false"), tables)
    assert none.columns == docs.columns and none.count() == 0
    got = stage(spark, docs, tables)
    assert got.columns == docs.columns
    got = got.collect()
    assert all(r[c] == f"own {c}" for r in got for c in CLASHING)
    want = [r for k, r in enumerate(rows) if name != "near_duplicates" or k not in (1, 2)]
    if name == "substring_dedup":
        cut = kept_words({3: long_}, 20)[3][2]
        want = [(i, cut if t == long_ else t) for i, t in want]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_registered_queries():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert len(STAGES) == 5 and lower("ÀB") == "Àb" and PLAIN.findall("a,b") == ["a", "b"]
