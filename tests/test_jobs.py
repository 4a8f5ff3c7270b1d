"""The jobs: two runs over growing input, runs that are repeated or tried again, and the command line."""

import json
import logging
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import pytest

from jobs import base, document_index, impact_report
from loomgraph.functions import text as X
from loomgraph.operators import bm25
from loomgraph.streaming import index
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, lang string, source string"


def words(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["cartTotal", "user_id", "the", "x", "Order", "sum2", "naïve", "HTTPServer"]) + rnd.choice(["", " 7", "\n"]) for _ in range(n))


def counted(spark, docs):
    """{(lang, term): (df, tf, idf)} of the documents' last versions, a document at a time."""
    rows = spark.createDataFrame([(i, t, lang) for i, (t, lang) in docs.items()], "id long, text string, lang string").select("id", "lang", X.tokenize(F.col("text")).alias("terms")).collect()
    n, df, tf = Counter(r.lang for r in rows), Counter(), Counter()
    for r in rows:
        for term, k in Counter(r.terms).items():
            df[r.lang, term] += 1
            tf[r.lang, term] += k
    return {k: (df[k], tf[k], round(math.log(1 + (n[k[0]] - df[k] + 0.5) / (df[k] + 0.5)), 6)) for k in df}


def of(frame):
    return {(r.lang, r.term): (r.df, r.tf, r.idf) for r in frame.collect()}


def read_rows(records):
    return [int(m[1]) for r in records if (m := re.search(r"document_index: read (\d+) new rows", r.getMessage()))]


def test_the_index_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "loomgraph.jobs")
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    first = [(k, words(k, k), ("en", "fr")[k % 2], "s") for k in range(30)] + [(40, None, "en", "s"), (41, "", None, "s"), (None, "lost words", "en", "s")]
    spark.createDataFrame(first, DOCS).coalesce(1).write.parquet(f"{tables}/documents.parquet")
    how = base.config("document_index")
    one = of(document_index.run(spark, tables, out, **how))
    known = {i: (t, lang or "und") for i, t, lang, _ in first if i is not None}
    assert one == counted(spark, known)
    again = of(document_index.run(spark, tables, out, **how))
    assert again == one and read_rows(caplog.records) == [33, 0]
    # New documents, a changed one, one that comes as it was, and one that loses its words.
    second = [(100 + k, words(200 + k, 5 + k), "en", "s") for k in range(10)] + [(3, "wholly other", "fr", "s"), (4, words(4, 4), "en", "s"), (7, None, "fr", "s")]
    spark.createDataFrame(second, DOCS).coalesce(1).write.mode("append").parquet(f"{tables}/documents.parquet")
    two = of(document_index.run(spark, tables, out, **how))
    known |= {i: (t, lang) for i, t, lang, _ in second}
    assert two == counted(spark, known) and two != one and read_rows(caplog.records)[-1] == 13
    assert spark.read.parquet(f"{out}/index/documents/batch=1").count() == 12
    # A batch that is tried again, whatever stands there already.
    index.add(spark.createDataFrame(second, DOCS).select(F.col("lang").alias("target"), F.col("doc_id").alias("id"), "text"), f"{out}/index", 1)
    assert of(document_index.run(spark, tables, out, **how)) == two
    # The stored index finds what an index that is built for the question finds.
    docs = spark.createDataFrame([(lang, i, t) for i, (t, lang) in known.items()], "target string, id long, text string")
    asked = spark.createDataFrame([("en", 1, "order of the user cart"), ("fr", 2, "other sum2 HTTPServer"), ("und", 3, "words"), ("en", 4, "")], "target string, question_id long, question string")
    found = index.search(asked, f"{out}/index", 4)
    want = bm25.search(asked, docs, 4)
    columns = ["target", "question_id", "id", "score", "rank"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect())) != []


def test_versions_of_one_batch_and_small_batches(spark, tmp_path):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    rows = [(k % 5, words(k, 6), "en", "s") for k in range(20)]
    for k in range(4):
        spark.createDataFrame(rows[5 * k : 5 * k + 5], DOCS).coalesce(1).write.mode("append").parquet(f"{tables}/documents.parquet")
    made = of(document_index.run(spark, tables, out, files_per_batch=1))
    assert len([d for d in os.listdir(f"{out}/index/documents") if d.startswith("batch=")]) == 4
    assert made in [counted(spark, {i: (rows[5 * k + i][1], "en") for i in range(5)}) for k in range(4)]
    repeated = str(tmp_path / "repeated")
    spark.createDataFrame([(1, "b b", "en", "s"), (1, "a", "en", "s"), (1, "cc", "en", "s")], DOCS).write.parquet(f"{repeated}/documents.parquet")
    assert of(document_index.run(spark, repeated, f"{out}-2", files_per_batch=9)) == counted(spark, {1: ("cc", "en")})


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    tables, rnd = str(tmp_path_factory.mktemp("shop")), random.Random(3)
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "NORTH"), (1, "2024-01-01")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(k, f"n{k}", k % 2) for k in range(4)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(k, f"c{k}", k % 4) for k in range(12)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(k, f"s{k}", k % 4) for k in range(6)]),
        "part": ("p_partkey long, p_name string", [(1, "p1")]),
        "orders": ("o_orderkey long, o_custkey long", [(k, rnd.randrange(12)) for k in range(30)]),
        "lineitem": ("l_orderkey long, l_linenumber int, l_returnflag string, l_suppkey long", [(rnd.randrange(30), k, "N", rnd.randrange(5)) for k in range(60)]),
    }
    for name, (kind, own) in rows.items():
        spark.createDataFrame(own, kind).write.parquet(f"{tables}/{name}.parquet")
    return tables, {name: own for name, (_, own) in rows.items()}


def test_the_impact_report_is_brute_force(spark, shop, tmp_path):
    tables, rows = shop
    out = str(tmp_path / "out")
    how = base.config("impact_report")
    got = [tuple(r) for r in impact_report.run(spark, tables, out, **how).collect()]
    buyer, sites = dict(rows["orders"]), defaultdict(Counter)
    for order, _, _, supplier in rows["lineitem"]:
        sites[supplier][f"C{buyer[order]}"] += 1
    up = {f"C{k}": f"N{n}" for k, _, n in rows["customer"]} | {f"S{k}": f"N{n}" for k, _, n in rows["supplier"]} | {f"N{k}": f"R{r}" for k, _, r in rows["nation"]}
    want, touched = [], {}
    for k, name, nation in rows["supplier"]:
        far, layer = {}, {f"S{k}"}
        for hop in range(1, 5):
            layer = {x for a in layer for x in [up.get(a), *(sites[int(a[1:])] if a[0] == "S" else [])] if x} - set(far)
            far |= dict.fromkeys(layer, hop)
        most = ",".join(c for c, _ in sorted(sites[k].items(), key=lambda x: (-x[1], x[0]))[:3])
        want.append((f"S{k}", name, len(sites[k]), sum(sites[k].values()), len(far), sum(x[0] == "R" for x in far), max(far.values()), most, rows["region"][nation % 2][1]))
        touched |= {(f"S{k}", x): hop for x, hop in far.items()}
    assert sorted(got) == sorted(want)
    affected = spark.read.schema(impact_report.AFFECTED).parquet(f"{out}/affected").collect()
    assert {(r.symbol, r.node): r.hop for r in affected} == touched and len(affected) == len(touched)
    assert sorted(os.listdir(f"{out}/report"))[-1] == "file=NORTH"
    assert sorted(map(tuple, impact_report.run(spark, tables, out, **how).collect())) == sorted(want)
    with pytest.raises(ValueError, match="doesn't end"):
        impact_report.run(spark, tables, f"{out}-2", **(how | {"hops": 1}))


def test_the_command_line(shop, tmp_path):
    tables, out, given = shop[0], str(tmp_path / "out"), tmp_path / "own.json"
    given.write_text(json.dumps({"callers": 1}))
    environment = os.environ | {"PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(tmp_path), "PYSPARK_SUBMIT_ARGS": f"--conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir={tmp_path}/shared pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.impact_report", tables, out, "--config", str(given)], cwd=ROOT, env=environment, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows at hop 1" in done.stderr and f"to {out}/report" in done.stderr
    given.write_text(json.dumps({"colour": 1}))
    with pytest.raises(ValueError, match="unknown parameters"):
        base.config("impact_report", str(given))
