"""Each query of the library's catalogue against its SQL, and the entry module without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from loomgraph.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_is_its_sql(spark, duck, name):
    frame = catalogue.queries()[name](spark, DATA)
    rows, names = frame.collect(), sorted(frame.columns)
    sql = catalogue.oracle_sql().get(name)
    if not sql:
        assert rows
        return
    want = duck.sql(sql)
    assert names == sorted(want.columns)
    order = [want.columns.index(c) for c in names]
    assert ordered(tuple(r[c] for c in names) for r in rows) == ordered(tuple(r[i] for i in order) for r in want.fetchall())


def test_the_guard_bites_at_twelve_hops(spark, tmp_path):
    rows = [(1, turn) for turn in range(20)] + [(2, 0), (2, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.id: r.qualified for r in catalogue.queries()["parent_chain_guard12"](spark, str(tmp_path)).collect()}
    assert got == {f"{c}:{t}": ".".join(f"m{i}" for i in range(max(0, t - 11), t + 1)) for c, t in rows}


def test_retrieval_takes_every_layer(spark):
    least = {}
    for r in spark.read.parquet(f"{DATA}/customer.parquet").collect():
        least[r.c_nationkey] = min(least.get(r.c_nationkey, r.c_custkey), r.c_custkey)
    rows = {r.question_id: r for r in catalogue.queries()["retrieve_layers"](spark, DATA).collect()}
    assert set(rows) == set(least)
    layers = ["qualified", "qualified-miss", "named-symbol-miss", "exact", "lexical", "none"]
    assert {k: r.strategy for k, r in rows.items()} == {k: layers[k % 6] for k in least}
    for k, r in rows.items():
        if k % 6 in (0, 3):
            assert set(r.ids.split(",")) == {f"C{least[k]}"} | ({f"N{k}"} if k % 6 else set())
        assert k % 6 != 4 or r.ids.startswith(f"N{k},")
        assert (r.reason is None) == (k % 6 in (0, 3, 4)) == (r.ids is not None)
    assert all(f"`Nation{k}`" in r.reason and f"Nation{k}" in r.suggestions.split(",") for k, r in rows.items() if k % 6 == 1)


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["item_id", "doc_id", "score", "rank"] and frame.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["loomgraph/llm", "tests/llm"], ["loomgraph/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for path in gone:
        shutil.rmtree(copy / path, ignore_errors=True)
        (copy / path).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') or x == 'pipeline' for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True, timeout=120)
