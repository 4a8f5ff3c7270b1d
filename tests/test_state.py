"""Versions and sessions of replayed batches against the answer over all rows; late rows are counted."""

import datetime
import random

from pyspark.sql import functions as F

from loomgraph.streaming import state

FILES = "target string, path string, modified timestamp, hash string, deleted boolean"
EVENTS = "user long, ts timestamp, value long"
T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def drained(query):
    query.awaitTermination()
    return state.late(query)


def test_versions_of_batches_are_those_of_all(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", None]), f"f{rnd.randrange(9)}", at(rnd.randrange(200)), rnd.choice(["x", "y", "z", None]), rnd.random() < 0.25) for _ in range(160)]
    rows += [("a", None, at(3), "x", False), ("a", "f0", None, "x", False)]
    batches = [rows[k : k + 27] for k in range(0, len(rows), 27)]
    path, out, point = (str(tmp_path / n) for n in ("files", "out", "checkpoint"))
    late = 0
    with state.state_store(spark):
        for batch in batches:
            spark.createDataFrame(batch, FILES).coalesce(1).write.mode("append").parquet(path)
            late += drained(state.follow(state.versions(spark.readStream.schema(FILES).parquet(path), "1 day"), out, point, "update"))
    changes = state.written(spark, out, state.CHANGES)
    newest = {}
    for t, p, m, h, d in rows:
        if p and m:
            key = (t or "und", p)
            newest[key] = max(newest.get(key, (at(-1), False, "")), (m, d, h or ""))
    # An equal text under a newer time is no change, so times are those of the last change.
    assert {(r.target, r.path, r.hash) for r in state.standing(changes).collect()} == {(*k, v[2]) for k, v in newest.items() if not v[1]}
    assert late == 0 and {r.change for r in changes.select("change").collect()} == {"added", "changed", "removed"}
    assert changes.groupBy("target", "path", "batch").count().filter("count > 1").count() == 0


def test_deleted_files_stay_deleted_and_late_versions_are_counted(spark, tmp_path):
    steps = [
        [("a", "f", at(0), "x", False), ("a", "g", at(0), "x", False)],
        [("a", "f", at(50), None, True)],
        [("a", "f", at(45), "old", False)],  # in time, older than the deletion
        [("a", "g", at(200), "y", False)],
        [("a", "f", at(40), "older", False), ("a", "h", at(30), "x", False)],  # the watermark has passed both
        [("a", "f", at(300), "new", False), ("a", "g", at(300), "y", False)],
    ]
    path, out, point = (str(tmp_path / n) for n in ("files", "out", "checkpoint"))
    late = []
    with state.state_store(spark):
        for batch in steps:
            spark.createDataFrame(batch, FILES).coalesce(1).write.mode("append").parquet(path)
            late.append(drained(state.follow(state.versions(spark.readStream.schema(FILES).parquet(path), "10 minutes"), out, point, "update")))
    got = [(r.path, r.hash, r.change) for r in state.written(spark, out, state.CHANGES).orderBy("batch", "path").collect()]
    assert got == [("f", "x", "added"), ("g", "x", "added"), ("f", None, "removed"), ("g", "y", "changed"), ("f", "new", "added")]
    assert late == [0, 0, 0, 0, 2, 0]
    assert spark.conf.get(state.PROVIDER) != state.ROCKS


def test_sessions_of_batches_are_those_of_all(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(rnd.choice([1, 2, None]), at(20 * k + rnd.randrange(40)), rnd.randrange(9)) for k in range(120)]
    path, out, point = (str(tmp_path / n) for n in ("events", "out", "checkpoint"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    late = []
    for batch in (rows[:50], rows[50:90], rows[90:], [(1, at(60), 1), (7, at(10_000), 1)]):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(path)
        late.append(drained(state.follow(state.sessions(spark.readStream.schema(EVENTS).parquet(path), ["user"], "ts", "30 minutes", "1 hour", sums), out, point)))
    got = state.written(spark, out, "user long, start timestamp, end timestamp, n long, total long").drop("batch")
    whole = state.sessions(spark.createDataFrame(rows, EVENTS), ["user"], "ts", "30 minutes", "1 hour", sums)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert late == [0, 0, 0, 1]
    ordered = sorted(rows, key=lambda r: (str(r[0]), r[1]))
    starts = sum(1 for a, b in zip([None, *ordered], ordered) if a is None or a[0] != b[0] or b[1] - a[1] > datetime.timedelta(minutes=30))
    assert whole.count() == starts


def test_versions_of_a_file_are_rows_not_frames():
    """a file's versions come and its change goes as rows, with no frame for each file."""
    from pyspark.sql import Row

    kept, timers = {}, []

    class Value:
        def get(self):
            return kept.get("last")

        def update(self, value):
            kept["last"] = value

    own = state._Versions()
    own.last, own.handle = Value(), type("Handle", (), {"registerTimer": lambda self, at: timers.append(at)})()

    def told(*versions):
        rows = iter([Row(micros=m, deleted=d, hash=h) for m, d, h in versions])
        return [(r.change, r.hash, r.modified, r.deleted) for r in own.handleInputRows(("a", "f"), rows, None)]

    def utc(micros):
        return datetime.datetime.fromtimestamp(0, datetime.UTC) + datetime.timedelta(microseconds=micros)

    assert told((5000, False, "x"), (7001, False, "y"), (7001, False, "b")) == [("added", "y", utc(7001), False)]
    assert told((6000, False, "z")) == [] and told((9000, True, "y")) == [("removed", None, utc(9000), True)]
    assert timers == [9] and kept["last"] == (9000, True, "y")
