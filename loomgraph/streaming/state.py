"""State over streams: the standing version of each file, and sessions of events. Both know when a row is too late by a
watermark, drop it then, and count it; both free the state that no row can change any more."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
CHANGES = "target string, path string, modified timestamp, hash string, deleted boolean, change string"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that ``versions`` needs, for queries that start within; the session's own setting comes back."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, was)


class _Versions(StatefulProcessor):
    """Keeps a file's newest version. Files have few versions a batch, so they come as rows: a frame for each file costs far
    more than what is done with it. A deletion is kept until the watermark has passed it: an older version that
    arrives before is known to be gone, and one that arrives after is too late anyhow."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "modified long, deleted boolean, hash string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = self.last.get()
        best = (was[0], was[1], was[2] or "") if was else None
        newest = max((*([best] if best else []), *((r.micros, r.deleted, r.hash) for r in rows)))
        if newest == best:
            return
        self.last.update(newest)
        there = best is not None and not best[1]
        if newest[1]:
            self.handle.registerTimer(newest[0] // 1000)
        if newest[1] and not there:
            return
        change = "removed" if newest[1] else "added" if not there else "changed" if newest[2] != best[2] else None
        if change:
            yield Row(target=key[0], path=key[1], modified=EPOCH + timedelta(microseconds=newest[0]), hash=None if newest[1] else newest[2], deleted=newest[1], change=change)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if (last := self.last.get()) and last[1] and last[0] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def versions(files: DataFrame, delay: str) -> DataFrame:
    """Changes (target, path, modified, hash, deleted, change) of files from a stream of their versions (target, path, modified,
    hash, deleted), in any order: ``added``, ``changed`` where the hash is another, ``removed``. Of each file and batch there is
    one row at most, which says what the newest version changes; older ones that come later change nothing. Of versions
    of one time a deletion comes last, then the greatest hash. A file that comes back after a deletion is added.

    Rows that are more than ``delay`` behind the newest one of the batches before are dropped (``late`` counts them). Null targets are
    ``und``, null hashes empty, null deletions false; rows without a path or a time are left out. To be started under ``state_store``."""
    own = files.filter("path IS NOT NULL AND modified IS NOT NULL").withWatermark("modified", delay)
    own = own.select(
        F.coalesce("target", F.lit("und")).alias("target"), "path", "modified", F.unix_micros("modified").alias("micros"),
        F.coalesce("hash", F.lit("")).alias("hash"), F.coalesce("deleted", F.lit(False)).alias("deleted"),
    )
    return own.groupBy("target", "path").transformWithState(_Versions(), CHANGES, "Update", "EventTime")


def standing(changes: DataFrame) -> DataFrame:
    """(target, path, modified, hash) of the files that stand after all changes (with ``batch``, the number of their batch)."""
    last = changes.groupBy("target", "path").agg(F.max_by(F.struct("modified", "hash", "deleted"), "batch").alias("_last"))
    return last.filter("NOT _last.deleted").select("target", "path", "_last.modified", "_last.hash")


def sessions(events: DataFrame, keys: Sequence[str], time: str, gap: str, delay: str, aggregates: Sequence[Column]) -> DataFrame:
    """(keys, start, end, aggregates) of runs of events that are ``gap`` apart at most; ``end`` is ``gap`` after the last one.

    On a stream a session is written once, when the watermark (``delay`` behind the newest event) has passed its end; an event
    that arrives later than that is dropped. On a table all sessions are there. Events without a time are left out; a null key is
    a key."""
    own = events.filter(F.col(time).isNotNull()).withWatermark(time, delay)
    made = own.groupBy(*keys, F.session_window(time, gap).alias("_session")).agg(*aggregates)
    rest = [c for c in made.columns if c not in (*keys, "_session")]
    return made.select(*keys, F.col("_session.start").alias("start"), F.col("_session.end").alias("end"), *rest)


def follow(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what a stream gives to a table, each batch under its number, until all that is there is read. A batch that is
    tried again overwrites what it had written."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()


def written(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What ``follow`` wrote, with the number of each row's batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(out.rstrip("/"))


def late(query: StreamingQuery) -> int:
    """Rows that the batches of a run dropped since they were too late, of as many batches as the session remembers
    (spark.sql.streaming.numRecentProgressUpdates)."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
