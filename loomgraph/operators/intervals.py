"""Joins on order: places to the innermost range around them, and rows to the last state before them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels of nested bins: numbers below 2**LEVELS.
LEVELS = 31
#: Rows of a key from which on it is cut by time, and rows of a part.
ROWS = 1_000_000
SENT = 100_000


def _stored(frame: DataFrame, keep, name: str) -> DataFrame:
    from ..plans.build import stored

    return keep(frame, name) if keep else stored(frame.sparkSession, frame, name)


def bins(start, end):
    """The fewest bins (level, number) that make up a range of whole numbers, ends included: at each level at most one at
    either side, so some 2 * log2 of its length. A bin of level k holds 2**k numbers, from number * 2**k on."""

    def of(k):
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, high = F.ceil(start / width), F.floor((end + 1) / width)
        odd = F.pmod(low, F.lit(2)) == 1
        left = F.when(odd & (low < high), low)
        after = low + odd.cast("long")
        right = F.when((F.pmod(high, F.lit(2)) == 1) & (after < high), high - 1)
        return F.transform(F.filter(F.array(left, right), lambda x: x.isNotNull()), lambda x: F.struct(k.alias("level"), x.alias("bin")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of))


def innermost(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str = "line", start: str = "line_start", end: str = "line_end", id_: str = "id") -> DataFrame:
    """Points with ``id_`` of the smallest range (keys, start, end, id_) around them (start <= at <= end), of equally small
    ones the last to start, then the smallest id; null where there is none. Numbers are whole, not negative and below 2**31;
    ranges that end before they start, and nulls, hold nothing. Points of one place are looked up once.

    Ranges are cut into nested bins and a place is in one bin of each level, so both meet in an equi-join. Of a bin's ranges only the
    best goes there, so a place meets a row a level at most, however many ranges hold it."""
    keys = list(keys)
    usable = ranges.select(*keys, F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end"), F.col(id_).alias("_id"))
    usable = usable.filter(f"_start >= 0 AND _end >= _start AND _end < {1 << LEVELS}")
    cut = usable.withColumn("_bin", F.explode(bins(F.col("_start"), F.col("_end")))).select(*keys, "_bin.level", "_bin.bin", "_start", "_end", "_id")
    # All places in a bin see the same ranges of it, so its best one stands for them.
    cut = cut.groupBy(*keys, "level", "bin").agg(F.min(F.struct((F.col("_end") - F.col("_start")).alias("size"), (-F.col("_start")).alias("late"), "_id")).alias("_best"))
    places = points.select(*keys, F.col(at).cast("long").alias("_at")).filter("_at >= 0").distinct()
    levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.floor(F.col("_at") / F.call_function("shiftleft", F.lit(1).cast("long"), k)).alias("bin")))
    met = places.withColumn("_bin", F.explode(levels)).select(*keys, "_at", "_bin.level", "_bin.bin").join(cut, [*keys, "level", "bin"])
    best = met.groupBy(*keys, "_at").agg(F.min("_best").alias("_best"))
    found = best.select(*keys, "_at", F.col("_best._id").alias(id_))
    return points.withColumn("_at", F.col(at).cast("long")).join(found, [*keys, "_at"], "left").drop("_at")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, order: str, *, rows: int = ROWS, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Rows of left (keys, time, ...) with the other columns of the last row of right (keys, time, order, ...) that isn't later
    than them: of those at one time the one with the greatest ``order``. Nulls where there is none, or where a key or the
    time is null. Names that both have beside keys and time are an error.

    Both sides are sorted together and each row takes the last state before it. A key of more than ``rows`` rows is cut at
    quantiles of its times; each part hands on its last state, so that no part needs more of the others than one row."""
    keys = list(keys)
    given = [c for c in right.columns if c not in (*keys, time)]
    if both := sorted({c.lower() for c in given} & {c.lower() for c in left.columns}):
        raise ValueError(f"columns of both sides: {', '.join(both)}")
    whole, state = F.array(*(F.col(k).isNotNull() for k in [*keys, time])), F.struct(F.col(time).alias("_time"), F.col(order).alias("_order"), F.struct(*given).alias("_row"))
    known = F.forall(whole, lambda x: x)
    rights = right.filter(known).groupBy(*keys, time).agg(F.max_by(state, order).alias("_state"))
    rest = [c for c in left.columns if c not in (*keys, time)]
    lefts = left.filter(known).select(*keys, time, F.struct(*rest).alias("_left") if rest else F.lit(None).alias("_left"), F.lit(True).alias("_asks"))
    lefts = lefts.withColumn("_state", F.lit(None).cast(rights.schema["_state"].dataType))
    all_ = lefts.unionByName(rights.withColumns({"_asks": F.lit(False), "_left": F.lit(None).cast(lefts.schema["_left"].dataType)}))
    all_, part = _cut(all_, keys, time, rows, keep)
    window = Window.partitionBy(*keys, "_part").orderBy(time, "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = all_.withColumn("_last", F.last("_state", ignorenulls=True).over(window))
    if part is not None:
        ends = all_.filter("_state IS NOT NULL").groupBy(*keys, "_part").agg(F.max_by("_state", time).alias("_end"))
        # A row a part: each takes the last end of those before it.
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = all_.select(*keys, "_part").distinct().join(ends, [*keys, "_part"], "left").withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
        held = held.join(parts, [*keys, "_part"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    columns = [F.col(f"_left.{c}").alias(c) for c in rest]
    found = held.filter("_asks").select(*keys, time, *columns, *(F.col(f"_last._row.{c}").alias(c) for c in given))
    none = left.filter(~known).select(*keys, time, *rest, *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in given))
    return found.unionByName(none)


def _cut(all_: DataFrame, keys: list[str], time: str, rows: int, keep) -> tuple[DataFrame, DataFrame | None]:
    """Rows with their part (0 where a key is whole), and the cuts (keys, cuts), or None where no key has any."""
    many = all_.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows)
    many = _stored(many, keep, "as-of-keys")
    n = many.count()
    if not n:
        return all_.withColumn("_part", F.lit(0)), None
    many = F.broadcast(many) if n <= SENT else many
    # Times as numbers, so that quantiles are times that occur.
    number = F.unix_micros(time) if dict(all_.dtypes)[time] == "timestamp" else F.col(time)
    most = int(many.agg(F.max("n").alias("n")).first().n // rows) + 1
    shares = F.array(*(F.lit(k / most) for k in range(1, most)))
    cuts = all_.join(many.select(*keys), keys, "left_semi").withColumn("_number", number).groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_number", shares, F.lit(10_000))).alias("_cuts"))
    cuts = _stored(cuts, keep, "as-of-cuts")
    placed = all_.withColumn("_number", number).join(F.broadcast(cuts) if n <= SENT else cuts, keys, "left")
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_number"))), F.lit(0))
    return placed.withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_number", "_cuts"), cuts
