"""Relational patterns that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefer(frame: DataFrame, keys: Sequence[str], wanted: Column) -> DataFrame:
    """Soft filter: of each group the rows that are wanted, or all of them where none is. Null isn't wanted."""
    is_wanted = F.coalesce(wanted, F.lit(False))
    some = F.max(is_wanted.cast("int")).over(Window.partitionBy(*keys))
    return frame.withColumn("_some", some).filter(is_wanted | (F.col("_some") == 0)).drop("_some")


def top_k(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the physical plan limits each task's rows before the exchange."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_wins(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_k(frame, keys, order, 1, "_rank").drop("_rank")


def last_wins(frame: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each group, by an aggregate that combines before it shuffles."""
    rest = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def fill_forward(frame: DataFrame, value: str, keys: Sequence[str], order: str, alias: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.withColumn(alias, F.last(value, ignorenulls=True).over(window))
