"""Ranks, running sums and look-backs over groups of any size.

A window over a whole group puts that group into one task. Here the rows are
first cut into even slices by a range partitioning on (group, order); a window
then runs inside each slice of a group, and what earlier slices contribute is
added from a summary with one row per (group, slice). The slice number is
stored with the rows (``settled``), so both reads see the same cut even when an
executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termindex.session import settled

SLICE = "_slice"


def cut(df: DataFrame, group: Sequence[str], order: Sequence[str],
        slices: int | None = None) -> DataFrame:
    """Cut rows into even slices of the (group, order) sequence; equal keys stay together.

    Without a number there are as many slices as shuffle partitions, less what
    adaptive execution merges: it joins neighbours only, which keeps the order.
    """
    ranged = (df.repartitionByRange(slices, *group, *order) if slices
              else df.repartitionByRange(*group, *order))
    return settled(ranged.withColumn(SLICE, F.spark_partition_id()))


def _inside(group: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*group, SLICE).orderBy(*order)


def _earlier(group: Sequence[str]):
    # One row per (group, slice): small, whatever the data.
    return (Window.partitionBy(*(group or [F.lit(0)])).orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str],
           name: str = "rank", slices: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in its group; (group, order) must be unique."""
    return running_sum(cut(df, group, order, slices), group, order, F.lit(1), name).drop(SLICE)


def _with_earlier_slices(rows: DataFrame, group: list[str], end: Column, carried: Column) -> DataFrame:
    """Add ``_before``: ``carried`` over the ``_end`` of the same group in all earlier slices, null if there is none.

    Only the first group of a slice can have begun in an earlier one, so the carried values are at most one
    row per slice, and the rows themselves stay where they are. A null group is a group.
    """
    before = (
        rows.groupBy(*group, SLICE).agg(end.alias("_end"))
        .withColumn("_before", carried.over(_earlier(group))).filter("_before IS NOT NULL")
        .select(*[F.col(c).alias(f"_{c}_") for c in group], F.col(SLICE).alias("_later"), "_before")
    )
    same = F.col(SLICE) == F.col("_later")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return rows.join(F.broadcast(before), same, "left").drop("_later", *[f"_{c}_" for c in group])


def running_sum(sliced: DataFrame, group: Sequence[str], order: Sequence[str],
                value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` from the start of the group to the row itself."""
    group = list(group)
    inside = _inside(group, order).rowsBetween(Window.unboundedPreceding, 0)
    marked = sliced.withColumn("_value", value).withColumn("_local", F.sum("_value").over(inside))
    return (
        _with_earlier_slices(marked, group, F.sum("_value"), F.sum("_end"))
        .withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop("_local", "_before", "_value")
    )


def running_last(sliced: DataFrame, group: Sequence[str], order: Sequence[str],
                 value: Column, name: str, with_current: bool) -> DataFrame:
    """Add the last non-null ``value`` up to the row (or before it)."""
    group = list(group)
    inside = _inside(group, order).rowsBetween(Window.unboundedPreceding, 0 if with_current else -1)
    marked = sliced.withColumn("_value", value).withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    position = F.when(F.col("_value").isNotNull(), F.struct(*[F.col(c) for c in order]))
    return (
        _with_earlier_slices(marked, group, F.max_by("_value", position), F.last("_end", ignorenulls=True))
        .withColumn(name, F.coalesce("_local", "_before"))
        .drop("_local", "_before", "_value")
    )


def running_max(sliced: DataFrame, group: Sequence[str], order: Sequence[str],
                value: Column, name: str) -> DataFrame:
    """Add the largest non-null ``value`` from the start of the group to the row itself."""
    group = list(group)
    inside = _inside(group, order).rowsBetween(Window.unboundedPreceding, 0)
    marked = sliced.withColumn("_value", value).withColumn("_local", F.max("_value").over(inside))
    return (
        _with_earlier_slices(marked, group, F.max("_value"), F.max("_end"))
        .withColumn(name, F.greatest("_local", "_before"))
        .drop("_local", "_before", "_value")
    )


def spread_copies(counted: DataFrame, count: str, size: int = 65536) -> DataFrame:
    """Turn (row, count) back into ``count`` equal rows, a bounded number per task step.

    Adds ``copy`` (0-based). A row with very many copies is split into parts of
    at most ``size`` that are redistributed before they are written out.
    """
    keys = [c for c in counted.columns if c != count]
    parts = counted.select(
        *keys, count,
        F.explode(F.expr(f"sequence(0L, (CAST(`{count}` AS bigint) - 1) div {size})")).alias("_part"))
    parts = parts.repartition(*keys, "_part")
    last = F.least(F.col(count).cast("bigint") - 1, (F.col("_part") + 1) * size - 1)
    return parts.select(*keys, F.explode(F.sequence(F.col("_part") * size, last)).alias("copy"))
