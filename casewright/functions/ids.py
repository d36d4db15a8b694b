"""Dense surrogate ids without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_of(order: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below or at ``order``, by halving."""
    if not cuts:
        return F.lit(0)
    return _between(order, cuts, 0, len(cuts))


def _between(order: Column, cuts: list[int], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(order < cuts[middle], _between(order, cuts, low, middle)).otherwise(
        _between(order, cuts, middle + 1, high)
    )


def id_slices(rows: DataFrame, order: str, slices: int | None = None) -> list[int]:
    """Cut points that split ``order`` (a number) into slices of about equal size.

    One small pass over the ``order`` column; the cut points come back as plain
    numbers, so every later use of them cuts the rows in the same way even
    when lost tasks are run again. Any cut points give right ids, good ones
    give even work.
    """
    if slices is None:
        slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if slices <= 1:
        return []
    cuts = rows.approxQuantile(order, [i / slices for i in range(1, slices)], 0.2 / slices)
    return sorted({int(c) for c in cuts})


def with_dense_ids(
    rows: DataFrame, order: str, name: str, after: Column, cuts: list[int]
) -> DataFrame:
    """Add ``name`` = ``after`` + 1, 2, 3, … in the order of the unique number ``order``.

    Rows are numbered inside each slice; a slice starts where the counts of
    the slices before it end. Only one row per slice is ever summed up.
    """
    sliced = rows.withColumn("_slice", slice_of(F.col(order), cuts))
    starts = (
        sliced.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_start",
            # at most one row per slice
            F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("_slice", F.coalesce("_start", F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(order))
    return (
        sliced.withColumn("_within", within)
        .join(starts, "_slice")
        .withColumn(name, after + F.col("_start") + F.col("_within"))
        .drop("_slice", "_within", "_start")
    )
