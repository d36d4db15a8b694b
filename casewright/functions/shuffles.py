"""Keeping joins with a hot key splittable at run time.

Adaptive execution cuts the rows of a hot join key into several tasks, but
only where both sides of the join come straight out of a shuffle. A side that
was just aggregated by the join key keeps that partitioning and skips the
shuffle; then a single task gets every row of the hot key from the other side.

Grouping by a struct of the key avoids this: the aggregate is partitioned by
the struct, so a join on its fields shuffles the aggregated side once more.
That side has one row per key, so the extra shuffle is the small one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions that a shuffle of a large step starts with; adaptive execution joins small ones.
FINE = 1024
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@contextmanager
def fine_shuffles(spark: SparkSession) -> Iterator[None]:
    """Steps stored in here start with `FINE` shuffle partitions at least, whatever the session's number is.

    A task then sorts or hashes up to the advisory size of a partition, not a fixed share of the input. Adaptive
    execution still joins small partitions and cuts those of a hot key. The session's setting is back afterwards.
    """
    before = spark.conf.get(INITIAL, None)
    least = int(before or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(INITIAL, str(max(FINE, least)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(INITIAL)
        else:
            spark.conf.set(INITIAL, before)


def grouped_apart(df: DataFrame, keys: tuple[str, ...], *aggregates: Column) -> DataFrame:
    """``df.groupBy(*keys).agg(*aggregates)``, ready to be joined by ``keys`` to a skewed side."""
    grouped = df.groupBy(F.struct(*keys).alias("_group")).agg(*aggregates)
    return grouped.select("_group.*", *[c for c in grouped.columns if c != "_group"])


def distinct_apart(df: DataFrame, *keys: str) -> DataFrame:
    """``df.select(*keys).distinct()``, ready to be joined by ``keys`` to a skewed side."""
    return df.select(F.struct(*keys).alias("_group")).distinct().select("_group.*")
