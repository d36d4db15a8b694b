"""Full exports of all tables and the way back."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.schema import TABLES
from casewright.sources.shared import shared_dir, stored
from casewright.sources.tables import load

__all__ = ["restore", "shared_dir", "snapshot", "snapshot_path", "stored"]

#: Buckets of a table by its key, the unit of a snapshot of changes.
BUCKETS = 64
#: Bits of the lower half of a digest's number.
HALF = 30
DIGESTS = "table_name string, bucket bigint, n bigint, low string, high string, held_in string"


class Damaged(RuntimeError):
    """Files of a snapshot do not hold what its digests say."""


def snapshot_path(base: str, as_of: dt.datetime) -> str:
    return f"{base}_{as_of:%Y%m%d}"


def snapshot(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write every table under ``path``, replacing an earlier snapshot there."""
    for name, table in TABLES.items():
        tables[name].select([c.name for c in table.columns]).write.mode("overwrite").parquet(
            f"{path}/{name}"
        )


def restore(spark: SparkSession, path: str, target: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot; with ``target``, they replace the tables there."""
    tables = load(spark, path)
    if target is None:
        return tables
    snapshot(tables, target)
    return load(spark, target)


def _bucket(key: str) -> Column:
    return F.coalesce(F.pmod(F.col(key), F.lit(BUCKETS)), F.lit(0)).cast("bigint")


def table_digests(rows: DataFrame, name: str) -> DataFrame:
    """(``table_name``, ``bucket``, ``n``, ``low``, ``high``): rows of each bucket, and two sums over their MD5.

    Sums do not mind the order of rows or how they are spread over files. NULL and text cannot be confused, as a
    value carries its length. A sum keeps 60 bits a row, so equal sums of unlike buckets are out of the question.
    """
    table = TABLES[name]
    texts = [F.col(c.name).cast("string") for c in table.columns]
    told = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]
    rows = rows.select(_bucket(table.key).alias("bucket"), F.md5(F.concat_ws("|", *told)).alias("md5"))
    numbers = [F.conv(F.substring("md5", start, 15), 16, 10).cast("bigint").alias(c) for start, c in ((1, "low"), (16, "high"))]
    # the 60 bits of a row are added in two halves as long numbers, which are exact for 2 ** 33 rows
    halves = [
        F.sum(half).alias(f"{c}_{k}")
        for c in ("low", "high")
        for k, half in enumerate((F.col(c).bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftright(c, HALF)))
    ]
    sums = rows.select("bucket", *numbers).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *halves)

    def whole(c: str) -> Column:
        high = F.col(f"{c}_1").cast("decimal(20,0)") * F.lit(1 << HALF).cast("decimal(10,0)")
        return (high + F.col(f"{c}_0").cast("decimal(20,0)")).cast("string").alias(c)

    return sums.select(F.lit(name).alias("table_name"), "bucket", "n", whole("low"), whole("high"))


def digests(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The digests of all tables, at most `BUCKETS` rows each."""
    return reduce(DataFrame.unionByName, [table_digests(tables[name], name) for name in TABLES])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """What a snapshot consists of; ``held_in`` is the folder that holds a bucket."""
    return spark.read.schema(DIGESTS).parquet(f"{path}/digests")


def snapshot_changes(tables: Mapping[str, DataFrame], path: str, previous: str | None = None) -> DataFrame:
    """A snapshot under ``path`` that only holds the buckets that differ from the ``previous`` one.

    Returns its digests, which are written last: without them a snapshot is not complete.
    """
    spark = tables[next(iter(TABLES))].sparkSession
    now = stored(digests(tables), "digests")
    same = ["table_name", "bucket", "n", "low", "high"]
    old = spark.createDataFrame([], DIGESTS) if previous is None else read_digests(spark, previous)
    held = now.join(old, same, "left").withColumn("held_in", F.coalesce("held_in", F.lit(path)))
    held = stored(held.select(*same, "held_in"), "held-digests")
    # at most BUCKETS rows a table
    changed: dict[str, list[int]] = {}
    for r in held.where(F.col("held_in") == path).select("table_name", "bucket").collect():
        changed.setdefault(r.table_name, []).append(r.bucket)
    for name, table in TABLES.items():
        buckets = changed.get(name, [])
        rows = tables[name].select([c.name for c in table.columns]).withColumn("bucket", _bucket(table.key))
        # a table without changes is not read again; else the condition reaches the table below its joins
        kept = rows.where(F.col("bucket").isin(buckets)) if buckets else spark.createDataFrame([], rows.schema)
        # few files per bucket; a large bucket is cut
        kept.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    held.coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")
    return read_digests(spark, path)


def restore_changes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of such a snapshot, from all folders that hold buckets of it; raises `Damaged` unless they fit."""
    wanted = read_digests(spark, path)
    # at most BUCKETS rows a table
    places: dict[tuple[str, str], list[int]] = {}
    for r in wanted.select("table_name", "held_in", "bucket").collect():
        places.setdefault((r.table_name, r.held_in), []).append(r.bucket)
    tables = {}
    for name, table in TABLES.items():
        parts = [spark.createDataFrame([], table.struct)]
        for (of, folder), buckets in sorted(places.items()):
            if of == name:
                schema = T.StructType([*table.struct.fields, T.StructField("bucket", T.LongType())])
                found = spark.read.schema(schema).parquet(f"{folder}/{name}")
                parts.append(found.where(F.col("bucket").isin(buckets)).drop("bucket"))
        tables[name] = reduce(DataFrame.union, parts)
    columns = ["table_name", "bucket", "n", "low", "high"]
    found, wanted = stored(digests(tables), "digests"), wanted.select(columns)
    if not (found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()):
        raise Damaged(path)
    return tables
