"""Reading, appending to, emptying and looking into the onboarding tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.dates import today
from casewright.functions.ids import id_slices, with_dense_ids
from casewright.functions.text import text_eq
from casewright.schema import NO_DEFAULT, TABLES, TODAY, Table
from casewright.sources.shared import stored


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All tables under ``path/<table>`` with their declared types, never inferred."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return {name: reader.schema(t.struct).load(f"{path}/{name}") for name, t in TABLES.items()}


def load_checked(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables from CSV under ``path/<table>``, and what does not fit.

    The second result has a row per value that does not fit its type: table_name, row_key, column_name, value; and
    a row without a column per line with too few or too many fields or an open quote, which has the line as its
    value. Such rows and lines are left out of their table, as a database would refuse them. Texts are kept
    as they are; ``dq_domain`` judges their length.
    """
    tables, rejects = {}, []
    for name, table in TABLES.items():
        texts = ", ".join(f"{c.name} string" for c in table.columns)
        reader = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"')
        # fields are counted only while all columns are read
        reader = reader.option("columnPruning", False).option("columnNameOfCorruptRecord", "_line")
        raw = reader.schema(f"{texts}, _line string").csv(f"{path}/{name}")
        wrong = [
            F.when(
                F.col(c.name).isNotNull() & F.col(c.name).try_cast(c.type).isNull(),
                F.struct(F.lit(c.name).alias("column_name"), F.col(c.name).alias("value")),
            )
            for c in table.columns
            if not isinstance(c.type, T.StringType)
        ]
        line = F.struct(F.lit(None).cast("string").alias("column_name"), F.col("_line").alias("value"))
        unfit = F.filter(F.array(*wrong), lambda w: w.isNotNull())
        judged = raw.withColumn("_wrong", F.when(F.col("_line").isNotNull(), F.array(line)).otherwise(unfit))
        rejects.append(
            judged.select(F.lit(name).alias("table_name"), F.col(table.key).alias("row_key"), F.inline("_wrong"))
        )
        fitting = judged.filter(F.size("_wrong") == 0)
        tables[name] = fitting.select([F.col(c.name).try_cast(c.type).alias(c.name) for c in table.columns])
    return tables, reduce(DataFrame.unionByName, rejects)


def with_defaults(rows: DataFrame, table: Table, as_of: dt.datetime) -> DataFrame:
    """``rows`` brought to the columns of ``table``.

    A column that is absent takes its default; a column that is present
    keeps its values, an explicit NULL included.
    """

    def value(col):
        if col.name in rows.columns:
            given = F.col(col.name)
        elif col.default is TODAY:
            given = today(as_of)
        else:
            given = F.lit(None if col.default is NO_DEFAULT else col.default)
        return given.cast(col.type).alias(col.name)

    unknown = set(rows.columns) - {c.name for c in table.columns}
    if unknown:
        raise ValueError(f"{table.name} has no column {sorted(unknown)}")
    return rows.select([value(c) for c in table.columns])


def with_ids(rows: DataFrame, key: str, existing: DataFrame, order: str) -> DataFrame:
    """``rows`` with the next free values of ``key``, in the order of the unique number ``order``."""
    highest = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("highest"))
    kind = existing.schema[key].dataType
    numbered = with_dense_ids(rows, order, key, highest.scalar(), id_slices(rows, order))
    return numbered.withColumn(key, F.col(key).cast(kind))


def append(
    rows: DataFrame, table: Table, path: str, as_of: dt.datetime, order: str | None = None
) -> None:
    """Add ``rows`` to the files of ``table`` under ``path``.

    Rows without the key column get the next free keys, in the order of ``order``,
    a column of unique numbers; without it, in no particular order.
    """
    if table.key not in rows.columns:
        existing = rows.sparkSession.read.schema(table.struct).parquet(f"{path}/{table.name}")
        by = order or "_order"
        if order is None:
            # numbered once in a stored copy, so that every later use sees the same order
            rows = stored(rows.withColumn(by, F.monotonically_increasing_id()), "rows-to-append")
        rows = with_ids(rows, table.key, existing, by)
    if order is not None and order not in {c.name for c in table.columns} or order is None:
        rows = rows.drop(order or "_order")
    with_defaults(rows, table, as_of).write.mode("append").parquet(f"{path}/{table.name}")


def purge(spark: SparkSession, path: str) -> None:
    """Empty every table, children before their parents."""
    for table in reversed(TABLES.values()):
        spark.createDataFrame([], table.struct).write.mode("overwrite").parquet(f"{path}/{table.name}")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name and number of rows."""
    counts = [
        tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name in TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def lookup(df: DataFrame, **equals: object) -> DataFrame:
    """Rows whose columns equal the given values; text compares under the collation."""
    for name, value in equals.items():
        if isinstance(df.schema[name].dataType, T.StringType):
            df = df.filter(text_eq(F.col(name), value))
        else:
            df = df.filter(F.col(name) == F.lit(value))
    return df
