"""Integrity rules as jobs that return the violating rows.

Every rule comes from `casewright.schema`; the files themselves enforce none.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.shuffles import distinct_apart
from casewright.functions.text import collated, text_in
from casewright.schema import TABLES, Check, Col, Table

Tables = Mapping[str, DataFrame]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _name(table: Table) -> Column:
    return F.lit(table.name).alias("table_name")


def _row_key(table: Table) -> Column:
    return F.col(table.key).cast("string").alias("row_key")


def primary_key_violations(tables: Tables) -> DataFrame:
    """Keys that are NULL or occur more than once, with their number of rows."""
    return _union(
        [
            tables[t.name]
            .groupBy(t.key)
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .filter((F.col("n_rows") > 1) | F.col(t.key).isNull())
            .select(_name(t), _row_key(t), "n_rows")
            for t in TABLES.values()
        ]
    )


def unique_violations(tables: Tables) -> DataFrame:
    """Values that repeat in a unique column; text by collation, NULL counts as a value."""
    return _union(
        [
            tables[t.name]
            .groupBy(collated(F.col(c)).alias("_value"))
            .agg(F.min(c).alias("value"), F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1)
            .select(_name(t), F.lit(c).alias("column_name"), "value", "n_rows")
            for t in TABLES.values()
            for c in t.unique
        ]
    )


def _flagged_columns(df: DataFrame, table: Table, flags: dict[str, Column]) -> DataFrame:
    """(table_name, row_key, column_name, value) for every raised flag, in one pass over ``df``.

    An unknown (NULL) flag is not raised. The flags are also the plain filter
    of the scan, so simple ones reach the Parquet reader.
    """
    raised = F.array(
        *[
            F.when(flag, F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value")))
            for name, flag in flags.items()
        ]
    )
    hits = F.filter(raised, lambda x: x.isNotNull())
    return (
        df.filter(reduce(Column.__or__, flags.values()))
        .select(_name(table), _row_key(table), F.explode(hits).alias("hit"))
        .select("table_name", "row_key", "hit.column_name", "hit.value")
    )


def not_null_violations(tables: Tables) -> DataFrame:
    frames = []
    for t in TABLES.values():
        flags = {c.name: F.col(c.name).isNull() for c in t.columns if c.required}
        frames.append(_flagged_columns(tables[t.name], t, flags).drop("value"))
    return _union(frames)


def _outside_domain(df: DataFrame, col: Col) -> Column | None:
    """Too long a text, or a value that its declared type cannot hold."""
    if col.length is not None:
        return F.length(col.name) > col.length
    if df.schema[col.name].dataType != col.type and not isinstance(col.type, T.StringType):
        fits = F.col(col.name).try_cast(col.type)
        return F.col(col.name).isNotNull() & fits.isNull()
    return None


def domain_violations(tables: Tables) -> DataFrame:
    frames = []
    for t in TABLES.values():
        df = tables[t.name]
        flags = {c.name: flag for c in t.columns if (flag := _outside_domain(df, c)) is not None}
        if flags:
            frames.append(_flagged_columns(df, t, flags))
    return _union(frames)


def _holds(check: Check) -> Column:
    col = F.col(check.column)
    if check.allowed is not None:
        return text_in(col, check.allowed)
    if check.high is None:
        return col >= check.low
    return col.between(check.low, check.high)


def check_violations(tables: Tables) -> DataFrame:
    """Rows whose check is false; an unknown result (NULL) passes."""
    return _union(
        [
            _flagged_columns(tables[t.name], t, {c.column: ~_holds(c) for c in t.checks})
            for t in TABLES.values()
            if t.checks
        ]
    )


def foreign_key_violations(tables: Tables, new: Tables | None = None) -> DataFrame:
    """Rows that refer to a missing parent; a NULL reference passes.

    ``new`` are rows to be judged before they are appended, by default all rows. Each child table is read once:
    its keys are looked up one parent after the other, a small parent without moving the child.
    """
    frames = []
    for t in TABLES.values():
        if not t.foreign or new is not None and t.name not in new:
            continue
        rows = (new or tables)[t.name].select(_name(t), _row_key(t), *t.foreign)
        missing = []
        for place, (column, parent) in enumerate(t.foreign.items()):
            keys = distinct_apart(tables[parent], TABLES[parent].key)
            keys = keys.select(F.col(TABLES[parent].key).alias(f"_key{place}"), F.lit(True).alias(f"_found{place}"))
            rows = rows.join(keys, F.col(column) == F.col(f"_key{place}"), "left")
            absent = F.col(column).isNotNull() & F.col(f"_found{place}").isNull()
            told = F.struct(F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value"))
            missing.append(F.when(absent, told))
        wrong = F.filter(F.array(*missing), lambda m: m.isNotNull())
        frames.append(rows.select("table_name", "row_key", F.inline(wrong)))
    return _union(frames)


def delete_guard(tables: Tables, parent: str, doomed: DataFrame) -> DataFrame:
    """Keys among ``doomed`` (of ``parent``) that may not be deleted, and the table in the way."""
    key = TABLES[parent].key
    keys = doomed.select(key).distinct()
    blocked = []
    for t in TABLES.values():
        for column, target in t.foreign.items():
            if target == parent:
                # only references to doomed rows are reduced
                used = tables[t.name].select(F.col(column).alias(key)).join(keys, key, "left_semi").distinct()
                blocked.append(used.select(key, F.lit(t.name).alias("child_table"), F.lit(column).alias("child_column")))
    return _union(blocked)


def ownership_total_violations(tables: Tables) -> DataFrame:
    """Companies whose holdings add up to more than 100 %."""
    return (
        tables["ownership"]
        .groupBy("company_id")
        .agg(F.sum("ownership_percentage").cast("decimal(18,2)").alias("total_percentage"))
        .filter(F.col("total_percentage") > 100)
    )
