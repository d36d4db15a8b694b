"""A sorted copy of a table for lookups by text, which reads few row groups.

Parquet statistics follow bytes, not the collation. So each row gets a folded key where folding is exact: of
printable ASCII without trailing blanks and in lower case, two texts are equal under the collation just when
their keys are. Every other text, which may equal one in ASCII (a soft hyphen counts for nothing, a full-width letter
is a letter), and NULL have no key. The copy is sorted by key, those without first; a search reads the row groups
that can hold its key and those without one, and compares under the collation there.

A search for a text that has no key itself reads all row groups. Rows of one hot text are cut over several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.sources.tables import lookup

KEY = "_lookup_key"
#: Size of a row group in bytes; the smaller, the less is read beside what is looked for.
ROW_GROUP = 8 << 20


def lookup_key(text: Column) -> Column:
    """The folded key; NULL where a key would not be exact."""
    return F.when(text.rlike(r"\A[ -~]*\z"), F.lower(F.rtrim(text)))


def write_lookup(df: DataFrame, column: str, path: str, row_group: int = ROW_GROUP) -> None:
    """Write ``df`` to ``path`` for searches in ``column``."""
    if KEY in df.columns:
        raise ValueError(f"{KEY} is a column already")
    # the hash of the whole row lets the sort cut a hot text
    keyed = df.withColumn(KEY, lookup_key(F.col(column))).sort(F.asc_nulls_first(KEY), F.xxhash64(*df.columns))
    keyed.write.option("parquet.block.size", row_group).parquet(path)


def find(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """The rows whose ``column`` equals ``value`` under the collation."""
    rows = spark.read.parquet(path)
    if value.isascii() and value.isprintable():
        key = F.col(KEY)
        rows = rows.where((key == value.rstrip(" ").lower()) | key.isNull())
    return lookup(rows, **{column: value}).drop(KEY)
