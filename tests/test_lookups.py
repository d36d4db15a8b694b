"""Lookups by text in the sorted copy: same rows as a full scan, few row groups read."""

import itertools

import pytest
from pyspark.sql import functions as F

from casewright.functions.text import collated
from casewright.sources.lookups import KEY, find, lookup_key, write_lookup
from casewright.sources.tables import lookup

ODD = [None, "", "  ", "name 7", "NAME 7  ", " name 7", "na­me 7", "Ｎame 7", "näme 7", "name 7\t", "name 7\n", "na\x01me 7"]


def rows_read(df):
    """Rows that the scan hands on, after row groups are skipped."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_keys_are_equal_just_when_texts_are(spark):
    signs = [chr(c) for c in range(0x20, 0x7F)]
    texts = signs + ["".join(p) for p in itertools.product(signs, signs)] + ["a-b ", "A-B", "ab", "a b", "Ab"]
    keyed = spark.createDataFrame([(t,) for t in texts], "text string").select(
        collated(F.col("text")).alias("collated"), lookup_key(F.col("text")).alias("key")
    )
    by_text = keyed.groupBy("collated").agg(F.count_distinct("key").alias("n"))
    by_key = keyed.groupBy("key").agg(F.count_distinct("collated").alias("n"))
    assert by_text.where("n != 1").count() == by_key.where("n != 1").count() == 0
    assert keyed.where("key IS NULL").count() == 0


@pytest.fixture(scope="module")
def named(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookups") / "names")
    plain = spark.range(40_000).selectExpr("id", "concat('Name ', id % 9000) AS name", "repeat('z', 40) AS Other")
    odd = spark.createDataFrame(list(enumerate(ODD, 50_000)), "id long, name string").selectExpr("*", "'odd' AS Other")
    hot = spark.range(60_000, 80_000).selectExpr("id", "'hot one' AS name", "uuid() AS Other")
    df = plain.union(odd).union(hot)
    write_lookup(df, "name", path, row_group=32 << 10)
    return df, path


@pytest.mark.parametrize("value", ["name 7", "NAME 8999 ", "HOT ONE", "no such name", "", "näme 7", "Ｎame 7", "name 7\t", "na­me 7"])
def test_same_rows_as_a_full_scan(spark, named, value):
    df, path = named
    got = find(spark, path, "name", value)
    assert got.columns == df.columns
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in lookup(df, name=value).collect())


def test_most_row_groups_are_skipped(spark, named):
    _, path = named
    assert rows_read(find(spark, path, "name", "name 4321")) < 6_000
    assert rows_read(find(spark, path, "name", "näme 7")) == 60_000 + len(ODD)


def test_empty_tables_and_taken_names(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, name string")
    write_lookup(empty, "name", str(tmp_path / "none"))
    assert find(spark, str(tmp_path / "none"), "name", "x").count() == 0
    with pytest.raises(ValueError):
        write_lookup(empty.selectExpr("*", f"1 AS {KEY}"), "name", str(tmp_path / "taken"))
