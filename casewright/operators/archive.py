"""Case files laid out by jurisdiction, and closed cases moved to an archive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.text import text_eq
from casewright.operators.overview import onboarding_overview
from casewright.schema import TABLES
from casewright.sources.shared import shared_dir, stored

Tables = Mapping[str, DataFrame]


def by_jurisdiction(tables: Tables) -> DataFrame:
    """The case overview with the rows of a country together.

    The rebalance hint leads to few files per country, and cuts a country
    that is too big for one task into several at run time.
    """
    return onboarding_overview(tables).hint("rebalance", "country_code")


def write_cases_by_jurisdiction(tables: Tables, path: str) -> None:
    """The case overview in one folder per country code."""
    by_jurisdiction(tables).write.mode("overwrite").partitionBy("country_code").parquet(path)


def split_closed(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(running, closed) cases."""
    closed = F.coalesce(text_eq(F.col("case_status"), "Closed"), F.lit(False))
    return cases.filter(~closed), cases.filter(closed)


#: The tables that belong to a case and go into the archive with it.
CASE_TABLES = ("onboarding_case", "submitted_documents", "external_verification_check")


def archive_closed_cases(tables: Tables, running_path: str, archive_path: str, run: str) -> None:
    """Move closed cases with their documents and checks into the archive.

    Each run writes a folder of its own, ``<archive_path>/<table>/run=<run>``, and the rest as a new
    version under ``<running_path>/<table>``. Both are overwritten, so a run that was lost or repeated
    stores nothing twice. ``running_path`` must not be where the tables are read from.
    """
    _, closed = split_closed(tables["onboarding_case"])
    ids = stored(closed.select("case_id").distinct().withColumn("_closed", F.lit(True)), "closed-cases")
    for name in CASE_TABLES:
        archived, kept = _split(tables[name], ids)
        archived.write.mode("overwrite").parquet(f"{archive_path}/{name}/run={run}")
        kept.write.mode("overwrite").parquet(f"{running_path}/{name}")


def _split(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the cases in ``ids``, and the others.

    Rows meet the ids once, and the ids are what is hashed, so that rows are moved once and never sorted.
    """
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "split")
    marked = rows.join(ids.hint("shuffle_hash"), "case_id", "left")
    marked = marked.select(*rows.columns, F.coalesce("_closed", F.lit(False)).alias("_closed"))
    marked.write.partitionBy("_closed").parquet(path)
    both = spark.read.schema(marked.schema).parquet(path)
    return both.filter("_closed").drop("_closed"), both.filter("NOT _closed").drop("_closed")


def read_archive(spark: SparkSession, archive_path: str, name: str) -> DataFrame:
    """All archived rows of a table, with the ``run`` that stored them."""
    schema = T.StructType([*TABLES[name].struct.fields, T.StructField("run", T.StringType())])
    return spark.read.schema(schema).parquet(f"{archive_path}/{name}")
