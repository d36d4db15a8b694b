"""Compliance review of all running cases in one set-based pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.rules import ACCEPTS_DOCUMENTS
from casewright.functions.text import text_eq, text_in
from casewright.operators.gaps import missing_types

Tables = Mapping[str, DataFrame]

# The texts of the report.
ADVANCED = "Status automatisch auf InReview gesetzt"
READY = "Alle Pflichtdokumente vorhanden – bereit für Genehmigung"
ONE_MISSING = "Noch 1 Pflichtdokument ausstehend"
MANY_MISSING = ("Noch ", " Pflichtdokumente ausstehend")


def _reviewed(tables: Tables) -> DataFrame:
    """Running cases of known companies with what they miss, in one pass over each table."""
    cases = tables["onboarding_case"].filter(text_in(F.col("case_status"), ACCEPTS_DOCUMENTS))
    lacking = missing_types(tables, cases, how="inner", keep=("case_status", "company_name"))
    missing = F.size("missing_types").cast("bigint")
    return lacking.select(
        "case_id",
        "company_name",
        "case_status",
        missing.alias("missing"),
        ((missing == 0) & text_eq(F.col("case_status"), "Open")).alias("advances"),
    )


def compliance_review_report(tables: Tables, ordered: bool = True) -> DataFrame:
    """One line per running case with its status after the review, worst first."""
    missing = F.col("missing")
    advice = (
        F.when(F.col("advances"), ADVANCED)
        .when(missing == 0, READY)
        .when(missing == 1, ONE_MISSING)
        .otherwise(F.concat(F.lit(MANY_MISSING[0]), missing.cast("string"), F.lit(MANY_MISSING[1])))
    )
    report = _reviewed(tables).select(
        "case_id",
        "company_name",
        F.when(F.col("advances"), "InReview").otherwise(F.col("case_status")).alias("case_status"),
        missing.alias("missing_mandatory"),
        advice.alias("recommendation"),
    )
    return report.orderBy(F.desc("missing_mandatory"), "case_id") if ordered else report


def review_case_updates(tables: Tables) -> DataFrame:
    """The status changes of the review: complete cases that were still open."""
    return (
        _reviewed(tables)
        .filter("advances")
        .select("case_id", F.col("case_status").alias("old_status"), F.lit("InReview").alias("new_status"))
    )
