"""The operators under SQL: tables and reports as views, rules as SQL functions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from casewright.functions.rules import REPORTABLE_FROM, STATUS_LABELS, UNKNOWN_STATUS_LABEL
from casewright.functions.text import COLLATION
from casewright.operators.gaps import missing_counts
from casewright.operators.overview import document_completion_stats, onboarding_overview
from casewright.operators.ownership import active_ubos, company_with_ubo
from casewright.schema import TABLES


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame], as_of: dt.datetime) -> None:
    """Temporary views: every table under its name, and the reports over them."""
    for name in TABLES:
        tables[name].createOrReplaceTempView(name)
    onboarding_overview(tables).createOrReplaceTempView("onboarding_overview")
    document_completion_stats(tables).createOrReplaceTempView("document_completion_stats")
    company_with_ubo(tables).createOrReplaceTempView("company_with_ubo")
    missing_counts(tables).createOrReplaceTempView("missing_mandatory")
    active_ubos(tables, as_of).createOrReplaceTempView("active_ubos")


def register_functions(spark: SparkSession) -> None:
    """SQL functions over the views of :func:`register_views`.

    They are expressions and subqueries that the optimizer turns into joins;
    none runs row by row.
    """
    whens = " ".join(
        f"WHEN collate(status, '{COLLATION}') = '{status}' THEN '{label}'"
        for status, label in STATUS_LABELS.items()
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION is_ubo_reportable(percentage DECIMAL(5,2)) "
        f"RETURNS BOOLEAN RETURN coalesce(percentage >= {REPORTABLE_FROM}, false)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION case_status_label(status STRING) "
        f"RETURNS STRING RETURN CASE {whens} ELSE '{UNKNOWN_STATUS_LABEL}' END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION count_missing_mandatory_docs(id BIGINT) RETURNS BIGINT "
        "RETURN coalesce((SELECT sum(m.missing) FROM missing_mandatory m WHERE m.case_id = id), 0)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION ubos_by_company(id BIGINT) RETURNS TABLE("
        "ubo_id BIGINT, first_name STRING, last_name STRING, full_name STRING, date_of_birth DATE, "
        "nationality STRING, ownership_percentage DECIMAL(5,2), ownership_type STRING, "
        "valid_from DATE, valid_to DATE, is_reportable BOOLEAN) "
        "RETURN SELECT a.ubo_id, a.first_name, a.last_name, a.full_name, a.date_of_birth, "
        "a.nationality, a.ownership_percentage, a.ownership_type, a.valid_from, a.valid_to, "
        "a.is_reportable FROM active_ubos a WHERE a.company_id = id"
    )
