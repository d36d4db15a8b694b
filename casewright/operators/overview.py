"""Read views over cases and their documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import text_eq

Tables = Mapping[str, DataFrame]


def company_profile(tables: Tables) -> DataFrame:
    """Companies with their legal form and country; the two catalogs are joined in first."""
    forms = tables["legal_form"].join(tables["country"], "country_id")
    return tables["company"].join(forms, "legal_form_id")


def onboarding_overview(tables: Tables) -> DataFrame:
    return (
        tables["onboarding_case"]
        .join(company_profile(tables), "company_id")
        .select(
            "case_id",
            "case_open_date",
            "case_status",
            "company_id",
            "company_name",
            "registration_number",
            "employee_count",
            "annual_revenue",
            "legal_form_name",
            "legal_form_code",
            "country_name",
            "country_code",
            "region_name",
        )
    )


def document_completion_stats(tables: Tables) -> DataFrame:
    """Documents per case by status; cases without documents do not appear.

    Documents are counted before the joins: they shuffle as one partial
    count per task and case, and a case name is never repeated per document.
    """

    def count_of(status: str):
        return F.count(F.when(text_eq(F.col("document_status"), status), 1))

    stats = (
        tables["submitted_documents"]
        .groupBy("case_id")
        .agg(
            F.count("submitted_document_id").alias("total_documents"),
            count_of("Verified").alias("verified_documents"),
            count_of("Pending").alias("pending_documents"),
            count_of("Rejected").alias("rejected_documents"),
        )
        .filter(F.col("total_documents") >= 1)
    )
    return (
        tables["onboarding_case"]
        .join(stats, "case_id")
        .join(tables["company"].select("company_id", "company_name"), "company_id")
        .select(
            "case_id",
            "company_name",
            "case_status",
            "total_documents",
            "verified_documents",
            "pending_documents",
            "rejected_documents",
        )
    )


def document_completion_rate(tables: Tables) -> DataFrame:
    """Share of verified documents per case, rounded to four places."""
    stats = document_completion_stats(tables)
    share = F.col("verified_documents").cast("decimal(18,0)") / F.col("total_documents").cast("decimal(18,0)")
    return stats.select(
        "case_id",
        "verified_documents",
        "total_documents",
        F.round(share, 4).cast("decimal(6,4)").alias("completion_rate"),
    )
