"""Audits of stored documents against rules that hold on submission only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import text_eq
from casewright.operators.gaps import reportable_owners

Tables = Mapping[str, DataFrame]


def ineligible_ubo_docs(tables: Tables) -> DataFrame:
    """Documents of an owner without a holding of at least 25 % in the case's company."""
    return (
        tables["submitted_documents"]
        .filter(F.col("ubo_id").isNotNull())
        .select("submitted_document_id", "case_id", "ubo_id")
        .join(tables["onboarding_case"].select("case_id", "company_id"), "case_id", "left")
        .join(reportable_owners(tables), ["company_id", "ubo_id"], "left_anti")
        .select("submitted_document_id", "case_id", "ubo_id")
    )


def document_scope_mismatches(tables: Tables) -> DataFrame:
    """Personal documents without an owner, and company documents with one."""
    scope = F.col("document_scope")
    mismatch = (text_eq(scope, "UBO") & F.col("ubo_id").isNull()) | (
        text_eq(scope, "Company") & F.col("ubo_id").isNotNull()
    )
    return (
        tables["submitted_documents"]
        .select("submitted_document_id", "case_id", "ubo_id", "document_type_id")
        .join(tables["document_type"].select("document_type_id", "document_scope"), "document_type_id")
        .filter(mismatch)
        .select("submitted_document_id", "case_id", "ubo_id", "document_type_id", "document_scope")
    )
