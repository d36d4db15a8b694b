"""Which required documents a case still lacks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.dates import not_ended
from casewright.functions.rules import is_live, is_reportable
from casewright.functions.shuffles import distinct_apart, grouped_apart
from casewright.functions.text import collated

Tables = Mapping[str, DataFrame]


def _company_rules(tables: Tables) -> DataFrame:
    """Mandatory rules that concern the company itself."""
    return tables["required_documents"].filter(F.col("is_mandatory") & ~F.col("applies_to_ubo"))


def _case_forms(cases: DataFrame, tables: Tables, how: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cases with the legal form of their company, and ``keep`` from either table."""
    of_case = [c for c in keep if c in cases.columns]
    company = tables["company"].select("company_id", "legal_form_id", *[c for c in keep if c not in of_case])
    return cases.select("case_id", "company_id", *of_case).join(company, "company_id", how)


def missing_types(
    tables: Tables,
    cases: DataFrame | None = None,
    documents: DataFrame | None = None,
    how: str = "left",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per case the document types still missing, once per rule row: (case_id, *keep, missing_types).

    ``keep`` names more columns of the case or its company to carry along;
    ``how`` is the join to the company.

    Both sides come down to one row per case before they meet. The documents
    collapse map-side into the set of types on file, so a case with very many
    documents shuffles no more than others; the set only keeps types that
    some rule asks for, which bounds it by the rule table.
    """
    cases = tables["onboarding_case"] if cases is None else cases
    documents = tables["submitted_documents"] if documents is None else documents
    rules = _company_rules(tables).select("legal_form_id", "document_type_id")
    wanted = rules.groupBy("legal_form_id").agg(F.collect_list("document_type_id").alias("wanted"))
    on_file = (
        documents.filter(is_live(F.col("document_status")))
        .select("case_id", "document_type_id")
        .join(rules.select("document_type_id").distinct(), "document_type_id", "left_semi")
        .groupBy("case_id")
        .agg(F.collect_set("document_type_id").alias("on_file"))
    )
    none = F.array().cast("array<bigint>")
    lacking = F.filter(
        F.coalesce("wanted", none), lambda t: ~F.array_contains(F.coalesce("on_file", none), t)
    )
    return (
        _case_forms(cases, tables, how, keep)
        .join(wanted, "legal_form_id", "left")
        .join(on_file, "case_id", "left")
        .select("case_id", *keep, lacking.alias("missing_types"))
    )


def missing_counts(tables: Tables, cases: DataFrame | None = None) -> DataFrame:
    """Missing mandatory company documents of every case, 0 included: (case_id, missing)."""
    return missing_types(tables, cases).select(
        "case_id", F.size("missing_types").cast("bigint").alias("missing")
    )


def _live_types(tables: Tables, *more: str) -> DataFrame:
    """Distinct live (case, type) pairs; reduced before the shuffle."""
    return (
        tables["submitted_documents"]
        .filter(is_live(F.col("document_status")))
        .select("case_id", "document_type_id", *more)
        .distinct()
    )


def missing_detail(tables: Tables) -> DataFrame:
    """The rule rows behind :func:`missing_counts`."""
    rules = _company_rules(tables).select(
        "legal_form_id", "required_document_id", "document_type_id", "requirement_level"
    )
    return (
        _case_forms(tables["onboarding_case"], tables, "inner")
        .join(rules, "legal_form_id")
        .join(_live_types(tables), ["case_id", "document_type_id"], "left_anti")
        .select("case_id", "required_document_id", "document_type_id", "requirement_level")
    )


def missing_by_level(tables: Tables) -> DataFrame:
    """Missing documents per case and requirement level.

    Levels that differ in case only are one level. They get one spelling in
    the small rule table, so that the cases group by plain text.
    """
    rules = tables["required_documents"].withColumn("_level", collated(F.col("requirement_level")))
    spelling = rules.groupBy("_level").agg(F.min("requirement_level").alias("_spelling"))
    spelled = rules.join(
        spelling.withColumnRenamed("_level", "_known"), F.col("_level").eqNullSafe(F.col("_known"))
    )
    spelled = spelled.withColumn("requirement_level", F.col("_spelling"))
    return (
        missing_detail(dict(tables) | {"required_documents": spelled})
        .groupBy("case_id", "requirement_level")
        .agg(F.count(F.lit(1)).alias("missing"))
    )


def reportable_owners(tables: Tables, as_of: dt.datetime | None = None) -> DataFrame:
    """Distinct (company, owner) with a holding of at least 25 %, if asked for one not yet ended."""
    holding = tables["ownership"].filter(is_reportable(F.col("ownership_percentage")))
    if as_of is not None:
        holding = holding.filter(not_ended(F.col("valid_to"), as_of))
    return distinct_apart(holding, "company_id", "ubo_id")


def _owner_rules(tables: Tables) -> DataFrame:
    return tables["required_documents"].filter(F.col("is_mandatory") & F.col("applies_to_ubo"))


def missing_ubo_docs(tables: Tables, as_of: dt.datetime) -> DataFrame:
    """Personal documents per case: how many its active reportable owners need, and how many lack.

    Needed is owners times rules; what is on file is counted from the
    documents. Cases, owners and rules are never multiplied out.
    """
    owners = reportable_owners(tables, as_of)
    rules = _owner_rules(tables).groupBy("legal_form_id", "document_type_id").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    owner_count = grouped_apart(owners, ("company_id",), F.count(F.lit(1)).alias("_owners"))
    rule_count = rules.groupBy("legal_form_id").agg(F.sum("_rows").alias("_rules"))
    cases = _case_forms(tables["onboarding_case"], tables, "inner")
    needed = (
        cases.join(rule_count, "legal_form_id")
        .join(owner_count, "company_id")
        .select("case_id", (F.col("_owners") * F.col("_rules")).alias("required_documents"))
    )
    on_file = (
        _live_types(tables, "ubo_id")
        .filter(F.col("ubo_id").isNotNull())
        .join(cases, "case_id")
        .join(rules, ["legal_form_id", "document_type_id"])
        .join(owners, ["company_id", "ubo_id"], "left_semi")
        .groupBy("case_id")
        .agg(F.sum("_rows").alias("_on_file"))
    )
    lacking = F.col("required_documents") - F.coalesce("_on_file", F.lit(0))
    return needed.join(on_file, "case_id", "left").select(
        "case_id", "required_documents", lacking.alias("missing_documents")
    )


def missing_ubo_docs_of(tables: Tables, as_of: dt.datetime, asked: DataFrame) -> DataFrame:
    """The personal documents still lacking in the ``asked`` cases (case_id), by owner and rule."""
    ids = distinct_apart(asked, "case_id")
    cases = tables["onboarding_case"].join(ids, "case_id", "left_semi")
    rules = _owner_rules(tables).select("legal_form_id", "required_document_id", "document_type_id")
    owners = reportable_owners(tables, as_of).join(
        distinct_apart(cases, "company_id"), "company_id", "left_semi"
    )
    on_file = _live_types(tables, "ubo_id").join(ids, "case_id", "left_semi")
    return (
        _case_forms(cases, tables, "inner")
        .join(rules, "legal_form_id")
        .join(owners, "company_id")
        .join(on_file, ["case_id", "ubo_id", "document_type_id"], "left_anti")
        .select("case_id", "ubo_id", "required_document_id", "document_type_id")
    )
