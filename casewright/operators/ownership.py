"""Holdings of beneficial owners in companies."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.dates import not_ended, valid_on
from casewright.functions.rules import full_name, is_reportable, owner_flag, ownership_type
from casewright.functions.shuffles import distinct_apart, fine_shuffles, grouped_apart
from casewright.operators.overview import company_profile
from casewright.sources.shared import stored

Tables = Mapping[str, DataFrame]


def company_with_ubo(tables: Tables) -> DataFrame:
    """Every company with its owners, or once with NULLs when it has none.

    The left join is written as its two halves. In the matching half the
    holdings may be split at run time when one company has very many of
    them, which a plain left join from the company side would rule out; the
    other half only needs the distinct companies that have holdings.
    """
    company = company_profile(tables).select("company_id", "company_name", "legal_form_name", "country_name")
    holding = tables["ownership"].select(
        "company_id", "ubo_id", "ownership_percentage", "is_ownership_direct", "valid_from", "valid_to"
    )
    ubo = tables["ubo"].select(
        F.col("ubo_id").alias("known_ubo_id"), "first_name", "last_name", "nationality"
    )
    held = holding.join(company, "company_id").join(
        ubo, F.col("ubo_id") == F.col("known_ubo_id"), "left"
    )
    ownerless = company.join(holding.select("company_id").distinct(), "company_id", "left_anti")
    return held.unionByName(ownerless, allowMissingColumns=True).select(
        "company_id",
        "company_name",
        "legal_form_name",
        "country_name",
        F.col("known_ubo_id").alias("ubo_id"),
        full_name(F.col("first_name"), F.col("last_name")).alias("ubo_full_name"),
        F.col("nationality").alias("ubo_nationality"),
        "ownership_percentage",
        ownership_type(F.col("is_ownership_direct")).alias("ownership_type"),
        "valid_from",
        "valid_to",
        owner_flag(F.col("ownership_percentage")).alias("is_beneficial_owner"),
    )


def active_ubos(tables: Tables, as_of: dt.datetime, company_id: int | None = None) -> DataFrame:
    """Owners whose holding has not ended, of one company or of all.

    Only the end counts: a holding that starts later is listed as well.
    """
    holding = tables["ownership"].filter(not_ended(F.col("valid_to"), as_of))
    if company_id is not None:
        holding = holding.filter(F.col("company_id") == company_id)
    return holding.join(tables["ubo"], "ubo_id").select(
        "company_id",
        "ubo_id",
        "first_name",
        "last_name",
        full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        "date_of_birth",
        "nationality",
        "ownership_percentage",
        ownership_type(F.col("is_ownership_direct")).alias("ownership_type"),
        "valid_from",
        "valid_to",
        is_reportable(F.col("ownership_percentage")).alias("is_reportable"),
    )


def ubo_reportable_flag(tables: Tables) -> DataFrame:
    return tables["ownership"].select(
        "ownership_id",
        "ownership_percentage",
        is_reportable(F.col("ownership_percentage")).alias("is_reportable"),
    )


def ownership_as_of(tables: Tables, day: dt.date) -> DataFrame:
    """Holdings valid on ``day``."""
    return tables["ownership"].filter(valid_on(F.col("valid_from"), F.col("valid_to"), F.lit(day)))


def reportable_at_onboarding(tables: Tables) -> DataFrame:
    """Holdings of at least 25 % that were valid when a case of the company was opened.

    One row per such holding with the number of cases opened while it was
    valid, from running totals of case openings: a holding covers the cases
    up to its end less those before its start. Cases and holdings of a
    company never meet as pairs. A running total has one row per company and
    day, so its window is bounded by the calendar. The holdings and the result
    are stored, in shuffles fine enough that the memory of a task does not
    follow the size of the tables.
    """
    with fine_shuffles(tables["ownership"].sparkSession):
        return stored(_reportable_at_onboarding(tables), "reportable-at-onboarding")


def _reportable_at_onboarding(tables: Tables) -> DataFrame:
    holding = (
        tables["ownership"]
        .filter(is_reportable(F.col("ownership_percentage")))
        .select("company_id", "ubo_id", "ownership_percentage", "valid_from", "valid_to")
        .withColumn("_eve", F.date_sub("valid_from", 1))
    )
    holding = stored(holding, "reportable-holdings")
    opened = (
        tables["onboarding_case"]
        .groupBy("company_id", F.col("case_open_date").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ends = [
        holding.filter(F.col(c).isNotNull()).select("company_id", F.col(c).alias("day"), F.lit(0).alias("n"))
        for c in ("_eve", "valid_to")
    ]
    by_day = Window.partitionBy("company_id").orderBy("day")
    running = (
        opened.unionByName(ends[0])
        .unionByName(ends[1])
        .groupBy("company_id", "day")
        .agg(F.sum("n").alias("n"))
        .select("company_id", "day", F.sum("n").over(by_day).alias("so_far"))
    )
    total = grouped_apart(opened, ("company_id",), F.sum("n").alias("_total"))

    def up_to(day: str, name: str) -> DataFrame:
        return running.select("company_id", F.col("day").alias(day), F.col("so_far").alias(name))

    covered = F.coalesce("_through", "_total") - F.coalesce("_before", F.lit(0))
    return (
        holding.join(total, "company_id")
        .join(up_to("_eve", "_before"), ["company_id", "_eve"], "left")
        .join(up_to("valid_to", "_through"), ["company_id", "valid_to"], "left")
        .select(
            "company_id",
            "ubo_id",
            "ownership_percentage",
            "valid_from",
            "valid_to",
            covered.alias("cases_opened"),
        )
        .filter(F.col("cases_opened") > 0)
    )


def reportable_owners_of(tables: Tables, asked: DataFrame) -> DataFrame:
    """The holdings of at least 25 % that were valid when the ``asked`` cases (case_id) were opened.

    Cases and holdings are cut down to the asked ones before they meet, so the work follows the request.
    """
    cases = tables["onboarding_case"].join(distinct_apart(asked, "case_id"), "case_id", "left_semi")
    holding = (
        tables["ownership"]
        .filter(is_reportable(F.col("ownership_percentage")))
        .join(distinct_apart(cases, "company_id"), "company_id", "left_semi")
    )
    return (
        cases.join(holding, "company_id")
        .filter(valid_on(F.col("valid_from"), F.col("valid_to"), F.col("case_open_date")))
        .select("case_id", "company_id", "case_open_date", "ubo_id", "ownership_percentage")
    )


def holdings_on_days(questions: DataFrame, tables: Tables) -> DataFrame:
    """The holdings of at least 25 % that were valid on the day of each question (question_id, company_id, day).

    A join over intervals: a holding is listed under every year in which it was valid and some question lies, and
    meets the questions of its company in that year only. Company and year are the key, so that a company
    with very many questions and holdings is spread over its years, and adaptive execution cuts what is still hot.
    A question lies in one year, so it meets a holding once.
    """
    span = questions.agg(F.min(F.year("day")).alias("first"), F.max(F.year("day")).alias("last")).first()
    low, high = F.lit(span["first"]).cast("int"), F.lit(span["last"]).cast("int")
    first = F.greatest(F.year("valid_from"), low)
    last = F.least(F.year("valid_to"), high)
    holding = (
        tables["ownership"]
        .filter(is_reportable(F.col("ownership_percentage")) & (first <= last))
        .select(
            "company_id",
            "ubo_id",
            "ownership_percentage",
            "valid_from",
            "valid_to",
            F.explode(F.sequence(first, last)).alias("year"),
        )
    )
    asked = questions.select("question_id", "company_id", "day", F.year("day").alias("year"))
    return (
        asked.join(holding, ["company_id", "year"])
        .filter(valid_on(F.col("valid_from"), F.col("valid_to"), F.col("day")))
        .select("question_id", "company_id", "day", "ubo_id", "ownership_percentage")
    )


def ownership_direct_indirect(tables: Tables) -> DataFrame:
    """Direct and indirect holdings of each company, summed and counted."""
    direct = F.col("is_ownership_direct")
    share = F.col("ownership_percentage")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, share)), F.lit(0)).cast("decimal(18,2)")

    return (
        tables["ownership"]
        .groupBy("company_id")
        .agg(
            F.count(F.when(direct, 1)).alias("direct_holdings"),
            F.count(F.when(~direct, 1)).alias("indirect_holdings"),
            total(direct).alias("direct_percentage"),
            total(~direct).alias("indirect_percentage"),
        )
    )
