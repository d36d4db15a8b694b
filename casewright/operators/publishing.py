"""The write step of batches: compute on the last version, publish the next one.

A batch has a name, its ``run_id``. Running it again under the same name changes nothing, so a scheduler may
retry it at any time; a batch that ends early is not seen at all.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from casewright.operators import archive, lifecycle, review, submissions
from casewright.schema import TABLES
from casewright.sources.shared import stored
from casewright.sources.tables import with_ids
from casewright.sources.versions import Version, latest, publish, published, read_version

Tables = Mapping[str, DataFrame]
Change = Callable[[Tables], tuple[dict[str, DataFrame], dict[str, DataFrame]]]


def start(spark: SparkSession, root: str, run_id: str, tables: Tables) -> Version:
    """Publish whole tables as the next version."""
    return publish(spark, root, run_id, latest(spark, root), replaced={n: tables[n] for n in TABLES})


def run(spark: SparkSession, root: str, run_id: str, change: Change) -> Version:
    """Publish what ``change`` makes of the last version: tables replaced, and rows appended."""
    done = published(spark, root, run_id)
    if done is not None:
        return done
    base = latest(spark, root)
    replaced, appended = change(read_version(spark, root, base.number))
    return publish(spark, root, run_id, base, replaced, appended)


def submit(spark: SparkSession, root: str, run_id: str, requests: DataFrame, as_of: dt.datetime) -> Version:
    """Handle a batch of submissions; new documents are appended."""

    def change(tables: Tables):
        outcome = submissions.submit_documents(requests, tables, as_of)
        cases = lifecycle.with_status(tables["onboarding_case"], stored(outcome.case_updates, "case-updates"))
        return {"onboarding_case": cases}, {"submitted_documents": outcome.new_documents}

    return run(spark, root, run_id, change)


def update_status(spark: SparkSession, root: str, run_id: str, requests: DataFrame, as_of: dt.datetime) -> Version:
    """Handle a batch of status requests; checks are appended under the next free ids."""

    def change(tables: Tables):
        outcome = lifecycle.apply_status_requests(requests, tables, as_of)
        checks = with_ids(
            stored(outcome.new_checks, "new-checks"), "external_check_id", tables["external_verification_check"], "case_id"
        )
        replaced = {"onboarding_case": outcome.cases, "submitted_documents": outcome.documents}
        return replaced, {"external_verification_check": checks}

    return run(spark, root, run_id, change)


def close_reviews(spark: SparkSession, root: str, run_id: str) -> Version:
    """Move reviewed cases on."""

    def change(tables: Tables):
        updates = stored(review.review_case_updates(tables), "case-updates")
        return {"onboarding_case": lifecycle.with_status(tables["onboarding_case"], updates)}, {}

    return run(spark, root, run_id, change)


def without_archived(spark: SparkSession, root: str, run_id: str) -> Version:
    """Take closed cases, their documents and their checks out of the tables."""

    def change(tables: Tables):
        _, closed = archive.split_closed(tables["onboarding_case"])
        ids = stored(closed.select("case_id").distinct(), "closed-cases")
        return {name: tables[name].join(ids, "case_id", "left_anti") for name in archive.CASE_TABLES}, {}

    return run(spark, root, run_id, change)
