"""Submissions and status requests interleaved in one feed.

The two kinds meet in two places only. A submission that completes a case
moves it from Open to InReview, which acts like one more status request at
that very position; it has no effect on a case that is not Open any more. And
a decision ends submissions for good, so what happens before it can be worked
out as if it never came. Hence: settle the submissions, add the completing
ones to the status requests, find the steps of every case, and turn down what
was submitted after its case was decided.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.rules import ACCEPTS_DOCUMENTS
from casewright.operators import lifecycle, submissions
from casewright.sources.shared import stored

Tables = Mapping[str, DataFrame]

SUBMIT, STATUS = "submit", "status"


@dataclass(frozen=True)
class Outcome:
    """What a feed leads to; ``changes`` has one row per status step, automatic ones included."""

    verdicts: DataFrame
    new_documents: DataFrame
    changes: DataFrame


def run_requests(requests: DataFrame, tables: Tables, as_of: dt.datetime) -> Outcome:
    """Handle a feed in request_id order.

    Columns of ``requests``: request_id (unique over both kinds), kind
    (``submit`` or ``status``), case_id, document_type_id, ubo_id, new_status.
    Statuses in the result have their standard spelling.
    """
    submits = requests.filter(F.col("kind") == SUBMIT)
    asked = requests.filter(F.col("kind") == STATUS).select("request_id", "case_id", "new_status")
    cases = tables["onboarding_case"]

    # both are read by several of the steps below
    settled = stored(submissions.settle(submits, tables), "settled-submissions")
    completing = (
        settled.filter((F.col("code") == "ACCEPTED") & (F.col("missing_after") == 0))
        .groupBy("case_id")
        .agg(F.min("first_id").alias("request_id"))
        .select("request_id", "case_id", F.lit("InReview").alias("new_status"))
    )
    # cases that only got submissions take part without a request
    others = settled.select("case_id").distinct()
    steps = stored(asked.unionByName(completing).unionByName(others, allowMissingColumns=True), "status-requests")
    timeline = stored(lifecycle.status_timeline(steps, cases), "case-timeline")

    def accepts(request_id):
        return lifecycle.state_in(lifecycle.state_before(request_id), ACCEPTS_DOCUMENTS)

    placed = settled.join(timeline, "case_id", "left")
    too_late = (F.col("code") == "ACCEPTED") & ~accepts(F.col("first_id"))
    kept = placed.withColumn("code", F.when(too_late, "CASE_STATUS").otherwise(F.col("code")))
    kept = submissions.with_document_ids(kept, submits, tables)

    request_id = F.col("request_id")
    answered = submissions.answer(submits, kept)
    closed = (F.col("code") != "CASE_NOT_FOUND") & ~accepts(request_id)
    met = lifecycle.state_before(request_id)
    after = F.when(lifecycle.is_step(request_id), "InReview").otherwise(lifecycle.state_name(met))
    # an accepted request that met a closed case was not the first of its key
    judged = answered.select(
        "request_id",
        "case_id",
        "document_type_id",
        "ubo_id",
        F.when(closed, "CASE_STATUS").otherwise(F.col("code")).alias("code"),
        "missing_after",
        "new_document_id",
        lifecycle.state_label(met).alias("label"),
        after.alias("after"),
    )
    accepted = F.col("code") == "ACCEPTED"
    submit_verdicts = judged.select(
        "request_id",
        F.lit(SUBMIT).alias("kind"),
        "case_id",
        "code",
        submissions.message(F.col("label")).alias("message"),
        F.when(accepted, F.col("new_document_id")).otherwise(0).alias("new_document_id"),
        F.when(accepted, F.col("missing_after")).alias("missing_after"),
        F.when(accepted, F.col("after")).alias("new_status"),
    )
    status_verdicts = lifecycle.judge_status_requests(asked, timeline).select(
        "request_id",
        F.lit(STATUS).alias("kind"),
        "case_id",
        "code",
        "message",
        F.lit(0).cast("bigint").alias("new_document_id"),
        F.lit(None).cast("bigint").alias("missing_after"),
        F.when(accepted, lifecycle.standard_spelling(F.col("new_status"))).alias("new_status"),
    )
    return Outcome(
        submit_verdicts.unionByName(status_verdicts),
        submissions.documents_of(kept, as_of),
        stored(lifecycle.steps_of(timeline), "case-steps"),
    )


def tables_after(tables: Tables, outcome: Outcome, as_of: dt.datetime) -> dict[str, DataFrame]:
    """The three tables that a feed changes, as new frames.

    Documents include the new ones, with decisions already carried through;
    the check table ends with the automatic checks under the next free ids.
    """
    decided = lifecycle.decisions(outcome.changes)
    documents = tables["submitted_documents"].unionByName(outcome.new_documents)
    checks = tables["external_verification_check"]
    return {
        "onboarding_case": lifecycle.with_status(
            tables["onboarding_case"], lifecycle.last_status(outcome.changes)
        ),
        "submitted_documents": lifecycle.propagate_to_documents(documents, decided, as_of),
        "external_verification_check": lifecycle.with_new_checks(
            checks, lifecycle.audit_checks(decided, checks, as_of)
        ),
    }
