"""Status requests, and what a status change sets off on documents and checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.dates import today
from casewright.functions.rules import DECISIONS, TRANSITIONS, status_label, transition_allowed
from casewright.functions.shuffles import grouped_apart
from casewright.functions.text import text_case, text_eq, text_in
from casewright.schema import CASE_STATUSES
from casewright.sources.shared import stored
from casewright.sources.tables import with_ids

Tables = Mapping[str, DataFrame]

# The texts of verdicts and of the automatic check.
NOT_FOUND = "Fehler: CaseID nicht gefunden."
INVALID = ('Fehler: Ungültiger Statusübergang von "', '" nach "', '".')
UPDATED = ("OK – Status von Case ", ' auf "', '" gesetzt.')
CHECK_SUMMARY = ("Automatisch erstellt durch Trigger – Statusänderung auf: ", " (vorher: ", ")")
CHECK_RESULT = {"Approved": "Passed", "Rejected": "Failed"}
INTERNAL_REVIEW_SOURCE = 1

#: Statuses as small numbers, so that the steps aggregate without text buffers.
_NUMBER = {status: i for i, status in enumerate(CASE_STATUSES, 1)}


def _longest_path(status: str) -> int:
    return max((1 + _longest_path(t) for t in TRANSITIONS.get(status, ())), default=0)


#: Targets that some step leads to, in the order of the vocabulary.
_TARGETS = [s for s in CASE_STATUSES if any(s in targets for targets in TRANSITIONS.values())]
#: No case can take more steps than this, however many requests it gets.
MAX_STEPS = max(map(_longest_path, CASE_STATUSES))


def state_number(status: Column) -> Column:
    """The number of a status, 0 for an unknown or missing one."""
    return text_case(status, _NUMBER, 0)


def state_name(number: Column) -> Column:
    """The status that a state number stands for, NULL for an unknown one."""
    names = F.array(*[F.lit(s) for s in CASE_STATUSES])
    return F.when(number > 0, F.element_at(names, F.greatest(number, F.lit(1))))


def standard_spelling(status: Column) -> Column:
    return state_name(state_number(status))


def state_label(number: Column) -> Column:
    return status_label(state_name(number))


def _next_step(firsts: DataFrame) -> DataFrame:
    """The first request that the current status allows, from the first request per target."""
    state = F.col("state")
    candidate, target = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    for status, targets in TRANSITIONS.items():
        # An absent target must lose: least() skips NULLs.
        columns = [F.col(f"first_{t}") for t in targets]
        earliest = F.least(*columns) if len(columns) > 1 else columns[0]
        candidate = F.when(state == _NUMBER[status], earliest).otherwise(candidate)
        for t in targets:
            hit = (state == _NUMBER[status]) & (F.col(f"first_{t}") == earliest)
            target = F.when(hit, _NUMBER[t]).otherwise(target)
    return (
        firsts.withColumn("request_id", candidate)
        .withColumn("next_state", target)
        .filter(F.col("request_id").isNotNull())
        .select("case_id", "request_id", F.col("next_state").alias("state"))
    )


def _first_per_target() -> list[Column]:
    return [
        F.min(F.when(F.col("target") == _NUMBER[t], F.col("request_id"))).alias(f"first_{t}")
        for t in _TARGETS
    ]


def _asked(requests: DataFrame) -> DataFrame:
    """The requests for a target that some step leads to: (case_id, request_id, target)."""
    return requests.select("case_id", "request_id", state_number(F.col("new_status")).alias("target")).filter(
        F.col("case_id").isNotNull() & F.col("target").isin([_NUMBER[t] for t in _TARGETS])
    )


def _later(asked: DataFrame, step: DataFrame) -> DataFrame:
    """The requests that come after the ``step`` of their case."""
    before = step.select(F.col("case_id").alias("of_case"), F.col("request_id").alias("after_request"), "state")
    return asked.join(before, (F.col("case_id") == F.col("of_case")) & (F.col("request_id") > F.col("after_request")))


def _first_requests(requests: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case with a request its stored state and its first request per target.

    A case whose stored status is NULL counts as not found, so it has no row.
    """
    states = cases.filter(F.col("case_status").isNotNull()).select("case_id", state_number(F.col("case_status")).alias("state"))
    touched = requests.select("case_id").withColumn("asked", F.lit(True))
    stacked = (
        _asked(requests)
        .unionByName(touched, allowMissingColumns=True)
        .unionByName(states, allowMissingColumns=True)
    )
    firsts = grouped_apart(
        stacked, ("case_id",), *_first_per_target(), F.max("state").alias("state"), F.max("asked").alias("asked")
    )
    return firsts.filter(F.col("asked") & F.col("state").isNotNull()).drop("asked")


def _accepted_steps(requests: DataFrame, firsts: DataFrame) -> list[DataFrame]:
    """The first, second, … accepted step of every case that takes one: (case_id, request_id, state).

    The lifecycle has no way back, so a case takes at most ``MAX_STEPS``
    steps, and each step is the earliest later request with an allowed
    target. Each round is a minimum per case, which combines map-side; no
    task ever holds or sorts all requests of one case. The steps of a round
    are stored, so the next one starts from the few cases that took one.
    """
    asked = _asked(requests)
    step = stored(_next_step(firsts), "steps")
    steps = [step]
    for _ in range(MAX_STEPS - 1):
        firsts = grouped_apart(_later(asked, step), ("of_case", "state"), *_first_per_target())
        step = stored(_next_step(firsts.withColumnRenamed("of_case", "case_id")), "steps")
        steps.append(step)
    return steps


def status_timeline(requests: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case with a request its stored state and its steps: case_id, state, request_1, state_1, request_2, …

    ``requests`` are read in every round, so they should be stored.
    """
    firsts = stored(_first_requests(requests, cases), "first-requests")
    stacked = firsts.select("case_id", "state")
    for i, step in enumerate(_accepted_steps(requests, firsts), 1):
        numbered = step.select(
            "case_id", F.col("request_id").alias(f"request_{i}"), F.col("state").alias(f"state_{i}")
        )
        stacked = stacked.unionByName(numbered, allowMissingColumns=True)
    columns = [c for c in stacked.columns if c != "case_id"]
    return grouped_apart(stacked, ("case_id",), *[F.max(c).alias(c) for c in columns])


def state_before(request_id: Column) -> Column:
    """The state number that a request meets, from the columns of a timeline."""
    current = F.col("state")
    for i in range(1, MAX_STEPS + 1):
        current = F.when(request_id > F.col(f"request_{i}"), F.col(f"state_{i}")).otherwise(current)
    return current


def is_step(request_id: Column) -> Column:
    """Whether a request is one of the accepted steps of a timeline."""
    taken = F.lit(False)
    for i in range(1, MAX_STEPS + 1):
        taken = taken | request_id.eqNullSafe(F.col(f"request_{i}"))
    return taken


def steps_of(timeline: DataFrame) -> DataFrame:
    """The steps of a timeline as changes: (request_id, case_id, old_status, new_status)."""
    steps, before = [], F.col("state")
    for i in range(1, MAX_STEPS + 1):
        after = F.col(f"state_{i}")
        steps.append(
            F.struct(
                F.col(f"request_{i}").alias("request_id"),
                state_name(before).alias("old_status"),
                state_name(after).alias("new_status"),
            )
        )
        before = after
    return (
        timeline.select("case_id", F.explode(F.array(*steps)).alias("step"))
        .filter(F.col("step.request_id").isNotNull())
        .select("step.request_id", "case_id", "step.old_status", "step.new_status")
    )


def state_in(state: Column, statuses: tuple[str, ...]) -> Column:
    return state.isin([_NUMBER[s] for s in statuses])


def status_update_verdicts(requests: DataFrame, cases: DataFrame) -> DataFrame:
    """Every status request with its outcome, as if handled one after the other by request_id.

    ``code`` is ACCEPTED, NOT_FOUND or INVALID. The requests are stored once, as every round reads them.
    """
    requests = stored(requests.select("request_id", "case_id", "new_status"), "status-requests")
    return judge_status_requests(requests, status_timeline(requests, cases))


def status_message(current: Column) -> Column:
    """The text for a verdict; ``current`` is the label of the status that a request met."""
    label = status_label(F.col("new_status"))
    updated = F.concat(F.lit(UPDATED[0]), F.col("case_id").cast("string"), F.lit(UPDATED[1]), label, F.lit(UPDATED[2]))
    invalid = F.concat(F.lit(INVALID[0]), current, F.lit(INVALID[1]), label, F.lit(INVALID[2]))
    code = F.col("code")
    return F.when(code == "NOT_FOUND", NOT_FOUND).when(code == "ACCEPTED", updated).otherwise(invalid)


def judge_status_requests(requests: DataFrame, timeline: DataFrame) -> DataFrame:
    """The verdicts of status requests, given the steps that their cases take."""
    row = requests.select("request_id", "case_id", "new_status").join(timeline, "case_id", "left")
    request_id = F.col("request_id")
    code = (
        F.when(F.col("state").isNull(), "NOT_FOUND")
        .when(is_step(request_id), "ACCEPTED")
        .otherwise("INVALID")
    )
    judged = row.select(
        "request_id", "case_id", "new_status", code.alias("code"), state_before(request_id).alias("current")
    )
    message = status_message(state_label(F.col("current")))
    return judged.select("request_id", "case_id", "new_status", "code", message.alias("message"))


def status_changes(requests: DataFrame, cases: DataFrame) -> DataFrame:
    """The accepted requests as changes: (request_id, case_id, old_status, new_status)."""
    return changes_of(status_update_verdicts(requests, cases), cases)


def changes_of(verdicts: DataFrame, cases: DataFrame) -> DataFrame:
    """The changes that accepted ``verdicts`` make, each with the status it replaces."""
    # a window over at most MAX_STEPS accepted rows per case
    by_case = Window.partitionBy("case_id").orderBy("request_id")
    return (
        verdicts.filter(F.col("code") == "ACCEPTED")
        .join(cases.select("case_id", "case_status"), "case_id")
        .select(
            "request_id",
            "case_id",
            F.coalesce(F.lag("new_status").over(by_case), F.col("case_status")).alias("old_status"),
            "new_status",
        )
    )


def last_status(changes: DataFrame) -> DataFrame:
    """The status every changed case ends with: (case_id, new_status)."""
    last = changes.groupBy("case_id").agg(F.max("request_id").alias("request_id"))
    return changes.join(last, ["case_id", "request_id"], "left_semi").select("case_id", "new_status")


def with_status(cases: DataFrame, updates: DataFrame) -> DataFrame:
    """``cases`` with the status of ``updates`` (one row per case) where there is one."""
    new = updates.select("case_id", F.col("new_status").alias("_new"))
    return cases.join(new, "case_id", "left").select(
        *[
            F.coalesce("_new", "case_status").alias("case_status") if c == "case_status" else F.col(c)
            for c in cases.columns
        ]
    )


def decisions(changes: DataFrame, order: str | None = None) -> DataFrame:
    """Changes into Approved or Rejected, at most one per case.

    With ``order`` the first decision of a case is taken: after it no
    document is pending and a check exists, so later ones have no effect.
    """
    decided = changes.filter(
        text_in(F.col("new_status"), DECISIONS) & ~text_eq(F.col("old_status"), F.col("new_status"))
    )
    if order is not None:
        first = decided.groupBy("case_id").agg(F.min(order).alias(order))
        decided = decided.join(first, ["case_id", order], "left_semi")
    return decided.select("case_id", "old_status", "new_status")


def propagate_to_documents(documents: DataFrame, decided: DataFrame, as_of: dt.datetime) -> DataFrame:
    """``documents`` after the decisions: pending ones become Verified or Rejected as of today."""
    approved = text_eq(F.col("new_status"), "Approved")
    outcome = grouped_apart(decided, ("case_id",), F.max(approved).alias("_approved"))
    hit = F.col("_approved").isNotNull() & text_eq(F.col("document_status"), "Pending")
    outcome_status = F.when(F.col("_approved"), "Verified").otherwise("Rejected")
    changed = {
        "document_status": F.when(hit, outcome_status).otherwise(F.col("document_status")),
        "verification_date": F.when(hit, today(as_of)).otherwise(F.col("verification_date")),
    }
    return documents.join(outcome, "case_id", "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns]
    )


def audit_checks(decided: DataFrame, checks: DataFrame, as_of: dt.datetime) -> DataFrame:
    """A check row for every decided case that has no check of any kind yet."""
    checked = checks.select("case_id").join(decided.select("case_id"), "case_id", "left_semi").distinct()
    result = F.when(text_eq(F.col("new_status"), "Approved"), CHECK_RESULT["Approved"]).otherwise(
        CHECK_RESULT["Rejected"]
    )
    return decided.join(checked, "case_id", "left_anti").select(
        "case_id",
        F.lit(INTERNAL_REVIEW_SOURCE).cast("bigint").alias("external_source_id"),
        today(as_of).alias("check_date"),
        result.alias("check_status"),
        F.concat(
            F.lit(CHECK_SUMMARY[0]),
            "new_status",
            F.lit(CHECK_SUMMARY[1]),
            "old_status",
            F.lit(CHECK_SUMMARY[2]),
        ).alias("result_summary"),
    )


def with_new_checks(checks: DataFrame, new: DataFrame) -> DataFrame:
    """``checks`` and the ``new`` ones, which get the next free ids by case.

    A case gets at most one new check, so its id orders them; they are stored first, because the ids
    are counted in several passes.
    """
    numbered = with_ids(stored(new, "new-checks"), "external_check_id", checks, "case_id")
    return checks.unionByName(numbered.select(checks.columns))


@dataclass(frozen=True)
class StatusOutcome:
    """What a batch of status requests leads to."""

    verdicts: DataFrame
    changes: DataFrame
    cases: DataFrame
    documents: DataFrame
    new_checks: DataFrame


def apply_status_requests(requests: DataFrame, tables: Tables, as_of: dt.datetime) -> StatusOutcome:
    """Handle status requests and carry their decisions through to documents and checks.

    The changes are stored first. They are few next to the documents, and the
    size of their files tells the planner so: while they are small they are
    broadcast and the documents stay where they are, else both are shuffled.
    """
    cases = tables["onboarding_case"]
    verdicts = status_update_verdicts(requests, cases)
    changes = stored(changes_of(verdicts, cases), "status-changes")
    decided = decisions(changes)
    return StatusOutcome(
        verdicts,
        changes,
        with_status(cases, last_status(changes)),
        propagate_to_documents(tables["submitted_documents"], decided, as_of),
        audit_checks(decided, tables["external_verification_check"], as_of),
    )


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """Changes of a status history that the lifecycle does not allow."""
    old, new = F.col("old_status"), F.col("new_status")
    changed = F.coalesce(~text_eq(old, new), F.lit(True))
    return changes.filter(changed & ~transition_allowed(old, new))
