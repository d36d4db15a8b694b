"""Validating and accepting a batch of document submissions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.dates import today
from casewright.functions.ids import id_slices, with_dense_ids
from casewright.functions.rules import ACCEPTS_DOCUMENTS, is_live, status_label
from casewright.functions.shuffles import distinct_apart, grouped_apart
from casewright.functions.text import text_eq, text_in
from casewright.operators.gaps import missing_types, reportable_owners
from casewright.sources.shared import stored

Tables = Mapping[str, DataFrame]

# The texts of the verdicts.
CASE_NOT_FOUND = ("Fehler: CaseID ", " existiert nicht.")
CASE_STATUS = ('Fehler: Case hat Status "', '" – Dokumente können nicht mehr eingereicht werden.')
TYPE_NOT_FOUND = ("Fehler: DocumentTypeID ", " existiert nicht.")
DUPLICATE = (
    "Hinweis: Dieses Dokument wurde bereits eingereicht und ist noch aktiv "
    '(Status nicht "Abgelehnt").'
)
UBO_NOT_REPORTABLE = (
    "Fehler: UBO ",
    " ist für dieses Unternehmen nicht meldepflichtig (Beteiligungsanteil unter 25%).",
)
COMPLETE = (
    "OK – Dokument eingereicht. Alle Pflichtdokumente vollständig – "
    'Case wurde auf "In Prüfung" gesetzt.'
)
STILL_MISSING = ("OK – Dokument erfolgreich eingereicht. Es fehlen noch ", " Pflichtdokument(e).")

_KEY = ("case_id", "document_type_id", "ubo_id")


@dataclass(frozen=True)
class Submission:
    """What a batch of requests leads to."""

    verdicts: DataFrame
    new_documents: DataFrame
    case_updates: DataFrame


def _same_key(left: DataFrame, right: DataFrame):
    """Equality of case, type and owner in which NULLs match."""
    condition = None
    for name in _KEY:
        part = left[name].eqNullSafe(right[f"_{name}"])
        condition = part if condition is None else condition & part
    return condition


def _live_documents(tables: Tables, touched: DataFrame) -> DataFrame:
    """The documents on file of the ``touched`` cases.

    The cases of a batch are few next to the documents, which stay where they are while the cases are
    small; else both are shuffled, and the documents of a hot case are split.
    """
    live = tables["submitted_documents"].filter(is_live(F.col("document_status")))
    return live.join(touched, "case_id", "left_semi")


def _judged(requests: DataFrame, tables: Tables) -> DataFrame:
    """One row per distinct (case, type, owner) with the verdict of its first request.

    All requests of one such key fare alike, except that after an accepted
    first one the rest are duplicates. Working on distinct keys keeps the
    work small when one case gets a large share of the requests.
    """
    keys = requests.groupBy(*_KEY).agg(F.min("request_id").alias("first_id"))
    touched = distinct_apart(keys, "case_id")
    cases = tables["onboarding_case"].select("case_id", "company_id", "case_status")
    types = tables["document_type"].select("document_type_id").withColumn("known_type", F.lit(True))
    live = (
        _live_documents(tables, touched)
        .select(*[F.col(c).alias(f"_{c}") for c in _KEY])
        .distinct()
        .withColumn("on_file", F.lit(True))
    )
    # the companies of the batch only
    companies = distinct_apart(cases.join(touched, "case_id", "left_semi"), "company_id")
    held = tables["ownership"].join(companies, "company_id", "left_semi")
    owners = reportable_owners({"ownership": held}).withColumn("eligible", F.lit(True))
    judged = keys.join(cases, "case_id", "left").join(types, "document_type_id", "left")
    judged = judged.join(live, _same_key(judged, live), "left").drop(*[f"_{c}" for c in _KEY])
    judged = judged.join(owners, ["company_id", "ubo_id"], "left")
    code = (
        F.when(F.col("case_status").isNull(), "CASE_NOT_FOUND")
        .when(~text_in(F.col("case_status"), ACCEPTS_DOCUMENTS), "CASE_STATUS")
        .when(F.col("known_type").isNull(), "TYPE_NOT_FOUND")
        .when(F.col("on_file"), "DUPLICATE")
        .when(F.col("ubo_id").isNotNull() & F.col("eligible").isNull(), "UBO_NOT_REPORTABLE")
        .otherwise("ACCEPTED")
    )
    return judged.select(*_KEY, "first_id", "case_status", code.alias("code"))


def _case_progress(accepted: DataFrame, tables: Tables) -> DataFrame:
    """Per case what was missing before, and by which request each missing rule row is met.

    ``met_by`` has at most one entry per rule row of the case's legal form.
    """
    touched = distinct_apart(accepted, "case_id")
    running = tables["onboarding_case"].join(touched, "case_id", "left_semi")
    missing = missing_types(tables, running, _live_documents(tables, touched)).select(
        "case_id", F.explode("missing_types").alias("document_type_id")
    )
    first = accepted.groupBy("case_id", "document_type_id").agg(F.min("first_id").alias("first_of_type"))
    return grouped_apart(
        missing.join(first, ["case_id", "document_type_id"], "left"),
        ("case_id",),
        F.count(F.lit(1)).alias("missing_before"),
        F.collect_list("first_of_type").alias("met_by"),
    )


def settle(requests: DataFrame, tables: Tables) -> DataFrame:
    """The judged keys, the accepted ones with what is missing once they are on file."""
    judged = stored(_judged(requests, tables), "judged-submissions")
    progress = _case_progress(judged.filter(F.col("code") == "ACCEPTED"), tables)
    met = F.size(F.filter(F.col("met_by"), lambda request: request <= F.col("first_id")))
    still_missing = F.coalesce(F.col("missing_before") - met, F.lit(0))
    return judged.join(progress, "case_id", "left").select(
        *_KEY,
        "first_id",
        "case_status",
        "code",
        F.when(F.col("code") == "ACCEPTED", still_missing).alias("missing_after"),
    )


def with_document_ids(settled: DataFrame, requests: DataFrame, tables: Tables) -> DataFrame:
    """``settled`` with the next free document ids on its accepted keys, in request order."""
    highest = tables["submitted_documents"].agg(
        F.coalesce(F.max("submitted_document_id"), F.lit(0)).alias("highest")
    )
    numbered = with_dense_ids(
        settled.filter(F.col("code") == "ACCEPTED").select("first_id"),
        "first_id",
        "new_document_id",
        highest.scalar(),
        id_slices(requests, "request_id"),
    )
    return settled.join(numbered, "first_id", "left")


def answer(requests: DataFrame, fate: DataFrame) -> DataFrame:
    """Every request next to the fate of its key; copies of an accepted request are duplicates."""
    asked = requests.select("request_id", *_KEY)
    fate = fate.withColumnsRenamed({c: f"_{c}" for c in (*_KEY, "code", "missing_after", "new_document_id")})
    joined = asked.join(fate, _same_key(asked, fate))
    repeated = (F.col("_code") == "ACCEPTED") & (F.col("request_id") != F.col("first_id"))
    others = [c for c in fate.columns if not c.startswith("_") and c != "first_id"]
    return joined.select(
        "request_id",
        *_KEY,
        *others,
        F.when(repeated, "DUPLICATE").otherwise(F.col("_code")).alias("code"),
        F.when(~repeated, F.col("_missing_after")).alias("missing_after"),
        F.when(~repeated, F.col("_new_document_id")).alias("new_document_id"),
    )


def message(status: Column) -> Column:
    """The text for a verdict; ``status`` is the label of the case status that a request met."""
    code = F.col("code")
    return (
        F.when(code == "CASE_NOT_FOUND", _around(CASE_NOT_FOUND, F.col("case_id").cast("string")))
        .when(code == "CASE_STATUS", _around(CASE_STATUS, status))
        .when(code == "TYPE_NOT_FOUND", _around(TYPE_NOT_FOUND, F.col("document_type_id").cast("string")))
        .when(code == "DUPLICATE", DUPLICATE)
        .when(code == "UBO_NOT_REPORTABLE", _around(UBO_NOT_REPORTABLE, F.col("ubo_id").cast("string")))
        .when(F.col("missing_after") == 0, COMPLETE)
        .otherwise(_around(STILL_MISSING, F.col("missing_after").cast("string")))
    )


def documents_of(settled: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The rows that accepted keys add to the submitted documents."""
    return settled.filter(F.col("code") == "ACCEPTED").select(
        F.col("new_document_id").alias("submitted_document_id"),
        "case_id",
        "ubo_id",
        "document_type_id",
        today(as_of).alias("submission_date"),
        F.lit("Pending").alias("document_status"),
        F.lit(None).cast("date").alias("verification_date"),
    )


def submit_documents(requests: DataFrame, tables: Tables, as_of: dt.datetime) -> Submission:
    """Handle ``requests`` (request_id, case_id, document_type_id, ubo_id) in request_id order.

    The outcome equals handling them one at a time: a case stays open for
    submissions throughout the batch, so requests influence each other only
    as duplicates and through the count of missing documents.
    """
    # all three results build on the settled keys
    settled = stored(settle(requests, tables), "settled-submissions")
    settled = with_document_ids(settled, requests, tables)
    accepted = F.col("code") == "ACCEPTED"
    advances = (F.col("missing_after") == 0) & text_eq(F.col("case_status"), "Open")
    status_after = F.when(advances, "InReview").otherwise(F.col("case_status"))
    verdicts = answer(requests, settled).select(
        "request_id",
        "code",
        message(status_label(F.col("case_status"))).alias("message"),
        F.coalesce("new_document_id", F.lit(0)).alias("new_document_id"),
        "missing_after",
        F.when(accepted, status_after).alias("new_status"),
    )
    case_updates = (
        settled.filter(accepted & advances)
        .select("case_id", F.col("case_status").alias("old_status"), F.lit("InReview").alias("new_status"))
        .distinct()
    )
    return Submission(verdicts, documents_of(settled, as_of), case_updates)


def _around(parts: tuple[str, str], value: Column) -> Column:
    return F.concat(F.lit(parts[0]), value, F.lit(parts[1]))
