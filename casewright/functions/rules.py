"""Scalar rules of the domain as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.functions.text import text_case, text_eq, text_in

# Threshold, labels and texts that results must carry verbatim.
REPORTABLE_FROM = 25
STATUS_LABELS = {
    "Open": "Offen – wartet auf Dokumente",
    "InReview": "In Prüfung",
    "Approved": "Genehmigt",
    "Rejected": "Abgelehnt",
    "Closed": "Geschlossen",
}
UNKNOWN_STATUS_LABEL = "Unbekannter Status"
OWNER_YES = "Ja"
OWNER_NO = "Nein"
OWNER_NONE = "Kein UBO"

# Which status may follow which.
TRANSITIONS = {
    "Open": ("InReview", "Rejected"),
    "InReview": ("Approved", "Rejected"),
    "Approved": ("Closed",),
    "Rejected": ("Closed",),
}
ACCEPTS_DOCUMENTS = ("Open", "InReview")
DECISIONS = ("Approved", "Rejected")


def is_reportable(percentage: Column) -> Column:
    """At least 25 %; the value takes its DECIMAL(5,2) form first, NULL is false."""
    return F.coalesce(percentage.cast("decimal(5,2)") >= F.lit(REPORTABLE_FROM), F.lit(False))


def owner_flag(percentage: Column) -> Column:
    """Like :func:`is_reportable` as a text, with a third value for no holding."""
    return (
        F.when(percentage.isNull(), OWNER_NONE)
        .when(is_reportable(percentage), OWNER_YES)
        .otherwise(OWNER_NO)
    )


def ownership_type(is_direct: Column) -> Column:
    return F.when(is_direct, "Direct").when(~is_direct, "Indirect")


def status_label(status: Column) -> Column:
    return text_case(status, STATUS_LABELS, UNKNOWN_STATUS_LABEL)


def transition_allowed(current: Column, target: Column) -> Column:
    """True only for a listed step; unknown or NULL statuses give false."""
    allowed = F.lit(False)
    for status, targets in TRANSITIONS.items():
        allowed = allowed | (text_eq(current, status) & text_in(target, targets))
    return F.coalesce(allowed, F.lit(False))


def is_live(document_status: Column) -> Column:
    """A document counts unless it was rejected."""
    return ~text_eq(document_status, "Rejected")


def full_name(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)
