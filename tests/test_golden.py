"""The worked example: every operator against results known in advance."""

import pytest

from casewright.operators import audits, gaps, integrity, lifecycle, overview, ownership, review, submissions
from casewright.sources.tables import row_counts
from tests.sample import AS_OF, as_set, world


@pytest.fixture(scope="module")
def tables(spark):
    return {name: df.cache() for name, df in world(spark).items()}


def test_row_counts(tables):
    counts = [r.n for r in row_counts(tables).collect()]
    assert counts == [6, 13, 12, 24, 10, 15, 7, 11, 12, 10, 6, 5]


def test_overview(tables):
    regions = [r.region_name for r in overview.onboarding_overview(tables).collect()]
    assert sorted(regions) == ["BENELUX"] * 6 + ["DACH"] * 6


def test_completion_stats(tables):
    df = overview.document_completion_stats(tables)
    expected = {(1, 3, 3, 0, 0), (3, 2, 0, 2, 0), (4, 2, 2, 0, 0), (7, 1, 0, 1, 0), (9, 2, 2, 0, 0)}
    columns = ("case_id", "total_documents", "verified_documents", "pending_documents", "rejected_documents")
    assert as_set(df, *columns) == expected


def test_company_with_ubo(tables):
    flags = [r.is_beneficial_owner for r in ownership.company_with_ubo(tables).collect()]
    assert sorted(flags) == ["Ja"] * 10 + ["Nein"] * 5


def test_missing(tables):
    got = as_set(gaps.missing_counts(tables), "case_id", "missing")
    assert got == {(c, 1 if c == 2 else 0) for c in range(1, 13)}
    detail = gaps.missing_detail(tables)
    assert as_set(detail, "case_id", "document_type_id") == {(2, 1)}
    assert as_set(gaps.missing_by_level(tables), "case_id", "requirement_level", "missing") == {
        (2, "Standard", 1)
    }


def test_active_ubos(tables):
    rows = ownership.active_ubos(tables, AS_OF).collect()
    assert len(rows) == 15 and sum(r.is_reportable for r in rows) == 10
    assert ownership.active_ubos(tables, AS_OF, company_id=3).count() == 2


def test_missing_ubo_docs(spark, tables):
    # forms 1 to 4 ask for type 5; company 1 has it, company 2 has no reportable owner
    got = as_set(gaps.missing_ubo_docs(tables, AS_OF), "case_id", "required_documents", "missing_documents")
    assert got == {(1, 1, 0), (3, 2, 2)}
    listed = gaps.missing_ubo_docs_of(tables, AS_OF, spark.createDataFrame([(3,)], "case_id bigint"))
    assert as_set(listed, "ubo_id", "document_type_id") == {(2, 5), (3, 5)}
    assert gaps.missing_ubo_docs_of(tables, AS_OF, spark.createDataFrame([(1,)], "case_id bigint")).count() == 0


def test_review(tables):
    rows = [tuple(r) for r in review.compliance_review_report(tables).collect()]
    assert rows[0] == (2, "Company 2", "Open", 1, "Noch 1 Pflichtdokument ausstehend")
    ready, advanced = review.READY, review.ADVANCED
    assert [(r[0], r[2], r[3], r[4]) for r in rows[1:]] == [
        (3, "InReview", 0, ready),
        (5, "InReview", 0, advanced),
        (7, "InReview", 0, ready),
        (8, "InReview", 0, advanced),
        (10, "InReview", 0, advanced),
        (11, "InReview", 0, ready),
        (12, "InReview", 0, advanced),
    ]
    after = lifecycle.with_status(tables["onboarding_case"], review.review_case_updates(tables))
    still_open = after.filter("case_status = 'Open'")
    assert as_set(still_open, "case_id") == {(2,)}


def test_no_violations(tables):
    for rule in (
        integrity.primary_key_violations,
        integrity.unique_violations,
        integrity.not_null_violations,
        integrity.domain_violations,
        integrity.check_violations,
        integrity.foreign_key_violations,
    ):
        assert rule(tables).collect() == []


def test_audits(tables):
    total = integrity.ownership_total_violations(tables).collect()
    assert [(r.company_id, float(r.total_percentage)) for r in total] == [(12, 109.0)]
    assert as_set(audits.ineligible_ubo_docs(tables), "case_id", "ubo_id") == {(4, 3), (9, 7)}
    assert audits.document_scope_mismatches(tables).collect() == []


def test_status_requests(spark, tables):
    requests = spark.createDataFrame(
        [(1, 3, "Approved"), (2, 2, "Rejected"), (3, 6, "Closed"), (4, 99, "Closed"), (5, 1, "Open")],
        "request_id bigint, case_id bigint, new_status string",
    )
    cases = tables["onboarding_case"]
    verdicts = lifecycle.status_update_verdicts(requests, cases)
    assert as_set(verdicts, "request_id", "code", "message") == {
        (1, "ACCEPTED", 'OK – Status von Case 3 auf "Genehmigt" gesetzt.'),
        (2, "ACCEPTED", 'OK – Status von Case 2 auf "Abgelehnt" gesetzt.'),
        (3, "ACCEPTED", 'OK – Status von Case 6 auf "Geschlossen" gesetzt.'),
        (4, "NOT_FOUND", "Fehler: CaseID nicht gefunden."),
        (
            5,
            "INVALID",
            'Fehler: Ungültiger Statusübergang von "Genehmigt" nach "Offen – wartet auf Dokumente".',
        ),
    }
    decided = lifecycle.decisions(lifecycle.status_changes(requests, cases))
    documents = lifecycle.propagate_to_documents(tables["submitted_documents"], decided, AS_OF)
    changed = documents.exceptAll(tables["submitted_documents"])
    assert as_set(changed, "case_id", "document_type_id", "document_status", "verification_date") == {
        (3, 1, "Verified", AS_OF.date()),
        (3, 2, "Verified", AS_OF.date()),
    }
    checks = lifecycle.audit_checks(decided, tables["external_verification_check"], AS_OF)
    prefix = "Automatisch erstellt durch Trigger – Statusänderung auf: "
    assert as_set(checks, "case_id", "external_source_id", "check_status", "result_summary") == {
        (3, 1, "Passed", prefix + "Approved (vorher: InReview)"),
        (2, 1, "Failed", prefix + "Rejected (vorher: Open)"),
    }


def test_submissions(spark, tables):
    requests = spark.createDataFrame(
        [
            (1, 2, 1, None),
            (2, 3, 1, None),
            (3, 3, 5, 3),
            (4, 7, 5, 5),
            (5, 1, 4, None),
            (6, 99, 99, None),
            (7, 2, 99, None),
        ],
        "request_id bigint, case_id bigint, document_type_id bigint, ubo_id bigint",
    )
    result = submissions.submit_documents(requests, tables, AS_OF)
    rows = {r.request_id: r for r in result.verdicts.collect()}
    assert [rows[i].code for i in range(1, 8)] == [
        "ACCEPTED",
        "DUPLICATE",
        "ACCEPTED",
        "UBO_NOT_REPORTABLE",
        "CASE_STATUS",
        "CASE_NOT_FOUND",
        "TYPE_NOT_FOUND",
    ]
    assert [rows[i].new_document_id for i in range(1, 8)] == [11, 0, 12, 0, 0, 0, 0]
    assert rows[1].message == submissions.COMPLETE and rows[1].new_status == "InReview"
    assert rows[3].message == submissions.COMPLETE and rows[3].new_status == "InReview"
    assert rows[6].message == "Fehler: CaseID 99 existiert nicht."
    assert rows[7].message == "Fehler: DocumentTypeID 99 existiert nicht."
    assert rows[5].message == (
        'Fehler: Case hat Status "Genehmigt" – Dokumente können nicht mehr eingereicht werden.'
    )
    assert as_set(result.case_updates, "case_id", "old_status", "new_status") == {(2, "Open", "InReview")}
    assert as_set(result.new_documents, "submitted_document_id", "case_id", "document_status") == {
        (11, 2, "Pending"),
        (12, 3, "Pending"),
    }
