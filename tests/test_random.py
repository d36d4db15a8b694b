"""Set-based workflow operators against the one-at-a-time models."""

import random
from decimal import Decimal

import pytest

from casewright.operators import lifecycle, submissions, workflow
from casewright.sources.snapshots import shared_dir
from casewright.streaming import request_feed
from tests.model import fold, run_feed, run_status_requests, run_submissions
from tests.sample import AS_OF, as_set, frame, rows_of_sample, world

STATUS_SPELLINGS = ["Open", "InReview", "Approved", "Rejected", "Closed", "open ", "INREVIEW", "approved", "x"]


@pytest.mark.parametrize("seed", [1, 2])
def test_status_requests(spark, seed):
    rng = random.Random(seed)
    cases = [
        dict(case_id=c, company_id=1, case_status=rng.choice(STATUS_SPELLINGS)) for c in range(1, 200)
    ]
    ids = rng.sample(range(10_000), 2500)
    targets = STATUS_SPELLINGS + [None]
    requests = [(i, rng.choice([None, 0, *range(1, 220)]), rng.choice(targets)) for i in ids]
    feed = spark.createDataFrame(requests, "request_id bigint, case_id bigint, new_status string")
    stored = frame(spark, "onboarding_case", cases)

    status = {r["case_id"]: r["case_status"] for r in cases}
    expected, changes = run_status_requests([r for r in requests], status)

    got = {
        r.request_id: (r.code, r.message)
        for r in lifecycle.status_update_verdicts(feed, stored).collect()
    }
    assert got == expected
    changed = lifecycle.status_changes(feed, stored)
    assert as_set(changed, "request_id", "case_id", "old_status", "new_status") == set(changes)
    after = lifecycle.with_status(stored, lifecycle.last_status(changed))
    assert as_set(after, "case_id", "case_status") == set(status.items())


def _random_rows(rng):
    rows = rows_of_sample()
    n = 120
    rows["company"] = [
        dict(company_id=c, legal_form_id=rng.randint(1, 6), company_name=f"Company {c}") for c in range(1, n + 1)
    ]
    rows["onboarding_case"] = [
        dict(case_id=c, company_id=rng.randint(1, n), case_status=rng.choice(["Open", "Open", "InReview", "open ", "Closed"]))
        for c in range(1, n + 1)
    ]
    rows["ownership"] = [
        dict(
            ownership_id=i,
            company_id=rng.randint(1, n),
            ubo_id=rng.randint(1, 4),
            ownership_percentage=Decimal(rng.choice(["24.99", "25.00", "80.00"])),
        )
        for i in range(1, 300)
    ]
    # duplicate rules for a form and type are legal and count twice
    rows["required_documents"] = [
        dict(
            required_document_id=i,
            legal_form_id=rng.randint(1, 5),
            document_type_id=rng.randint(1, 5),
            applies_to_ubo=rng.random() < 0.2,
            is_mandatory=rng.random() < 0.8,
        )
        for i in range(1, 25)
    ]
    rows["submitted_documents"] = [
        dict(
            submitted_document_id=i,
            case_id=rng.randint(1, n),
            ubo_id=rng.choice([None, None, 1, 2]),
            document_type_id=rng.randint(1, 7),
            document_status=rng.choice(["Pending", "Verified", "Rejected", "rejected "]),
        )
        for i in range(1, 200)
    ]
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_submissions(spark, seed):
    rng = random.Random(seed)
    rows = _random_rows(rng)
    ids = rng.sample(range(50_000), 2000)
    requests = [
        (
            i,
            rng.choice([None, 999, *range(1, 125), *range(1, 125)]),
            rng.choice([None, 0, 1, 2, 3, 4, 5, 6, 7]),
            rng.choice([None, None, None, 1, 2, 3, 9]),
        )
        for i in ids
    ]
    feed = spark.createDataFrame(
        requests, "request_id bigint, case_id bigint, document_type_id bigint, ubo_id bigint"
    )
    result = submissions.submit_documents(feed, world(spark, **rows), AS_OF)
    expected, status = run_submissions(requests, rows)
    got = {
        r.request_id: (r.code, r.message, r.new_document_id, r.missing_after, r.new_status)
        for r in result.verdicts.collect()
    }
    assert {r[0] for r in expected.values()} >= {"ACCEPTED", "DUPLICATE", "UBO_NOT_REPORTABLE", "CASE_STATUS"}
    wrong = {k: (got.get(k), v) for k, v in expected.items() if got.get(k) != v}
    assert not wrong and len(got) == len(expected)
    before = {r["case_id"]: r["case_status"] for r in rows["onboarding_case"]}
    assert as_set(result.case_updates, "case_id", "old_status", "new_status") == {
        (c, before[c], s) for c, s in status.items() if before[c] != s
    }
    accepted = {(v[2], k) for k, v in expected.items() if v[0] == "ACCEPTED"}
    assert as_set(result.new_documents, "submitted_document_id") == {(d,) for d, _ in accepted}


def _feed(rng, n=1500):
    targets = ["InReview", "Approved", "Rejected", "Closed", "Open", "approved ", None]
    weights = [3, 3, 1, 2, 1, 1, 1]
    out = []
    for i in rng.sample(range(50_000), n):
        case = rng.choice([None, 999, *range(1, 125), *range(1, 125)])
        if rng.random() < 0.75:
            kind = rng.choice([None, 0, 1, 2, 3, 4, 5, 6, 7])
            out.append((i, "submit", case, kind, rng.choice([None, None, None, 1, 2, 9]), None))
        else:
            out.append((i, "status", case, None, None, rng.choices(targets, weights)[0]))
    return out


def _seen(verdicts):
    return {
        r.request_id: (r.code, r.message, r.new_document_id, r.missing_after, fold(r.new_status))
        for r in verdicts.collect()
    }


def _folded(expected):
    return {k: (*v[:4], fold(v[4])) for k, v in expected.items()}


@pytest.mark.parametrize("seed", [6, 7])
def test_interleaved_feed(spark, seed):
    rng = random.Random(seed)
    rows, requests = _random_rows(rng), _feed(rng)
    tables = world(spark, **rows)
    outcome = workflow.run_requests(
        spark.createDataFrame(requests, request_feed.REQUEST_SCHEMA), tables, AS_OF
    )
    expected, end = run_feed(requests, rows)
    got = _seen(outcome.verdicts)
    wrong = {k: (got.get(k), v) for k, v in _folded(expected).items() if got.get(k) != v}
    assert not wrong and len(got) == len(expected)
    after = workflow.tables_after(tables, outcome, AS_OF)
    assert {(r.case_id, fold(r.case_status)) for r in after["onboarding_case"].collect()} == {
        (c, fold(r["case_status"])) for c, r in end.case.items()
    }
    assert {
        (r.submitted_document_id, r.case_id, fold(r.document_status))
        for r in after["submitted_documents"].collect()
    } == {(d["submitted_document_id"], d["case_id"], fold(d["document_status"])) for d in end.documents}
    assert {r.case_id for r in after["external_verification_check"].collect()} == end.checked


def test_streamed_feed_equals_one_batch(spark):
    rng = random.Random(8)
    rows, requests = _random_rows(rng), sorted(_feed(rng, 900), key=lambda r: r[0])
    tables = world(spark, **rows)
    base = shared_dir(spark, "feed")
    for part in (requests[:300], requests[300:500], requests[500:]):
        spark.createDataFrame(part, request_feed.REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{base}/feed"
        )
        stream = spark.readStream.schema(request_feed.REQUEST_SCHEMA).parquet(f"{base}/feed")
        request_feed.follow_requests(stream, tables, f"{base}/out", f"{base}/cp", AS_OF).awaitTermination()
    expected, end = run_feed(requests, rows)
    out = f"{base}/out"
    assert _seen(request_feed.read_output(spark, out, "verdicts")) == _folded(expected)
    assert request_feed.read_output(spark, out, "verdicts").select("batch_id").distinct().count() == 3
    now = request_feed.current_tables(spark, tables, out, 99)
    assert {(r.case_id, fold(r.case_status)) for r in now["onboarding_case"].collect()} == {
        (c, fold(r["case_status"])) for c, r in end.case.items()
    }
    updated = {
        r.submitted_document_id: r.document_status
        for r in request_feed.read_output(spark, out, "document_updates").collect()
    }
    before = {d["submitted_document_id"]: "Pending" for d in end.documents}
    before |= {d["submitted_document_id"]: d["document_status"] for d in rows["submitted_documents"]}
    assert updated == {
        d["submitted_document_id"]: d["document_status"]
        for d in end.documents
        if fold(before[d["submitted_document_id"]]) == "pending" and d["document_status"] != "Pending"
    }
    checks = request_feed.read_output(spark, out, "checks")
    stored = {r["case_id"] for r in rows["external_verification_check"]}
    assert {r.case_id for r in checks.collect()} == end.checked - stored
