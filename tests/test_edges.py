"""Edge rows of the single rules."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from casewright.functions.ids import id_slices, with_dense_ids
from casewright.functions.rules import is_reportable, status_label
from casewright.operators import gaps, integrity, lifecycle, overview, ownership, roster, submissions
from casewright.schema import CASE_STATUSES, TABLES
from tests.sample import AS_OF, as_set, frame, rows_of_sample, world


def test_reportable(spark):
    df = spark.createDataFrame([("24.99",), ("24.995",), ("25.00",), (None,)], "p string")
    got = df.select("p", is_reportable(F.col("p").cast("decimal(10,3)"))).collect()
    assert {tuple(r) for r in got} == {("24.99", False), ("24.995", True), ("25.00", True), (None, False)}


def test_company_without_owner(spark):
    tables = world(spark, ownership=rows_of_sample()["ownership"][1:])
    row = ownership.company_with_ubo(tables).filter("company_id = 1").collect()
    assert len(row) == 1
    assert (row[0].is_beneficial_owner, row[0].ubo_id, row[0].ubo_full_name) == ("Kein UBO", None, None)
    assert row[0].ownership_type is None


def test_holding_of_unknown_owner_keeps_its_percentage(spark):
    rows = [dict(ownership_id=1, company_id=1, ubo_id=77, ownership_percentage=Decimal(30))]
    row = ownership.company_with_ubo(world(spark, ownership=rows)).filter("company_id = 1").first()
    assert (row.ubo_id, row.is_beneficial_owner) == (None, "Ja")


def test_status_label(spark):
    df = spark.createDataFrame([("open",), ("OPEN",), ("Open ",), (" Open",), (None,), ("x",)], "s string")
    labels = [r[0] for r in df.select(status_label(F.col("s"))).collect()]
    assert labels == ["Offen – wartet auf Dokumente"] * 3 + ["Unbekannter Status"] * 3


def _missing_of_case_2(spark, documents, rules=None):
    replaced = {"submitted_documents": documents}
    if rules is not None:
        replaced["required_documents"] = rules
    return dict(as_set(gaps.missing_counts(world(spark, **replaced)), "case_id", "missing"))[2]


def _document(status, ubo=None, case=2):
    return dict(submitted_document_id=1, case_id=case, ubo_id=ubo, document_type_id=1, document_status=status)


def _rule(i, mandatory=True):
    return dict(
        required_document_id=i, legal_form_id=2, document_type_id=1, applies_to_ubo=False, is_mandatory=mandatory
    )


def test_missing_documents(spark):
    assert _missing_of_case_2(spark, [_document("REJECTED ")]) == 1
    assert _missing_of_case_2(spark, [_document("Pending")]) == 0
    assert _missing_of_case_2(spark, [_document("Verified", ubo=9)]) == 0
    assert _missing_of_case_2(spark, [_document(None)]) == 1
    assert _missing_of_case_2(spark, [], [_rule(1), _rule(2)]) == 2
    assert _missing_of_case_2(spark, [], [_rule(1, mandatory=False)]) == 0


def test_documents_of_unknown_cases_add_no_case(spark):
    tables = world(spark, submitted_documents=[_document("Pending", case=500)])
    assert gaps.missing_counts(tables).count() == 12
    assert overview.document_completion_stats(tables).count() == 0


def test_active_holdings(spark):
    today = AS_OF.date()
    ends = [None, today - dt.timedelta(1), today, today + dt.timedelta(1)]
    rows = [
        dict(ownership_id=i, company_id=1, ubo_id=i, ownership_percentage=Decimal(30), valid_to=end)
        for i, end in enumerate(ends, 1)
    ]
    rows.append(
        dict(
            ownership_id=5,
            company_id=1,
            ubo_id=5,
            ownership_percentage=Decimal(30),
            valid_from=today + dt.timedelta(90),
        )
    )
    tables = world(spark, ownership=rows)
    assert as_set(ownership.active_ubos(tables, AS_OF), "ubo_id") == {(1,), (4,), (5,)}
    midnight = dt.datetime.combine(today, dt.time.min)
    assert as_set(ownership.active_ubos(tables, midnight), "ubo_id") == {(1,), (3,), (4,), (5,)}


def test_point_in_time(spark):
    d = dt.date
    rows = [
        dict(ownership_id=1, company_id=2, ubo_id=1, ownership_percentage=Decimal(30), valid_from=d(2025, 3, 1), valid_to=d(2025, 3, 15)),
        dict(ownership_id=2, company_id=2, ubo_id=2, ownership_percentage=Decimal(30), valid_from=d(2025, 3, 16)),
        dict(ownership_id=3, company_id=2, ubo_id=3, ownership_percentage=Decimal("24.99")),
    ]
    cases = [dict(case_id=1, company_id=2, case_open_date=d(2025, 3, 15), case_status="Open")]
    tables = world(spark, ownership=rows, onboarding_case=cases)
    assert as_set(ownership.ownership_as_of(tables, d(2025, 3, 15)), "ownership_id") == {(1,), (3,)}
    assert as_set(ownership.ownership_as_of(tables, d(2025, 3, 16)), "ownership_id") == {(2,), (3,)}
    assert as_set(ownership.reportable_owners_of(tables, spark.createDataFrame([(1,)], "case_id bigint")), "case_id", "ubo_id") == {(1, 1)}
    assert as_set(ownership.reportable_at_onboarding(tables), "ubo_id", "cases_opened") == {(1, 1)}


def test_reportable_at_onboarding_counts(spark):
    """Running totals against counting case by case, with open and reversed intervals."""
    rng = random.Random(11)
    day = dt.date(2025, 1, 1)

    def some_day():
        return None if rng.random() < 0.2 else day + dt.timedelta(rng.randint(0, 30))

    cases = [
        dict(case_id=i, company_id=rng.randint(1, 4), case_open_date=day + dt.timedelta(rng.randint(0, 30)), case_status="Open")
        for i in range(80)
    ]
    holdings = [
        dict(
            ownership_id=i,
            company_id=rng.randint(1, 5),
            ubo_id=i,
            ownership_percentage=Decimal(rng.choice(["24.99", "25.00"])),
            valid_from=some_day(),
            valid_to=some_day(),
        )
        for i in range(60)
    ]
    tables = world(spark, onboarding_case=cases, ownership=holdings)
    expected = set()
    for h in holdings:
        n = sum(
            c["company_id"] == h["company_id"]
            and (h["valid_from"] is None or h["valid_from"] <= c["case_open_date"])
            and (h["valid_to"] is None or h["valid_to"] >= c["case_open_date"])
            for c in cases
        )
        if n and h["ownership_percentage"] >= 25:
            expected.add((h["ubo_id"], n))
    assert as_set(ownership.reportable_at_onboarding(tables), "ubo_id", "cases_opened") == expected


def test_checks(spark):
    rows = rows_of_sample()
    rows["company"][0]["employee_count"] = None
    rows["company"][1]["employee_count"] = -1
    rows["onboarding_case"][0]["case_status"] = "OPEN"
    rows["onboarding_case"][1]["case_status"] = "Offen"
    rows["ownership"][0]["ownership_percentage"] = Decimal("100.01")
    rows["document_type"][0]["document_scope"] = "Bank"
    rows["company_address"][0]["address_type"] = "Post"
    rows["submitted_documents"][0]["document_status"] = "Lost"
    rows["external_verification_check"][0]["check_status"] = "Done"
    got = as_set(integrity.check_violations(world(spark, **rows)), "table_name", "row_key", "column_name", "value")
    assert got == {
        ("company", "2", "employee_count", "-1"),
        ("onboarding_case", "2", "case_status", "Offen"),
        ("ownership", "1", "ownership_percentage", "100.01"),
        ("document_type", "1", "document_scope", "Bank"),
        ("company_address", "1", "address_type", "Post"),
        ("submitted_documents", "1", "document_status", "Lost"),
        ("external_verification_check", "1", "check_status", "Done"),
    }


def test_unique(spark):
    rows = rows_of_sample()
    for ubo, passport in zip(rows["ubo"], ("DE-P-1", "de-p-1 ", None, None)):
        ubo["passport_no"] = passport
    rows["country"][0]["country_code"] = "c2"
    got = as_set(integrity.unique_violations(world(spark, **rows)), "column_name", "value", "n_rows")
    assert got == {("passport_no", "DE-P-1", 2), ("passport_no", None, 2), ("country_code", "C2", 2)}


def test_keys_nulls_and_domains(spark):
    rows = rows_of_sample()
    rows["ubo"][1]["ubo_id"] = 1
    rows["country"][5]["country_id"] = None
    rows["submitted_documents"][3]["ubo_id"] = None
    rows["submitted_documents"][4]["ubo_id"] = 55
    rows["company"][0]["company_name"] = None
    rows["ubo"][4]["nationality"] = "DEU"
    tables = world(spark, **rows)
    keys = as_set(integrity.primary_key_violations(tables), "table_name", "row_key", "n_rows")
    assert keys == {("ubo", "1", 2), ("country", None, 1)}
    nulls = as_set(integrity.not_null_violations(tables), "table_name", "row_key", "column_name")
    assert nulls == {("country", None, "country_id"), ("company", "1", "company_name")}
    domain = as_set(integrity.domain_violations(tables), "table_name", "row_key", "column_name", "value")
    assert domain == {("ubo", "5", "nationality", "DEU")}
    foreign = as_set(integrity.foreign_key_violations(tables), "table_name", "column_name", "value")
    # owner 2 lost its key above, and country 6 as well
    assert ("submitted_documents", "ubo_id", "55") in foreign
    assert ("ownership", "ubo_id", "2") in foreign
    assert ("legal_form", "country_id", "6") in foreign
    assert not any(value is None for _, _, value in foreign)


def test_staged_values_outside_their_type(spark):
    tables = dict(world(spark))
    tables["ownership"] = tables["ownership"].withColumn("ownership_percentage", F.lit("1000.00"))
    got = integrity.domain_violations(tables).collect()
    assert len(got) == 15 and {r.column_name for r in got} == {"ownership_percentage"}


def test_delete_guard(spark):
    tables = world(spark)
    doomed = tables["document_type"]
    got = as_set(integrity.delete_guard(tables, "document_type", doomed), "document_type_id", "child_table")
    assert got == {
        (1, "required_documents"),
        (2, "required_documents"),
        (3, "required_documents"),
        (5, "required_documents"),
        (1, "submitted_documents"),
        (2, "submitted_documents"),
        (5, "submitted_documents"),
    }


def test_all_transitions(spark):
    pairs = [(a, b) for a in CASE_STATUSES for b in CASE_STATUSES]
    cases = frame(
        spark, "onboarding_case", [dict(case_id=i, company_id=1, case_status=a) for i, (a, _) in enumerate(pairs)]
    )
    requests = spark.createDataFrame(
        [(i, i, b) for i, (_, b) in enumerate(pairs)], "request_id bigint, case_id bigint, new_status string"
    )
    verdicts = lifecycle.status_update_verdicts(requests, cases).filter("code = 'ACCEPTED'")
    assert {pairs[r.case_id] for r in verdicts.collect()} == {
        ("Open", "InReview"),
        ("Open", "Rejected"),
        ("InReview", "Approved"),
        ("InReview", "Rejected"),
        ("Approved", "Closed"),
        ("Rejected", "Closed"),
    }


def test_unknown_stored_status_is_not_found(spark):
    cases = spark.createDataFrame(
        [(1, 1, None, None), (2, 2, None, "Open")],
        "case_id bigint, company_id bigint, case_open_date date, case_status string",
    )
    asked = spark.createDataFrame([(1, 1, "InReview"), (2, 2, "InReview")], "request_id bigint, case_id bigint, new_status string")
    verdicts = lifecycle.status_update_verdicts(asked, cases)
    assert as_set(verdicts, "request_id", "code") == {(1, "NOT_FOUND"), (2, "ACCEPTED")}


def test_new_checks_get_the_next_ids(spark):
    checks = world(spark)["external_verification_check"]
    decided = spark.createDataFrame(
        [(8, "InReview", "Approved"), (3, "InReview", "Rejected")], "case_id bigint, old_status string, new_status string"
    )
    after = lifecycle.with_new_checks(checks, lifecycle.audit_checks(decided, checks, AS_OF))
    assert as_set(after.filter("external_check_id > 5"), "external_check_id", "case_id") == {(6, 3), (7, 8)}
    assert integrity.primary_key_violations({**world(spark), "external_verification_check": after}).count() == 0


def test_decision_inside_a_batch_is_not_lost(spark):
    cases = frame(spark, "onboarding_case", [dict(case_id=1, company_id=1, case_status="Open")])
    steps = [(1, 1, "InReview"), (2, 1, "Approved"), (3, 1, "Closed")]
    requests = spark.createDataFrame(steps, "request_id bigint, case_id bigint, new_status string")
    changes = lifecycle.status_changes(requests, cases)
    assert as_set(lifecycle.decisions(changes), "case_id", "old_status", "new_status") == {
        (1, "InReview", "Approved")
    }
    assert as_set(lifecycle.last_status(changes), "case_id", "new_status") == {(1, "Closed")}


def test_direct_updates(spark):
    tables = world(spark)
    changes = spark.createDataFrame(
        [(1, 3, "Approved", "Approved"), (2, 7, "Approved", "Rejected"), (3, 1, "Open", "Approved")],
        "request_id bigint, case_id bigint, old_status string, new_status string",
    )
    decided = lifecycle.decisions(changes)
    documents = lifecycle.propagate_to_documents(tables["submitted_documents"], decided, AS_OF)
    changed = documents.exceptAll(tables["submitted_documents"])
    assert as_set(changed, "case_id", "document_status") == {(7, "Rejected")}
    checks = lifecycle.audit_checks(decided, tables["external_verification_check"], AS_OF)
    assert as_set(checks, "case_id") == {(7,)}
    assert as_set(lifecycle.illegal_transitions(changes), "request_id") == {(2,), (3,)}


def test_resubmission_and_null_keys(spark):
    documents = [dict(submitted_document_id=9, case_id=2, document_type_id=1, document_status="Rejected")]
    tables = world(spark, submitted_documents=documents)
    requests = spark.createDataFrame(
        [(1, 2, 1, None), (2, 2, 1, None), (3, None, 1, None), (4, 2, None, None), (5, 8, 1, 6), (6, 8, 1, None)],
        "request_id bigint, case_id bigint, document_type_id bigint, ubo_id bigint",
    )
    rows = {r.request_id: r for r in submissions.submit_documents(requests, tables, AS_OF).verdicts.collect()}
    assert [rows[i].code for i in range(1, 7)] == [
        "ACCEPTED",
        "DUPLICATE",
        "CASE_NOT_FOUND",
        "TYPE_NOT_FOUND",
        "ACCEPTED",
        "ACCEPTED",
    ]
    assert rows[3].message is None and rows[4].message is None
    assert [rows[i].new_document_id for i in (1, 5, 6)] == [10, 11, 12]


def test_dense_ids(spark):
    rows = spark.range(0, 100_000, 7, 5).withColumnRenamed("id", "n").withColumn("n", F.col("n") * F.col("n"))
    cuts = id_slices(rows, "n", 9)
    assert 6 <= len(cuts) <= 8
    numbered = with_dense_ids(rows, "n", "row_id", F.lit(100), cuts).orderBy("n").collect()
    assert [r.row_id for r in numbered] == list(range(101, 101 + len(numbered)))
    none = with_dense_ids(rows.limit(0), "n", "row_id", F.lit(0), [])
    assert none.count() == 0


def test_access_roster(spark):
    principals = spark.createDataFrame(
        [
            ("Reader", "S", "SQL_USER", 11, 1),
            ("ReaderRole", "R", "DATABASE_ROLE", None, 2),
            ("DBO", "S", "SQL_USER", 12, 3),
            ("lonely", "U", "WINDOWS_USER", 13, 4),
            ("key", "K", "CERTIFICATE", 14, 5),
        ],
        "name string, type string, type_desc string, sid bigint, principal_id bigint",
    )
    logins = spark.createDataFrame([(11, "reader_login")], "sid bigint, name string")
    members = spark.createDataFrame([(1, 2)], "member_principal_id bigint, role_principal_id bigint")
    got = [tuple(r) for r in roster.access_roster(principals, logins, members).collect()]
    assert got == [
        ("ReaderRole", "DATABASE_ROLE", "-", "-"),
        ("Reader", "SQL_USER", "reader_login", "ReaderRole"),
        ("lonely", "WINDOWS_USER", "-", "-"),
    ]


def test_every_table_has_a_first_column_key():
    assert [t.key for t in TABLES.values()][:3] == ["country_id", "legal_form_id", "company_id"]
    assert sum(len(t.foreign) for t in TABLES.values()) == 14
    assert sum(len(t.checks) for t in TABLES.values()) == 8
    assert sum(len(t.unique) for t in TABLES.values()) == 2


def test_new_rows_are_judged_before_they_are_appended(spark):
    tables = world(spark)
    columns = "submitted_document_id bigint, case_id bigint, ubo_id bigint, document_type_id bigint"
    new = spark.createDataFrame([(1, 1, None, 1), (2, 999, 888, 1), (None, 999, None, None)], columns)
    found = integrity.foreign_key_violations(tables, {"submitted_documents": new})
    assert as_set(found, "row_key", "column_name", "value") == {
        ("2", "case_id", "999"), ("2", "ubo_id", "888"), (None, "case_id", "999"),
    }
