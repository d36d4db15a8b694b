"""What the planner makes of the operators over stored tables."""

import re

import pytest

from casewright.functions import shuffles
from casewright.operators import archive, gaps, integrity, overview, ownership, review
from casewright.sources.snapshots import restore, shared_dir, snapshot
from casewright.sources.tables import lookup
from tests.sample import AS_OF, world


@pytest.fixture(scope="module")
def tables(spark):
    path = shared_dir(spark, "plans")
    snapshot(world(spark), path)
    return restore(spark, path)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(df) -> list[str]:
    return re.findall(r"FileScan parquet .*", _plan(df))


def test_end_of_holding_reaches_the_scan(tables):
    scan = next(s for s in _scans(ownership.active_ubos(tables, AS_OF, company_id=3)) if "valid_to" in s)
    pushed = scan.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(valid_to,2026-03-02)" in pushed and "EqualTo(company_id,3)" in pushed


def test_checks_reach_the_scan(tables):
    scans = _scans(integrity.check_violations(tables))
    company = next(s for s in scans if "annual_revenue" in s)
    assert "LessThan(annual_revenue" in company.split("PushedFilters:")[1]
    nulls = next(s for s in _scans(integrity.not_null_violations(tables)) if "submission_date" in s)
    assert "IsNull(submission_date)" in nulls


def test_lookup_by_key_reaches_the_scan(tables):
    scan = _scans(lookup(tables["submitted_documents"], case_id=3, document_status="pending"))[0]
    assert "EqualTo(case_id,3)" in scan


def test_only_needed_columns_are_read(tables):
    for df in (gaps.missing_counts(tables), review.compliance_review_report(tables)):
        documents = next(s for s in _scans(df) if "document_status" in s)
        assert documents.endswith("ReadSchema: struct<case_id:bigint,document_type_id:bigint,document_status:string>")
    stats = next(s for s in _scans(overview.document_completion_stats(tables)) if "document_status" in s)
    assert "verification_date" not in stats and "ubo_id" not in stats


def test_small_sides_are_broadcast_by_their_size(spark, tables):
    assert "BroadcastHashJoin" in _plan(overview.onboarding_overview(tables))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(overview.onboarding_overview(tables))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_no_python_and_no_cross_joins(spark, tables):
    for df in (
        gaps.missing_detail(tables),
        gaps.missing_ubo_docs(tables, AS_OF),
        gaps.missing_ubo_docs_of(tables, AS_OF, spark.createDataFrame([(3,)], "case_id bigint")),
        ownership.reportable_owners_of(tables, spark.createDataFrame([(3,)], "case_id bigint")),
        review.compliance_review_report(tables),
        ownership.company_with_ubo(tables),
        ownership.reportable_at_onboarding(tables),
        integrity.foreign_key_violations(tables),
    ):
        plan = _plan(df)
        assert not re.search("Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan), plan


def test_documents_are_counted_before_the_join(tables):
    plan = _plan(overview.document_completion_stats(tables))
    assert plan.index("HashAggregate") > plan.index("Join")
    assert "partial_count" in plan and "SortAggregate" not in plan


def test_jurisdiction_layout_rebalances(tables):
    plan = _plan(archive.by_jurisdiction(tables))
    assert "REBALANCE_PARTITIONS_BY_COL" in plan


def test_reportable_at_onboarding_shuffles_finely(spark, monkeypatch):
    """A task's share does not follow the session's number of shuffle partitions."""
    plans, before = [], spark.conf.get(shuffles.INITIAL, None)
    plain = ownership.stored

    def noted(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, purpose)

    monkeypatch.setattr(ownership, "stored", noted)
    ownership.reportable_at_onboarding(world(spark))
    assert spark.conf.get(shuffles.INITIAL, None) == before
    counts = [int(n) for plan in plans for n in re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)]
    assert counts and min(counts) >= shuffles.FINE
    assert not any(re.search("Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan) for plan in plans)
