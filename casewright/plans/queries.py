"""The registered queries: every operator over the derived onboarding tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.rules import status_label
from casewright.functions.sql_surface import register_functions, register_views
from casewright.operators import (
    archive,
    audits,
    capture,
    gaps,
    integrity,
    lifecycle,
    overview,
    ownership,
    publishing,
    review,
    roster,
    submissions,
    workflow,
)
from casewright.schema import TABLES
from casewright.sources.derived import Derived
from casewright.sources.lookups import find, write_lookup
from casewright.sources.shared import stored
from casewright.sources.snapshots import (
    digests,
    restore,
    restore_changes,
    shared_dir,
    snapshot,
    snapshot_changes,
    snapshot_path,
)
from casewright.sources.versions import publish, read_version
from casewright.sources.tables import load_checked, lookup, row_counts, with_defaults, with_ids
from casewright.streaming import keyed_workflow, request_feed, status_changes as change_stream

AS_OF = dt.datetime(1998, 6, 1, 12, 0, 0)
OWNERSHIP_DAY = dt.date(1997, 1, 1)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(run: Callable[[Derived], DataFrame]) -> Callable[[Derived], DataFrame]:
    """Register ``run`` under its own name."""
    QUERIES[run.__name__] = lambda spark, sf_dir: run(Derived(spark, sf_dir))
    return run


# Reports -------------------------------------------------------------------


@_query
def onboarding_overview(t: Derived) -> DataFrame:
    return overview.onboarding_overview(t)


@_query
def document_completion_stats(t: Derived) -> DataFrame:
    return overview.document_completion_stats(t)


@_query
def document_completion_rate(t: Derived) -> DataFrame:
    return overview.document_completion_rate(t)


@_query
def company_with_ubo(t: Derived) -> DataFrame:
    return ownership.company_with_ubo(t)


@_query
def ubo_reportable_flag(t: Derived) -> DataFrame:
    return ownership.ubo_reportable_flag(t)


@_query
def case_status_label(t: Derived) -> DataFrame:
    label = status_label(F.col("new_status")).alias("status_label")
    return t["status_requests"].select("request_id", "new_status", label)


@_query
def missing_mandatory_docs(t: Derived) -> DataFrame:
    return gaps.missing_counts(t)


@_query
def missing_mandatory_detail(t: Derived) -> DataFrame:
    return gaps.missing_detail(t)


@_query
def missing_by_level(t: Derived) -> DataFrame:
    return gaps.missing_by_level(t)


@_query
def missing_ubo_docs(t: Derived) -> DataFrame:
    return gaps.missing_ubo_docs(t, AS_OF)


def _asked(t: Derived) -> DataFrame:
    """The cases that some request wants reviewed."""
    return t["status_requests"].filter(F.col("new_status") == "InReview").select("case_id")


@_query
def missing_ubo_docs_listed(t: Derived) -> DataFrame:
    return gaps.missing_ubo_docs_of(t, AS_OF, _asked(t))


@_query
def reportable_owners_listed(t: Derived) -> DataFrame:
    return ownership.reportable_owners_of(t, _asked(t))


@_query
def holdings_at_openings(t: Derived) -> DataFrame:
    """Each case asks for the reportable holdings of its company on the day it was opened; here summed up by case."""
    questions = t["onboarding_case"].select(F.col("case_id").alias("question_id"), "company_id", F.col("case_open_date").alias("day"))
    return (
        ownership.holdings_on_days(questions, t)
        .groupBy(F.col("question_id").alias("case_id"))
        .agg(
            F.count(F.lit(1)).alias("holdings"),
            F.countDistinct("ubo_id").alias("owners"),
            F.sum("ownership_percentage").cast("decimal(18,2)").alias("total_percentage"),
        )
    )


@_query
def active_ubos(t: Derived) -> DataFrame:
    return ownership.active_ubos(t, AS_OF)


@_query
def ownership_as_of(t: Derived) -> DataFrame:
    return ownership.ownership_as_of(t, OWNERSHIP_DAY)


@_query
def reportable_at_onboarding(t: Derived) -> DataFrame:
    return ownership.reportable_at_onboarding(t)


@_query
def ownership_direct_indirect(t: Derived) -> DataFrame:
    return ownership.ownership_direct_indirect(t)


# Workflow ------------------------------------------------------------------


@_query
def compliance_review_report(t: Derived) -> DataFrame:
    return review.compliance_review_report(t)


@_query
def review_case_updates(t: Derived) -> DataFrame:
    return review.review_case_updates(t)


@_query
def cases_after_review(t: Derived) -> DataFrame:
    return lifecycle.with_status(t["onboarding_case"], review.review_case_updates(t))


def _submission(t: Derived) -> submissions.Submission:
    return submissions.submit_documents(t["submit_requests"], t, AS_OF)


@_query
def submit_document_verdicts(t: Derived) -> DataFrame:
    return _submission(t).verdicts


@_query
def submit_new_documents(t: Derived) -> DataFrame:
    return _submission(t).new_documents


@_query
def submit_case_updates(t: Derived) -> DataFrame:
    return _submission(t).case_updates


@_query
def status_update_verdicts(t: Derived) -> DataFrame:
    return lifecycle.status_update_verdicts(t["status_requests"], t["onboarding_case"])


def _changes(t: Derived) -> DataFrame:
    return lifecycle.status_changes(t["status_requests"], t["onboarding_case"])


def _applied(t: Derived) -> lifecycle.StatusOutcome:
    return lifecycle.apply_status_requests(t["status_requests"], t, AS_OF)


@_query
def status_changes(t: Derived) -> DataFrame:
    return _changes(t)


@_query
def cases_after_status_updates(t: Derived) -> DataFrame:
    return _applied(t).cases


@_query
def status_change_documents(t: Derived) -> DataFrame:
    return _applied(t).documents


@_query
def status_change_audit_checks(t: Derived) -> DataFrame:
    return _applied(t).new_checks


@_query
def checks_after_status_updates(t: Derived) -> DataFrame:
    return lifecycle.with_new_checks(t["external_verification_check"], _applied(t).new_checks)


def _outcome(t: Derived) -> workflow.Outcome:
    return workflow.run_requests(t["workflow_requests"], t, AS_OF)


@_query
def workflow_verdicts(t: Derived) -> DataFrame:
    return _outcome(t).verdicts


@_query
def workflow_cases(t: Derived) -> DataFrame:
    return workflow.tables_after(t, _outcome(t), AS_OF)["onboarding_case"]


@_query
def workflow_documents(t: Derived) -> DataFrame:
    return workflow.tables_after(t, _outcome(t), AS_OF)["submitted_documents"]


@_query
def audit_illegal_transitions(t: Derived) -> DataFrame:
    """The status requests read as direct updates of the stored status."""
    history = t["status_requests"].join(
        t["onboarding_case"].select("case_id", F.col("case_status").alias("old_status")), "case_id"
    )
    return lifecycle.illegal_transitions(
        history.select("request_id", "case_id", "old_status", "new_status")
    )


@_query
def audit_ineligible_ubo_docs(t: Derived) -> DataFrame:
    return audits.ineligible_ubo_docs(t)


@_query
def audit_document_scope(t: Derived) -> DataFrame:
    return audits.document_scope_mismatches(t)


# Integrity -----------------------------------------------------------------


@_query
def dq_primary_key(t: Derived) -> DataFrame:
    return integrity.primary_key_violations(t)


@_query
def dq_unique(t: Derived) -> DataFrame:
    return integrity.unique_violations(t)


@_query
def dq_not_null(t: Derived) -> DataFrame:
    return integrity.not_null_violations(t)


@_query
def dq_domain(t: Derived) -> DataFrame:
    return integrity.domain_violations(t)


@_query
def dq_check(t: Derived) -> DataFrame:
    return integrity.check_violations(t)


@_query
def dq_foreign_key(t: Derived) -> DataFrame:
    return integrity.foreign_key_violations(t)


@_query
def dq_delete_guard(t: Derived) -> DataFrame:
    """Companies in deficit that are to be deleted, and what still refers to them."""
    doomed = t["company"].filter(F.col("annual_revenue") < 0)
    return integrity.delete_guard(t, "company", doomed)


@_query
def dq_ownership_total(t: Derived) -> DataFrame:
    return integrity.ownership_total_violations(t)


# Tables, lookups, files ----------------------------------------------------


@_query
def table_row_counts(t: Derived) -> DataFrame:
    return row_counts(t)


@_query
def append_with_defaults(t: Derived) -> DataFrame:
    """The requested documents appended with only their keys given."""
    table = TABLES["submitted_documents"]
    rows = t["submit_requests"].select("request_id", "case_id", "ubo_id", "document_type_id")
    numbered = with_ids(rows, table.key, t["submitted_documents"], "request_id").drop("request_id")
    return t["submitted_documents"].unionByName(with_defaults(numbered, table, AS_OF))


def _staged(t: Derived) -> str:
    """Holdings as text: some percentages too wide for their type, some dates without a day, some broken lines."""
    base = shared_dir(t.spark, "staged")
    for name, table in TABLES.items():
        rows = t[name] if name == "ownership" else t.spark.createDataFrame([], table.struct)
        if name == "ownership":
            wide = F.when(F.col("ownership_id") % 10 == 3, F.col("ownership_percentage") * 25)
            day = F.when(F.col("ownership_id") % 10 == 5, F.date_format("valid_from", "yyyy-MM"))
            day = F.when(F.col("ownership_id") % 10 == 7, F.lit("1997-13-01")).otherwise(day)
            rows = rows.withColumns(
                {
                    "ownership_percentage": F.coalesce(wide, "ownership_percentage").cast("string"),
                    "valid_from": F.coalesce(day, F.col("valid_from").cast("string")),
                }
            )
        rows.select([c.name for c in table.columns]).write.option("header", True).csv(f"{base}/{name}")
    # every tenth row comes once more, cut short, with a field too many or with an open quote
    key = F.col("ownership_id").cast("string")
    line = (
        F.when(F.col("ownership_id") % 30 == 8, F.concat(key, F.lit(",1")))
        .when(F.col("ownership_id") % 30 == 18, F.concat(key, F.lit(",1,2,30,true,1997-01-01,,more")))
        .otherwise(F.concat(key, F.lit(',1,2,"30,true,1997-01-01,')))
    )
    # written as one field without quotes, under the header of the table
    header = ",".join(c.name for c in TABLES["ownership"].columns)
    broken = t["ownership"].where(F.col("ownership_id") % 10 == 8).select(line.alias(header))
    as_is = {"header": True, "sep": "\u0001", "quote": "\u0000"}
    broken.write.mode("append").options(**as_is).csv(f"{base}/ownership")
    return base


@_query
def staged_rejects(t: Derived) -> DataFrame:
    return load_checked(t.spark, _staged(t))[1]


@_query
def staged_holdings(t: Derived) -> DataFrame:
    return load_checked(t.spark, _staged(t))[0]["ownership"]


@_query
def lookup_cases_by_status(t: Derived) -> DataFrame:
    return lookup(t["onboarding_case"], case_status="inreview ")


@_query
def lookup_documents_by_case_status(t: Derived) -> DataFrame:
    return lookup(t["submitted_documents"], case_id=8, document_status="PENDING")


@_query
def lookup_company_by_name(t: Derived) -> DataFrame:
    return lookup(t["company"], company_name="customer#000000042")


@_query
def lookup_company_by_registration(t: Derived) -> DataFrame:
    return lookup(t["company"], registration_number="hr-42")


@_query
def find_company_by_name(t: Derived) -> DataFrame:
    path = shared_dir(t.spark, "companies-by-name")
    write_lookup(t["company"], "company_name", path)
    return find(t.spark, path, "company_name", "customer#000000042 ")


@_query
def find_cases_by_status(t: Derived) -> DataFrame:
    """One of few texts that many rows share."""
    path = shared_dir(t.spark, "cases-by-status")
    write_lookup(t["onboarding_case"], "case_status", path)
    return find(t.spark, path, "case_status", "InReview")


@_query
def lookup_ubo_by_last_name(t: Derived) -> DataFrame:
    return lookup(t["ubo"], last_name="000000007")


@_query
def lookup_ownership_by_company(t: Derived) -> DataFrame:
    return lookup(t["ownership"], company_id=42)


@_query
def snapshot_roundtrip_counts(t: Derived) -> DataFrame:
    path = snapshot_path(shared_dir(t.spark, "snapshot"), AS_OF)
    snapshot(t, path)
    return row_counts(restore(t.spark, path))


@_query
def snapshot_digests(t: Derived) -> DataFrame:
    """Digests of all tables as a snapshot of changes restores them, of which the second part holds what status requests changed."""
    base = shared_dir(t.spark, "snapshot")
    snapshot_changes(t, f"{base}/first")
    cases = lifecycle.apply_status_requests(t["status_requests"], t, AS_OF).cases
    snapshot_changes(dict(t) | {"onboarding_case": stored(cases, "cases")}, f"{base}/second", f"{base}/first")
    return digests(restore_changes(t.spark, f"{base}/second"))


@_query
def cases_by_jurisdiction(t: Derived) -> DataFrame:
    path = shared_dir(t.spark, "jurisdictions")
    archive.write_cases_by_jurisdiction(t, path)
    written = overview.onboarding_overview(t).schema
    return t.spark.read.schema(written).parquet(path)


def _archived(t: Derived, name: str) -> DataFrame:
    """A case table after two equal runs of the archive, with the place of each row."""
    base = shared_dir(t.spark, "archive")
    for _ in range(2):
        archive.archive_closed_cases(t, f"{base}/running", f"{base}/archive", "1")
    running = t.spark.read.schema(TABLES[name].struct).parquet(f"{base}/running/{name}")
    closed = archive.read_archive(t.spark, f"{base}/archive", name).drop("run")
    return running.withColumn("stored_in", F.lit("running")).unionByName(
        closed.withColumn("stored_in", F.lit("archive"))
    )


@_query
def archive_closed_cases(t: Derived) -> DataFrame:
    return _archived(t, "onboarding_case")


@_query
def archive_closed_documents(t: Derived) -> DataFrame:
    return _archived(t, "submitted_documents")


@_query
def access_roster(t: Derived) -> DataFrame:
    """Suppliers as users, nations as their roles, customers in credit as logins."""

    def role_id(nation: str):
        return F.col(nation).cast("bigint") + F.lit(1_000_000_000_000)

    users = t.raw("supplier").select(
        F.col("s_name").alias("name"),
        F.lit("S").alias("type"),
        F.lit("SQL_USER").alias("type_desc"),
        F.col("s_suppkey").alias("sid"),
        F.col("s_suppkey").alias("principal_id"),
    )
    roles = t.raw("nation").select(
        F.col("n_name").alias("name"),
        F.lit("R").alias("type"),
        F.lit("DATABASE_ROLE").alias("type_desc"),
        F.lit(None).cast("bigint").alias("sid"),
        role_id("n_nationkey").alias("principal_id"),
    )
    logins = (
        t.raw("customer")
        .filter(F.col("c_acctbal") > 0)
        .select(F.col("c_custkey").alias("sid"), F.col("c_name").alias("name"))
    )
    members = t.raw("supplier").select(
        F.col("s_suppkey").alias("member_principal_id"),
        role_id("s_nationkey").alias("role_principal_id"),
    )
    return roster.access_roster(users.unionByName(roles), logins, members)


# SQL surface and stream ----------------------------------------------------


@_query
def sql_scalar_functions(t: Derived) -> DataFrame:
    register_views(t.spark, t, AS_OF)
    register_functions(t.spark)
    return t.spark.sql(
        "SELECT case_id, case_status_label(case_status) AS status_label, "
        "count_missing_mandatory_docs(case_id) AS missing FROM onboarding_case"
    )


@_query
def sql_ubos_by_company(t: Derived) -> DataFrame:
    register_views(t.spark, t, AS_OF)
    register_functions(t.spark)
    return t.spark.sql(
        "SELECT c.company_id, u.ubo_id, u.full_name, u.ownership_percentage, "
        "is_ubo_reportable(u.ownership_percentage) AS is_reportable "
        "FROM company c, LATERAL ubos_by_company(c.company_id) u"
    )


def _streamed(t: Derived, output: str) -> DataFrame:
    base = shared_dir(t.spark, "status-stream")
    feed = f"{base}/feed"
    _changes(t).repartitionByRange(2, "request_id").write.parquet(feed)
    stream = t.spark.readStream.schema(change_stream.CHANGE_SCHEMA)
    stream = stream.option("maxFilesPerTrigger", 1).parquet(feed)
    change_stream.follow_status_changes(
        stream, t, f"{base}/out", f"{base}/checkpoint", AS_OF
    ).awaitTermination()
    return change_stream.read_output(t.spark, f"{base}/out", output).drop("batch_id")


@_query
def stream_status_change_checks(t: Derived) -> DataFrame:
    return _streamed(t, "checks")


@_query
def stream_document_updates(t: Derived) -> DataFrame:
    return _streamed(t, "document_updates")


@_query
def stream_workflow_verdicts(t: Derived) -> DataFrame:
    """The interleaved feed in two micro-batches, the earlier requests first."""
    base = shared_dir(t.spark, "request-stream")
    feed, out = f"{base}/feed", f"{base}/out"
    requests = t["workflow_requests"]
    middle = requests.approxQuantile("request_id", [0.5], 0.01)[0]
    run = {"tables": t, "out": out, "checkpoint": f"{base}/checkpoint", "as_of": AS_OF}
    for part in (F.col("request_id") <= middle, F.col("request_id") > middle):
        requests.filter(part).write.mode("append").parquet(feed)
        stream = t.spark.readStream.schema(request_feed.REQUEST_SCHEMA).parquet(feed)
        request_feed.follow_requests(stream, **run).awaitTermination()
    return request_feed.read_output(t.spark, out, "verdicts").drop("batch_id")


@_query
def stream_keyed_verdicts(t: Derived) -> DataFrame:
    """The interleaved feed in three micro-batches, with the state of each case in a state store."""
    base = shared_dir(t.spark, "keyed-stream")
    feed, out = f"{base}/feed", f"{base}/out"
    requests = t["workflow_requests"]
    low, high = requests.approxQuantile("request_id", [0.33, 0.67], 0.01)
    request_id, owners = F.col("request_id"), stored(gaps.reportable_owners(t), "reportable-owners")
    for part in (request_id <= low, (request_id > low) & (request_id <= high), request_id > high):
        requests.filter(part).write.mode("append").parquet(feed)
        stream = t.spark.readStream.schema(request_feed.REQUEST_SCHEMA).parquet(feed)
        keyed_workflow.follow_cases(stream, t, out, f"{base}/checkpoint", AS_OF, owners=owners).awaitTermination()
    return keyed_workflow.read_output(t.spark, out, "verdicts").drop("batch_id")


#: How long a request waits for earlier ones, and the days on which a micro-batch of the query below ends.
WAIT = dt.timedelta(days=3)
CUT_DAYS = ("2024-01-11", "2024-01-21")


@_query
def stream_late_verdicts(t: Derived) -> DataFrame:
    """The feed by the time of each request, in three micro-batches by arrival; late requests have the code LATE."""
    base = shared_dir(t.spark, "late-stream")
    feed, out = f"{base}/feed", f"{base}/out"
    requests = stored(t["timed_requests"], "timed-requests")
    owners = stored(gaps.reportable_owners(t), "reportable-owners")
    received = F.col("received_at")
    first, second = (F.lit(day).cast("timestamp") for day in CUT_DAYS)
    # at last the clock moves on, so that all requests are released
    end = requests.agg(F.max("received_at").alias("received_at")).select(
        F.lit(0).cast("bigint").alias("request_id"),
        F.lit(keyed_workflow.CLOCK).alias("kind"),
        (F.col("received_at") + F.lit(2 * WAIT)).alias("received_at"),
    )
    parts = [requests.filter(p) for p in (received < first, (received >= first) & (received < second), received >= second)]
    for part in [*parts, requests.limit(0).unionByName(end, allowMissingColumns=True)]:
        part.write.mode("append").parquet(feed)
        stream = t.spark.readStream.schema(keyed_workflow.TIMED_SCHEMA).parquet(feed)
        query = keyed_workflow.follow_cases(stream, t, out, f"{base}/checkpoint", AS_OF, wait=WAIT, owners=owners)
        query.awaitTermination()
    verdicts = keyed_workflow.read_output(t.spark, out, "verdicts")
    late = keyed_workflow.read_output(t.spark, out, "late").withColumn("code", F.lit(keyed_workflow.LATE))
    columns = ["request_id", "kind", "case_id", "code", "message", "missing_after"]
    both = verdicts.select(*columns, F.col("new_status")).unionByName(
        late.select("request_id", "kind", "case_id", "code"), allowMissingColumns=True
    )
    return both.select(*columns, "new_status")


# Versions ------------------------------------------------------------------


def _twice(step, *args):
    """A batch that is run again under its name changes nothing."""
    first = step(*args)
    assert step(*args) == first
    return first


@_query
def published_documents(t: Derived) -> DataFrame:
    """The documents of the version after a batch of submissions."""
    root = shared_dir(t.spark, "versions")
    publishing.start(t.spark, root, "base", t)
    _twice(publishing.submit, t.spark, root, "submissions", t["submit_requests"], AS_OF)
    return read_version(t.spark, root)["submitted_documents"]


@_query
def published_checks(t: Derived) -> DataFrame:
    """The checks of the version after a batch of status requests."""
    root = shared_dir(t.spark, "versions")
    publishing.start(t.spark, root, "base", t)
    _twice(publishing.update_status, t.spark, root, "statuses", t["status_requests"], AS_OF)
    return read_version(t.spark, root)["external_verification_check"]


@_query
def published_review(t: Derived) -> DataFrame:
    """The cases of the version after the review."""
    root = shared_dir(t.spark, "versions")
    publishing.start(t.spark, root, "base", t)
    _twice(publishing.close_reviews, t.spark, root, "review")
    return read_version(t.spark, root)["onboarding_case"]


@_query
def captured_changes(t: Derived) -> DataFrame:
    """Changed keys of the case tables between a version and the one after status requests and the archive."""
    root = shared_dir(t.spark, "versions")
    old = publishing.start(t.spark, root, "base", t)
    publishing.update_status(t.spark, root, "statuses", t["status_requests"], AS_OF)
    new = publishing.without_archived(t.spark, root, "archive")
    parts = [
        capture.version_changes(t.spark, root, old, new, name).select(
            F.lit(name).alias("table_name"), F.col(TABLES[name].key).alias("row_key"), "change", "n_old", "n_new"
        )
        for name in archive.CASE_TABLES
    ]
    return reduce(DataFrame.unionByName, parts)


def _captured(t: Derived) -> tuple[dict[str, DataFrame], DataFrame]:
    """What follows from the statuses of a new version, which a batch without any effects has published."""
    root = shared_dir(t.spark, "versions")
    old = publishing.start(t.spark, root, "base", t)
    changes = stored(lifecycle.status_changes(t["status_requests"], t["onboarding_case"]), "status-changes")
    cases = lifecycle.with_status(t["onboarding_case"], lifecycle.last_status(changes))
    new = publish(t.spark, root, "statuses", old, replaced={"onboarding_case": cases})
    return capture.follow_versions(t.spark, root, old, new, AS_OF)


@_query
def captured_document_updates(t: Derived) -> DataFrame:
    return _captured(t)[0]["submitted_documents"]


@_query
def captured_audit_checks(t: Derived) -> DataFrame:
    return _captured(t)[0]["external_verification_check"]


@_query
def captured_illegal_transitions(t: Derived) -> DataFrame:
    """Steps between the two versions that no single allowed step explains."""
    return _captured(t)[1]
