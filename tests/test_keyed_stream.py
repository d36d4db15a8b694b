"""The workflow as keyed state: against the sequential model, by arrival and by the time of the requests."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from casewright.sources.snapshots import shared_dir
from casewright.streaming import keyed_workflow, request_feed
from tests.model import fold, run_feed
from tests.sample import AS_OF, world
from tests.test_random import _feed, _folded, _random_rows, _seen

DAY = dt.datetime(2025, 3, 1)
HOUR = dt.timedelta(hours=1)


def test_micro_batches_equal_one_batch(spark):
    rng = random.Random(11)
    rows, requests = _random_rows(rng), sorted(_feed(rng, 900), key=lambda r: r[0])
    tables, base = world(spark, **rows), shared_dir(spark, "keyed")
    read = []
    for part in (requests[:300], requests[300:500], requests[500:]):
        frame = spark.createDataFrame(part, request_feed.REQUEST_SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(f"{base}/feed")
        stream = spark.readStream.schema(request_feed.REQUEST_SCHEMA).parquet(f"{base}/feed")
        query = keyed_workflow.follow_cases(stream, tables, f"{base}/out", f"{base}/cp", AS_OF)
        query.awaitTermination()
        read.append(sum(s.numInputRows for p in query.recentProgress for s in p.sources))
    out = f"{base}/out"
    expected, end = run_feed(requests, rows)
    assert _seen(keyed_workflow.read_output(spark, out, "verdicts")) == _folded(expected)
    changes = keyed_workflow.read_output(spark, out, "changes")
    last = changes.groupBy("case_id").agg(F.max_by("new_status", F.struct("batch_id", "request_id")).alias("now"))
    assert {r.case_id: fold(r.now) for r in last.collect()} == {
        c: fold(r["case_status"]) for c, r in end.case.items() if r["case_status"] != _before(rows, c)
    }
    # a micro-batch reads its own requests only
    assert read == [300, 200, len(requests) - 500]
    # what a broken micro-batch has written is not seen
    spark.createDataFrame([(1, "submit", 1, "X", "", 0, 0, None)], keyed_workflow.OUTPUTS["verdicts"]).write.parquet(
        f"{out}/verdicts/batch_id=77"
    )
    assert keyed_workflow.read_output(spark, out, "verdicts").count() == len(requests)


def _before(rows, case_id):
    return next(r["case_status"] for r in rows["onboarding_case"] if r["case_id"] == case_id)


def test_late_requests(spark):
    """Requests are handled in the order in which they were made; what comes too late goes aside."""
    rng = random.Random(12)
    rows = _random_rows(rng)
    wait, timed = 10 * HOUR, []
    for place, request in enumerate(sorted(_feed(rng, 600), key=lambda r: r[0])):
        received = DAY + place * dt.timedelta(minutes=6)
        timed.append((*request, received - rng.choice([0, 1, 5, 9, 14, 30]) * HOUR, received))
    timed[5] = (*timed[5][:6], None, timed[5][7])
    parts = [timed[:200], timed[200:450], timed[450:]]
    late, on_time, clock = set(), [], None
    for part in parts:
        for r in part:
            made = r[6] or r[7]
            if clock is not None and made + wait <= clock:
                late.add(r[0])
            else:
                on_time.append((made, r[0], r))
        clock = max(r[7] for r in part)
    assert 20 < len(late) < 400
    turns = {r[0]: turn for turn, (_, _, r) in enumerate(sorted(on_time, key=lambda x: x[:2]))}
    expected, _ = run_feed([(turns[r[0]], *r[1:6]) for _, _, r in sorted(on_time, key=lambda x: x[:2])], rows)
    tables, base = world(spark, **rows), shared_dir(spark, "late")
    end = [(0, keyed_workflow.CLOCK, None, None, None, None, None, clock + 2 * wait)]
    for part in (*parts, end):
        frame = spark.createDataFrame(part, keyed_workflow.TIMED_SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(f"{base}/feed")
        stream = spark.readStream.schema(keyed_workflow.TIMED_SCHEMA).parquet(f"{base}/feed")
        keyed_workflow.follow_cases(stream, tables, f"{base}/out", f"{base}/cp", AS_OF, wait=wait).awaitTermination()
    got = {
        r.request_id: (r.code, r.message, r.missing_after, fold(r.new_status))
        for r in keyed_workflow.read_output(spark, f"{base}/out", "verdicts").collect()
    }
    wanted = {r: (expected[t][0], expected[t][1], expected[t][3], fold(expected[t][4])) for r, t in turns.items()}
    assert got == wanted
    aside = keyed_workflow.read_output(spark, f"{base}/out", "late").collect()
    assert sorted(r.request_id for r in aside) == sorted(late)
    ids = [r.submitted_document_id for r in keyed_workflow.read_output(spark, f"{base}/out", "documents").collect()]
    assert len(ids) == len(set(ids)) == sum(v[0] == "ACCEPTED" and r[1] == "submit" for v, r in ((got[x[1]], x[2]) for x in on_time))


def test_only_cases_with_changes_enter_the_store(spark):
    rows = _random_rows(random.Random(13))
    tables, base = world(spark, **rows), shared_dir(spark, "keyed")
    case = rows["onboarding_case"][0]["case_id"]
    asked = [(1, "status", case, None, None, "nowhere"), (2, "status", -5, None, None, "Open"), (3, "submit", None, 1, None, None)]
    spark.createDataFrame(asked, request_feed.REQUEST_SCHEMA).write.parquet(f"{base}/feed")
    stream = spark.readStream.schema(request_feed.REQUEST_SCHEMA).parquet(f"{base}/feed")
    query = keyed_workflow.follow_cases(stream, tables, f"{base}/out", f"{base}/cp", AS_OF)
    query.awaitTermination()
    verdicts = keyed_workflow.read_output(spark, f"{base}/out", "verdicts").collect()
    assert {r.request_id: r.code for r in verdicts} == {1: "INVALID", 2: "NOT_FOUND", 3: "CASE_NOT_FOUND"}
    assert len(rows["onboarding_case"]) > 1
    assert max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators) == 0


def test_cases_share_keys_of_the_store(spark):
    """Waiting requests and changed cases take rows of the store by key, not one or more each."""
    rows, n = _random_rows(random.Random(14)), 400
    rows["onboarding_case"] = [dict(case_id=c, company_id=1, case_status="Open") for c in range(1, n + 1)]
    asked = [
        (2 * c + turn, "status", c, None, None, "InReview" if turn else "Open", DAY + turn * HOUR, DAY + turn * HOUR)
        for c in range(1, 2 * n + 1)
        for turn in (0, 1)
    ]
    tables, base, kept = world(spark, **rows), shared_dir(spark, "keyed"), []
    end = [(0, keyed_workflow.CLOCK, None, None, None, None, None, DAY + 9 * HOUR)]
    for part in (asked, end):
        spark.createDataFrame(part, keyed_workflow.TIMED_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/feed")
        stream = spark.readStream.schema(keyed_workflow.TIMED_SCHEMA).parquet(f"{base}/feed")
        query = keyed_workflow.follow_cases(stream, tables, f"{base}/out", f"{base}/cp", AS_OF, wait=2 * HOUR)
        query.awaitTermination()
        kept += [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    got = {r.request_id: r.code for r in keyed_workflow.read_output(spark, f"{base}/out", "verdicts").collect()}
    assert got == {r[0]: "NOT_FOUND" if r[2] > n else "ACCEPTED" if r[0] % 2 else "INVALID" for r in asked}
    # of each key its cases, waiting requests and timers
    assert 0 < max(kept) < 10 * keyed_workflow.SPREAD < 2 * n


def test_owners_are_not_found_again_in_each_micro_batch(spark):
    """What is joined to the requests reads the stored pairs of company and owner, not all holdings."""
    rows = _random_rows(random.Random(15))
    tables, base = world(spark, **rows), shared_dir(spark, "keyed")
    tables["ownership"].write.parquet(f"{base}/all-holdings")
    tables["ownership"] = spark.read.schema(tables["ownership"].schema).parquet(f"{base}/all-holdings")
    spark.createDataFrame([(1, "submit", 1, 1, 1, None)], request_feed.REQUEST_SCHEMA).write.parquet(f"{base}/feed")
    stream = spark.readStream.schema(request_feed.REQUEST_SCHEMA).parquet(f"{base}/feed")
    query = keyed_workflow.follow_cases(stream, tables, f"{base}/out", f"{base}/cp", AS_OF)
    query.awaitTermination()
    plan = query._jsq.explainInternal(True)
    assert "reportable-owners" in plan and "all-holdings" not in plan


def test_values_of_columns():
    columns = [
        pa.array([1, None, 2**62 + 1]), pa.array([True, None, False]), pa.array(["a", None, "", "a"]),
        pa.array([[1, 2**60], [], None, [1, 2**60]]), pa.array([], pa.int64()), pa.array([None], pa.string()),
    ]
    for column in columns:
        assert keyed_workflow._values(pa.chunked_array([column])) == column.to_pylist()
