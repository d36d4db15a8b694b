"""One case, company or owner with a third of all rows: right results, and the hot key is split."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from casewright.operators import gaps, lifecycle, overview, ownership, submissions
from tests.model import run_status_requests
from tests.sample import AS_OF, frame, world

ROWS = 60_000
HOT = 3
STATUSES = ["Open", "InReview", "Approved", "Rejected", "Closed"]


@contextmanager
def large_scale_plans(spark):
    """No broadcasts, and partitions that count as skewed at test size."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def _hot(i):
    """Row number -> key: every third row has the hot key, the others spread."""
    return F.when(i % 3 == 0, HOT).otherwise(i % 5000 + 10)


@pytest.fixture(scope="module")
def cases(spark):
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("case_id") % 5 + 1).cast("int"))
    return spark.range(6000, numPartitions=2).select(
        F.col("id").alias("case_id"),
        F.col("id").alias("company_id"),
        F.to_date(F.lit("2025-01-01")).alias("case_open_date"),
    ).withColumn("case_status", F.when(F.col("case_id") == HOT, "Open").otherwise(status))


def test_status_requests(spark, cases):
    rng = random.Random(5)
    late = {"Approved": 0.2, "Closed": 0.2, "Rejected": 0.01}
    rows = []
    for i in range(ROWS):
        # the hot case must wait long for its first accepted step
        if i % 3 == 0:
            target = "InReview" if i > ROWS * 0.8 and rng.random() < 0.1 else rng.choice(["Approved", "Closed", "Open"])
            rows.append((i, HOT, target))
        else:
            rows.append((i, i % 5000 + 10, rng.choice(STATUSES + list(late))))
    feed = spark.createDataFrame(rows, "request_id bigint, case_id bigint, new_status string").repartition(8)
    status = {r.case_id: r.case_status for r in cases.collect()}
    expected, changes = run_status_requests(rows, status)
    with large_scale_plans(spark):
        verdicts = lifecycle.status_update_verdicts(feed, cases)
        got = {r.request_id: (r.code, r.message) for r in verdicts.collect()}
        plans = [_final_plan(verdicts)]
        # the rounds are stored, so their searches for later requests have plans of their own
        firsts = lifecycle._first_requests(feed, cases)
        for step in lifecycle._accepted_steps(feed, firsts)[:-1]:
            later = lifecycle._later(lifecycle._asked(feed), step)
            later.collect()
            plans.append(_final_plan(later))
    assert got == expected
    assert len([c for c in changes if c[1] == HOT]) == 3
    # both searches for later steps and the final look-up split the hot case
    assert len(plans) == 3
    assert all(plan.count("SortMergeJoin(skew=true)") == 1 for plan in plans), plans


def test_submissions_answer_every_copy(spark, cases):
    feed = spark.range(ROWS, numPartitions=8).select(
        F.col("id").alias("request_id"),
        _hot(F.col("id")).alias("case_id"),
        (F.col("id") % 4 + 1).alias("document_type_id"),
        F.lit(None).cast("bigint").alias("ubo_id"),
    )
    tables = dict(world(spark))
    tables["onboarding_case"] = cases
    with large_scale_plans(spark):
        verdicts = submissions.submit_documents(feed, tables, AS_OF).verdicts
        rows = verdicts.collect()
        plan = _final_plan(verdicts)
    assert len(rows) == ROWS
    hot = [r for r in rows if r.request_id % 3 == 0]
    # four types for an open case: two on file as Pending in the sample, two accepted
    assert sum(r.code == "ACCEPTED" for r in hot) == 2
    assert sum(r.code == "DUPLICATE" for r in hot) == len(hot) - 2
    ids = sorted(r.new_document_id for r in rows if r.code == "ACCEPTED")
    assert ids == list(range(11, 11 + len(ids)))
    assert "skewed" in plan, plan


def test_submissions_for_a_case_with_many_documents(spark, cases):
    """The hot case's documents are reduced to their keys before they meet the requests."""
    feed = spark.range(4000).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") < 8, F.lit(HOT)).otherwise(F.col("id") + 6).cast("bigint").alias("case_id"),
        (F.col("id") % 8 + 1).alias("document_type_id"),
        F.lit(None).cast("bigint").alias("ubo_id"),
    )
    tables = dict(world(spark))
    tables["onboarding_case"], tables["submitted_documents"] = cases, _documents(spark)
    with large_scale_plans(spark):
        judged = submissions._judged(feed, tables)
        rows = judged.collect()
        plan = _final_plan(judged)
    hot = {r.document_type_id: r.code for r in rows if r.case_id == HOT}
    assert hot == {**dict.fromkeys(range(1, 8), "DUPLICATE"), 8: "TYPE_NOT_FOUND"}
    joined = plan[plan.index("LeftSemi") :]
    assert "HashAggregate" in joined and "partial" not in joined[: joined.index("HashAggregate")]


def _documents(spark):
    n = F.col("id")
    status = F.element_at(F.array(F.lit("Pending"), F.lit("Verified"), F.lit("Rejected")), (n % 3 + 1).cast("int"))
    return spark.range(ROWS, numPartitions=8).select(
        n.alias("submitted_document_id"),
        _hot(n).alias("case_id"),
        F.lit(None).cast("bigint").alias("ubo_id"),
        (n % 7 + 1).alias("document_type_id"),
        F.to_date(F.lit("2025-01-01")).alias("submission_date"),
        status.alias("document_status"),
        F.lit(None).cast("date").alias("verification_date"),
    )


def test_documents_of_one_case(spark, cases):
    tables = dict(world(spark))
    tables["onboarding_case"], tables["submitted_documents"] = cases, _documents(spark)
    decided = spark.createDataFrame(
        [(HOT, "InReview", "Approved")], "case_id bigint, old_status string, new_status string"
    )
    with large_scale_plans(spark):
        after = lifecycle.propagate_to_documents(tables["submitted_documents"], decided, AS_OF)
        counts = {r.document_status: r["count"] for r in after.groupBy("document_status").count().collect()}
        written = after.select("submitted_document_id", "case_id", "document_status")
        written.collect()
        assert "skewed" in _final_plan(written)
        missing = gaps.missing_counts(tables)
        assert missing.count() == 6000
    # every third row is Pending and all of those belong to the hot case
    assert counts == {"Verified": 2 * ROWS // 3, "Rejected": ROWS // 3}


def test_counts_combine_before_the_shuffle(spark, cases):
    """Stacked requirements and document statistics shuffle partial results only."""
    tables = dict(world(spark))
    tables["onboarding_case"], tables["submitted_documents"] = cases, _documents(spark)
    tables["company"] = cases.select("company_id", F.lit("x").alias("company_name"), F.lit(1).cast("bigint").alias("legal_form_id"))
    for df in (gaps.missing_counts(tables), overview.document_completion_stats(tables)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan and "SortAggregate" not in plan
    hot = overview.document_completion_stats(tables).filter(F.col("case_id") == HOT).first()
    assert hot.total_documents == ROWS // 3


def test_owners_of_one_company(spark, cases):
    n = F.col("id")
    holdings = spark.range(ROWS, numPartitions=8).select(
        n.alias("ownership_id"),
        _hot(n).alias("company_id"),
        (n % 10 + 1).alias("ubo_id"),
        F.lit(30).cast("decimal(5,2)").alias("ownership_percentage"),
        F.lit(True).alias("is_ownership_direct"),
        F.lit(None).cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
    )
    tables = dict(world(spark))
    tables["ownership"] = holdings
    tables["company"] = frame(
        spark,
        "company",
        [dict(company_id=i, legal_form_id=1, company_name=f"C{i}") for i in range(6000)],
    )
    with large_scale_plans(spark):
        df = ownership.company_with_ubo(tables)
        rows = df.collect()
        plan = _final_plan(df)
    held = 1 + 5000 - 10 + 10  # the hot company and 10..5009
    assert sum(r.company_id == HOT for r in rows) == ROWS // 3
    assert len(rows) == ROWS + 6000 - len({r.company_id for r in rows if r.ubo_id is not None})
    assert held >= len({r.company_id for r in rows if r.ubo_id is not None})
    assert "skewed" in plan, plan


def test_questions_about_one_company(spark):
    """A third of all questions and of all holdings are about one company."""
    i = F.col("id")
    company = F.when(i % 3 == 0, HOT).otherwise(i % 500 + 10).cast("bigint")
    start = F.date_add(F.lit("2000-01-01").cast("date"), (i * 37 % 7000).cast("int"))
    questions = spark.range(6000, numPartitions=4).select(i.alias("question_id"), company.alias("company_id"), start.alias("day"))
    holdings = spark.range(1500, numPartitions=4).select(
        company.alias("company_id"),
        (i % 90).alias("ubo_id"),
        F.when(i % 7 == 0, 24).otherwise(25 + i % 50).cast("decimal(5,2)").alias("ownership_percentage"),
        F.when(i % 11 > 0, F.date_sub(start, 200)).alias("valid_from"),
        F.when(i % 5 > 0, F.date_add(start, (i % 900).cast("int"))).alias("valid_to"),
    )
    expected = questions.join(holdings, "company_id").where(
        "ownership_percentage >= 25 AND coalesce(valid_from <= day, true) AND coalesce(valid_to >= day, true)"
    )
    columns = ["question_id", "company_id", "day", "ubo_id", "ownership_percentage"]
    with large_scale_plans(spark):
        found = ownership.holdings_on_days(questions, {"ownership": holdings})
        rows = found.collect()
        plan = _final_plan(found)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, expected.select(columns).collect())) and len(rows) > 100_000
    sizes = found.groupBy("company_id", F.year("day")).count().agg(F.max("count")).first()[0]
    assert sizes < len(rows) / 10 and "SortMergeJoin" in plan
    assert ownership.holdings_on_days(questions.limit(0), {"ownership": holdings}).count() == 0
