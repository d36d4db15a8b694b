"""Submissions and status requests as a stream."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casewright.functions.text import text_eq
from casewright.operators import lifecycle
from casewright.operators.workflow import run_requests

Tables = Mapping[str, DataFrame]

REQUEST_SCHEMA = (
    "request_id bigint, kind string, case_id bigint, document_type_id bigint, ubo_id bigint, new_status string"
)
OUTPUTS = {
    "verdicts": "request_id bigint, kind string, case_id bigint, code string, message string, "
    "new_document_id bigint, missing_after bigint, new_status string",
    "documents": "submitted_document_id bigint, case_id bigint, ubo_id bigint, document_type_id bigint, "
    "submission_date date, document_status string, verification_date date",
    "changes": "request_id bigint, case_id bigint, old_status string, new_status string",
    "document_updates": "submitted_document_id bigint, case_id bigint, document_status string, "
    "verification_date date",
    "checks": "case_id bigint, external_source_id bigint, check_date date, check_status string, "
    "result_summary string",
}


def read_output(spark: SparkSession, out: str, name: str) -> DataFrame:
    """All micro-batches of one output, with their ``batch_id``."""
    return spark.read.schema(f"{OUTPUTS[name]}, batch_id bigint").parquet(f"{out}/{name}")


def current_tables(spark: SparkSession, tables: Tables, out: str, before_batch: int) -> dict[str, DataFrame]:
    """``tables`` with what the batches before ``before_batch`` added.

    New documents stay Pending here: those of a decided case are listed in
    ``document_updates``, and such a case takes no more submissions.
    """
    earlier = {
        name: read_output(spark, out, name).filter(F.col("batch_id") < before_batch)
        for name in ("documents", "changes", "checks")
    }
    place = F.struct("batch_id", "request_id")
    latest = (
        earlier["changes"]
        .groupBy("case_id")
        .agg(F.max_by("new_status", place).alias("new_status"))
    )
    return dict(tables) | {
        "onboarding_case": lifecycle.with_status(tables["onboarding_case"], latest),
        "submitted_documents": tables["submitted_documents"].unionByName(
            earlier["documents"].drop("batch_id")
        ),
        "external_verification_check": tables["external_verification_check"].unionByName(
            earlier["checks"].drop("batch_id"), allowMissingColumns=True
        ),
    }


def follow_requests(
    requests: DataFrame, tables: Tables, out: str, checkpoint: str, as_of: dt.datetime, **trigger
) -> StreamingQuery:
    """Start a query that handles request micro-batches and writes `OUTPUTS` under ``out``.

    Requests of a micro-batch are handled in request_id order, micro-batches
    in order of arrival, so a late request meets the status its case has by
    then. State is the base tables plus the outputs so far: a batch only adds
    its own ``batch_id`` folders, and overwrites them when it is run again.
    """
    spark = requests.sparkSession
    for name, schema in OUTPUTS.items():
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{out}/{name}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        now = current_tables(session, tables, out, batch_id)
        outcome = run_requests(batch, now, as_of)

        def write(name: str, df: DataFrame) -> DataFrame:
            path = f"{out}/{name}/batch_id={batch_id}"
            df.write.mode("overwrite").parquet(path)
            return session.read.schema(OUTPUTS[name]).parquet(path)

        write("verdicts", outcome.verdicts)
        added = write("documents", outcome.new_documents)
        decided = lifecycle.decisions(write("changes", outcome.changes))
        documents = now["submitted_documents"].unionByName(added)
        concerned = documents.filter(text_eq(F.col("document_status"), "Pending")).join(
            decided.select("case_id"), "case_id", "left_semi"
        )
        updated = lifecycle.propagate_to_documents(concerned, decided, as_of)
        write(
            "document_updates",
            updated.select("submitted_document_id", "case_id", "document_status", "verification_date"),
        )
        write("checks", lifecycle.audit_checks(decided, now["external_verification_check"], as_of))

    return (
        requests.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
