"""Status changes as a stream: documents and checks follow as micro-batches arrive."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casewright.functions.text import text_eq
from casewright.operators.lifecycle import audit_checks, decisions, propagate_to_documents

Tables = Mapping[str, DataFrame]

CHANGE_SCHEMA = "request_id bigint, case_id bigint, old_status string, new_status string"
OUTPUTS = {
    "decided": "case_id bigint, old_status string, new_status string",
    "document_updates": "submitted_document_id bigint, case_id bigint, document_status string, "
    "verification_date date",
    "checks": "case_id bigint, external_source_id bigint, check_date date, check_status string, "
    "result_summary string",
}


def read_output(spark: SparkSession, out: str, name: str) -> DataFrame:
    """All micro-batches of one output, with their ``batch_id``."""
    return spark.read.schema(f"{OUTPUTS[name]}, batch_id bigint").parquet(f"{out}/{name}")


def follow_status_changes(
    changes: DataFrame, tables: Tables, out: str, checkpoint: str, as_of: dt.datetime, **trigger
) -> StreamingQuery:
    """Start a query that writes document updates and check rows under ``out``.

    Each micro-batch writes its own ``batch_id`` folder and overwrites it
    when it is run again, so a retry adds nothing twice. Only the first
    decision of a case has an effect, in this batch or any before it.
    """
    spark = changes.sparkSession
    for name, schema in OUTPUTS.items():
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{out}/{name}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        earlier = read_output(session, out, "decided").filter(F.col("batch_id") < batch_id)
        decided = decisions(batch, order="request_id").join(
            earlier.select("case_id"), "case_id", "left_anti"
        )
        folder = f"batch_id={batch_id}"
        decided.write.mode("overwrite").parquet(f"{out}/decided/{folder}")
        decided = session.read.schema(OUTPUTS["decided"]).parquet(f"{out}/decided/{folder}")
        pending = tables["submitted_documents"].filter(text_eq(F.col("document_status"), "Pending"))
        concerned = pending.join(decided.select("case_id"), "case_id", "left_semi")
        propagate_to_documents(concerned, decided, as_of).select(
            "submitted_document_id", "case_id", "document_status", "verification_date"
        ).write.mode("overwrite").parquet(f"{out}/document_updates/{folder}")
        audit_checks(decided, tables["external_verification_check"], as_of).write.mode(
            "overwrite"
        ).parquet(f"{out}/checks/{folder}")

    return (
        changes.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
