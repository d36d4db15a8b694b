"""Changes between two versions of a table, and what they set off.

Rows are compared by a digest of all their columns, NULLs included, so only key and digest are shuffled. Rows
count as many times as they stand in a table: keys may repeat. A key that only lost rows is deleted, one that only
gained rows is inserted, one with both is updated. Folders that two versions share are not read at all.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.text import text_eq
from casewright.operators import lifecycle
from casewright.schema import TABLES
from casewright.sources.shared import stored
from casewright.sources.versions import Version, read_folders

Tables = Mapping[str, DataFrame]

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def row_digest(columns: list[str]) -> Column:
    """A digest of a row that tells NULL from every text and minds the order of columns."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def _net(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(``key``, ``digest``, ``n``): how many more rows of that content ``after`` has."""
    columns = sorted(before.columns)
    sides = [
        side.select(key, row_digest(columns).alias("digest"), F.lit(sign).alias("n")) for side, sign in ((before, -1), (after, 1))
    ]
    return sides[0].union(sides[1]).groupBy(key, "digest").agg(F.sum("n").alias("n")).where("n <> 0")


def table_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(``key``, ``change``, ``n_old``, ``n_new``): the changed keys, with the rows that went and came."""
    lost, gained = (F.sum(F.greatest(n, F.lit(0))).cast("bigint") for n in (-F.col("n"), F.col("n")))
    found = _net(before, after, key).groupBy(key).agg(lost.alias("n_old"), gained.alias("n_new"))
    change = F.when(F.col("n_old") == 0, INSERT).when(F.col("n_new") == 0, DELETE).otherwise(UPDATE)
    return found.select(key, change.alias("change"), "n_old", "n_new")


def version_sides(spark: SparkSession, root: str, old: Version, new: Version, table: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a table that only the old and only the new version's folders hold."""
    mine, other = (set(v.folders.get(table, ())) for v in (old, new))
    return tuple(read_folders(spark, root, table, tuple(sorted(f))) for f in (mine - other, other - mine))


def version_changes(spark: SparkSession, root: str, old: Version, new: Version, table: str) -> DataFrame:
    """`table_changes` of a table between two versions."""
    before, after = version_sides(spark, root, old, new, table)
    return table_changes(before, after, TABLES[table].key)


def status_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases of both sides whose status differs: (case_id, old_status, new_status). Spelling alone is no change."""
    changed = stored(table_changes(before, after, "case_id").where(F.col("change") == UPDATE).select("case_id"), "changed")
    old, new = (
        side.join(changed, "case_id", "left_semi").select("case_id", F.col("case_status").alias(name))
        for side, name in ((before, "old_status"), (after, "new_status"))
    )
    same = F.coalesce(text_eq(F.col("old_status"), F.col("new_status")), F.col("old_status").eqNullSafe(F.col("new_status")))
    return old.join(new, "case_id").where(~same)


def follow_versions(
    spark: SparkSession, root: str, old: Version, new: Version, as_of: dt.datetime
) -> tuple[dict[str, DataFrame], DataFrame]:
    """What the status changes between two versions set off on documents and checks, and the steps not allowed.

    Only the first and the last status of a case are known, so steps between them have no effect.
    """
    changes = stored(status_changes(*version_sides(spark, root, old, new, "onboarding_case")), "captured")
    decided = lifecycle.decisions(changes)
    documents, checks = (
        read_folders(spark, root, t, new.folders.get(t, ())) for t in ("submitted_documents", "external_verification_check")
    )
    tables = {
        "submitted_documents": lifecycle.propagate_to_documents(documents, decided, as_of),
        "external_verification_check": lifecycle.with_new_checks(checks, lifecycle.audit_checks(decided, checks, as_of)),
    }
    return tables, lifecycle.illegal_transitions(changes)
