"""Versions of the tables: data first, a manifest last.

A table of a version is a list of folders. A run writes its folders under its own name and then publishes one
manifest file, which lists the folders of all tables; readers only follow manifests. So a run that
ends early leaves the version before it as it was, and one that is repeated writes the same folders again or,
once it is published, nothing at all. Appended rows add a folder; other folders stay where they are.

Two runs that start from the same version both claim the next number. The manifest that was written first has
it (of the same moment the first run in the order of names); the other run gets `Conflict` and has to be run again
on the new version.

    root/data/<run>/<table>      root/manifest/version=<n>/
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.schema import TABLES

MANIFEST = "run_id string, base bigint, table_name string, folder string"


class Conflict(RuntimeError):
    """Another run has published the next version first."""


@dataclass(frozen=True)
class Version:
    """What a version consists of: the folders of each table, below the root."""

    number: int = 0
    run_id: str = ""
    folders: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    """All rows of all manifests; of runs that claim one number the first one counts."""
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(f"{root}/manifest")
    rows = spark.read.schema(f"{MANIFEST}, version bigint").parquet(f"{root}/manifest")
    rows = rows.select("*", F.col("_metadata.file_modification_time").alias("written")).where("version IS NOT NULL")
    first = rows.groupBy("version").agg(F.min(F.struct("written", "run_id"))["run_id"].alias("run_id"))
    return rows.join(F.broadcast(first), ["version", "run_id"], "left_semi")  # one row per version


def _version(rows: DataFrame, number: int) -> Version:
    # as many rows as a version has folders
    held = rows.where(F.col("version") == number).orderBy("table_name", "folder").collect()
    folders: dict[str, tuple[str, ...]] = {}
    for r in held:
        folders[r.table_name] = (*folders.get(r.table_name, ()), r.folder)
    return Version(number, held[0].run_id if held else "", folders)


def latest(spark: SparkSession, root: str) -> Version:
    """The last published version; number 0 without any."""
    rows = _manifests(spark, root)
    return _version(rows, rows.agg(F.max("version")).first()[0] or 0)


def version(spark: SparkSession, root: str, number: int) -> Version:
    found = _version(_manifests(spark, root), number)
    if not found.folders:
        raise KeyError(f"{root} has no version {number}")
    return found


def read_folders(spark: SparkSession, root: str, table: str, folders: tuple[str, ...]) -> DataFrame:
    reader = spark.read.schema(TABLES[table].struct)
    return reader.parquet(*[f"{root}/{f}" for f in folders]) if folders else spark.createDataFrame([], TABLES[table].struct)


def read_version(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """All tables of a version, the last one by default."""
    found = latest(spark, root) if number is None else version(spark, root, number)
    return {name: read_folders(spark, root, name, found.folders.get(name, ())) for name in TABLES}


def published(spark: SparkSession, root: str, run_id: str) -> Version | None:
    """The version that a run has published, if it has."""
    rows = _manifests(spark, root)
    number = rows.where(F.col("run_id") == run_id).agg(F.max("version")).first()[0]
    return None if number is None else _version(rows, number)


def write_manifest(rows: DataFrame, root: str, number: int) -> None:
    """One file, so that it appears at once."""
    rows.coalesce(1).write.mode("append").parquet(f"{root}/manifest/version={number}")


def publish(
    spark: SparkSession,
    root: str,
    run_id: str,
    base: Version,
    replaced: Mapping[str, DataFrame] | None = None,
    appended: Mapping[str, DataFrame] | None = None,
) -> Version:
    """The version after ``base``, in which some tables are replaced and others have more rows.

    A run that is published already changes nothing; one that is run again before that starts over.
    """
    done = published(spark, root, run_id)
    if done is not None:
        return done
    if latest(spark, root).number != base.number:
        raise Conflict(f"version {base.number} is not the last one any more")
    folders = dict(base.folders)
    for keeps, tables in ((False, replaced or {}), (True, appended or {})):
        for name, rows in tables.items():
            folder = f"data/{run_id}/{name}{'-added' if keeps else ''}"
            rows.select([c.name for c in TABLES[name].columns]).write.mode("overwrite").parquet(f"{root}/{folder}")
            folders[name] = (*(folders.get(name, ()) if keeps else ()), folder)
    listed = [(run_id, base.number, name, f) for name, some in folders.items() for f in some]
    write_manifest(spark.createDataFrame(listed, MANIFEST), root, base.number + 1)
    done = published(spark, root, run_id)
    if done is None:
        raise Conflict(f"another run has published version {base.number + 1}")
    return done
