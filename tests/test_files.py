"""Loading, appending, emptying, snapshots, layouts, the SQL surface and the stream."""

import hashlib

import pytest
from pyspark.sql import functions as F

from casewright.functions.sql_surface import register_functions, register_views
from casewright.operators import archive, lifecycle, overview
from casewright.schema import NO_DEFAULT, TABLES
from casewright.sources.snapshots import restore, shared_dir, snapshot, snapshot_path
from casewright.sources import snapshots
from casewright.sources.tables import append, load, load_checked, lookup, purge, row_counts, with_defaults
from casewright.streaming.status_changes import CHANGE_SCHEMA, follow_status_changes, read_output
from tests.sample import AS_OF, as_set, world

EXPECTED_COUNTS = [6, 13, 12, 24, 10, 15, 7, 11, 12, 10, 6, 5]


def test_defaults_fill_absent_columns_only(spark):
    table = TABLES["ownership"]
    rows = spark.createDataFrame([(1, 2, None)], "company_id bigint, ubo_id bigint, ownership_percentage decimal(5,2)")
    row = with_defaults(rows, table, AS_OF).first()
    assert row.ownership_percentage is None and row.is_ownership_direct is True and row.valid_to is None
    case = with_defaults(spark.createDataFrame([(1,)], "company_id bigint"), TABLES["onboarding_case"], AS_OF).first()
    assert (case.case_status, case.case_open_date, case.case_id) == ("Open", AS_OF.date(), None)
    with pytest.raises(ValueError):
        with_defaults(rows.withColumn("colour", F.lit(1)), table, AS_OF)
    defaults = [c for t in TABLES.values() for c in t.columns if c.default is not NO_DEFAULT]
    assert len(defaults) == 17


def test_snapshot_restore_append_purge(spark):
    tables = world(spark)
    base = shared_dir(spark, "files")
    path = snapshot_path(f"{base}/backup", AS_OF)
    assert path.endswith("backup_20260301")
    snapshot(tables, path)
    snapshot(tables, path)
    live = restore(spark, path, f"{base}/live")
    assert [r.n for r in row_counts(live).collect()] == EXPECTED_COUNTS
    more = spark.createDataFrame([(13, "Late")], "company_id bigint, company_name string")
    append(more, TABLES["company"], f"{base}/live", AS_OF)
    unnumbered = spark.createDataFrame([(1, 9), (2, 5)], "company_id bigint, asked bigint")
    append(unnumbered, TABLES["onboarding_case"], f"{base}/live", AS_OF, order="asked")
    cases = load(spark, f"{base}/live")["onboarding_case"]
    assert as_set(cases.filter("case_id > 12"), "case_id", "company_id") == {(13, 2), (14, 1)}
    append(unnumbered.drop("asked"), TABLES["onboarding_case"], f"{base}/live", AS_OF)
    assert as_set(load(spark, f"{base}/live")["onboarding_case"].filter("case_id > 14"), "case_id") == {(15,), (16,)}
    company = load(spark, f"{base}/live")["company"]
    assert company.count() == 13
    assert company.filter("company_id = 13").first().registration_date == AS_OF.date()
    purge(spark, f"{base}/live")
    assert [r.n for r in row_counts(load(spark, f"{base}/live")).collect()] == [0] * 12
    again = restore(spark, path, f"{base}/live")
    assert [r.n for r in row_counts(again).collect()] == EXPECTED_COUNTS


def test_load_csv(spark):
    base = shared_dir(spark, "csv")
    for name, df in world(spark).items():
        df.write.option("header", True).csv(f"{base}/{name}")
    tables = load(spark, base, "csv")
    assert [r.n for r in row_counts(tables).collect()] == EXPECTED_COUNTS
    assert tables["ownership"].exceptAll(world(spark)["ownership"]).count() == 0


def test_load_checked_csv(spark):
    base = shared_dir(spark, "csv")
    for name, df in world(spark).items():
        df.write.option("header", True).csv(f"{base}/{name}")
    bad = [("91", "1", "1", "abc", "true", None, None), ("92", "1", "1", "1000.5", "maybe", None, None),
           ("93", "1", "1", "30", "true", "2025-13-01", None)]
    columns = [c.name for c in TABLES["ownership"].columns]
    spark.createDataFrame(bad, ", ".join(f"{c} string" for c in columns)).write.mode("append").option("header", True).csv(
        f"{base}/ownership"
    )
    tables, rejects = load_checked(spark, base)
    assert [r.n for r in row_counts(tables).collect()] == EXPECTED_COUNTS
    assert tables["ownership"].exceptAll(world(spark)["ownership"]).count() == 0
    assert as_set(rejects, "row_key", "column_name", "value") == {
        ("91", "ownership_percentage", "abc"), ("92", "ownership_percentage", "1000.5"),
        ("92", "is_ownership_direct", "maybe"), ("93", "valid_from", "2025-13-01"),
    }


def test_malformed_lines(spark, tmp_path):
    base = shared_dir(spark, "csv")
    for name, df in world(spark).items():
        df.write.option("header", True).csv(f"{base}/{name}")
    header = ",".join(c.name for c in TABLES["company"].columns)
    width = len(TABLES["company"].columns)
    lines = [header, "901,2", "902" + "," * width, '903,"open' + "," * (width - 2), ""]
    folder = base.removeprefix("file:")
    with open(f"{folder}/company/broken.csv", "w") as file:
        file.write("\n".join(lines))
    tables, rejects = load_checked(spark, base)
    assert [r.n for r in row_counts(tables).collect()] == EXPECTED_COUNTS
    assert as_set(rejects, "table_name", "row_key", "column_name", "value") == {
        ("company", line.split(",")[0], None, line) for line in lines[1:4]
    }


def _digest_set(frame):
    return as_set(frame, "table_name", "bucket", "n", "low", "high")


def test_snapshot_of_changes(spark):
    base, tables = shared_dir(spark, "changes"), world(spark)
    first = snapshots.snapshot_changes(tables, f"{base}/1")
    assert {r.held_in for r in first.collect()} == {f"{base}/1"}
    # another order and other files: the same digests
    shuffled = {n: df.repartition(5).sortWithinPartitions(F.rand(3)) for n, df in tables.items()}
    assert _digest_set(snapshots.digests(shuffled)) == _digest_set(first)
    one = F.col("case_id") == 3
    changed = tables["onboarding_case"].withColumn("case_status", F.when(one, "Closed").otherwise(F.col("case_status")))
    second = snapshots.snapshot_changes(tables | {"onboarding_case": changed}, f"{base}/2", f"{base}/1")
    moved = second.where(F.col("held_in") == f"{base}/2").collect()
    assert [(r.table_name, r.bucket) for r in moved] == [("onboarding_case", 3)]
    restored = snapshots.restore_changes(spark, f"{base}/2")
    assert restored["onboarding_case"].exceptAll(changed).count() == 0
    assert [r.n for r in row_counts(restored).collect()] == EXPECTED_COUNTS
    # a row less in a file of the first snapshot
    restored["ubo"].limit(1).withColumn("bucket", F.lit(0).cast("long")).write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/1/ubo")
    with pytest.raises(snapshots.Damaged):
        snapshots.restore_changes(spark, f"{base}/2")


def test_digest_tells_null_from_text(spark):
    rows = [(1, None, "a|b"), (1, "-", "a|b"), (1, "", "a|b"), (1, "a", "|b")]
    frames = [spark.createDataFrame([(k, 1, x, None, y, "t")], "external_source_id bigint, c int, source_name string, d int, source_country string, source_type string") for k, x, y in rows]
    found = {tuple(snapshots.table_digests(f, "external_source").first()) for f in frames}
    assert len(found) == len(rows)


def test_lookup(spark):
    tables = world(spark)
    assert as_set(lookup(tables["onboarding_case"], case_status="open "), "case_id") == {(2,), (5,), (8,), (10,), (12,)}
    assert lookup(tables["submitted_documents"], case_id=3, document_status="PENDING").count() == 2
    assert lookup(tables["ubo"], last_name="läst1").count() == 0


def test_jurisdictions_and_archive(spark):
    tables = world(spark)
    base = shared_dir(spark, "layout")
    archive.write_cases_by_jurisdiction(tables, f"{base}/by_country")
    schema = overview.onboarding_overview(tables).schema
    written = spark.read.schema(schema).parquet(f"{base}/by_country")
    assert written.filter("country_code = 'C1'").count() == 2 and written.count() == 12
    after = tables["onboarding_case"].withColumn(
        "case_status", F.when(F.col("case_id") < 4, "closed").otherwise(F.col("case_status"))
    )
    for _ in range(2):
        archive.archive_closed_cases({**tables, "onboarding_case": after}, f"{base}/running", f"{base}/archive", "1")
    assert archive.read_archive(spark, f"{base}/archive", "onboarding_case").count() == 3
    assert archive.read_archive(spark, f"{base}/archive", "submitted_documents").count() == 5
    assert spark.read.parquet(f"{base}/running/onboarding_case").count() == 9
    assert spark.read.parquet(f"{base}/running/submitted_documents").count() == 5


def test_sql_surface(spark):
    register_views(spark, world(spark), AS_OF)
    register_functions(spark)
    got = spark.sql(
        "SELECT case_id, case_status_label(case_status) l, count_missing_mandatory_docs(case_id) m, "
        "count_missing_mandatory_docs(case_id + 500) x FROM onboarding_case WHERE case_id IN (1, 2)"
    )
    assert as_set(got, "case_id", "l", "m", "x") == {
        (1, "Genehmigt", 0, 0),
        (2, "Offen – wartet auf Dokumente", 1, 0),
    }
    flags = spark.sql("SELECT is_ubo_reportable(24.995) a, is_ubo_reportable(24.99) b, is_ubo_reportable(NULL) c")
    assert tuple(flags.first()) == (True, False, False)
    owners = spark.sql("SELECT u.ubo_id, u.is_reportable FROM ubos_by_company(3) u")
    assert {tuple(r) for r in owners.collect()} == {(3, True), (2, True)}
    assert spark.sql("SELECT * FROM document_completion_stats").count() == 5


def test_shared_dir_needs_a_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(base) and shared_dir(spark, "x") != shared_dir(spark, "x")


CHANGES = [
    (1, 2, "Open", "InReview"),
    (2, 3, "InReview", "Approved"),
    (3, 2, "InReview", "Rejected"),
    (4, 3, "Approved", "Rejected"),  # a direct update after the decision: no further effect
    (5, 7, "InReview", "rejected"),
    (6, 7, "rejected", "Closed"),
    (7, 1, "Open", "Approved"),  # has checks and nothing pending
]


def _stream(spark, tables, out, checkpoint, feed):
    source = spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed)
    follow_status_changes(source, tables, out, checkpoint, AS_OF).awaitTermination()


def test_stream_equals_batch(spark):
    tables = world(spark)
    base = shared_dir(spark, "stream")
    changes = spark.createDataFrame(CHANGES, CHANGE_SCHEMA)
    feed, out = f"{base}/feed", f"{base}/out"
    changes.filter("request_id <= 3").coalesce(1).write.mode("append").parquet(feed)
    _stream(spark, tables, out, f"{base}/cp", feed)
    changes.filter("request_id > 3").coalesce(1).write.mode("append").parquet(feed)
    _stream(spark, tables, out, f"{base}/cp", feed)

    decided = lifecycle.decisions(changes, order="request_id")
    checks = lifecycle.audit_checks(decided, tables["external_verification_check"], AS_OF)
    streamed = read_output(spark, out, "checks")
    assert streamed.drop("batch_id").exceptAll(checks).count() == 0
    assert streamed.count() == checks.count() == 3
    documents = lifecycle.propagate_to_documents(tables["submitted_documents"], decided, AS_OF)
    columns = ["submitted_document_id", "case_id", "document_status", "verification_date"]
    changed = documents.exceptAll(tables["submitted_documents"]).select(columns)
    updates = read_output(spark, out, "document_updates").drop("batch_id")
    assert updates.exceptAll(changed).count() == 0 and updates.count() == changed.count() == 3
    assert read_output(spark, out, "decided").select("batch_id").distinct().count() == 2


def test_stream_batch_run_again_adds_nothing(spark):
    """A second query without the first one's checkpoint replays batch 0 over its own output."""
    tables = world(spark)
    base = shared_dir(spark, "replay")
    feed, out = f"{base}/feed", f"{base}/out"
    spark.createDataFrame(CHANGES, CHANGE_SCHEMA).coalesce(1).write.parquet(feed)
    _stream(spark, tables, out, f"{base}/cp1", feed)
    first = {n: read_output(spark, out, n).collect() for n in ("checks", "document_updates")}
    _stream(spark, tables, out, f"{base}/cp2", feed)
    for name, rows in first.items():
        assert sorted(map(str, read_output(spark, out, name).collect())) == sorted(map(str, rows))


def test_archive_moves_rows_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (3, "d")], "case_id bigint, v string")
    ids = spark.createDataFrame([(1, True), (None, True), (4, True)], "case_id bigint, _closed boolean")
    archived, kept = archive._split(rows, ids)
    assert sorted(r.v for r in archived.collect()) == ["a", "a"]
    assert sorted(r.v for r in kept.collect()) == ["b", "c", "d"]
    assert archived.columns == rows.columns == kept.columns
    # both are read from files: the join has run
    assert all("Join" not in part._jdf.queryExecution().toString() for part in (archived, kept))


def test_tables_without_changes_are_read_once_for_a_snapshot(spark):
    base, tables = shared_dir(spark, "unchanged"), world(spark)
    snapshots.snapshot_changes(tables, f"{base}/1")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ubo = tables["ubo"]
    again = snapshots.snapshot_changes(tables | {"ubo": ubo.mapInArrow(counted, ubo.schema)}, f"{base}/2", f"{base}/1")
    assert {r.held_in for r in again.collect()} == {f"{base}/1"}
    assert seen.value == ubo.count()


def test_digest_sums_of_many_rows_are_exact(spark):
    rows = [(i * snapshots.BUCKETS, i, "a", None, "b", "t") for i in range(500)]
    schema = "external_source_id bigint, c int, source_name string, d int, source_country string, source_type string"
    got = snapshots.table_digests(spark.createDataFrame(rows, schema), "external_source").collect()
    columns = [c.name for c in snapshots.TABLES["external_source"].columns]
    names = [c.split()[0] for c in schema.split(", ")]

    def told(row):
        values = [dict(zip(names, row))[c] for c in columns]
        return "|".join("-" if v is None else f"{len(str(v))}:{v}" for v in values)

    md5 = [hashlib.md5(told(row).encode()).hexdigest() for row in rows]
    low, high = (str(sum(int(m[k : k + 15], 16) for m in md5)) for k in (0, 15))
    assert [tuple(r) for r in got] == [("external_source", 0, len(rows), low, high)]
