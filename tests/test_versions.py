"""Versions of the tables: broken, repeated and competing runs; changes between versions."""

import pytest

from casewright.operators import capture, publishing
from casewright.schema import TABLES
from casewright.sources import versions
from casewright.sources.snapshots import shared_dir
from tests.sample import AS_OF, as_set, world


@pytest.fixture
def root(spark):
    path = shared_dir(spark, "versions")
    publishing.start(spark, path, "base", world(spark))
    return path


def _cases(spark, root):
    return as_set(versions.read_version(spark, root)["onboarding_case"], "case_id", "case_status")


def _requests(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id bigint, case_id bigint, new_status string")


def test_broken_run_leaves_the_version_before(spark, root, monkeypatch):
    before = _cases(spark, root)
    open_case = next(c for c, s in before if s == "Open")
    requests = _requests(spark, (1, open_case, "InReview"))

    def lost(*_):
        raise OSError("lost")

    # the run ends after the data and before its manifest
    with monkeypatch.context() as m:
        m.setattr(versions, "write_manifest", lost)
        with pytest.raises(OSError):
            publishing.update_status(spark, root, "statuses", requests, AS_OF)
    assert spark.read.parquet(f"{root}/data/statuses/onboarding_case").count() == len(before)
    assert _cases(spark, root) == before and versions.latest(spark, root).number == 1
    # data that a lost run has left is overwritten
    spark.range(3).write.mode("overwrite").parquet(f"{root}/data/statuses/onboarding_case")
    done = publishing.update_status(spark, root, "statuses", requests, AS_OF)
    assert done.number == 2 and _cases(spark, root) - before == {(open_case, "InReview")}
    assert publishing.update_status(spark, root, "statuses", requests, AS_OF) == done
    assert versions.latest(spark, root) == done
    assert as_set(versions.read_version(spark, root, 1)["onboarding_case"], "case_id", "case_status") == before


def test_competing_runs(spark, root):
    base = versions.latest(spark, root)
    cases = versions.read_version(spark, root)["onboarding_case"]
    versions.publish(spark, root, "b", base, replaced={"onboarding_case": cases.limit(1)})
    with pytest.raises(versions.Conflict):
        versions.publish(spark, root, "c", base, replaced={"onboarding_case": cases.limit(2)})
    # both looked before either had published: the manifest that was there first has the number
    late = [("a", 1, "onboarding_case", base.folders["onboarding_case"][0])]
    versions.write_manifest(spark.createDataFrame(late, versions.MANIFEST), root, 2)
    assert versions.latest(spark, root).run_id == "b" and versions.published(spark, root, "a") is None
    with pytest.raises(KeyError):
        versions.version(spark, root, 9)


def test_appended_rows_are_a_folder(spark, root):
    old = versions.latest(spark, root)
    one = versions.read_version(spark, root)["onboarding_case"].first()
    documents = spark.createDataFrame(
        [(900, one.case_id, None, 1, None, "Pending", None)], TABLES["submitted_documents"].struct
    )
    new = versions.publish(spark, root, "more", old, appended={"submitted_documents": documents})
    before, after = capture.version_sides(spark, root, old, new, "submitted_documents")
    assert before.count() == 0 and after.count() == 1
    found = capture.version_changes(spark, root, old, new, "submitted_documents").collect()
    assert [(r.submitted_document_id, r.change, r.n_old, r.n_new) for r in found] == [(900, "insert", 0, 1)]
    assert capture.version_changes(spark, root, old, new, "company").count() == 0


def test_changes_of_rows(spark):
    schema = "k bigint, a string, b string"
    before = [(1, "x", None), (2, "x", ""), (3, None, "y"), (4, "p", "q"), (4, "p", "q"), (None, "n", "n"), (6, "s", "s")]
    after = [(1, None, "x"), (2, "x", None), (3, None, "y"), (4, "p", "q"), (5, "z", "z"), (None, "m", "n"), (6, "s", "s"), (6, "s", "s")]
    found = capture.table_changes(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), "k")
    assert {(r.k, r.change, r.n_old, r.n_new) for r in found.collect()} == {
        (1, "update", 1, 1),
        (2, "update", 1, 1),
        (4, "delete", 1, 0),
        (5, "insert", 0, 1),
        (None, "update", 1, 1),
        (6, "insert", 0, 1),
    }
    empty = spark.createDataFrame([], schema)
    assert capture.table_changes(empty, empty, "k").count() == 0


def test_spelling_is_no_status_change(spark):
    schema = "case_id bigint, case_status string"
    before = spark.createDataFrame([(1, "Open"), (2, "Open"), (3, None), (4, None)], schema)
    after = spark.createDataFrame([(1, "open "), (2, "Rejected"), (3, "Open"), (4, None)], schema)
    changes = capture.status_changes(before, after)
    assert as_set(changes, "case_id", "old_status", "new_status") == {(2, "Open", "Rejected"), (3, None, "Open")}
