"""The workflow of each case as keyed state: submissions and status requests, one case after the other.

A state store keeps, per case that a request changed, its status, the types it still lacks and the documents it
took. About `TOGETHER` cases share a key of the store, so that a call of the store, a timer and a batch between
Spark and Python serve many requests; a key's requests travel in one value. A micro-batch reads its own requests and the
state of the keys of their cases, whose size is bounded by `TOGETHER`, so its state does not grow with what came
before. What cases start from is taken from the tables once, when the query first starts, and written beside the
outputs; it is joined to the requests before they reach their state, as are the known document types and the
reportable owners of the companies. A case without requests never enters the store.

With ``wait`` requests are taken in the order of ``requested_at``, not of arrival. The clock is the
latest ``received_at`` of the micro-batches before. A request waits in its case's state until the clock has
passed its time by ``wait``; a timer of its key then releases it after all earlier ones. One that arrives later than
that is late: it changes nothing and goes to an output of its own. Files must come in the order of ``received_at``. A request of the
kind ``clock`` asks for nothing, it only moves the clock. Without a time a request counts as made when it arrived.

A key's requests of one micro-batch are handled in one task, so the size of micro-batches (an option of
the source) bounds that task. A feed in which one case gets a large share is better served by
`request_feed`, which is set-based. Requests for cases that do not exist share no state: they are dealt out over
all keys and handled singly.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from casewright.functions.ids import id_slices, with_dense_ids
from casewright.functions.rules import ACCEPTS_DOCUMENTS, TRANSITIONS, is_live
from casewright.operators import lifecycle, submissions
from casewright.operators.gaps import missing_types, reportable_owners
from casewright.operators.workflow import STATUS, SUBMIT
from casewright.schema import CASE_STATUSES
from casewright.sources.shared import stored
from casewright.streaming.request_feed import REQUEST_SCHEMA

Tables = Mapping[str, DataFrame]

CLOCK, LATE = "clock", "LATE"
TIMED_SCHEMA = f"{REQUEST_SCHEMA}, requested_at timestamp, received_at timestamp"
OUTPUTS = {
    "verdicts": "request_id bigint, kind string, case_id bigint, code string, message string, "
    "new_document_id bigint, missing_after bigint, new_status string",
    "documents": "submitted_document_id bigint, case_id bigint, ubo_id bigint, document_type_id bigint, "
    "submission_date date, document_status string, verification_date date",
    "changes": "request_id bigint, case_id bigint, old_status string, new_status string",
    "late": "request_id bigint, kind string, case_id bigint, document_type_id bigint, ubo_id bigint, "
    "new_status string",
    # written last: a micro-batch without it is not complete
    "complete": "highest_document_id bigint",
}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Cases that share a key of the store, about, and the least number of keys.
TOGETHER, SPREAD = 1024, 64
#: Requests that are dealt out to their keys together, and those turned into Python's values at once.
BLOCK, SLICE = 1 << 18, 1 << 14
STORE = "spark.sql.streaming.stateStore.providerClass"

_NUMBER = {status: i for i, status in enumerate(CASE_STATUSES, 1)}
_ALLOWED = {(_NUMBER[s], _NUMBER[t]) for s, targets in TRANSITIONS.items() for t in targets}
_ACCEPTS = {_NUMBER[s] for s in ACCEPTS_DOCUMENTS}
_ASKED = (
    "requested", "request_id", "kind", "case_id", "document_type_id", "ubo_id", "new_status",
    "target", "known_type", "eligible", "state", "missing", "on_file", "known_case",
)
_HANDLED = (
    "request_id bigint, kind string, case_id bigint, document_type_id bigint, ubo_id bigint, new_status string, "
    "code string, met int, after int, missing_after bigint"
)
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_PACKED = "key bigint, earliest bigint, rows binary"
#: A request's time and number; its case, or case and number where the case does not exist.
_TURN = itemgetter(0, 1)


def _case(asked: tuple) -> object:
    return asked[3] if asked[13] else (asked[3], asked[1])


def _as_value(rows: list[tuple]) -> tuple[int | None, bytes]:
    """Requests as one value, and the earliest of their times."""
    return min(row[0] for row in rows) if rows[0][0] is not None else None, pickle.dumps(rows)


def _values(column: pa.ChunkedArray) -> list:
    """Python's values of a column, without a scalar of Arrow for each."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        # what cases lack comes in few kinds
        texts = pc.binary_join(pc.cast(column, pa.list_(pa.string())), ",").combine_chunks().dictionary_encode()
        values = [[*map(int, text.split(","))] if text else [] for text in texts.dictionary.to_pylist()]
    elif pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        texts = column.combine_chunks().dictionary_encode()
        values = texts.dictionary.to_pylist()
    else:
        empty = False if pa.types.is_boolean(column.type) else 0
        plain = pc.fill_null(column, empty).to_numpy().astype(object)
        plain[pc.is_null(column).to_numpy()] = None
        return plain.tolist()
    values.append(None)
    return [values[i] for i in pc.fill_null(texts.indices, len(values) - 1).to_numpy().tolist()]


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The requests of each key of a block as one value."""

    def dealt(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(block)
        table = table.filter(pc.fill_null(pc.not_equal(table["kind"], CLOCK), True))
        table = table.take(pc.sort_indices(table, [("key", "ascending")]))
        for low in range(0, table.num_rows, SLICE):
            part = table.slice(low, SLICE).combine_chunks()
            keys = part["key"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            rows = [*zip(*(_values(part[name]) for name in _ASKED), strict=True)]
            values = [_as_value(rows[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            earliest, packed = zip(*values, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[cuts[:-1]]), pa.array(earliest, pa.int64()), pa.array(packed, pa.binary())],
                ["key", "earliest", "rows"],
            )

    block, size = [], 0
    for batch in batches:
        block.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield from dealt(block)
            block, size = [], 0
    if block:
        yield from dealt(block)


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of `_HANDLED` from values of handled requests."""
    names, types = zip(*(c.split() for c in _HANDLED.split(", ")), strict=True)
    for batch in batches:
        for value in batch.column(0).to_pylist():
            columns = zip(*pickle.loads(value), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, _ARROW[t]) for c, t in zip(columns, types, strict=True)], names
            )


def _answer(row: tuple, code: str, met: int | None, after: int | None, missing: int | None = None) -> tuple:
    return *row[1:7], code, met, after, missing


class CaseWorkflow(StatefulProcessor):
    """Handles each case's requests in order, at arrival or once their time has passed by ``wait`` milliseconds."""

    def __init__(self, wait: int | None = None):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value a key, so that a call reads and writes it once: by case its status, missing types and documents
        self.cases = handle.getValueState("cases", "cases binary")
        self.waiting = handle.getListState("waiting", "earliest bigint, rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if self.wait is None:
            yield from _given(self._walk([asked for row in rows for asked in pickle.loads(row.rows)]))
            return
        late, early = self._split(((row.earliest, row.rows) for row in rows), timerValues.getCurrentWatermarkInMs())
        if early:
            self.waiting.appendList(early)
            self._wake(early)
        yield from _given([_answer(row, LATE, None, None) for row in late])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        due, later = self._split(self.waiting.get(), timerValues.getCurrentWatermarkInMs())
        if not due:
            return
        if later:
            self.waiting.put(later)
            self._wake(later)
        else:
            self.waiting.clear()
        # of a request that came twice the last one counts
        yield from _given(self._walk([*{(_case(row), _TURN(row)): row for row in due}.values()]))

    def _split(self, values: Iterable[tuple], clock: int) -> tuple[list[tuple], list[tuple]]:
        """The requests whose time the clock has passed by ``wait``, and the values of all others."""
        passed, others = [], []
        for earliest, value in values:
            if earliest + self.wait > clock:
                others.append((earliest, bytes(value)))
                continue
            rows = pickle.loads(value)
            passed += [row for row in rows if row[0] + self.wait <= clock]
            if left := [row for row in rows if row[0] + self.wait > clock]:
                others.append(_as_value(left))
        return passed, others

    def _wake(self, waiting: list[tuple]) -> None:
        """A timer for the earliest of them; when it goes off, the next one is set."""
        self.handle.registerTimer(min(earliest for earliest, _ in waiting) + self.wait)

    def close(self) -> None:
        pass

    def _walk(self, rows: list[tuple]) -> list[tuple]:
        """The answers to requests, of each case in order; the store has what they changed."""
        by_case: dict[object, list[tuple]] = defaultdict(list)
        for row in rows:
            by_case[_case(row)].append(row)
        held = self.cases.get() if rows else None
        cases, changed, answers = pickle.loads(held[0]) if held else {}, False, []
        for case, asked in by_case.items():
            asked.sort(key=_TURN)
            before = cases.get(case) or (*asked[0][10:12], [])
            after = _handled(asked, *before, answers)
            if after is not None:
                cases[case], changed = after, True
        if changed:
            self.cases.update((pickle.dumps(cases),))
        return answers


def _handled(asked: list[tuple], state: int | None, missing: list[int], documents: list[tuple], answers: list[tuple]) -> tuple | None:
    """What one case is after its requests, if they change it; their answers are appended."""
    before, taken = (state, missing), set(documents)
    for row in asked:
        _, _, kind, _, type_id, ubo_id, _, target, known_type, eligible, _, _, on_file, _ = row
        if kind == STATUS:
            code = "NOT_FOUND" if state is None else "ACCEPTED" if (state, target) in _ALLOWED else "INVALID"
            after = target if code == "ACCEPTED" else state
            answers.append(_answer(row, code, state, after))
            state = after
            continue
        if state is None:
            code = "CASE_NOT_FOUND"
        elif state not in _ACCEPTS:
            code = "CASE_STATUS"
        elif not known_type:
            code = "TYPE_NOT_FOUND"
        elif on_file or (type_id, ubo_id) in taken:
            code = "DUPLICATE"
        elif ubo_id is not None and not eligible:
            code = "UBO_NOT_REPORTABLE"
        else:
            taken.add((type_id, ubo_id))
            missing = [t for t in missing if t != type_id]
            after = _NUMBER["InReview"] if not missing and state == _NUMBER["Open"] else state
            answers.append(_answer(row, "ACCEPTED", state, after, len(missing)))
            state = after
            continue
        answers.append(_answer(row, code, state, state))
    if state is not None and ((state, missing) != before or len(taken) > len(documents)):
        return state, missing, [*taken]
    return None


def _given(answers: list[tuple]) -> Iterator[Row]:
    """Answers as values of bounded size."""
    for low in range(0, len(answers), SLICE):
        yield Row(rows=pickle.dumps(answers[low : low + SLICE]))


def initial_state(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """What the state of each case starts from: a row for each case, and its documents on file.

    Cases that are past submissions need no documents.
    """
    cases = tables["onboarding_case"].filter(F.col("case_status").isNotNull())
    state = lifecycle.state_number(F.col("case_status"))
    open_ = cases.filter(lifecycle.state_in(state, ACCEPTS_DOCUMENTS))
    none = F.array().cast("array<bigint>")
    lacking = missing_types(tables, open_)
    own = cases.select("case_id", state.alias("state")).join(lacking, "case_id", "left")
    documents = tables["submitted_documents"].filter(is_live(F.col("document_status")))
    documents = documents.join(open_.select("case_id"), "case_id", "left_semi")
    missing = F.coalesce("missing_types", none).alias("missing")
    start = own.groupBy("case_id").agg(F.max(F.struct("state", missing)).alias("_start"))
    return start.select("case_id", "_start.*"), documents.select("case_id", "document_type_id", "ubo_id").distinct()


def _started(tables: Tables, out: str) -> tuple[DataFrame, DataFrame]:
    """`initial_state` as of the first start of the query, kept beside its outputs."""
    spark = tables["onboarding_case"].sparkSession
    parts = []
    for name, rows in zip(("cases", "documents"), initial_state(tables), strict=True):
        path = f"{out}/start/{name}"
        try:
            parts.append(spark.read.schema(rows.schema).parquet(path))
        except AnalysisException:
            rows.write.parquet(path)
            parts.append(spark.read.schema(rows.schema).parquet(path))
    return parts[0], parts[1]


def _enriched(
    requests: DataFrame, tables: Tables, start: tuple[DataFrame, DataFrame], owners: DataFrame, keys: int
) -> DataFrame:
    """``requests`` with what their state does not hold, and its key, one of ``keys``."""
    cases = tables["onboarding_case"].filter(F.col("case_status").isNotNull()).select("case_id", "company_id")
    types = tables["document_type"].select("document_type_id").withColumn("known_type", F.lit(True))
    eligible = owners.select("company_id", "ubo_id", F.lit(True).alias("eligible"))
    known = cases.withColumn("known_case", F.lit(True))
    # both by case, one after the other: the requests are dealt out by case once
    joined = requests.join(known, "case_id", "left").join(start[0], "case_id", "left")
    joined = joined.join(types, "document_type_id", "left").join(eligible, ["company_id", "ubo_id"], "left")
    documents = start[1].select(*[F.col(c).alias(f"_{c}") for c in start[1].columns], F.lit(True).alias("on_file"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in start[1].columns]
    joined = joined.join(documents, same, "left")
    # requests without a case share no state
    dealt = F.when(F.col("known_case"), F.xxhash64("case_id")).otherwise(F.xxhash64("request_id"))
    return joined.select(
        *requests.columns,
        lifecycle.state_number(F.col("new_status")).alias("target"),
        "known_type",
        "eligible",
        "state",
        "missing",
        F.coalesce("on_file", F.lit(False)).alias("on_file"),
        F.coalesce("known_case", F.lit(False)).alias("known_case"),
        F.pmod(dealt, F.lit(keys)).alias("key"),
    )


@contextmanager
def _rocks(spark: SparkSession):
    """Keyed state of this kind lives in RocksDB; the setting is taken when a query starts."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def read_output(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One output of all complete micro-batches, with their ``batch_id``."""
    schema = f"{OUTPUTS[name]}, batch_id bigint"
    rows = spark.read.schema(schema).parquet(f"{out}/{name}")
    complete = spark.read.schema(f"{OUTPUTS['complete']}, batch_id bigint").parquet(f"{out}/complete")
    return rows.join(complete.select("batch_id").distinct(), "batch_id", "left_semi")


def follow_cases(
    requests: DataFrame,
    tables: Tables,
    out: str,
    checkpoint: str,
    as_of: dt.datetime,
    wait: dt.timedelta | None = None,
    owners: DataFrame | None = None,
    **trigger,
) -> StreamingQuery:
    """Start a query that handles requests (`REQUEST_SCHEMA`, with ``wait`` `TIMED_SCHEMA`) and writes `OUTPUTS`.

    A micro-batch writes its own ``batch_id`` folders, ``complete`` last, and overwrites them when it is run again.
    Document ids go on from the highest one that the micro-batch before left in ``complete``. ``owners`` are the
    `reportable_owners` of ``tables`` where the caller has them stored; otherwise each start stores them, so that
    micro-batches do not find them in all holdings again.
    """
    spark = requests.sparkSession
    for name, schema in OUTPUTS.items():
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{out}/{name}")
    tables = dict(tables)
    if wait is None:
        requests = requests.withColumn("requested", F.lit(None).cast("bigint"))
    else:
        requests = requests.withColumn("requested", F.unix_millis(F.coalesce("requested_at", "received_at"))).withWatermark("received_at", "0 seconds")
    start = _started(tables, out)
    # the same at each start, as what the query first started from stays
    keys = max(SPREAD, start[0].count() // TOGETHER)
    owners = stored(reportable_owners(tables), "reportable-owners") if owners is None else owners
    asked = _enriched(requests, tables, start, owners, keys).select("key", *_ASKED)
    handled = (
        asked.repartition("key")
        .mapInArrow(_packed, _PACKED)
        .groupBy("key")
        .transformWithState(
            CaseWorkflow(None if wait is None else wait // dt.timedelta(milliseconds=1)),
            "rows binary",
            "Append",
            "None" if wait is None else "EventTime",
        )
        .mapInArrow(_unpacked, _HANDLED)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = stored(batch, "handled-requests")
        answered = rows.filter(F.col("code") != LATE)
        accepted = (F.col("kind") == SUBMIT) & (F.col("code") == "ACCEPTED")
        if batch_id:
            last = session.read.schema(OUTPUTS["complete"]).parquet(f"{out}/complete/batch_id={batch_id - 1}")
            highest = last.agg(F.max("highest_document_id")).first()[0]
        else:
            highest = tables["submitted_documents"].agg(F.max("submitted_document_id")).first()[0] or 0
        taken = answered.filter(accepted).select("request_id")
        ids = with_dense_ids(taken, "request_id", "new_document_id", F.lit(highest), id_slices(taken, "request_id"))
        numbered = stored(answered.join(ids, "request_id", "left"), "numbered-requests")
        met = lifecycle.state_label(F.col("met"))
        message = F.when(F.col("kind") == SUBMIT, submissions.message(met)).otherwise(lifecycle.status_message(met))
        verdicts = numbered.select(
            "request_id",
            "kind",
            "case_id",
            "code",
            message.alias("message"),
            F.coalesce("new_document_id", F.lit(0)).alias("new_document_id"),
            "missing_after",
            F.when(F.col("code") == "ACCEPTED", lifecycle.state_name(F.col("after"))).alias("new_status"),
        )
        steps = numbered.filter(F.col("met") != F.col("after")).select(
            "request_id",
            "case_id",
            lifecycle.state_name(F.col("met")).alias("old_status"),
            lifecycle.state_name(F.col("after")).alias("new_status"),
        )
        results = {
            "verdicts": verdicts,
            "documents": submissions.documents_of(numbered.filter(accepted), as_of),
            "changes": steps,
            "late": rows.filter(F.col("code") == LATE).select([c.split()[0] for c in OUTPUTS["late"].split(", ")]),
            "complete": numbered.agg(
                F.coalesce(F.max("new_document_id"), F.lit(highest)).cast("bigint").alias("highest_document_id")
            ),
        }
        for name, frame in results.items():
            frame.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")

    with _rocks(spark):
        return (
            handled.writeStream.foreachBatch(write)
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
