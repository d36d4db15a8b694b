"""Quality by co-training two views of a document.

The content view sees hashed words and shape statistics of the whole text. The metadata view sees language,
source and length. Each view has a logistic model, fitted on a bounded sample of labelled rows. In each
round both models label all other rows in Spark, and each hands its most confident ones of either class, a
fixed share of these rows, to the other's training set. The threshold of that share is the exact order statistic of
the log-odds of all of them: histograms of more and more of their bits are counted in Spark, and only counts reach the
driver. What the views see of the rows is stored once and read in each round. Every task learns from the rows handed on
among its own, as many as the labelled sample has at a time and together with it, and returns the changes of the weights, a vector of fixed size; their mean, by
how often a weight was used, moves the model. A row stays where the first round put it, which later rounds find again
by the models of the rounds before. At the end each model's log-odds are calibrated (slope and
intercept) on labelled rows that neither was trained on, and the calibrated log-odds are added, the
prior counted once. All documents are scored in one pass without a shuffle.

Defined results: a NULL or empty text has only the statistics of an empty text; NULL metadata are a value of
their own; NULL labels are not used, and of repeated labels of a key the highest counts; without labels every
score is 0.5; repeated or NULL keys keep a row each; an empty table gives no rows. Labels and the key never
enter a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import IN_WORD, blocks, remainder, stored, text_bytes, word_hashes

BUCKETS, META_BUCKETS, SHAPES = 1 << 15, 1 << 10, 24
#: Labelled rows of each class (of quality 0 and 1), by smallest hash.
SAMPLE = (2000, 2500)
#: Bits of a log-odds that a histogram tells apart, and the number of rows from which on it tells all of them apart.
BITS, POOL = 16, 4000
#: Rows whose stored bags are unpacked at once.
UNPACKED = 512
#: Rounds, and the share of all rows that each view hands on of each class in a round.
ROUNDS, SHARE, EPOCHS, BATCH, RATE = 4, 0.025, 6, 64, 0.02
HELD_OUT, CALIBRATION = 5, 4
#: Parts in which a view's changes are added, so that the vectors of many tasks stay small in one.
PARTS = 32

Bag = tuple[np.ndarray, np.ndarray]


def content_bags(texts: pa.Array) -> list[Bag]:
    """Words by the root of their number, and shape statistics in quarters of their range."""
    out = []
    for own, times, levels in content_counts(texts):
        weight = np.sqrt(times)
        out.append(
            (
                np.concatenate([own, levels]).astype(np.int32),
                np.concatenate([weight / max(1e-9, np.linalg.norm(weight)), np.ones(len(levels))]).astype(np.float32),
            )
        )
    return out


def content_counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, list[int]]]:
    """The words of each text, how often each occurs, and the levels of its shape statistics."""
    data, at = text_bytes(texts)
    words, word_at = word_hashes(texts)
    bucket = (words & np.uint64(BUCKETS - 1)).astype(np.int64)
    kinds = {
        "word": IN_WORD[data], "digit": (data >= 48) & (data <= 57), "upper": (data >= 65) & (data <= 90),
        "line": data == 10, "high": data >= 128,
    }
    sums = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in kinds.items()}
    out = []
    for i in range(len(texts)):
        own, times = np.unique(bucket[word_at[i] : word_at[i + 1]], return_counts=True)
        n, size = max(1, int(times.sum())), max(1, int(at[i + 1] - at[i]))
        shape = [
            *((sums[k][at[i + 1]] - sums[k][at[i]]) / size for k in kinds),
            len(own) / n, float(times.max(initial=0)) / n, min(1.0, np.log1p(n) / 12), min(1.0, size / n / 20),
        ]
        out.append((own, times, [BUCKETS + SHAPES * k + min(SHAPES - 1, int(s * SHAPES)) for k, s in enumerate(shape)]))
    return out


def metadata_bags(lang: list, source: list, n_chars: list) -> list[Bag]:
    out = []
    for a, b, n in zip(lang, source, n_chars, strict=True):
        size = -1 if n is None else int(n).bit_length()
        values = (f"l{a}", f"s{b}", f"n{size}", f"ls{a}/{b}", f"ln{a}/{size}", f"sn{b}/{size}")
        own = np.unique([zlib.crc32(v.encode()) % META_BUCKETS for v in values])
        out.append((own.astype(np.int32), np.ones(len(own), np.float32)))
    return out


@dataclass
class Stack:
    """Bags one after the other, none of them empty; bag ``i`` begins at ``at[i]``."""

    own: np.ndarray
    weight: np.ndarray
    at: np.ndarray

    def bag(self, i: int) -> Bag:
        return self.own[self.at[i] : self.at[i + 1]], self.weight[self.at[i] : self.at[i + 1]]


@dataclass
class Logistic:
    weight: np.ndarray
    bias: float = 0.0

    def odds(self, rows: list[Bag]) -> np.ndarray:
        return np.array([float(self.weight[i] @ w) for i, w in rows]) + self.bias

    def stack_odds(self, rows: Stack) -> np.ndarray:
        """As `odds`; a row's sum does not depend on the rows around it."""
        return np.add.reduceat(self.weight[rows.own] * rows.weight, rows.at[:-1]) + self.bias

    @classmethod
    def fit(cls, rows: list[Bag], labels: np.ndarray, buckets: int, start: Logistic | None = None) -> Logistic:
        rng = np.random.default_rng(0)
        weight, bias = (start.weight.copy(), start.bias) if start else (np.zeros(buckets), 0.0)
        m, v, step = np.zeros(buckets), np.zeros(buckets), 0
        epochs = max(EPOCHS, -(-300 * BATCH // max(1, len(rows))))
        for _ in range(epochs if len(rows) else 0):
            order = rng.permutation(len(rows))
            for low in range(0, len(order), BATCH):
                batch = order[low : low + BATCH]
                own, value = (np.concatenate([rows[i][k] for i in batch]) for k in (0, 1))
                doc = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                odds = np.bincount(doc, weight[own] * value, len(batch)) + bias
                miss = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[batch]) / len(batch)
                g = np.bincount(own, miss[doc] * value, buckets) + 1e-4 * weight
                step += 1
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                weight -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                bias -= RATE * float(miss.sum())
        return cls(weight, bias)


def calibrate(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make log-odds fit labels, by Newton steps with a weak prior on slope 1."""
    x = np.stack([odds, np.ones(len(odds))], 1)
    p = np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        slope = x.T @ (q - labels) + (p - [1, 0])
        p = p - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), slope)
    return float(max(0.0, p[0])), float(p[1])


@dataclass
class QualityModel:
    content: Logistic
    metadata: Logistic
    scale: tuple[tuple[float, float], tuple[float, float]]
    prior: float

    def scores(self, content: list[Bag], metadata: list[Bag]) -> np.ndarray:
        total = np.full(len(content), -self.prior)
        for (slope, shift), view, rows in zip(self.scale, (self.content, self.metadata), (content, metadata), strict=True):
            total += slope * view.odds(rows) + shift
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


Round = tuple[tuple[Logistic, Logistic], np.ndarray]


def order_codes(odds: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the numbers."""
    bits = np.ascontiguousarray(odds, np.float64).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def from_code(code: int) -> float:
    bits = np.int64(code)
    return float((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64))


def selected(codes: DataFrame, wanted: list[tuple[str, int]]) -> list[int]:
    """For each column and rank (from 0) the value of that rank among all rows.

    Each job counts the rows of each value of the next bits, within what the bits before have in common, for all ranks
    at once; the driver gets at most ``2 ** BITS`` or `POOL` counts for each.
    """
    found = [(64, 0, rank, POOL + 1) for _, rank in wanted]
    while any(shift for shift, *_ in found):
        asked, next_shift = [], {}
        for i, ((name, _), (shift, common, _, many)) in enumerate(zip(wanted, found, strict=True)):
            if shift:
                next_shift[i] = 0 if many <= POOL else shift - BITS
                bits = F.struct(F.lit(i).alias("wanted"), F.shiftright(name, next_shift[i]).alias("bits"))
                asked.append(bits if shift == 64 else F.when(F.shiftright(name, shift) == common, bits))
        hits = codes.select(F.explode(F.array(*asked)).alias("hit")).where("hit is not null").select("hit.*")
        counts = hits.groupBy("wanted", "bits").agg(F.count(F.lit(1)).alias("n")).toArrow()
        of, bits, n = (counts[c].to_numpy() for c in ("wanted", "bits", "n"))
        for i, shift in next_shift.items():
            order = np.flatnonzero(of == i)
            order = order[np.argsort(bits[order])]
            upto, rank = np.cumsum(n[order]), found[i][2]
            k = int(np.searchsorted(upto, rank, "right"))
            found[i] = shift, int(bits[order[k]]), rank - int(upto[k] - n[order[k]]), int(n[order[k]])
    return [common for _, common, *_ in found]


def thresholds(models: tuple[Logistic, Logistic], rest: DataFrame) -> np.ndarray:
    """For each view the odds up to which, and from which on, rows are handed on: `SHARE` of ``rest``, all counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for views in stacks(batches):
            codes = [pa.array(order_codes(m.stack_odds(v))) for m, v in zip(models, views, strict=True)]
            yield pa.RecordBatch.from_arrays(codes, ["view0", "view1"])

    codes = stored(rest.mapInArrow(work, "view0 long, view1 long"), "odds")
    n = codes.count()
    if not n:
        return np.array([[-np.inf, np.inf]] * 2)
    most = max(1, round(SHARE * n))
    found = selected(codes, [(f"view{view}", rank) for view in (0, 1) for rank in (most - 1, n - most)])
    return np.array([from_code(code) for code in found]).reshape(2, 2)


def packed(rest: DataFrame) -> DataFrame:
    """What both views see of each row, in few bytes, stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            counts = content_counts(block.column(0))
            metadata = metadata_bags(*(block.column(i).to_pylist() for i in (1, 2, 3)))
            columns = (
                [own.astype(np.uint16) for own, _, _ in counts],
                [times.astype(np.uint8 if times.max(initial=0) < 256 else np.uint32) for _, times, _ in counts],
                [np.array(levels, np.uint16) for _, _, levels in counts],
                [own.astype(np.uint16) for own, _ in metadata],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v in column], pa.binary()) for column in columns],
                ["words", "times", "levels", "metadata"],
            )

    return stored(rest.mapInArrow(work, "words binary, times binary, levels binary, metadata binary"), "bags")


def stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Stack, Stack]]:
    """The bags of both views of rows that `packed` has stored, some rows at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, UNPACKED):
            columns = (c.to_pylist() for c in batch.slice(low, UNPACKED).columns)
            content, metadata = [], []
            for words, times, levels, meta in zip(*columns, strict=True):
                own = np.frombuffer(words, np.uint16)
                many = np.frombuffer(times, np.uint8 if len(times) == len(own) else np.uint32)
                weight, shape = np.sqrt(many, dtype=np.float64), np.frombuffer(levels, np.uint16)
                weight /= max(1e-9, np.sqrt(weight @ weight))
                content += (own, weight), (shape, np.ones(len(shape)))
                metadata.append(np.frombuffer(meta, np.uint16))
            at = np.cumsum([0, *(len(own) for own, _ in content)])[::2]
            yield (
                Stack(*(np.concatenate([c[k] for c in content]).astype(t) for k, t in enumerate((np.int32, np.float32))), at),
                Stack(own := np.concatenate(metadata).astype(np.int32), np.ones(len(own), np.float32), np.cumsum([0, *map(len, metadata)])),
            )


def handed(rounds: list[Round], content: Stack, metadata: Stack) -> tuple[np.ndarray, np.ndarray]:
    """For each row the view that learns from it (-1: none) and its pseudo-label, as of the first round that takes it."""
    n = len(content.at) - 1
    learner, mark = np.full(n, -1), np.zeros(n, int)
    for models, limits in rounds:
        for view, rows in enumerate((content, metadata)):
            odds = models[view].stack_odds(rows)
            low, high = limits[view]
            for label, hit in ((0, (odds <= low) & (odds <= 0)), (1, (odds >= high) & (odds > 0))):
                hit &= learner < 0
                learner[hit], mark[hit] = 1 - view, label
    return learner, mark


def calibrated(models: tuple[Logistic, Logistic], rows: list[tuple[Bag, Bag]], labels: np.ndarray) -> QualityModel:
    scale = tuple(
        calibrate(m.odds([row[view] for row in rows]), labels) if len(rows) else (1.0, 0.0) for view, m in enumerate(models)
    )
    share = (labels.sum() + 1) / (len(rows) + 2)
    return QualityModel(models[0], models[1], scale, float(np.log(share / (1 - share))))


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the tasks' vectors for each view, always in the same order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for view, values in zip(batch["view"].to_pylist(), batch["values"].to_pylist(), strict=True):
                own = np.frombuffer(values, np.float64)
                sums[view] = sums[view] + own if view in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["view", "values"]
            )

    dealt = parts.repartition(2 * PARTS, "view").sortWithinPartitions("view", "task").select("view", "values")
    found = dealt.mapInArrow(work, "view int, values binary").toArrow().to_pydict()  # PARTS rows for each view
    whole = {v: np.frombuffer(b, np.float64) for v, b in zip(found["view"], found["values"], strict=True)}
    views = sorted({v // PARTS for v in whole})
    return {v: np.concatenate([whole[v * PARTS + k] for k in range(PARTS)]) for v in views}


def learn(rest: DataFrame, rounds: list[Round], models: tuple[Logistic, Logistic], known: list[tuple[Bag, Bag]], labels: np.ndarray) -> tuple[Logistic, Logistic]:
    """``models`` after learning from all rows of ``rest``, as `packed` has stored them, that the rounds so far hand on."""
    # what travels with the tasks is bounded by the samples and the rounds
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, uses = list(models), [np.zeros(len(m.weight) + 1) for m in models]
        waiting: list[list[tuple[Bag, int]]] = [[], []]

        def step(view: int) -> None:
            both = [row[view] for row in known] + [bag for bag, _ in waiting[view]]
            marks = np.concatenate([labels, [m for _, m in waiting[view]]])
            size = len(uses[view]) - 1
            now[view] = Logistic.fit(both, marks, size, now[view])
            uses[view][:-1] += np.bincount(np.concatenate([b for b, _ in both]), minlength=size)
            uses[view][-1] += len(both)
            waiting[view].clear()

        for views in stacks(batches):
            learner, mark = handed(rounds, *views)
            for i in np.flatnonzero(learner >= 0).tolist():
                waiting[learner[i]].append((views[learner[i]].bag(i), mark[i]))
            for view in (0, 1):
                if len(waiting[view]) >= len(known):
                    step(view)
        for view in (0, 1):
            if waiting[view]:
                step(view)
        for view in (0, 1):
            if uses[view][-1]:
                change = np.append(now[view].weight - models[view].weight, now[view].bias - models[view].bias)
                packed = np.array_split(np.concatenate([change * uses[view], uses[view]]), PARTS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()),
                        pa.array([view * PARTS + k for k in range(PARTS)], pa.int32()),
                        pa.array([v.tobytes() for v in packed], pa.binary()),
                    ],
                    ["task", "view", "values"],
                )

    out = list(models)
    for view, total in added(rest.mapInArrow(work, "task int, view int, values binary")).items():
        change, uses = np.split(total, 2)
        move = change / np.maximum(uses, 1)
        out[view] = Logistic(models[view].weight + move[:-1], models[view].bias + float(move[-1]))
    return out[0], out[1]


def _view_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), "lang", "source", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Co-train on ``labels`` (key, ``quality`` 0 or 1) that ``usable`` lets through and on all other rows."""
    known = labels.where(usable) if usable is not None else labels
    known = known.where(F.col("quality").isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("key")).agg(F.max("quality").cast("int").alias("mark"))
    parts = [known.where(F.col("mark") == mark).orderBy(F.xxhash64("key"), "key").limit(most) for mark, most in enumerate(SAMPLE)]
    # at most sum(SAMPLE) rows of two numbers are broadcast
    picked = parts[0].union(parts[1])
    rows = _view_rows(docs, doc_id, text).join(F.broadcast(picked), F.col("id") == F.col("key"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = content_bags(block.column(0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b.tobytes() for b, _ in found], pa.binary()),
                    pa.array([w.tobytes() for _, w in found], pa.binary()),
                    *(block.column(i) for i in range(1, 6)),
                ],
                ["own", "weight", "lang", "source", "n_chars", "mark", "fold"],
            )

    kept = rows.select(
        "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), "mark",
        (remainder(F.concat(F.lit("c"), F.col("id").cast("string")), CALIBRATION) == 0).alias("fold"),
    )
    table = kept.mapInArrow(
        work, "own binary, weight binary, lang string, source string, n_chars long, mark int, fold boolean"
    ).toArrow()
    found = table.to_pydict()
    content = [
        (np.frombuffer(b, np.int32), np.frombuffer(w, np.float32)) for b, w in zip(found["own"], found["weight"], strict=True)
    ]
    both = list(zip(content, metadata_bags(found["lang"], found["source"], found["n_chars"]), strict=True))
    own = sorted(range(len(both)), key=lambda i: (found["mark"][i], found["own"][i]))
    fold = np.array([found["fold"][i] for i in own], bool)
    marks = np.array([found["mark"][i] for i in own], int)
    train, check = ([both[i] for i, f in zip(own, fold, strict=True) if f == side] for side in (False, True))
    sizes = (BUCKETS + SHAPES * 9, META_BUCKETS)
    models = tuple(Logistic.fit([row[view] for row in train], marks[~fold], size) for view, size in enumerate(sizes))
    # no labelled row of the sample, those for calibration neither, is among the rest
    sampled = F.broadcast(picked.select("key"))
    rest = _view_rows(docs, doc_id, text).join(sampled, F.col("id") == F.col("key"), "left_anti")
    rest = rest.select("text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    rounds: list[Round] = []
    if train:
        rest = packed(rest)
    for _ in range(ROUNDS if train else 0):
        rounds.append((models, thresholds(models, rest)))
        models = learn(rest, rounds, models, train, marks[~fold])
    return calibrated(models, check, marks[fold])


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ``score``, the probability of quality 1."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            metadata = metadata_bags(*(block.column(i).to_pylist() for i in (2, 3, 4)))
            found = pa.array(model.scores(content_bags(block.column(1)), metadata))
            yield pa.RecordBatch.from_arrays([block.column(0), found], [doc_id, "score"])

    return _view_rows(docs, doc_id, text).mapInArrow(work, f"{doc_id} {kind}, score double")
