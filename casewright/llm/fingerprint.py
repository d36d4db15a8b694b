"""Document fingerprints by locally consistent parsing.

Each level cuts a sequence of names into phrases by deterministic coin tossing: a name gets the lowest bit
in which it differs from the one before it, twice that place plus the bit's value; a few rounds leave
labels below 6, and a phrase begins where a label is larger than both neighbours, or at a place that
such labels leave too far from any. Runs of one name are phrases of their own. A phrase's name
is a hash of its names, so the next level starts from the phrases. Where a cut falls depends on a few names
around it only: equal substrings have equal phrases inside, wherever they stand.

Levels go on while a text has enough phrases. The fingerprint lists, for each level from the second on, the number
of distinct phrases and the smallest of their names: all names of a fixed share of the range, so that a list grows
with its text, and at least a fixed number of them. The likeness of two texts is read from the highest level, up to
the fourth, at which both have enough phrases: of the names up to the end of the shorter list's range, the share that
both hold. Phrases of higher levels are so long that scattered edits touch them all; they tell long shared passages.

Defined results: a NULL text counts as empty; the likeness of two empty texts is 1, of an empty and another
0; equal texts have equal fingerprints; repeated rows follow each other in the order of their texts; rows
with a NULL key come first; an empty table gives no rows. In a table of one row the next row is the row itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.ids import slice_of
from casewright.llm.common import GOLDEN, blocks, mix, text_bytes

#: The least number of names kept, the share of the range of names that is kept whole, and the phrases of a level
#: that are enough for comparing it and for a next one.
KEPT, SHARE, ENOUGH = 48, 1 / 16, 8
FIRST_LEVEL, COMPARED = 2, 4
RANGE = int(SHARE * 2**32)
#: Text parsed at once, in bytes; the arrays of a parse take some hundred times as much.
PARSED = 1 << 20


def _differing_bit(label: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which two 32-bit numbers differ, plus that bit of the first."""
    differ = label ^ before
    low = differ & (~differ + np.uint32(1))
    # the exponent of a power of two
    place = (low.astype(np.float32).view(np.uint32) >> np.uint32(23)) - np.uint32(127)
    place[low == 0] = 0
    return (2 * place + (label >> place & np.uint32(1))).astype(np.uint8)


_PAIR = np.arange(64 * 64, dtype=np.uint32)
#: The next label of a label below 64 after another, at 64 times the one before plus the label.
NEXT_LABEL = _differing_bit(_PAIR & np.uint32(63), _PAIR >> np.uint32(6))


def coin_labels(names: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels below 6, different from the one before wherever the names are; ``head``: first of a text."""
    before = np.empty_like(names)
    before[0], before[1:] = 0, names[:-1]
    before[head] = ~names[head]
    labels = _differing_bit(names, before)
    first = np.flatnonzero(head)
    for _ in range(3):
        index = np.empty(len(labels), np.uint16)
        index[0], index[1:] = 0, labels[:-1]
        index[first] = labels[first] ^ 1
        labels = NEXT_LABEL[index << 6 | labels]
    return labels.view(np.int8)


def _name(codes: np.ndarray) -> np.ndarray:
    return (mix(codes) >> np.uint64(32)).astype(np.uint32)


#: Labels leave no phrase longer than this.
PLACE_FACTOR = mix(np.arange(1, 65, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def parse(names: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases and which of them are the first of a text."""
    n = len(names)
    # runs of one name first become one name each, so that neighbours differ
    new = head.copy()
    new[1:] |= names[1:] != names[:-1]
    start = np.flatnonzero(new)
    length = np.diff(start, append=n)
    names = np.where(length > 1, _name(names[start] + mix(length.astype(np.uint64))), names[start])
    head = head[start]
    n = len(names)
    labels = coin_labels(names, head)
    edge = np.full(1, -1, np.int8)
    left = np.concatenate([edge, labels[:-1]])
    right = np.concatenate([labels[1:], edge])
    left[head] = -1
    last = np.append(head[1:], True)
    right[last] = -1
    cut = ((labels > left) & (labels > right)) | head
    # a lone first name joins the phrase after it
    cut[1:] &= ~head[:-1] | head[1:]
    begin = np.flatnonzero(cut)
    place = np.arange(n) - np.repeat(begin, np.diff(begin, append=n))
    parts = (names + np.uint64(1)) * PLACE_FACTOR[np.minimum(place, len(PLACE_FACTOR) - 1)]
    return _name(np.add.reduceat(mix(parts), begin)), head[begin]


BYTE_NAME = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def fingerprints(data: np.ndarray, at: np.ndarray) -> list[str]:
    """The fingerprint of each text ``data[at[i]:at[i + 1]]``."""
    count = len(at) - 1
    full = np.diff(at) > 0
    out: list[list[str]] = [[] for _ in range(count)]
    if full.any():
        names, head = BYTE_NAME[data], np.zeros(len(data), bool)
        head[at[:-1][full]] = True
        texts = active = np.flatnonzero(full)
        level = 0
        while len(active):
            if level >= FIRST_LEVEL:
                owner = texts[np.cumsum(head) - 1]
                both = np.unique(owner.astype(np.uint64) << np.uint64(32) | names)
                edges = np.searchsorted((both >> np.uint64(32)).astype(np.int64), np.arange(count + 1))
                low = both & np.uint64(0xFFFFFFFF)
                for t in active:
                    own = low[edges[t] : edges[t + 1]]
                    some = own[: max(KEPT, int(np.searchsorted(own, RANGE)))]
                    out[t].append(f"{len(own)}:" + some.astype(">u4").tobytes().hex())
                active = active[np.diff(edges)[active] >= ENOUGH]
            names, head = parse(names, head)
            level += 1
    return [";".join(x) for x in out]


def _names(listed: str) -> tuple[int, set[int], float]:
    """The number of names of a level, those that are listed, and up to where the list is whole."""
    n, some = listed.split(":")
    names = np.frombuffer(bytes.fromhex(some), ">u4").tolist()
    return int(n), set(names), max(RANGE - 1, names[-1]) if len(names) < int(n) else np.inf


def likeness(a: str, b: str) -> float:
    """Between 0 and 1, from two fingerprints."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    best = 0.0
    levels = list(zip(a.split(";"), b.split(";")))[: COMPARED - FIRST_LEVEL + 1]
    for place, (x, y) in enumerate(levels):
        (n, p, end), (m, q, other) = _names(x), _names(y)
        if place and min(n, m) < ENOUGH:
            break
        joint = [v for v in p | q if v <= min(end, other)]
        best = sum(v in p and v in q for v in joint) / len(joint) if joint else 0.0
    return best


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ``fingerprint``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, PARSED):
            found = fingerprints(*text_bytes(block.column(1)))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found)], [doc_id, "fingerprint"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).alias("text")).mapInArrow(work, f"{doc_id} {kind}, fingerprint string")


def _slices(spark: SparkSession, docs: DataFrame, doc_id: str) -> list[int]:
    """Cut points that deal the keys into about equal slices, one for each shuffle partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.approxQuantile(doc_id, [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted({int(c) for c in cuts})


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row's text, by ascending key.

    Editing replaces the last quarter of the code points by as many from the start of the next row's
    text. Keys are dealt into slices by fixed cut points; each slice also gets the first row of the
    next slice, so that every row meets its next one in one shuffle and no task gets more than a slice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = _slices(spark, rows, "id")
    sliced = rows.withColumn("slice", F.when(F.col("id").isNull(), 0).otherwise(slice_of(F.col("id"), cuts)))
    # one row for each slice that has any
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", F.xxhash64("text").alias("hash"))
    held = sorted((r["slice"], r["low"]["id"], r["low"]["hash"]) for r in sliced.groupBy("slice").agg(F.min(order).alias("low")).collect())
    firsts = [(s, i, h, held[k - 1][0]) for k, (s, i, h) in enumerate(held)]
    # as many rows as slices
    first = F.broadcast(spark.createDataFrame(firsts, "own int, first long, first_hash long, target int"))
    guests = sliced.join(
        first,
        (F.col("slice") == F.col("own"))
        & F.col("id").eqNullSafe(F.col("first"))
        & (F.xxhash64("text") == F.col("first_hash")),
    ).select("id", "text", F.col("target").alias("slice"), F.lit(True).alias("guest"))
    parts = max(1, len(held))
    dealt = (
        sliced.select("id", "text", "slice", F.lit(False).alias("guest"))
        .unionByName(guests)
        .repartition(parts, "slice")
        .withColumn("hash", F.xxhash64("text"))
        .sortWithinPartitions("slice", "guest", F.col("id").asc_nulls_first(), "hash")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for block in blocks(batches, PARSED):
            whole = pa.Table.from_batches([block])
            if carried is not None:
                whole = pa.concat_tables([carried, whole]).combine_chunks()
            yield from paired(whole.to_batches()[0] if whole.num_rows else block)
            carried = whole.slice(whole.num_rows - 1)

    def paired(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Every row but the last, with the row after it."""
        ids, slices, guest = (batch[c].to_pylist() for c in ("id", "slice", "guest"))
        texts = batch["text"].to_pylist()
        pairs = [i for i in range(len(ids) - 1) if not guest[i] and slices[i] == slices[i + 1]]
        if not pairs:
            return
        edited = []
        for i in pairs:
            cut = len(texts[i]) // 4
            edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
        found, changed = (
            fingerprints(*text_bytes(pa.array([t.encode() for t in some], pa.large_binary())))
            for some in (texts, edited)
        )
        yield pa.RecordBatch.from_pydict(
            {
                "id": pa.array([ids[i] for i in pairs], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in pairs], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [found[i] for i in pairs],
                "edited_fingerprint": changed,
                "near_edited": [likeness(found[i], c) for i, c in zip(pairs, changed, strict=True)],
                "near_next": [likeness(found[i], found[i + 1]) for i in pairs],
            }
        )

    schema = (
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return dealt.select("id", "text", "slice", "guest").mapInArrow(work, schema).withColumnRenamed("id", doc_id)
