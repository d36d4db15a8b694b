"""Removal of every byte under a 200-byte string that starts more than once in the corpus.

A suffix array of all bytes, as external induced sorting builds it, needs sixteen or more bytes of sorted
tuples for each byte of text, several times the disk that is allowed (README). So positions are sampled
as induced sorting samples its substrings, and what holds at the samples is carried over to all others:

1. Each 200-byte window names an anchor, the place of its smallest hashed 32-byte gram. Equal windows name equal
   grams at equal offsets. Neighbouring windows with one anchor form a stretch, 65 windows on average. Only
   stretches whose gram occurs twice go on; the rest is read, never shuffled a second time.
2. Stretches with the same bytes repeat as a whole.
3. Of the others of one gram, one text of each is brought together, and all their windows are compared;
   a gram with very many different stretches has its windows dealt out by their own hash instead.

Every window is thus compared with every other that can equal it; windows are compared by 64-bit hashes,
whole texts by MD5.
Sorting and merging are Spark's external sorts. Stored steps lie in the shared folder.

Defined results: a NULL text is empty; texts shorter than 200 bytes lose nothing; equal texts of 200 bytes
or more lose everything; repeated or NULL keys keep a row each; an empty table gives no rows.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.common import (
    BASE_INVERSE, BYTE_CODE, blocks, powers, prefix_hash, span_hash, stored, text_bytes,
)

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1
#: Longer texts are cut into pieces of this size that overlap by all but one byte of a window.
PIECE = 8 << 20
#: Different stretches of one gram that one task compares; the windows of further grams are dealt out.
TOGETHER = 20_000
#: Text looked at at once for stretches, in bytes; the arrays take some hundred times as much.
AT_ONCE = 1 << 20
LOW = np.uint64((1 << 24) - 1)
TOP = np.uint64((1 << 64) - 1)


def stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, gram hash, hash of all bytes, first window and number of windows of each stretch."""
    parts = [_stretches(data, at)] if len(data) <= PIECE or len(at) > 2 else []
    if not parts:
        for start in range(0, len(data), PIECE):
            piece = data[start : start + PIECE + LENGTH - 1]
            text, gram, union, first, many = _stretches(piece, np.array([0, len(piece)]))
            parts.append((text, gram, union, first + start, many))
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def _stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    grams = len(data) - GRAM + 1
    if grams < SPAN:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    prefix, inverse = prefix_hash(BYTE_CODE[data]), powers(BASE_INVERSE, len(data) + 1)
    place = np.arange(grams)
    gram = span_hash(prefix, place, place + GRAM, inverse)
    # equal grams are told apart by place, the leftmost counts
    ranked = np.full(-(-grams // SPAN) * SPAN, TOP)
    ranked[:grams] = gram & ~LOW | place.astype(np.uint64) & LOW
    ranked = ranked.reshape(-1, SPAN)
    so_far = np.minimum.accumulate(ranked, 1).ravel()
    from_here = np.minimum.accumulate(ranked[:, ::-1], 1)[:, ::-1].ravel()
    window = place[: grams - SPAN + 1]
    low = np.minimum(from_here[window], so_far[window + SPAN - 1])
    text = np.searchsorted(at, window, "right") - 1
    inside = window + LENGTH <= at[text + 1]
    window, low, text = window[inside], low[inside], text[inside]
    new = np.ones(len(window), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    many = np.diff(first, append=len(window))
    start = window[first]
    anchor = start + ((low[first] & LOW).astype(np.int64) - start) % (int(LOW) + 1)
    union = span_hash(prefix, start, start + many - 1 + LENGTH, inverse)
    return text[first], gram[anchor], union, start - at[text[first]], many


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The row's key, the digest of its text, and the text packed for the shuffles."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = [t.as_buffer() for t in block.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0), block.column(1), pa.array([t.size for t in texts], pa.int64()),
                    pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary()),
                ],
                ["id", "key", "n_bytes", "packed"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), _digest(whole).alias("key"), whole.alias("text"))
    return rows.mapInArrow(work, f"id {kind}, key binary, n_bytes long, packed binary")


def _stretch_rows(docs: DataFrame, text: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, AT_ONCE):
            owner, gram, union, first, many = stretches(*text_bytes(block.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram.view(np.int64)), pa.array(union.view(np.int64)),
                    block.column(0).take(pa.array(owner)), pa.array(first << 8 | many),
                ],
                ["gram", "bytes", "key", "place"],
            )

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(_digest(whole).alias("key"), whole.alias("text"))
    return rows.mapInArrow(work, "gram long, bytes long, key binary, place long")


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of steps whose results are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _window_hashes(texts: list[bytes], many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window of the stretches, its stretch, and its number in it."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts)), many)
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = begin[owner] + number
    hashes = span_hash(prefix_hash(BYTE_CODE[data]), start, start + LENGTH, powers(BASE_INVERSE, len(data) + 1))
    return hashes, owner, number


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of lone stretches, from rows sorted by gram; a gram's rows stay together."""
    carried: pa.Table | None = None

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        place = rows["place"].to_numpy()
        hashes, owner, number = _window_hashes(rows["stretch"].to_pylist(), place & 255)
        _, group, times = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = (times[group] > 1) & rows["lone"].to_numpy()[owner]
        if not hit.any():
            return
        texts = rows["key"].combine_chunks().dictionary_encode()
        key = texts.indices.to_numpy()[owner[hit]]
        start = (place >> 8)[owner[hit]] + number[hit]
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key)) - 1
        yield pa.RecordBatch.from_arrays(
            [texts.dictionary.take(pa.array(key[first])), pa.array(start[first]), pa.array(start[last] + LENGTH)], ["key", "low", "high"]
        )

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if carried is not None:
            rows = pa.concat_tables([carried, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        grams = rows["gram"].to_numpy()
        cut = int(np.searchsorted(grams, grams[-1]))
        yield from found(rows.slice(0, cut))
        carried = rows.slice(cut)
    if carried is not None:
        yield from found(carried)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch["place"].to_numpy()
        hashes, owner, number = _window_hashes(batch["stretch"].to_pylist(), place & 255)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hashes.view(np.int64)), batch["key"].take(pa.array(owner)),
                pa.array((place >> 8)[owner] + number), batch["lone"].take(pa.array(owner)),
            ],
            ["window", "key", "low", "lone"],
        )


def repeated_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``low``, ``high``): byte ranges under repeated windows, by digest of the text; they may overlap."""
    spark = docs.sparkSession
    rows = _stretch_rows(docs, text)
    # aggregated by a struct, so that the join can still split a frequent gram
    twice = rows.groupBy(F.struct("gram").alias("g")).agg(F.count("*").alias("n")).where("n > 1").select("g.gram")
    shared = stored(rows.join(twice, "gram"), "shared")
    _release(spark)

    same = shared.groupBy("gram", "bytes").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("one")
    )
    same = stored(same.select("gram", "bytes", "n", "one.key", "one.place"), "same")
    whole = shared.join(same.where("n > 1").select("gram", "bytes"), ["gram", "bytes"]).select(
        "key",
        F.shiftright("place", 8).alias("low"),
        (F.shiftright("place", 8) + F.col("place").bitwiseAND(255) + (LENGTH - 1)).alias("high"),
    )
    # copies of a text have equal ranges: one row for all of them
    whole = stored(whole.distinct(), "whole")

    mixed = same.groupBy(F.struct("gram").alias("g")).agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = same.join(mixed.select("g.gram", "kinds"), "gram").select(
        "key", F.struct("gram", "place", (F.col("n") == 1).alias("lone"), (F.col("kinds") > TOGETHER).alias("many")).alias("want")
    )
    wanted = wanted.groupBy("key").agg(F.collect_list("want").alias("wants"))
    texts = _keyed(docs, doc_id, text).groupBy("key").agg(F.any_value("n_bytes").alias("n_bytes"), F.any_value("packed").alias("packed"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = pa.decompress(batch["packed"][i].as_buffer(), batch["n_bytes"][i].as_py(), "zstd", asbytes=True)
                wants = batch["wants"][i].values
                place = wants.field("place").to_numpy()
                spans = [raw[p >> 8 : (p >> 8) + (p & 255) + LENGTH - 1] for p in place.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        wants.field("gram"), batch["key"].take(pa.array(np.full(len(place), i))),
                        wants.field("place"), wants.field("lone"), wants.field("many"), pa.array(spans, pa.binary()),
                    ],
                    ["gram", "key", "place", "lone", "many", "stretch"],
                )

    pieces = stored(
        wanted.join(texts, "key").mapInArrow(
            cut_out, "gram long, key binary, place long, lone boolean, many boolean, stretch binary"
        ),
        "pieces",
    )
    _release(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = pieces.where(~F.col("many")).drop("many").repartition(parts, "gram").sortWithinPartitions("gram")
    ranges = whole.union(few.mapInArrow(_compare, "key binary, low long, high long"))
    windows = pieces.where("many").drop("many")
    if not windows.isEmpty():
        dealt = windows.mapInArrow(_explode, "window long, key binary, low long, lone boolean")
        again = dealt.groupBy(F.struct("window").alias("g")).agg(F.count("*").alias("n")).where("n > 1").select("g.window")
        hit = dealt.where("lone").join(again, "window")
        ranges = ranges.union(hit.select("key", "low", (F.col("low") + LENGTH).alias("high")))
    return ranges


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges that touch or overlap become one."""
    for batch in batches:
        lows, highs = [], []
        for low, high in zip(batch["low"], batch["high"], strict=True):
            low, high = low.values.to_numpy(), high.values.to_numpy()
            order = np.argsort(low)
            low, so_far = low[order], np.maximum.accumulate(high[order])
            first = np.append(True, low[1:] > so_far[:-1])
            lows.append(low[first])
            highs.append(so_far[np.append(first[1:], True)])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(lows, kind), pa.array(highs, kind)], ["key", "low", "high"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (bytes)."""
    ranges = stored(repeated_ranges(docs, doc_id, text), "ranges")
    _release(docs.sparkSession)
    # ranges are distinct, so a text has fewer than bytes, however many copies it has
    by_text = ranges.groupBy(F.struct("key").alias("g")).agg(
        F.collect_list("low").alias("low"), F.collect_list("high").alias("high")
    )
    merged = by_text.select("g.key", "low", "high").mapInArrow(_merge, "key binary, low array<long>, high array<long>")
    joined = _keyed(docs, doc_id, text).join(merged, "key", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield cut(batch.slice(start, 256))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, spans, kept = [], [], []
        sizes = batch["n_bytes"].to_pylist()
        for i, size in enumerate(sizes):
            raw = pa.decompress(batch["packed"][i].as_buffer(), size, "zstd", asbytes=True)
            low, high = batch["low"][i].values, batch["high"][i].values
            if low is None or not len(low):
                removed.append(0)
                spans.append(0)
                kept.append(raw)
                continue
            step = np.bincount(low.to_numpy(), minlength=size + 1) - np.bincount(high.to_numpy(), minlength=size + 1)
            under = np.cumsum(step[:size]) > 0
            removed.append(int(under.sum()))
            spans.append(int(under[0]) + int((under[1:] & ~under[:-1]).sum()))
            kept.append(np.frombuffer(raw, np.uint8)[~under].tobytes())
        return pa.RecordBatch.from_arrays(
            [
                batch["id"], batch["n_bytes"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                pa.array(kept, pa.binary()),
            ],
            ["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    kind = joined.schema["id"].dataType.simpleString()
    rows = joined.select("id", "n_bytes", "packed", "low", "high")
    out = rows.mapInArrow(work, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", doc_id)
