"""Benchmark decontamination by greedy string tiling.

Words are compared without ASCII case and punctuation. Five words in a row are a seed. Documents that
share a seed with a benchmark item are joined to it; then tiles are placed, longest first: matching
windows are found by rolling hashes of one search length, extended while both sides match and are free, and
marked without overlap, and what a longer tile leaves of a match is taken up again by its size; the length is
halved down to five. Only the left ends of matches are looked at, so long runs of one word stay cheap. An item
is leaked where tiles cover at least half of its words, in whatever order its passages stand.

A tile of L words holds L - 4 seeds, a fifth of L at least, so a leaked item of m words shares m / 10 of its places with
the text. An item is therefore joined by its rarest seeds only, all but m / 10 - 1 of its places: phrases that are
common to many documents and items pair nothing, and no leaked item is lost.

A bit filter of the benchmark's seeds, at most 8 MB whatever the benchmark's size, keeps most documents out of the
join; the join itself is on the seeds and exact. Equal texts are tiled once.

Defined results: NULL texts are empty; items of fewer than five words are not searched for; NULL items or
keys are kept as they are; repeated rows keep a row each; empty tables leak nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import (
    BASE_INVERSE, GOLDEN, blocks, fresh, mix, powers, prefix_hash, runs, span_hash, stored, word_hashes,
)

SEED, COVERAGE, FIRST_SEARCH = 5, 0.5, 20
#: Bits of the filter for each seed, and the most of them in all, as powers of 2; bits set by a seed.
BITS_A_SEED, MOST_BITS = 6, 26
PROBES = np.arange(1, 4, dtype=np.uint64) * GOLDEN


def seeds_of(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the seed that begins at each word, and whether there is one within the text."""
    joined = np.zeros(len(words), np.uint64)
    for shift in range(SEED):
        end = len(words) - shift
        joined[:end] = joined[:end] * GOLDEN + mix(words[shift:] + np.uint64(shift))
    inside = np.arange(len(words)) + SEED <= np.repeat(at[1:], np.diff(at))
    return mix(joined), inside


def tile(text: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in the text, place in the item, words) of the tiles between two sequences of word hashes.

    The longest match of free words is marked first, of equal ones the leftmost in the text, then in the item.
    """
    n, m = len(text), len(item)
    if min(n, m) < SEED:
        return []
    item_seeds = seeds_of(item, np.array([0, m]))[0][: m - SEED + 1]
    text_seeds = seeds_of(text, np.array([0, n]))[0][: n - SEED + 1]
    starts = np.flatnonzero(np.isin(text_seeds, item_seeds))
    hashes = [(prefix_hash(x), powers(BASE_INVERSE, len(x) + 1)) for x in (text, item)]
    free_text, free_item = np.ones(n, bool), np.ones(m, bool)
    tiles: list[tuple[int, int, int]] = []
    search = min(FIRST_SEARCH, n, m)
    while True:
        own = _windows(item, np.arange(m - search + 1), free_item, search, *hashes[1])
        here = _windows(text, starts[starts + search <= n], free_text, search, *hashes[0])
        matches = []
        for i, j in _left_ends(here, own):
            size = _extent(text, item, free_text, free_item, i, j)
            if size >= search:
                matches.append((-size, i, j))
        heapq.heapify(matches)
        while matches:
            size, i, j = heapq.heappop(matches)
            free = free_text[i : i - size] & free_item[j : j - size]
            if free.all():
                free_text[i : i - size] = free_item[j : j - size] = False
                tiles.append((i, j, -size))
                continue
            # what longer tiles left of it
            for low, high in zip(*runs(free, np.array([0, -size])), strict=True):
                if high - low >= search:
                    heapq.heappush(matches, (int(low - high), i + int(low), j + int(low)))
        if search == SEED:
            return tiles
        search = max(SEED, search // 2)


def _windows(
    words: np.ndarray, start: np.ndarray, free: np.ndarray, search: int, prefix: np.ndarray, inverse: np.ndarray
) -> Iterator[tuple[int, int, int | None]]:
    """Start and hash of each window of free words, and the free word before it."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    start = start[taken[start + search] == taken[start]]
    hashes = span_hash(prefix, start, start + search, inverse)
    before = [words[i - 1].item() if i and free[i - 1] else None for i in start.tolist()]
    return zip(start.tolist(), hashes.tolist(), before, strict=True)


def _left_ends(
    here: Iterator[tuple[int, int, int | None]], own: Iterator[tuple[int, int, int | None]]
) -> Iterator[tuple[int, int]]:
    """Pairs of windows of one hash that no equal free words precede: the others lie within a match that begins earlier."""
    windows: dict[int, dict[int | None, list[int]]] = {}
    for j, h, before in own:
        windows.setdefault(h, {}).setdefault(before, []).append(j)
    for i, h, before in here:
        for other, places in windows.get(h, {}).items():
            if before is None or before != other:
                for j in places:
                    yield i, j


def _extent(text: np.ndarray, item: np.ndarray, free_text: np.ndarray, free_item: np.ndarray, i: int, j: int) -> int:
    most = min(len(text) - i, len(item) - j)
    same = (text[i : i + most] == item[j : j + most]) & free_text[i : i + most] & free_item[j : j + most]
    return most if same.all() else int(np.argmin(same))


def _bits(seeds: np.ndarray, size: int) -> np.ndarray:
    """The bits of each seed, one column for each probe."""
    return np.stack([mix(seeds + p) & np.uint64(size - 1) for p in PROBES], 1)


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    kind = benchmark.schema[item_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words, at = word_hashes(block.column(1))
            seeds, inside = seeds_of(words, at)
            rows = [
                (words[a:b], *np.unique(seeds[a:b][inside[a:b]], return_counts=True))
                for a, b in zip(at[:-1], at[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    pa.array([w.tobytes() for w, *_ in rows], pa.binary()),
                    pa.array([s.view(np.int64) for _, s, _ in rows], pa.list_(pa.int64())),
                    pa.array([n for *_, n in rows], pa.list_(pa.int64())),
                ],
                ["item", "item_words", "seeds", "times"],
            )

    rows = benchmark.select(item_id, F.col(text).alias("text"))
    return rows.mapInArrow(work, f"item {kind}, item_words binary, seeds array<long>, times array<long>")


def _filter(seeds: DataFrame) -> np.ndarray:
    """A bit for each probe of each seed, as 64-bit words; its size is bounded."""
    n = seeds.agg(F.count("*")).head()[0]
    size = 1 << min(MOST_BITS, max(16, int(n).bit_length() + BITS_A_SEED))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy().view(np.uint64), size).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((bits >> np.uint64(6)).astype(np.int64)),
                    pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64)),
                ],
                ["word", "bits"],
            )

    found = seeds.mapInArrow(work, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = found.toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out.view(np.uint64)


def _touched(keyed: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(``key``, ``words``, ``seeds``) of the texts in which the filter finds a seed."""
    size = len(bitmap) << 6

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words, at = word_hashes(block.column(1))
            seeds, inside = seeds_of(words, at)
            hit = inside
            for probe in PROBES:
                place = np.flatnonzero(hit)
                bit = mix(seeds[place] + probe) & np.uint64(size - 1)
                hit = np.zeros(len(seeds), bool)
                hit[place[(bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)) > 0]] = True
            place = np.flatnonzero(hit)
            texts = np.unique(np.searchsorted(at, place, "right") - 1)
            edges = np.searchsorted(place, np.stack([at[texts], at[texts + 1]])) if len(texts) else np.zeros((2, 0), int)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0).take(pa.array(texts)),
                    pa.array([words[at[t] : at[t + 1]].tobytes() for t in texts], pa.binary()),
                    pa.array(
                        [np.unique(seeds[place[a:b]]).view(np.int64) for a, b in edges.T], pa.list_(pa.int64())
                    ),
                ],
                ["key", "words", "seeds"],
            )

    return keyed.select("key", "text").mapInArrow(work, "key binary, words binary, seeds array<long>")


def _rarest(items: DataFrame, text_seeds: DataFrame) -> DataFrame:
    """(``item``, ``item_key``, ``seed``): the seeds one of which every text shares that holds enough of the item."""
    each = items.select(
        "item", F.md5("item_words").alias("item_key"), (F.octet_length("item_words") / 8).cast("long").alias("size"),
        F.explode(F.arrays_zip("seeds", "times")).alias("s"),
    ).select("item", "item_key", "size", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times")).distinct()
    found = text_seeds.groupBy("seed").agg(F.count("*").alias("texts"))
    # over the seeds of one item; those that no text has come first
    rarest = Window.partitionBy("item", "item_key").orderBy(F.asc_nulls_first("texts"), "seed")
    before = F.coalesce(F.sum("times").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = F.ceil(F.col("size") * COVERAGE / SEED)
    return (
        each.join(found, "seed", "left")
        .withColumn("before", before)
        .where(F.col("texts").isNotNull() & (F.col("before") <= F.col("size") - SEED + 1 - shared))
        .select("item", "item_key", "seed")
    )


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(``key``, ``item``, ``coverage``): a text's MD5, a leaked item, and the part of its words under tiles."""
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.unhex(F.md5(whole)).alias("key"), whole.alias("text"))
    items = stored(_items(benchmark, item_id, item_text), "items")
    bitmap = _filter(items.select(F.explode("seeds").alias("seed")))
    touched = stored(_touched(keyed, bitmap).dropDuplicates(["key"]), "touched")
    text_seeds = touched.select("key", F.explode("seeds").alias("seed"))
    pairs = (
        text_seeds.join(_rarest(items, text_seeds), "seed").select("key", "item", "item_key").distinct()
    )
    texts = items.select("item", F.md5("item_words").alias("item_key"), "item_words").distinct()
    found = pairs.join(
        texts, pairs["item"].eqNullSafe(texts["item"]) & (pairs["item_key"] == texts["item_key"])
    ).select(pairs["key"], pairs["item"], "item_words")
    work_rows = found.join(touched.select("key", "words"), "key").select("key", "item", "item_words", "words")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cover = []
            for words, own in zip(batch["words"], batch["item_words"], strict=True):
                item = np.frombuffer(own.as_py(), np.uint64)
                placed = tile(np.frombuffer(words.as_py(), np.uint64), item)
                cover.append(sum(size for *_, size in placed) / len(item))
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["item"], pa.array(cover, pa.float64())], ["key", "item", "coverage"]
            )

    kind = items.schema["item"].dataType.simpleString()
    covered = work_rows.mapInArrow(work, f"key binary, item {kind}, coverage double")
    return covered.where(F.col("coverage") >= COVERAGE)


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: the key, ``contaminated``, the leaked ``items`` in order, and the largest ``coverage`` (0 without)."""
    found = stored(leaks(docs, benchmark, text), "leaks")
    by_text = found.groupBy(F.struct("key").alias("g")).agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.max("coverage").alias("coverage")
    ).select("g.key", "items", "coverage")
    keyed = docs.select(doc_id, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"))
    none = F.array().cast(by_text.schema["items"].dataType)
    return keyed.join(by_text, "key", "left").select(
        doc_id,
        F.col("coverage").isNotNull().alias("contaminated"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def keep_unleaked(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, without those that leak an item."""
    md5, leaked = fresh(docs.columns, "_md5"), fresh(docs.columns, "_leaked")
    found = stored(leaks(docs, benchmark, text).select(F.col("key").alias(leaked)).distinct(), "leaks")
    keyed = docs.withColumn(md5, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    return keyed.join(found, F.col(md5) == F.col(leaked), "left_anti").select(docs.columns)
