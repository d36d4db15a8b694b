"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One inserted or deleted letter changes one count by one, one replaced letter two counts by one. So near
words of equal length are at most 2 apart in the sum of absolute differences (L1), near words whose
lengths differ by one exactly 1. For each pair of lengths (L, L) and (L, L + 1) the words of the longer length
are points in a k-d tree and those of the shorter one ask for points within 2 or 1; subtrees whose box is
farther away are pruned. The letters of the points found are compared in order.

The top of each length's tree is built first: as long as a cell holds more than ``CELL`` words, the letter and
count that halve it best are taken from the counts' histogram, which Spark sums. The driver holds one split
for each such cell, a small number for thousands of words. Every word is one cell's point and is sent as a
question to each cell that its reach touches; a task builds the rest of the tree of its cell and searches it.

A word's form is the most frequent near word if that is at least twice as frequent. Counts double from form
to form, so chains are short; roots are found by joins that double the step.

Defined results: NULL texts have no words, words that occur too rarely or have too few letters are left out;
words without near words keep a row; an empty table gives no rows. ``variants`` takes any table of distinct
words with counts and ignores rows with a NULL word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import stored

#: Letters of a word, once A to Z are in lower case.
LETTERS = "a-zÀ-ÿ"
SHORTEST, RAREST, FACTOR = 5, 3, 2
#: Most words of a cell, points of a leaf, and words or characters compared at once.
CELL, LEAF, TOGETHER = 4096, 64, 1 << 20
#: Counted letters: a to z have a place each, others share the rest. Counts stop at ``MOST``.
PLACES, MOST = 42, 3


def occurrences(docs: DataFrame, text: str = "text", *kept: str) -> DataFrame:
    """(``kept``, ``run``): each maximal run of letters, with the letters A to Z in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    # a pattern of two ranges instead of three is ten times as fast
    lower = F.translate(text, upper, upper.lower())
    return docs.select(*kept, F.explode(F.split(lower, f"[^{LETTERS}]+")).alias("run"))


def count_words(words: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(``word``, ``n``) of a column ``word``: the distinct long and frequent ones."""
    long = words.where(F.length("word") >= shortest)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rarest)


class Words:
    """Words as code points, one after the other, and their letter counts.

    A count c is written as c ones of ``MOST`` bits, so a vector is two numbers of 64 bits, the distance of
    two vectors the number of bits in which they differ, and a bit tells whether a count is above a cut.
    Vectors with shared places and counts that stop are no farther apart than those of all letters.
    """

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.cumsum(self.size) - self.size
        place = self.codes.astype(np.int64) - ord("a")
        place = np.where((place >= 0) & (place < 26), place, 26 + self.codes % (PLACES - 26))
        owner = np.repeat(np.arange(len(words)), self.size)
        counts = np.bincount(owner * PLACES + place, minlength=len(words) * PLACES).reshape(-1, PLACES)
        ones = np.zeros((len(words), 128), bool)
        ones[:, : PLACES * MOST] = (counts[:, :, None] > np.arange(MOST)).reshape(-1, PLACES * MOST)
        self.vector = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)


def unpacked(vectors: np.ndarray) -> np.ndarray:
    return np.unpackbits(vectors.view(np.uint8), axis=1, bitorder="little")


def mask(bits: range) -> np.ndarray:
    ones = np.zeros((1, 128), bool)
    ones[0, list(bits)] = True
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[0]


def gap(low: np.ndarray, high: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """How far each vector is from the box between the counts ``low`` and ``high``."""
    return np.bitwise_count(low & ~vectors | vectors & ~high).sum(1)


def one_edit(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words ``a`` become ``b`` by one replaced letter or, where ``b`` is longer by one, one inserted letter."""
    out = np.zeros(len(a), bool)
    size = words.size[a]
    for length in np.unique(size):
        mine = np.flatnonzero(size == length)
        step, place = max(1, TOGETHER // max(1, int(length))), np.arange(length)
        for some in np.split(mine, range(step, len(mine), step)):
            x = words.codes[words.at[a[some], None] + place]
            y = words.codes[words.at[b[some], None] + place]
            same = x == y
            replaced = (~same).sum(1) == 1
            longer = words.size[b[some]] == length + 1
            z = words.codes[words.at[b[some], None] + place + longer[:, None]]
            front = np.logical_and.accumulate(same, axis=1).sum(1)
            back = np.logical_and.accumulate((x == z)[:, ::-1], axis=1).sum(1)
            out[some] = np.where(longer, front + back >= length, replaced)
    return out


def _pieces(words: Words, which: np.ndarray, back: bool, length: int) -> list[bytes]:
    """The first or last ``length`` letters of each word."""
    start = words.at[which] + (words.size[which] - length if back else 0)
    return [words.codes[s : s + length].tobytes() for s in start]


def _crowd_pairs(words: Words, points: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of many points of one vector and those that ask for them: one edit leaves a front or a back half."""
    length, found = int(words.size[asked[0]]), []
    for back, half in ((False, length // 2), (True, length - length // 2)):
        if not half:
            continue
        held: dict[bytes, list[int]] = {}
        for p, piece in zip(points, _pieces(words, points, back, half), strict=True):
            held.setdefault(piece, []).append(p)
        for q, piece in zip(asked, _pieces(words, asked, back, half), strict=True):
            found += [(q, p) for p in held.get(piece, ())]
    pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def within(words: Words, points: np.ndarray, asked: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asked, point) at most ``reach`` apart, by a k-d tree over the points; all asked have one length."""
    todo = [(points, asked)]
    while todo:
        points, asked = todo.pop()
        vectors = words.vector[points]
        low, high = np.bitwise_and.reduce(vectors), np.bitwise_or.reduce(vectors)
        asked = asked[gap(low, high, words.vector[asked]) <= reach]
        if not len(asked):
            continue
        if len(points) <= LEAF:
            for some in np.split(asked, range(4096, len(asked), 4096)):
                apart = np.bitwise_count(words.vector[some][:, None] ^ vectors).sum(2)
                i, j = np.nonzero(apart <= reach)
                yield some[i], points[j]
        elif (low == high).all():
            yield _crowd_pairs(words, points, asked)
        else:
            ones = unpacked(vectors)
            above = ones[:, np.argmin(np.abs(ones.mean(0) - 0.5))].astype(bool)
            todo += [(points[~above], asked), (points[above], asked)]


#: The top of the trees: the bit by which each named cell is cut, that is a letter and the cut of its counts.
Splits = dict[str, int]


def route(words: Words, splits: Splits, asking: bool) -> Iterator[tuple[str, np.ndarray]]:
    """(cell, words): the cell that holds each word or, for ``asking``, those of its length and the next that it asks."""
    for length in np.unique(words.size):
        mine = np.flatnonzero(words.size == length)
        for extra in (0, 1) if asking else (0,):
            reach = 2 - extra if asking else 0
            todo = [(f"{length + extra}:", mine, mask(range(0)), mask(range(PLACES * MOST)))]
            while todo:
                cell, some, low, high = todo.pop()
                some = some[gap(low, high, words.vector[some]) <= reach]
                if len(some) and cell in splits:
                    bit = splits[cell]
                    first = bit - bit % MOST
                    todo.append((cell + "a", some, low, high & ~mask(range(bit, first + MOST))))
                    todo.append((cell + "b", some, low | mask(range(first, bit + 1)), high))
                elif len(some):
                    yield cell, some


def _split_once(words: DataFrame, splits: Splits, cell_size: int) -> Splits:
    """The evenest split of every cell that holds more than ``cell_size`` words of unlike vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = Words(batch["word"].to_pylist())
            for cell, held in route(some, splits, asking=False):
                above = unpacked(some.vector[held]).sum(0, dtype=np.int64)[: PLACES * MOST]
                yield pa.RecordBatch.from_pydict(
                    {"cell": [cell] * len(above), "bit": np.arange(len(above), dtype=np.int32), "above": above}
                    | {"n": np.full(len(above), len(held))}
                )

    counted = words.select("word").mapInArrow(work, "cell string, bit int, above long, n long")
    counted = counted.groupBy("cell", "bit").agg(F.sum("above").alias("above"), F.sum("n").alias("n"))
    even = F.least(F.col("above"), F.col("n") - F.col("above"))
    best = counted.where((F.col("n") > cell_size) & (even > 0)).groupBy("cell").agg(F.max(F.struct(even, "bit"))["bit"].alias("bit"))
    return {r["cell"]: r["bit"] for r in best.collect()}


def near_words(words: DataFrame, cell_size: int = CELL) -> DataFrame:
    """(``word``, ``near``, ``near_n``), both ways round, of all distinct words (``word``, ``n``) one edit apart."""
    splits: Splits = {}
    while more := _split_once(words, splits, cell_size):
        splits |= more

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = Words(batch["word"].to_pylist())
            for asking in (False, True):
                for cell, held in route(some, splits, asking):
                    rows = batch.take(pa.array(held))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell] * len(held)), pa.array([asking] * len(held)), rows["word"], rows["n"]],
                        ["cell", "asking", "word", "n"],
                    )

    def search(table: pa.Table) -> pa.Table:
        texts, counts = table["word"].to_pylist(), table["n"].to_numpy()
        asking, some = table["asking"].to_numpy(zero_copy_only=False), Words(texts)
        points, pairs = np.flatnonzero(~asking), []
        length = some.size[points[0]] if len(points) else 0
        for extra in (0, 1):
            asked = np.flatnonzero(asking & (some.size == length - extra))
            if not len(points) or not len(asked):
                continue
            for a, b in within(some, points, asked, 2 - extra):
                right = one_edit(some, a, b)
                pairs.append((a[right], b[right]))
                if extra:  # the longer words do not ask for shorter ones
                    pairs.append((b[right], a[right]))
        a, b = (np.concatenate([p[i] for p in pairs] or [np.zeros(0, np.int64)]) for i in (0, 1))
        words_of = table["word"].combine_chunks()
        return pa.table({"word": words_of.take(pa.array(a)), "near": words_of.take(pa.array(b)), "near_n": counts[b]})

    known = words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    dealt = known.mapInArrow(deal, "cell string, asking boolean, word string, n long")
    return dealt.groupBy("cell").applyInArrow(search, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``): the end of each word's chain of forms."""
    steps = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        jump = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(steps.join(jump, "root").select("word", F.col("root").alias("old"), F.col("next").alias("root")), "roots")
        steps = moved.select("word", "root")
        if moved.where("old <> root").isEmpty():
            return steps


def variants(words: DataFrame, factor: int = FACTOR, cell_size: int = CELL) -> DataFrame:
    """Per word (``word``, ``n``): ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = stored(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words")
    found = near_words(words, cell_size)
    # of the most frequent near words, the first in code-point order
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = found.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("first"))
    held: Column = -F.col("first.less") >= factor * F.col("n")
    forms = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(held, F.col("first.near")).alias("form"),
            F.when(held, -F.col("first.less")).alias("form_n"),
        ),
        "forms",
    )
    return forms.join(_roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
