"""Fill-in-middle: a text is cut at two places between its units, and its middle goes to the end.

A unit is a run of blanks with the run of other characters after it; blanks at the end of a text are a unit.
Each code point has a class that tells whether it is blank and whether its run ends with it. A block of texts
becomes one wavelet matrix over these classes: three rows of bits, each sorted stably by the row before it,
with counts of ones. A rank query counts one class before a place by three steps; the units that end before
a place are the ranks of two classes together. The last rank tells a text's units, and a bisection on the
ranks finds where the wanted number of units ends, for all texts of a block at once.

Two marked orders exist: prefix, suffix, middle (psm) and suffix, prefix, middle (spm). Texts that are empty or
hold a mark themselves stay plain, so every output can be told apart and undone.

Nothing is shuffled; a task works on its own texts, block by block.

Defined results: a NULL text counts as empty, is plain and has no units; a NULL key counts as the empty text in
the draw; equal rows get equal outputs; an empty table gives no rows; of the columns only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import blocks, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed of the draw, and the shares in per cent of marked texts and of suffix-first ones among them.
SEED, MARKED, SUFFIX_FIRST = 42, 50, 80
#: Classes of a character: blank or not, and whether a unit ends with it.
BLANK, LAST_BLANK, INSIDE, WORD_END = 0, 3, 4, 6
ROWS = 3
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x9, 0xE)]] = True


class WaveletMatrix:
    """Ranks of small numbers: how many of the first ones equal a given number."""

    def __init__(self, values: np.ndarray, rows: int):
        self.rows, self.bits, self.before, self.zeros = rows, [], [], []
        for row in reversed(range(rows)):
            bit = (values >> row & 1).astype(bool)
            packed = np.zeros(len(values) // 64 + 1, np.uint64)
            packed.view(np.uint8)[: -(-len(values) // 8)] = np.packbits(bit, bitorder="little")
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(len(values) - int(self.before[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, row: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[row][word] + np.bitwise_count(self.bits[row][word] & below)

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` numbers equal ``value``."""
        at, start = at.astype(np.int64), np.zeros(1, np.int64)
        for row in range(self.rows):
            if value >> (self.rows - 1 - row) & 1:
                at, start = (self.zeros[row] + self._ones(row, x) for x in (at, start))
            else:
                at, start = (x - self._ones(row, x) for x in (at, start))
        return at - start


def classes(data: np.ndarray, place: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each character; ``place``: its first byte; ``ends``: the characters before each text's end."""
    blank = IS_BLANK[data[place]]
    last = np.zeros(len(place), bool)
    last[ends[ends > 0] - 1] = True
    turns = last.copy()
    turns[:-1] |= blank[1:] != blank[:-1]
    # a run of blanks inside a text ends no unit
    out = np.where(blank, np.where(last, LAST_BLANK, np.where(turns, BLANK + 1, BLANK)), np.where(turns, WORD_END, INSIDE))
    return out.astype(np.uint8)


class Units:
    """The units of a block of texts."""

    def __init__(self, texts: pa.Array):
        self.data, self.at = text_bytes(texts)
        place = np.flatnonzero((self.data & 0xC0) != 0x80)
        #: code points before each text, and the last one's end
        self.chars = np.searchsorted(place, self.at)
        self.place = np.append(place, len(self.data))
        self.matrix = WaveletMatrix(classes(self.data, place, self.chars[1:]), ROWS)
        self.before = self.ended(self.chars[:-1])
        self.count = self.ended(self.chars[1:]) - self.before

    def ended(self, at: np.ndarray) -> np.ndarray:
        """Units that end within the first ``at`` characters of the block."""
        return self.matrix.rank(WORD_END, at) + self.matrix.rank(LAST_BLANK, at)

    def end_of(self, units: np.ndarray) -> np.ndarray:
        """Where the first ``units`` units of each text end, in characters of the block."""
        low, high = self.chars[:-1].copy(), self.chars[1:].copy()
        while (low < high).any():
            middle = (low + high) // 2
            enough = self.ended(middle) - self.before >= units
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low


def draw(doc_id: str = "doc_id", seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    marked: int = MARKED,
    suffix_first: int = SUFFIX_FIRST,
    seed: int = SEED,
) -> DataFrame:
    """Per row: the key, ``n`` units, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draw(doc_id, seed)
    unfit = (whole == "") | F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    form = F.when(unfit | (h3 % 100 >= marked), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select(F.col(doc_id).alias("id"), whole.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    kind = docs.schema[doc_id].dataType.simpleString()
    p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            units = Units(block["text"])
            picks = [block[c].to_numpy(zero_copy_only=False) % (units.count + 1) for c in ("h1", "h2")]
            first, second = units.end_of(np.minimum(*picks)), units.end_of(np.maximum(*picks))
            forms = block["form"].to_pylist()
            plain = pa.array(np.array([f == "plain" for f in forms], bool))
            lengths = (first - units.chars[:-1], second - first)
            data, out = units.data.tobytes(), []
            edges = zip(units.at[:-1], units.place[first], units.place[second], units.at[1:], strict=True)
            for kept, (a, b, c, d) in zip(forms, edges, strict=True):
                prefix, middle, suffix = data[a:b], data[b:c], data[c:d]
                if kept == "plain":
                    out.append(data[a:d])
                elif kept == "psm":
                    out.append(p + prefix + s + suffix + m + middle)
                else:
                    out.append(s + suffix + p + prefix + m + middle)
            yield pa.RecordBatch.from_arrays(
                [
                    block["id"],
                    pa.array(units.count, pa.int64()),
                    block["form"],
                    *(pa.array(x, pa.int64(), mask=plain.to_numpy(zero_copy_only=False)) for x in lengths),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", doc_id)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part holds a mark, so each mark is found where it was put."""
    before_middle = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(
        F.substring_index(F.substring_index(before_middle, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(before_middle, SUFFIX, -1)
    )
    spm = F.concat(
        F.substring_index(before_middle, PREFIX, -1), middle, F.substring_index(F.substring_index(before_middle, PREFIX, 1), SUFFIX, -1)
    )
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
