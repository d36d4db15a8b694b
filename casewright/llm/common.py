"""What several operators share: walking texts in blocks, words, hashing, stored steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.sources.shared import stored as stored

#: Text worked on at once, in bytes; a longer single text makes a block of its own.
BLOCK_BYTES = 2 << 20

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def blocks(
    batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES, text: str = "text"
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; NULL texts become empty."""
    for batch in batches:
        place = batch.schema.get_field_index(text)
        whole = pc.fill_null(batch.column(place).cast(pa.large_string()), "")
        batch = batch.set_column(place, text, whole)
        ends = np.cumsum(np.diff(offsets_of(whole)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(array: pa.Array) -> np.ndarray:
    """Offsets of a large string or binary array, from its own first value on."""
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins; the last offset is the end."""
    at = offsets_of(array)
    if array.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(array.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: One random-looking number for each byte value, and the odd base of rolling hashes with its inverse.
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * GOLDEN)
BASE = U64(0xD6E8FEB86659FD93)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def prefix_hash(codes: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Sums of code times power of the base, before each position and at the end."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(base, len(codes)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of the spans [start, stop); equal spans get equal numbers wherever they stand."""
    return mix((prefix[stop] - prefix[start]) * inverse[start] + mix((stop - start).astype(U64)))


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or a longer one that no column has; column names do not tell case apart."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


#: Bytes that belong to words: ASCII letters and digits, and all bytes of other characters.
IN_WORD = np.zeros(256, bool)
IN_WORD[128:] = True
for _low, _high in ((48, 57), (65, 90), (97, 122)):
    IN_WORD[_low : _high + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True that does not cross a text's border."""
    inner = np.zeros(len(mask) + 1, bool)
    inner[at] = True
    left = mask.copy()
    left[1:] &= ~mask[:-1] | inner[1:-1]
    right = mask.copy()
    right[:-1] &= ~mask[1:] | inner[1:-1]
    return np.flatnonzero(left), np.flatnonzero(right) + 1


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, in order, and where the words of each text begin.

    A word is a run of letters, digits and non-ASCII characters; ASCII case is folded.
    """
    data, at = text_bytes(texts)
    start, stop = runs(IN_WORD[data], at)
    hashes = span_hash(prefix_hash(BYTE_CODE[LOWER[data]]), start, stop, powers(BASE_INVERSE, len(data) + 1))
    return hashes, np.searchsorted(start, at)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of
