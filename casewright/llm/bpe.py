"""Byte-level BPE encoding and decoding with a given rank file.

Encoding cuts every text into matches of the splitting pattern, gathers the distinct matches of a block
of documents, and folds ranked merges over their byte arrays: each round joins, in every word, the
neighbours whose joined bytes have the lowest rank, until no pair has a rank. The rank map is part of
the task. Joining all places of the lowest pair at once gives what one merge at a time gives, because
every piece of such a vocabulary is itself reached by merges of lower rank; a test checks this of the file.

``fold_merges`` is the same fold as a Spark higher-order function over a literal rank map. It costs about
90 microseconds of CPU a word, twenty times the array form, so whole tables are encoded by the array form
(figures in the README).

Decoding concatenates the binary pieces of the ids.

Nothing is shuffled: a task works on its own documents, block by block, and a lost task is run again.

Defined results: a NULL or empty text has no ids; NULL or repeated keys are kept as they are, one row
each; an empty table gives no rows; only the key and the text are read, other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.llm.common import blocks, text_bytes

#: Text whose distinct words are encoded together, in bytes; the arrays of a block take some forty times as much.
ENCODE_BLOCK = 2 << 20
NO_RANK = np.int32((1 << 31) - 1)
LETTER, NUMBER, SPACE, OTHER = range(4)
#: The characters of Unicode's White_Space property.
WHITE_SPACE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    first = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    table[list(WHITE_SPACE)] = SPACE
    return table


def split_words(data: np.ndarray, at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the matches of the splitting pattern begin, and the matches before each text.

    The pattern takes runs of one class of characters. The last blank of a run of white space goes to the
    run after it; another last character of such a run stands alone; and an apostrophe that begins a match
    takes one of the endings s, t, re, ve, m, ll, d.
    """
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    text_start = np.searchsorted(place, at)
    n = len(chars)
    kind = classes[chars]
    border = np.zeros(n + 1, bool)
    border[text_start] = True
    new = border[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(new)
    stop = np.append(first[1:], n)
    begins = np.zeros(n + 4, bool)
    begins[first] = True
    followed = ~border[stop]

    spaces = (kind[first] == SPACE) & followed
    long = spaces & (stop - first > 1)
    begins[stop[long] - 1] = True
    glued = spaces & (chars[stop - 1] == 0x20)
    begins[stop[glued] - 1] = True
    begins[stop[glued]] = False

    quote = np.flatnonzero(
        (chars[first] == ord("'")) & (stop - first == 1) & begins[first] & followed
    )
    quote = quote[kind[stop[quote]] == LETTER]
    at_letters, letters_end = stop[quote], stop[quote + 1]
    one = chars[at_letters]
    two = np.where(letters_end - at_letters > 1, chars[np.minimum(at_letters + 1, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for taken, size in ((short, 1), (pair & ~short, 2)):
        begins[at_letters[taken]] = False
        begins[at_letters[taken] + size] |= letters_end[taken] > at_letters[taken] + size
    marks = np.flatnonzero(begins[:n])
    return place[marks], np.searchsorted(marks, text_start)


class RankTable:
    """Pairs of tokens and the rank of their joined bytes, found without a search.

    A pair's hash selects a group, and the group's shift sends its pairs to slots of their own.
    The table travels with tasks, so nothing of it refers to this module's cached functions.
    """

    GROUPS, SLOTS, FACTOR = 1 << 15, 1 << 18, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        joined = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    joined[left << 20 | right] = rank
        keys = np.fromiter(joined, np.uint64, len(joined))
        group, slot = self._hash(keys)
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(self.GROUPS + 1))
        self.shift = np.zeros(self.GROUPS, np.int64)
        self.key = np.full(self.SLOTS, (1 << 64) - 1, np.uint64)
        self.rank = np.full(self.SLOTS, NO_RANK)
        taken = np.zeros(self.SLOTS, bool)
        for g in np.argsort(-np.diff(edges), kind="stable"):
            own = order[edges[g] : edges[g + 1]]
            if not len(own):
                break
            shift = next(
                s
                for s in range(self.SLOTS)
                if not taken[slot[own] ^ s].any() and len(set((slot[own] ^ s).tolist())) == len(own)
            )
            self.shift[g], taken[slot[own] ^ shift] = shift, True
            self.key[slot[own] ^ shift] = keys[own]
            self.rank[slot[own] ^ shift] = [joined[int(k)] for k in keys[own]]
        self.classes = classes
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        #: Ranks of all pairs of single bytes, which need no hash.
        self.byte_pair = self.find(np.repeat(self.byte, 256), np.tile(self.byte, 256))
        pieces = sorted(ranks, key=ranks.get)
        if [ranks[p] for p in pieces] != list(range(len(pieces))):
            raise ValueError("ranks are not 0, 1, 2 and so on")
        self.pieces = pa.array(pieces, pa.large_binary())

    def _hash(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys * self.FACTOR
        return (h >> np.uint64(49)).astype(np.int64), (h >> np.uint64(20) & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)
        group, slot = self._hash(keys)
        slot ^= self.shift.take(group)
        found = self.rank.take(slot)
        found[self.key.take(slot) != keys] = NO_RANK
        return found


@lru_cache(maxsize=2)
def rank_table(path: str) -> RankTable:
    return RankTable(read_ranks(path), char_classes())


def fold_words(data: np.ndarray, at: np.ndarray, table: RankTable) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the words ``data[at[i]:at[i + 1]]``, one after the other, and where each word's begin."""
    many = np.zeros(len(at) - 1, np.int64)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    token = table.byte.take(data)
    word = np.repeat(np.arange(len(many), dtype=np.int32), np.diff(at))
    rank = np.full(len(token), NO_RANK)
    rank[:-1] = table.byte_pair.take(data[:-1].astype(np.int32) << 8 | data[1:])
    rank[:-1][word[1:] != word[:-1]] = NO_RANK
    #: Words that no pair is left of, and their tokens; a word ends in one round.
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(token):
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(start, append=len(word))
        best = np.minimum.reduceat(rank, start)
        ended = best == NO_RANK
        low = np.repeat(best, size)
        open_ = low != NO_RANK
        own = word[start[ended]]
        many[own] = size[ended]
        done.append((own, token[~open_]))
        low, word, token, rank = low[open_], word[open_], token[open_], rank[open_]
        hit = np.flatnonzero(rank == low)
        if not len(hit):
            break
        # of places that overlap, every other one counts, from the left
        run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) > 1, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        token[hit] = low[hit]
        keep = np.ones(len(token), bool)
        keep[hit + 1] = False
        place = (np.cumsum(keep) - 1)[hit]
        word, token, rank = word[keep], token[keep], rank[keep]
        for left in (place, place[place > 0] - 1):
            paired = left[left + 1 < len(word)]
            paired = paired[word[paired] == word[paired + 1]]
            rank[left] = NO_RANK
            rank[paired] = table.find(token[paired], token[paired + 1])
    ends = np.zeros(len(at), np.int64)
    np.cumsum(many, out=ends[1:])
    tokens = np.empty(ends[-1], np.int64)
    for own, found in done:
        size = many[own]
        tokens[np.repeat(ends[own] - (np.cumsum(size) - size), size) + np.arange(len(found))] = found
    return tokens, ends


def take_spans(values: np.ndarray, at: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans ``values[at[p]:at[p + 1]]`` for each ``p`` of ``picked``, joined, and where each begins."""
    size = np.diff(at)[picked]
    ends = np.zeros(len(picked) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return values[np.repeat(at[:-1][picked] - ends[:-1], size) + np.arange(ends[-1])], ends


def encode_texts(texts: pa.Array, table: RankTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where each text's ids begin."""
    data, at = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    begins, before = split_words(data, at, table.classes)
    marks = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
    found = pa.Array.from_buffers(
        pa.large_binary(), len(begins), [None, marks, pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    words = found.dictionary.cast(pa.large_binary())
    tokens, token_at = fold_words(*text_bytes(words), table)
    ids, word_ends = take_spans(tokens, token_at, found.indices.to_numpy())
    return ids, word_ends[before]


def decode_ids(ids: np.ndarray, at: np.ndarray, table: RankTable) -> pa.Array:
    """The bytes of each text: the pieces of its ids, joined."""
    pieces = table.pieces.take(pa.array(ids))
    data, ends = text_bytes(pieces)
    return pa.Array.from_buffers(
        pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends[at]), pa.py_buffer(np.ascontiguousarray(data))]
    )


def encode(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``n_tokens``, ``ids`` (packed, little-endian unsigned 32-bit) and ``decoded`` (bytes)."""
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids binary, decoded binary"
    table = rank_table(ranks_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ENCODE_BLOCK):
            yield packed(block)

    def packed(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = encode_texts(block.column(1), table)
        four = pa.Array.from_buffers(
            pa.large_binary(), block.num_rows, [None, pa.py_buffer(4 * at), pa.py_buffer(ids.astype("<u4"))]
        )
        columns = [block.column(0), pa.array(np.diff(at)), four.cast(pa.binary()), decode_ids(ids, at, table).cast(pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [doc_id, "n_tokens", "ids", "decoded"])

    return docs.select(doc_id, F.col(text).alias("text")).mapInArrow(work, schema)


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``decoded`` anew from a column ``ids`` of packed ids; all columns but ``decoded`` stay. NULL ids give NULL."""
    ranks = read_ranks(ranks_path)
    kept = encoded.drop("decoded")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sorted(ranks, key=ranks.get)
        for batch in batches:
            texts = [
                None if x is None else b"".join(pieces[i] for i in unpack(x)) for x in batch["ids"].to_pylist()
            ]
            yield batch.append_column("decoded", pa.array(texts, pa.binary()))

    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())])
    return kept.mapInArrow(work, schema)


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of ``word`` by a Spark higher-order function; an array of numbers, NULL for NULL.

    The state has one character per token, from code point 256 on; a literal map is searched from its
    start, so the rank map is cut by checksum into maps of a few entries.
    """
    first, buckets = 0x100, [{} for _ in range(1 << 15)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                pair = chr(first + left) + chr(first + right)
                buckets[zlib.crc32(pair.encode()) % len(buckets)][pair] = f"{rank:05d}{pair}{chr(first + rank)}"
    rank_map = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,string>>")
    by_byte = "".join(chr(first + ranks[bytes([b])]) for b in range(256))
    start = F.translate(
        F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "".join(map(chr, range(256))), by_byte
    )

    def found(pair: Column) -> Column:
        bucket = F.crc32(pair.cast("binary")).bitwiseAND(len(buckets) - 1).cast("int")
        return F.try_element_at(F.get(rank_map, bucket), pair)

    def step(state: Column, _: Column) -> Column:
        tokens = state["tokens"]
        pairs = F.regexp_extract_all(tokens, F.lit("(?s)(?=(..))"), 1)
        joined = F.transform(
            F.array(F.array_min(F.transform(pairs, found))),
            lambda low: F.struct(
                F.when(low.isNull(), tokens)
                .otherwise(F.replace(tokens, F.substring(low, 6, 2), F.substring(low, 8, 1)))
                .alias("tokens"),
                low.isNull().alias("done"),
            ),
        )
        return F.when(state["done"], state).otherwise(joined[0])

    begin = F.struct(start.alias("tokens"), F.lit(False).alias("done"))
    tokens = F.aggregate(F.sequence(F.lit(0), F.octet_length(word)), begin, step, lambda s: s["tokens"])
    return F.transform(F.regexp_extract_all(tokens, F.lit("(?s)."), 0), lambda c: F.ascii(c) - first)
