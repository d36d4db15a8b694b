"""Token counts of whole texts, those of huge documents by overlapping chunks that are spliced.

A text that fits into one chunk is encoded by its pieces: a space after a visible ASCII character always begins
a match of the splitting pattern, so texts may be cut there, and each distinct piece of a block of texts is
encoded once and its number of tokens kept for the next blocks. A longer text is cut into chunks that overlap, each a row
of its own, dealt over all tasks and encoded with offsets. Two neighbours are spliced at a place in their
overlap at which both begin a match of the splitting pattern. Such a place is proven stable:

* The pattern looks behind at nothing, and special strings are searched from the left. So what follows
  a place at which a match begins depends on the text from there on, wherever the chunk began.
* A match depends on at most three characters from its start and on the one after its end, and a special
  string is known when all of it is seen. So a match that ends ``margin`` characters before the end of a
  chunk is the match of the whole text, if it begins where one of the whole text begins.

The first chunk begins where the text does, so by induction all spliced pieces are the tokens of the whole text.
Where an overlap has no such place (a long run of one class of characters) the document goes through once
more with chunks and overlaps four times as wide, at last in one chunk.

Equal huge texts are one, by their MD5, so copies are encoded once. Chunks are shuffled, shorter texts are not.

Defined results: a NULL text counts as empty and has no tokens; NULL or repeated keys keep a row each; an
empty table gives no rows; of the columns only the key and text are read. A tokenizer file of another
kind than a byte-level one raises ValueError, as the proof does not hold for it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import blocks, stored, text_bytes

#: Code points of a chunk and of what the next one repeats; both grow by this factor where splicing fails.
CHUNK, OVERLAP, WIDEN = 1 << 15, 1 << 8, 4
LIMIT = 1024
#: Pieces whose tokens a task remembers; beyond that it starts anew.
REMEMBERED = 1 << 18
#: A pattern's match looks at three characters from its start and one after its end.
LOOKS = 4


def read_tokenizer(path: str) -> tuple[str, int]:
    """The tokenizer file's content and the margin before a chunk's end that splicing has to leave."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    parts = json.loads(content)
    cut = parts["pre_tokenizer"] or {}
    plain = (
        parts["normalizer"] is None
        and parts["model"]["type"] == "BPE"
        and not parts["model"].get("dropout")
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut.get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in parts["added_tokens"])
    )
    if not plain:
        raise ValueError(f"{path} is no plain byte-level tokenizer")
    return content, LOOKS + max((len(t["content"]) for t in parts["added_tokens"]), default=0)


def _library(content: str) -> Callable:
    """Makes the tokenizer in a task; its threads stay off, as Spark has a task for each core."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    return make


def count_pieces(texts: pa.Array, tokenizer, known: dict[str, int]) -> np.ndarray:
    """The number of tokens of each text, from those of the distinct pieces of all; ``known`` remembers them."""
    data, at = text_bytes(texts)
    begin = np.zeros(len(data), bool)
    begin[1:] = (data[1:] == 0x20) & (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    begin[at[:-1][np.diff(at) > 0]] = True
    begins = np.flatnonzero(begin)
    marks = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
    pieces = pa.Array.from_buffers(
        pa.large_binary(), len(begins), [None, marks, pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    distinct = pieces.dictionary.cast(pa.large_string()).to_pylist()
    if len(known) > REMEMBERED:
        known.clear()
    new = [piece for piece in distinct if piece not in known]
    known.update(zip(new, map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
    sizes = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
    before = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(sizes[pieces.indices.to_numpy()], out=before[1:])
    return np.diff(before[np.searchsorted(begins, at)])


def _count_whole(texts: DataFrame, content: str) -> DataFrame:
    """(``id``, ``n_bytes``, ``n_tokens``) of texts of one chunk."""
    make = _library(content)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = make(), {}
        for block in blocks(batches):
            counts = pa.array(count_pieces(block["text"], tokenizer, known))
            yield pa.RecordBatch.from_arrays([block["id"], block["n_bytes"], counts], ["id", "n_bytes", "n_tokens"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "n_bytes", "text").mapInArrow(work, f"id {kind}, n_bytes long, n_tokens long")


def _chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """(``key``, ``number``, ``last``, ``text``): chunk ``number`` begins at code point ``number * size``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for key, text in zip(block["key"], block["text"], strict=True):
                whole = text.as_py()
                count = max(1, -(-(len(whole) - overlap) // size))
                for number in range(count):
                    piece = whole[number * size : (number + 1) * size + overlap]
                    yield pa.RecordBatch.from_pydict(
                        {"key": pa.array([key.as_py()], pa.binary()), "number": pa.array([number], pa.int32())}
                        | {"last": [number == count - 1], "text": [piece]}
                    )

    cut = texts.select("key", "text").mapInArrow(work, "key binary, number int, last boolean, text string")
    # copies of a text have the same chunks; the shuffle also deals them over all tasks
    return cut.groupBy("key", "number").agg(F.any_value("last").alias("last"), F.any_value("text").alias("text"))


def match_starts(encoding) -> tuple[list[int], list[int]]:
    """Code points at which a match of the splitting pattern begins, and the number of tokens before each."""
    places, before, word = [], [], None
    for index, (own, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if own != word:
            places.append(start)
            before.append(index)
            word = own
    return places, before


def _encoded(chunks: DataFrame, content: str, size: int, overlap: int, margin: int) -> DataFrame:
    """Per chunk its tokens and, for either overlap, the stable places and the tokens before each.

    Places count from where the later of the two chunks begins.
    """
    make = _library(content)
    sides = "struct<place:array<int>,before:array<int>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make()
        for block in blocks(batches):
            rows = []
            found = tokenizer.encode_batch(block["text"].to_pylist(), add_special_tokens=False)
            for encoding in found:
                pairs = list(zip(*match_starts(encoding), strict=True))
                begin = [(p, b) for p, b in pairs if p <= overlap - margin]
                end = [(p - size, b) for p, b in pairs if size <= p <= size + overlap - margin]
                rows.append(
                    {"n": len(encoding)}
                    | {
                        name: {"place": [p for p, _ in side], "before": [b for _, b in side]}
                        for name, side in (("begin", begin), ("end", end))
                    }
                )
            kind = pa.struct([("place", pa.list_(pa.int32())), ("before", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays(
                [
                    *(block[c] for c in ("key", "number", "last")),
                    pa.array([r["n"] for r in rows], pa.int64()),
                    *(pa.array([r[c] for r in rows], kind) for c in ("begin", "end")),
                ],
                ["key", "number", "last", "n", "begin", "end"],
            )

    schema = f"key binary, number int, last boolean, n long, begin {sides}, end {sides}"
    return chunks.select("key", "number", "last", "text").mapInArrow(work, schema)


def _spliced(encoded: DataFrame) -> DataFrame:
    """(``key``, ``n_tokens``, ``failed``): the tokens of each text, and whether two of its chunks did not meet.

    The tokens are those of the last chunk, and for every joint those of the earlier chunk before the place
    less those of the later one before it.
    """
    earlier = encoded.where("NOT last").select("key", (F.col("number") + 1).alias("number"), F.col("end").alias("e"))
    later = encoded.where("number > 0").select("key", "number", F.col("begin").alias("b"))
    place = F.array_min(F.array_intersect("e.place", "b.place"))
    joints = earlier.join(later, ["key", "number"]).withColumn("place", place)

    def tokens(side: str):
        return F.try_element_at(f"{side}.before", F.array_position(f"{side}.place", F.col("place")).cast("int"))

    gain = F.when(F.col("place").isNotNull(), tokens("e") - tokens("b"))
    parts = joints.select("key", gain.cast("long").alias("n"), F.col("place").isNull().alias("failed")).union(
        encoded.where("last").select("key", "n", F.lit(False))
    )
    return parts.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.max("failed").alias("failed"))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = LIMIT,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Per row: the key, ``n_bytes``, ``n_tokens``, and ``over_limit`` (more than ``limit`` tokens)."""
    content, margin = read_tokenizer(tokenizer_path)
    if overlap < margin or chunk < overlap:
        raise ValueError(f"an overlap needs {margin} code points or more, and a chunk as many as its overlap")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    # bytes are no fewer than code points
    huge = F.col("n_bytes") > chunk + overlap
    keyed = rows.where(huge).withColumn("key", F.unhex(F.md5("text")))
    short = _count_whole(rows.where(~huge), content)
    done, todo = [], keyed
    while True:
        encoded = stored(_encoded(_chunks(todo, chunk, overlap), content, chunk, overlap, margin), "chunks")
        found = stored(_spliced(encoded), "spliced")
        done.append(found.where("NOT failed").select("key", "n_tokens"))
        failed = found.where("failed").select("key")
        if failed.isEmpty():
            break
        todo = keyed.join(failed, "key", "left_semi")
        chunk, overlap = WIDEN * chunk, WIDEN * overlap
    counts = reduce(DataFrame.union, done)
    long = keyed.select("id", "n_bytes", "key").join(counts, "key").select("id", "n_bytes", "n_tokens")
    return short.union(long).select(
        F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
