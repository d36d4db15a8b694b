"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly.

Each word is the bag of itself and its character n-grams (3 to 5 bytes, marked at both ends of the word),
hashed to a fixed number of buckets. A word's vector is the mean of its bag, a text's vector the mean of
its words, each by the root of its number, and some blanks, and a linear softmax gives the class. Embeddings and softmax are trained together by Adam, so
that misspellings never seen share the vectors of the n-grams they keep.

The model is fitted on a bounded sample of labelled rows: the ``SAMPLE`` labelled keys of each class with
the smallest hashes, as sparse bags. Their size is bounded by rows times buckets, whatever the texts.
After training the embeddings and the softmax are folded into one number per bucket, as both are linear;
scoring is one pass over the whole texts without a shuffle.

Defined results: a NULL or empty text, or one without words, has the score of the bias alone; NULL labels are not used, and
of repeated labels of one key the highest counts; with no labels at all every score is 0.5 or what the one
class present gives; repeated or NULL keys keep a row each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import (
    BASE_INVERSE, BYTE_CODE, IN_WORD, LOWER, blocks, mix, powers, prefix_hash, remainder, runs, span_hash, text_bytes,
)

BUCKETS, DIMENSION, SIZES = 1 << 17, 4, (3, 4, 5)
#: Labelled rows used for training, by class: (clean, toxic).
SAMPLE = (6000, 1700)
#: The rate falls to 0 over all steps.
EPOCHS, BATCH, RATE = 10, 50, 0.06
#: Small samples get more epochs, up to this many steps.
LEAST_STEPS = 600
HELD_OUT = 5
#: Words without a vector that are averaged in with every text, so that a few odd words decide little.
BLANKS = 20


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of all texts as (bucket, distinct word) pairs, and for each place of a word
    its distinct word; last, where the words of each text begin."""
    data, at = text_bytes(texts)
    start, stop = runs(IN_WORD[data], at)
    inverse = powers(BASE_INVERSE, len(data) + 1)
    prefix = prefix_hash(BYTE_CODE[LOWER[data]])
    whole = span_hash(prefix, start, stop, inverse)
    distinct, first, place = np.unique(whole, return_index=True, return_inverse=True)
    begin, end = start[first], stop[first]
    buckets, owner = [distinct], [np.arange(len(distinct))]
    for size in SIZES:
        many = np.maximum(end - begin - size + 1, 0)
        word = np.repeat(np.arange(len(begin)), many)
        shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        left = begin[word] + shift
        marks = (shift == 0).astype(np.uint64) + 2 * (left + size == end[word]).astype(np.uint64)
        buckets.append(mix(span_hash(prefix, left, left + size, inverse) + marks))
        owner.append(word)
    bucket = (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return bucket, np.concatenate(owner), place, np.searchsorted(start, at)


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their weights."""
    bucket, owner, place, at = subwords(texts)
    order = np.argsort(owner, kind="stable")
    bucket, size = bucket[order], np.bincount(owner)
    begin = np.cumsum(size) - size
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        words, times = np.unique(place[a:b], return_counts=True)
        many, share = size[words], np.sqrt(times)
        spread = np.repeat(share / many / (share.sum() + BLANKS), many)
        index = np.repeat(begin[words] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        own, where = np.unique(bucket[index], return_inverse=True)
        out.append((own.astype(np.int32), np.bincount(where, spread, len(own)).astype(np.float32)))
    return out


@dataclass
class ToxicityModel:
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        bucket, owner, place, at = subwords(texts)
        n = int(place.max()) + 1 if len(place) else 0
        word = np.bincount(owner, self.weight[bucket], n) / np.maximum(np.bincount(owner, minlength=n), 1)
        texts = np.repeat(np.arange(len(at) - 1), np.diff(at))
        each, times = np.unique(texts * max(1, n) + place, return_counts=True)
        texts, each, share = each // max(1, n), each % max(1, n), np.sqrt(times)
        mean = np.bincount(texts, word[each] * share, len(at) - 1) / (
            np.bincount(texts, share, len(at) - 1) + BLANKS
        )
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -50, 50)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> ToxicityModel:
    """Joint training of the embeddings, which begin at 0, and the softmax; buckets that no row has keep no weight."""
    if not len(rows):
        return ToxicityModel(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(0)
    params = [
        np.zeros((DIMENSION, BUCKETS), np.float32),
        rng.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32),
        np.zeros(2, np.float32),
    ]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    batches = -(-len(rows) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), BATCH):
            batch = order[low : low + BATCH]
            own, weight = (np.concatenate([rows[i][k] for i in batch]) for k in (0, 1))
            doc = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            embed, soft, bias = params
            vector = np.stack([np.bincount(doc, e[own] * weight, len(batch)) for e in embed], 1)
            logit = vector @ soft + bias
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(batch)), labels[batch]] -= 1
            prob /= len(batch)
            back = prob @ soft.T
            grads = [
                np.stack([np.bincount(own, back[doc, d] * weight, BUCKETS) for d in range(DIMENSION)]),
                vector.T @ prob,
                prob.sum(0),
            ]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    embed, soft, bias = params
    return ToxicityModel((soft[:, 1] - soft[:, 0]) @ embed, float(bias[1] - bias[0]))


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text"
) -> ToxicityModel:
    """Train on ``labels`` (key, ``toxic`` 0 or 1) that ``usable`` lets through."""
    known = labels.where(usable) if usable is not None else labels
    known = known.where(F.col("toxic").isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.groupBy(doc_id).agg(F.max("toxic").alias("toxic"))
    picked = None
    for label, most in enumerate(SAMPLE):
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64(doc_id), doc_id).limit(most)
        picked = some if picked is None else picked.unionByName(some)
    # at most sum(SAMPLE) rows of two numbers are broadcast
    rows = docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(picked), doc_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = bags(block.column(0))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(1),
                    pa.array([len(b) for b, _ in found], pa.int32()),
                    # buckets ascend, so that their steps pack well
                    pa.array([zlib.compress(np.diff(b, prepend=0).astype(np.int32).tobytes(), 1) for b, _ in found], pa.binary()),
                    pa.array([zlib.compress(w.tobytes(), 1) for _, w in found], pa.binary()),
                ],
                ["toxic", "size", "buckets", "weights"],
            )

    kept = rows.select("text", F.col("toxic").cast("int").alias("toxic"))
    table = kept.mapInArrow(work, "toxic int, size int, buckets binary, weights binary").toArrow()  # sum(SAMPLE) rows
    ends = np.concatenate([[0], np.cumsum(table["size"].to_numpy().astype(np.int64))])
    bucket, weight = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32)
    for i, (b, w) in enumerate(zip(table["buckets"], table["weights"], strict=True)):
        low, high = ends[i], ends[i + 1]
        np.cumsum(np.frombuffer(zlib.decompress(b.as_py()), np.int32), out=bucket[low:high])
        weight[low:high] = np.frombuffer(zlib.decompress(w.as_py()), np.float32)
    labels_of = table["toxic"].to_numpy()
    del table
    taught = [(bucket[a:b], weight[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    order = sorted(range(len(taught)), key=lambda i: (taught[i][0][:16].tobytes(), len(taught[i][0])))
    return train([taught[i] for i in order], labels_of[order])


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ``score``, the probability of the toxic class."""
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = pa.array(model.scores(block.column(1)))
            yield pa.RecordBatch.from_arrays([block.column(0), found], [doc_id, "score"])

    return docs.select(doc_id, F.col(text).alias("text")).mapInArrow(work, schema)


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, without those that the model rejects (score 0.5 or more)."""
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for block in blocks(iter([batch.select([place]).rename_columns(["text"])])):
                clean = pa.array(model.scores(block.column(0)) < 0.5)
                yield batch.slice(start, block.num_rows).filter(clean)
                start += block.num_rows

    return docs.mapInArrow(work, docs.schema)
