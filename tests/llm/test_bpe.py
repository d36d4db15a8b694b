"""Byte-level BPE against the tiktoken library."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from casewright.llm import bpe
from tests.llm.odd import ODD_TEXTS, empty_documents, odd_documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}
    )


def _encode(texts):
    table = bpe.rank_table(PATH)
    ids, at = bpe.encode_texts(pa.array(texts, pa.large_string()), table)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])], bpe.decode_ids(ids, at, table).to_pylist()


def test_random_texts(library):
    rng = random.Random(1)
    signs = "ab  \n\t's't're've'm'll'd1.,é漢😀 ́A  ½"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", "it's I'm 'll ''s 's'ssss x'reb  'd 'vee 'v 'l", "a" * 1000, " " * 77, "a'", "' s", "DON'T don't"]
    ids, back = _encode(texts)
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert back == [t.encode() for t in texts]


def test_long_words(library):
    rng = random.Random(2)
    texts = ["ab" * 40_000, "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    assert _encode(texts)[0] == [library.encode_ordinary(t) for t in texts]


def test_every_piece_is_reached_by_merges():
    pieces = sorted(bpe.read_ranks(PATH), key=bpe.read_ranks(PATH).get)
    at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    tokens, begins = bpe.fold_words(np.frombuffer(b"".join(pieces), np.uint8), at, bpe.rank_table(PATH))
    assert tokens.tolist() == list(range(len(pieces))) and begins.tolist() == list(range(len(pieces) + 1))


def test_merging_of_words_by_definition_in_little_memory():
    rng, ranks = random.Random(3), bpe.read_ranks(PATH)
    words = ["".join(rng.choice("aabcdeeinorst") for _ in range(rng.randint(0, 12))).encode() for _ in range(20_000)]
    words += [b"", b"a" * 301, "\u00e9\u00e8".encode() * 20, b""]
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    data, table = np.frombuffer(b"".join(words), np.uint8), bpe.rank_table(PATH)
    tracemalloc.start()
    tokens, begins = bpe.fold_words(data, at, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * len(data)
    for i in [*range(500), *range(20_000, len(words))]:
        parts = [words[i][k : k + 1] for k in range(len(words[i]))]
        while len(parts) > 1:
            rank, k = min((ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert tokens[begins[i] : begins[i + 1]].tolist() == [ranks[p] for p in parts], words[i]


def test_odd_rows(spark, library):
    rows = bpe.encode(odd_documents(spark), PATH).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, text in enumerate(ODD_TEXTS):
        assert bpe.unpack(by_id[i].ids) == library.encode_ordinary(text or "")
        assert bytes(by_id[i].decoded) == (text or "").encode() and by_id[i].n_tokens == len(by_id[i].ids) // 4
    assert bpe.encode(empty_documents(spark), PATH).count() == 0


def test_decode_alone(spark):
    encoded = bpe.encode(odd_documents(spark), PATH)
    again = bpe.decode(encoded.withColumnRenamed("decoded", "first").withColumn("more", F.lit(1)), PATH)
    assert again.where("decoded <> first OR decoded IS NULL").count() == 0 and "more" in again.columns


def test_higher_order_form(spark, library):
    words = [" the", "unbelievable", "été", "aaaaaaaaaaaa", "x", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", bpe.fold_merges(F.col("w"), bpe.read_ranks(PATH)).alias("ids")).collect()
    assert {r.w: r.ids for r in got} == {w: library.encode_ordinary(w) for w in words}
