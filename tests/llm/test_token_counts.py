"""Token counts against the library on whole texts."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casewright.llm import queries, token_counts
from tests.llm.odd import ODD_TEXTS, empty_documents, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False))


def _texts(rng):
    signs = ["a", "bc ", " ", "  ", "\n", "\n\n ", "'s", "'re", "'", "1", "23", "é", "漢", "😀", ".", "--", "<|endoftext|>"]
    signs += ["<|end", "oftext|>", "The quick", " over", "\t", " ", "ve", "r"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    # runs without any stable place
    texts += ["x" * 900, " " * 700 + "end", "ab " * 40 + "z" * 500 + " cd" * 90, "." * 333 + "\n" * 333, "1" * 100 + "<|endoftext|>" * 60]
    return texts


def test_chunks_are_spliced(spark, library):
    texts = _texts(random.Random(4))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = token_counts.count_tokens(docs, PATH, limit=50, chunk=70, overlap=30).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: library(t) for i, t in enumerate(texts)}
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 50) for r in rows)


def test_pieces(library):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["", *_texts(random.Random(5)), "", "a <|endoftext|> b", "é \u3000 x  y", " lead", "\x7f \x00 a"]
    known = {}
    for _ in range(2):
        counted = token_counts.count_pieces(pa.array(texts, pa.large_string()), tokenizer, known)
        assert counted.tolist() == [library(t) for t in texts]
    assert token_counts.count_pieces(pa.array(["", ""], pa.large_string()), tokenizer, known).tolist() == [0, 0]


def test_places_are_stable(spark, library):
    """A run of letters needs wider chunks, prose does not."""
    content, margin = token_counts.read_tokenizer(PATH)
    docs = spark.createDataFrame([(b"a", "word by word, " * 60), (b"b", "y" * 840)], "key binary, text string")
    encoded = token_counts._encoded(token_counts._chunks(docs, 70, 30), content, 70, 30, margin)
    found = {bytes(r.key): (r.n_tokens, r.failed) for r in token_counts._spliced(encoded).collect()}
    assert found[b"a"] == (library("word by word, " * 60), False)
    assert found[b"b"][1] is True


def test_copies_and_odd_rows(spark, library):
    docs = odd_documents(spark).union(odd_documents(spark).where("doc_id > 4"))
    rows = token_counts.count_tokens(docs, PATH, chunk=2000, overlap=64).collect()
    expected = sorted((str(r.doc_id), library(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == expected
    whole = token_counts.count_tokens(odd_documents(spark), PATH).collect()
    assert {r.doc_id: r.n_tokens for r in whole if r.doc_id is not None} == {i: library(t) for i, t in enumerate(ODD_TEXTS)}
    assert token_counts.count_tokens(empty_documents(spark), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_token_counts(spark, sf).select("*", F.lit(1)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        i: (len((t or "").encode()), library(t), library(t) > 1024) for i, t in texts.items()
    }
