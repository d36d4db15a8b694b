"""Every stage of the pipeline against a plain version, on its own input."""

import re

import pytest
import tiktoken
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from casewright.llm import bpe, toxicity
from casewright.llm.common import remainder, stored
from tests.llm.odd import odd_documents
from tests.llm.test_pairs import brute_classes, words_of
from tests.llm.test_secret_scan import brute as secrets_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returned, after the input."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def _rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_names_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    assert all(frame.dtypes == kept[0].dtypes for frame in kept[:5])


def test_toxic_documents_go(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(kept[0], labels, remainder(F.col("doc_id"), 5) != 0)
    before = kept[0].collect()
    scores = model.scores(pa.array([r.text for r in before], pa.large_string()))
    assert set(_rows(kept[1])) == {r.doc_id for r, s in zip(before, scores) if s < 0.5}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(clean & set(_rows(kept[1]))) >= 0.95 * len(clean)
    assert len(toxic & set(_rows(kept[1]))) < 0.5 * len(toxic)


def test_one_document_of_each_class_stays(kept):
    before = sorted((r.doc_id, r.text) for r in kept[1].collect())
    assert sorted(_rows(kept[2])) == sorted(set(brute_classes(before)))


def test_leaks_go(spark, kept):
    items = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, row in _rows(kept[2]).items():
        text = " " + " ".join(words_of(row.text)) + " "
        whole = any(f" {item} " in text for item in items)
        seeds = {tuple(words_of(row.text)[k : k + 5]) for k in range(len(words_of(row.text)))}
        touched = any(tuple(item.split()[k : k + 5]) in seeds for item in items for k in range(len(item.split()) - 4))
        if whole:
            assert i not in _rows(kept[3])
        if not touched:
            assert i in _rows(kept[3])


def test_secrets_are_blotted_out(kept):
    after = _rows(kept[4])
    assert set(after) == set(_rows(kept[3]))
    for i, row in _rows(kept[3]).items():
        assert not secrets_of(after[i].text) and after[i].n_chars == len(after[i].text)
        if "[SECRET]" not in after[i].text:
            assert after[i].text == row.text
        else:
            parts = after[i].text.split("[SECRET]")
            assert re.fullmatch("(?s)" + ".+?".join(map(re.escape, parts)), row.text)


def test_ids_are_the_librarys(kept):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(corpus_pipeline.RANKS), special_tokens={}
    )
    texts = _rows(kept[4])
    for i, row in _rows(kept[5]).items():
        assert bpe.unpack(row.ids) == library.encode_ordinary(texts[i].text) and row.n_tokens == len(row.ids) // 4


def test_odd_rows_pass_all_stages(spark):
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            rows = stored(stage(spark, rows, SF), f"odd-{name}")
        assert "ids" in rows.columns
