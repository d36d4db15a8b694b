"""Fill-in-middle against a plain version over tokens of the pattern."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from casewright.llm import infill, queries
from tests.llm.odd import empty_documents, odd_documents

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_ranks():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 8, size).astype(np.uint8)
        matrix, at = infill.WaveletMatrix(values, 3), np.arange(size + 1)
        for v in range(8):
            assert matrix.rank(v, at).tolist() == [0, *np.cumsum(values == v).tolist()]


def test_units_of_a_block():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é漢😀 \t\n \x0b") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    units = infill.Units(pa.array(texts, pa.large_string()))
    found = [UNIT.findall(t) for t in texts]
    assert units.count.tolist() == [len(f) for f in found]
    for wanted in range(4):
        k = np.minimum(wanted, units.count)
        ends = units.end_of(k) - units.chars[:-1]
        assert ends.tolist() == [len("".join(f[:wanted])) for f in found]


def test_random_texts(spark):
    rng = random.Random(3)
    signs = ["a", "bc", " ", "\n", "<P>", "<", "S>", "<S", "M>", "é😀", "P>", "x y"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = infill.transform(docs).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    texts = dict(rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, texts[r.doc_id])
        assert r.back == texts[r.doc_id]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    made = infill.transform(docs).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    expected = sorted((str(r.doc_id), *map(str, plain(r.doc_id, r.text)), r.text or "") for r in docs.collect())
    got = [(str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.back) for r in made]
    assert sorted(got) == expected
    assert infill.transform(empty_documents(spark)).count() == 0
    forced = infill.transform(docs, marked=100, suffix_first=0).select("form", "output").collect()
    assert {r.form for r in forced if r.output} == {"psm"}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_infill(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        *numbers, output = plain(r.doc_id, texts[r.doc_id])
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (output, texts[r.doc_id])]
        assert [r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256] == numbers + digests
