"""Removal of repeated 200-byte strings against a plain count of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from casewright.llm import repeats
from tests.llm.odd import ODD_TEXTS, empty_documents, odd_documents


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    windows = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if windows[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def _texts(rng):
    draw = lambda n, signs="abcdefghij é\n": "".join(rng.choice(signs) for _ in range(n))
    line, block = draw(197) + "é", draw(260)
    assert len(line.encode()) >= 200
    texts = [draw(rng.randint(0, 900)) for _ in range(20)]
    texts += [draw(rng.randint(0, 300)) + line + draw(rng.randint(0, 300)) for _ in range(40)]  # many contexts
    texts += [draw(50) + block[: rng.randint(150, 260)] + draw(60) for _ in range(12)]  # around the limit
    copy = draw(1200)
    texts += [copy, copy, copy[:700] + draw(5) + copy[700:], copy[100:1000], copy[::-1]]
    texts += ["a" * 199, "a" * 199, "b" * 200, "b" * 200, "c" * 201, "xy" * 300, draw(250) * 2, "é" * 150, ""]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("together", [20_000, 1])
def test_equal_to_plain_counts(spark, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    texts = _texts(random.Random(6))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute(texts)
    rows = repeats.remove_repeats(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice("abcd") for _ in range(5000))
    data = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(repeats, "PIECE", 700)
    owner, _, _, first, many = repeats.stretches(data, np.array([0, len(data)]))
    covered = sorted(p for f, m in zip(first.tolist(), many.tolist()) for p in range(f, f + m))
    assert covered == list(range(len(text) - 199)) and many.max() <= repeats.SPAN and not owner.any()
    texts = [text, text[1300:3300], text[100:290]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_copies_share_their_ranges(spark):
    rng = random.Random(8)
    copy, part = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (3000, 400))
    texts = [copy] * 3000 + [copy[:500] + part, part + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    ranges = [tuple(r) for r in repeats.repeated_ranges(docs).collect()]
    assert len(ranges) == len(set(ranges)) < 200
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()}
    assert got == dict(enumerate([(3000, 3000, 1, b"")] * 3000 + [(900, 900, 1, b""), (401, 400, 1, b"x")]))


def test_odd_rows(spark):
    rows = repeats.remove_repeats(odd_documents(spark)).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].n_bytes == 0 and by_id[5].n_removed == 70_000 and by_id[8].n_removed == 0
    assert repeats.remove_repeats(empty_documents(spark)).count() == 0
