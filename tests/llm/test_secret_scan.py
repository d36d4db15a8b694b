"""Secrets: fixed formats against plain regular expressions, and formats that the automata add."""

import random
import re

import pyarrow as pa

from casewright.llm import secret_scan
from casewright.llm.common import text_bytes
from tests.llm.odd import ODD_TEXTS, empty_documents, odd_documents

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(found)]


def _scan(spark, texts, model=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = secret_scan.scan(docs, model or secret_scan.learn_formats(docs))
    return {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()}


def test_fixed_formats(spark):
    rng = random.Random(4)
    parts = ["password", "PassWord", "token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "é😀", "AKIA", "ABCD1234",
             "deadbeef", "0123456789", "f", "Z", "-", "secret", "ſecret", "passwd", "abc/def+gh="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = _scan(spark, texts)
    for i, text in enumerate(texts):
        assert [s for s in got[i] if s[0] != "format"] == brute(text), text


def test_added_formats_look_like_the_labelled_ones(spark):
    rng = random.Random(5)
    key = lambda n, signs: "".join(rng.choice(signs) for _ in range(n))
    texts = [f"say token={key(24, 'abcdef0123456789')} and AKIA{key(16, 'ABCDEFGHIJKLMNOP234567')} now" for _ in range(300)]
    texts += [f"see https-host{key(3, '123')}.example.com.page.of.words{i} there" for i in range(300)]
    # the head of an access key cut off: the same alphabet and length, no fixed format
    lone = [f"got ASIA{key(16, 'ABCDEFGHIJKLMNOP234567')} here" for _ in range(50)]
    got = _scan(spark, texts + lone)
    added = [any(s[0] == "format" for s in got[i]) for i in range(len(texts) + len(lone))]
    assert sum(added[:300]) == 0 and sum(added[300:600]) <= 3 and sum(added[600:]) >= 40
    start = got[600 + added[600:].index(True)][0]
    assert start == ("format", 4, 24)


def test_every_run_is_a_candidate(spark):
    rng = random.Random(6)
    key = lambda n, signs: "".join(rng.choice(signs) for _ in range(n))
    capitals, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    texts = [f"token={key(13, capitals)} password: {key(4, 'XYZ')}{key(16, hexes)}{key(4, 'XYZ')} end" for _ in range(300)]
    texts += [f"the counterrevolution{key(2, 'stuy')} of incomprehensible{key(2, 'lnor')}things {i}" for i in range(300)]
    # bare: short, of letters only and before a full stop; and a key with a fixed format inside
    bare = [f"got {key(13, capitals)}. Then" for _ in range(40)]
    inner = [f"got {key(4, 'XYZ')}{key(16, hexes)}{key(4, 'XYZ')} then" for _ in range(40)]
    got = _scan(spark, texts + bare + inner)
    added = [[s[1:] for s in got[i] if s[0] == "format"] for i in range(len(got))]
    assert not any(added[:600])
    assert sum(spans == [(4, 17)] for spans in added[600:640]) >= 38
    assert sum(spans == [(4, 28)] for spans in added[640:]) >= 36
    assert all(any(s[0] == "hex" for s in got[i]) for i in range(640, 680))


def test_candidates_without_numpy():
    rng = random.Random(7)
    texts = ["".join(rng.choice(["ab", "F0", ".", "..", "=", " ", "é", "token=", "0123456789abcdef", "longwordhere"])
                     for _ in range(rng.randint(0, 12))) for _ in range(400)]
    data, at = text_bytes(pa.array(texts, pa.large_string()))
    base = secret_scan.base_spans(data, at)
    want = []
    for low, text in zip(at, texts):
        for m in re.finditer(rb"[0-9A-Za-z+/_.=-]+", text.encode()):
            run = m[0].rstrip(b".")
            place = range(int(low) + m.start(), int(low) + m.start() + len(run))
            if len(run) >= 12 and not all(any(b <= p < e for _, b, e in base) for p in place):
                want.append((place.start, place.stop))
    assert secret_scan.candidate_runs(data, at, base) == want


def test_automaton_merges_states():
    automaton = secret_scan.Automaton([b"0a" * n for n in range(4, 40)] * 8)
    reached, todo = {0}, [0]
    while todo:
        for to in automaton.states[todo.pop()].next.values():
            if to not in reached:
                reached.add(to)
                todo.append(to)
    assert len(reached) < 40  # the prefix tree has 79 states
    assert automaton.log_likelihood(b"0a" * 12) > automaton.log_likelihood(b"a0" * 12) + 8


def test_redaction(spark):
    text = "été token = abcdef0123456789abcdef0123 fin"
    docs = spark.createDataFrame([(1, text, 7), (2, None, 8), (3, "clean", 9)], "doc_id long, text string, text_id int")
    rows = {r.doc_id: r for r in secret_scan.redact(docs, secret_scan.learn_formats(docs)).collect()}
    assert rows[1].text == "été [SECRET] fin" and rows[1].text_id == 7
    assert rows[2].text is None and rows[3].text == "clean"


def test_odd_rows(spark):
    docs = odd_documents(spark)
    model = secret_scan.learn_formats(docs)
    rows = secret_scan.scan(docs, model).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    assert secret_scan.redact(docs, model).columns == docs.columns
    none = empty_documents(spark)
    assert secret_scan.scan(none, secret_scan.learn_formats(none)).count() == 0
