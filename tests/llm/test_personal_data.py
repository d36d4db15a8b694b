"""Personal data: fixed formats against plain regular expressions, votes, and the trained classifier."""

import random
import re

from pyspark.sql import functions as F

from casewright.llm import personal_data
from tests.llm.odd import ODD_TEXTS, empty_documents, odd_documents


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m)) <= 19 and luhn(digits(m)):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m)) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return sorted(found)




def test_fixed_formats(spark):
    rng = random.Random(3)
    parts = ["1", "2", "23", "4", "55", "0", ".", ".", " ", "-", "@", "a", "b.c", "_", "+", "(", ")", "é", "😀", "255",
             "a@b.c", "4111111111111111", "4111 1111 1111 1111", "+1 269 555-3296", "007", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["a@" + "b." * 3000, "1." * 4000, "9" * 30_000, "9 " * 9000, "+1" + " " * 30_000, "a" * 50_000, "mail x@y.zz, " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in personal_data.detect(docs).collect():
        assert [tuple(s) for s in row.spans if s.kind != "other"] == brute(texts[row.doc_id])


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "call +1 269 555-3296")], "doc_id long, text string")
    for frame in (personal_data.find_spans(docs), personal_data.detect(docs)):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_more_spans_are_learned(spark):
    rng = random.Random(4)
    number = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    texts = [f"please call {number()} or phone: +1 {number()} or mail u{i}@example.com" for i in range(200)]
    texts += [f"order 12.34.5678{i % 10} and version 20.11.2024{i % 10} of the page" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [s for s in r.spans if s.kind == "other"] for r in personal_data.detect(docs).collect()}
    assert sum(bool(got[i]) for i in range(200)) >= 190 and not any(got[i] for i in range(200, 400))
    assert got[0][0].start == texts[0].index("-") - 3 and got[0][0].end == got[0][0].start + 12


def test_expectation_maximisation_finds_reliabilities():
    rng = random.Random(5)
    hits, counted = 0, {}
    for _ in range(6000):
        truth = rng.random() < 0.4
        right = [truth if rng.random() < p else not truth for p in (0.95, 0.9, 0.6, 0.85)]
        votes = tuple(int(r) if rng.random() < 0.8 else 2 for r in right)
        counted.setdefault(votes, []).append(truth)
    belief = personal_data.reliabilities(sorted((v, len(t)) for v, t in counted.items()))
    for votes, truths in counted.items():
        hits += sum((belief[votes] > 0.5) == t for t in truths)
    assert hits / 6000 > 0.9


def test_odd_rows(spark):
    rows = personal_data.detect(odd_documents(spark)).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    assert all(not r.spans for r in rows if r.doc_id in (0, 1, 2))
    assert personal_data.detect(empty_documents(spark)).count() == 0
    assert personal_data.detect(odd_documents(spark)).agg(F.count("doc_id")).head()[0] == len(ODD_TEXTS) + 1
