"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from casewright.llm import queries, spelling
from tests.llm.odd import empty_documents, odd_documents


def edits(word):
    """What a deleted letter leaves, with its place."""
    return [(word[:i] + word[i + 1 :], i) for i in range(len(word))]


def brute(counts):
    """word: (form, root, n, n_near, form_n)."""
    shared = defaultdict(set)
    for word in counts:
        for rest, i in edits(word):
            shared[rest, i].add(word)
    near = {w: set() for w in counts}
    for word in counts:
        for rest, i in edits(word):
            near[word] |= shared[rest, i] - {word}
            if rest in counts:
                near[word].add(rest)
                near[rest].add(word)
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda x: (-counts[x], x), default=None)
        form[word] = best if best is not None and counts[best] >= 2 * n else None

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return {w: (form[w], root(w), n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items()}


def result(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_one_edit():
    rng = random.Random(1)
    pairs = []
    for _ in range(3000):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(5, 8)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + "z" + a[i + 1 :], a[:i] + rng.choice("abc") + a[i:], a[:i] + rng.choice("abé") + a[i + 1 :], a[::-1]])
        pairs.append((a, b))
    words = spelling.Words([w for pair in pairs for w in pair])
    index = np.arange(len(pairs)) * 2
    got = spelling.one_edit(words, index, index + 1)
    for (a, b), found in zip(pairs, got):
        if len(a) == len(b):
            assert found == (sum(x != y for x, y in zip(a, b)) == 1)
        else:
            assert found == any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_random_words_in_small_cells(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9))) for _ in range(3000)}
    counts = {w: rng.choice([3, 4, 7, 20, 90]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert result(spelling.variants(frame, cell_size=100)) == brute(counts)


def test_many_words_of_one_vector(spark):
    rng = random.Random(3)
    letters = list("aaaabbbbcccc")
    words = set()
    while len(words) < 600:
        rng.shuffle(letters)
        words.add("".join(letters))
    words |= {w[:3] + "d" + w[4:] for w in list(words)[:200]} | {w[:-1] for w in list(words)[:200]}
    counts = {w: i + 3 for i, w in enumerate(sorted(words))}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(spelling.variants(frame, cell_size=50)) == brute(counts)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    runs = spelling.occurrences(docs, "text", "doc_id")
    counted = spelling.count_words(queries.misspelt(runs), rarest=1)
    assert {r.word for r in counted.collect()} >= {"x" * 70_000, "twice"}
    assert result(spelling.variants(counted))["x" * 70_000] == (None, "x" * 70_000, 1, 0, None)
    assert spelling.variants(spelling.count_words(queries.misspelt(spelling.occurrences(empty_documents(spark), "text", "doc_id")))).count() == 0
    frame = spark.createDataFrame([(None, 4, 1), ("", 3, 1), ("a", 3, 1), ("ab", 9, 1), ("😀b", 30, 1)], "word string, n long, cell int")
    assert result(spelling.variants(frame)) == brute({"": 3, "a": 3, "ab": 9, "😀b": 30})


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.op13_spelling(spark, sf)) == brute(words_of(rows))
