"""Near-duplicates, fingerprints and decontamination against plain versions."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa

from casewright.llm import decontaminate, fingerprint, minhash
from casewright.llm.common import text_bytes
from casewright.llm.graph import components
from tests.llm.odd import ODD_TEXTS, empty_documents, odd_documents


def words_of(text):
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def weights(text):
    words, out = words_of(text), {}
    for i in range(max(1, len(words) - 4) if words else 0):
        key = tuple(words[i : i + 5])
        out[key] = out.get(key, 0) + 1
    return {k: 1 + np.log(n) for k, n in out.items()}


def similarity(x, y):
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())


def brute_classes(rows):
    """Smallest key of each class: equal texts, and links of similarity 0.8 or more."""
    sets = [weights(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] or "") == (rows[j][1] or "") or (sets[i].keys() & sets[j].keys() and similarity(sets[i], sets[j]) >= 0.8):
            root[find(j)] = find(i)
    return [min(rows[k][0] for k in range(len(rows)) if find(k) == find(i)) for i in range(len(rows))]


def near_rows(rng):
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 120))]
        texts.append(" ".join(base))
        chain = base
        for _ in range(rng.randint(0, 6)):  # chains: each a few edits from the one before
            chain = list(chain)
            for _ in range(max(1, len(chain) // 40)):
                chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
            texts.append(" ".join(chain))
    texts += ["one two", "One, two!", "one three", "", "", "!!!", "?!", "a b c a b c a b c " * 20, "a b c a b c a b c " * 21]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.class_size) for r in minhash.near_duplicates(docs).collect()}
    want = brute_classes(rows)
    assert {i: c for i, (c, _) in got.items()} == {r[0]: c for r, c in zip(rows, want)}
    assert all(size == want.count(c) for c, size in got.values())
    assert sorted(r.doc_id for r in minhash.keep_first(docs).collect()) == sorted(set(want))


def test_registers_estimate_probability_jaccard():
    rng = random.Random(8)
    a = [f"w{rng.randrange(1000)}" for _ in range(200)]
    b = a[:150] + [f"w{rng.randrange(1000)}" for _ in range(50)]
    pairs = [(" ".join(a), " ".join(b)), ("x y z u v " * 9 + " ".join(a), " ".join(a))]
    for x, y in pairs:
        registers, has = minhash.signatures(pa.array([x, y], pa.large_string()))
        true = similarity(weights(x), weights(y))
        assert has.all() and abs((registers[0] == registers[1]).mean() - true) < 0.17
        sets = [sorted((hash(k), w) for k, w in weights(t).items()) for t in (x, y)]
        arrays = [np.array(c) for s in sets for c in zip(*s)]
        assert abs(minhash.probability_jaccard(*arrays) - true) < 1e-9


def test_near_duplicates_odd_rows(spark):
    docs = odd_documents(spark)
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    sizes = {r.doc_id: r.class_size for r in rows}
    assert sizes[8] == 2 and sizes[0] == sizes[1] == 3  # two NULL texts and an empty one
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.class_id for r in rows})
    assert minhash.near_duplicates(empty_documents(spark)).count() == 0
    assert minhash.keep_first(empty_documents(spark)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def _fingerprints(texts):
    return fingerprint.fingerprints(*text_bytes(pa.array([t.encode() for t in texts], pa.large_binary())))


def test_equal_substrings_share_phrases():
    rng = random.Random(10)
    draw = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    common, a, b = draw(3000), draw(77), draw(190)
    x, y, z = _fingerprints([a + common, b + common, draw(3200)])
    assert fingerprint.likeness(x, y) > 0.6 and fingerprint.likeness(x, z) < 0.1
    assert _fingerprints([common])[0] == _fingerprints(["", common, "q"])[1]
    assert fingerprint.likeness("", "") == 1 and fingerprint.likeness("", x) == 0


def test_labels_are_small_and_differ_from_the_one_before():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 1 << 32, 5000, dtype=np.uint32)
    head = np.zeros(5000, bool)
    head[[0, 1000, 1001]] = True
    labels = fingerprint.coin_labels(names, head)
    assert labels.max() < 6 and (labels[1:] != labels[:-1])[~head[1:]].all()


def _level_sets(text):
    """All phrase names of each compared level."""
    names, head, out = fingerprint.BYTE_NAME[np.frombuffer(text.encode(), np.uint8)], None, []
    head = np.zeros(len(names), bool)
    head[0] = True
    for level in range(fingerprint.COMPARED + 1):
        if level >= fingerprint.FIRST_LEVEL:
            out.append(set(names.tolist()))
        names, head = fingerprint.parse(names, head)
    return out


def test_likeness_against_whole_sets():
    rng = random.Random(12)
    letters = "abcdefghij klmno"
    for size, allowed in ((60, 0), (300, 0), (20_000, 0.15), (200_000, 0.08)):
        for edits in (1, size // 200, size // 20):
            a = "".join(rng.choice(letters) for _ in range(size))
            b = list(a)
            for _ in range(edits):
                b[rng.randrange(size)] = rng.choice(letters)
            x, y = _fingerprints([a, "".join(b)])
            p, q = next(
                (p, q)
                for i, (p, q) in reversed(list(enumerate(zip(_level_sets(a), _level_sets("".join(b))))))
                if i == 0 or min(len(p), len(q)) >= fingerprint.ENOUGH
            )
            assert abs(fingerprint.likeness(x, y) - len(p & q) / len(p | q)) <= allowed + 1e-9


def test_long_texts_have_longer_lists_and_more_levels():
    rng = random.Random(13)
    short, long = _fingerprints(["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (3000, 300_000)])
    first = [int(x.split(":")[0]) for x in (short, long)]
    assert len(long) > 5 * len(short) and len(long.split(";")) > len(short.split(";")) and first[1] > 20 * first[0]


def test_edited_texts(spark):
    rng = random.Random(11)
    rows = [(i * 2 + 1, "".join(rng.choice("abc é😀") for _ in range(rng.randint(0, 200)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprint.compare_edited(docs).collect()}
    assert len(got) == len(rows)
    alone = dict(fingerprint.fingerprint(docs).collect())
    for (i, text), (j, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == alone[i] and got[i].edited_fingerprint == _fingerprints([edited])[0]
        assert got[i].near_next == fingerprint.likeness(alone[i], alone[j])


def test_fingerprint_odd_rows(spark):
    assert fingerprint.compare_edited(odd_documents(spark)).count() == len(ODD_TEXTS) + 3
    assert fingerprint.compare_edited(empty_documents(spark)).count() == 0
    one = odd_documents(spark).where("doc_id = 3")
    assert [r.near_next for r in fingerprint.compare_edited(one).collect()] == [1.0]


def brute_cover(text, item):
    """Plain greedy tiling: the longest free match again and again."""
    free_a, free_b, covered = [True] * len(text), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(text)), range(len(item))):
            n = 0
            while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and free_a[i + n] and free_b[j + n]:
                n += 1
            best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < decontaminate.SEED:
            return covered
        covered += n
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n


def test_tiles_equal_plain_greedy_tiling():
    rng = random.Random(12)
    for _ in range(60):
        item = [rng.randrange(9) if rng.random() < 0.3 else rng.randrange(1000) for _ in range(rng.randint(1, 60))]
        parts = [item[a : a + rng.randint(3, 30)] for a in (rng.randrange(len(item)) for _ in range(4))]
        text = [w for p in parts for w in [rng.randrange(2000, 3000), *p]]
        tiles = decontaminate.tile(np.array(text, np.uint64), np.array(item, np.uint64))
        assert all(text[i : i + n] == item[j : j + n] and n >= 5 for i, j, n in tiles)
        assert sum(n for *_, n in tiles) == brute_cover(text, item)


def test_tiles_of_few_words_equal_plain_greedy_tiling():
    rng = random.Random(14)
    for _ in range(80):
        item, text = ([rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, most))] for most in (40, 70))
        tiles = decontaminate.tile(np.array(text, np.uint64), np.array(item, np.uint64))
        assert sum(n for *_, n in tiles) == brute_cover(text, item)


def test_long_runs_of_one_word_are_tiled_in_time():
    begin = time.process_time()
    assert decontaminate.tile(np.full(20_000, 7, np.uint64), np.full(5_000, 7, np.uint64)) == [(0, 0, 5_000)]
    assert time.process_time() - begin < 20


def test_items_of_common_phrases_lose_no_leak(spark):
    """Items and texts made of a few phrases that most of them share, against tiles of all pairs."""
    rng = random.Random(15)
    phrases = [" ".join(f"p{i}w{k}" for k in range(rng.randint(4, 9))) for i in range(12)]
    common = [0, 0, 0, 1, 1, *range(12)]

    def said(most):
        own = [phrases[rng.choice(common)] if rng.random() < 0.7 else f"x{rng.randrange(10**6)}" for _ in range(rng.randint(1, most))]
        return " ".join(own)

    items = [(i % 37, said(8)) for i in range(40)] + [(None, phrases[2]), (None, phrases[3])]
    docs = [(i, said(14)) for i in range(120)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS key", "2 AS seed", "3 AS texts")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    codes = {}

    def coded(text):
        return np.array([codes.setdefault(w, len(codes)) for w in text.split()], np.uint64)

    wanted = set()
    for _, text in docs:
        for item, words in items:
            cover = sum(n for *_, n in decontaminate.tile(coded(text), coded(words))) / len(words.split())
            if cover >= decontaminate.COVERAGE:
                wanted.add((hashlib.md5(text.encode()).digest(), item, round(cover, 9)))
    assert len(wanted) > 100
    assert {(bytes(r.key), r.item, round(r.coverage, 9)) for r in got} == wanted


def test_reordered_passages_are_caught(spark):
    rng = random.Random(13)
    items = [(i, " ".join(f"q{rng.randrange(5000)}" for _ in range(40))) for i in range(30)] + [(30, "too short item"), (31, None)]
    docs = []
    for i in range(60):
        words = [f"d{rng.randrange(5000)}" for _ in range(200)]
        if i % 3 == 0:  # the item's quarters in another order
            own = items[i // 3][1].split()
            quarters = [own[k : k + 10] for k in (30, 10, 0, 20)]
            words[50:50] = [w.upper() for q in quarters for w in [*q, "between,"]]
        elif i % 3 == 1:  # a third of it
            words[20:20] = items[i // 3][1].split()[:13]
        docs.append((i, " ".join(words)))
    frames = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.contaminated, r.items, r.coverage) for r in decontaminate.contamination(*frames).collect()}
    for i, _ in docs:
        assert got[i] == ((True, [i // 3], 1.0) if i % 3 == 0 else (False, [], 0.0))
    assert decontaminate.keep_unleaked(*frames).count() == 40


def test_decontamination_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(None, "word word word word word word"), (1, None), (1, "")], "item_id long, text string")
    rows = decontaminate.contamination(docs, items).collect()
    assert len(rows) == len(ODD_TEXTS) + 3 and sum(r.contaminated for r in rows) == 1
    kept = decontaminate.keep_unleaked(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ODD_TEXTS) + 2
    assert decontaminate.contamination(empty_documents(spark), items).count() == 0
    assert decontaminate.contamination(docs, items.where("false")).where("contaminated").count() == 0
