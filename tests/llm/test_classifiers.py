"""Toxicity and quality: held-out accuracy, unseen spellings, odd rows."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from casewright.llm import quality, toxicity
from casewright.llm.common import remainder
from tests.llm.odd import ODD_TEXTS, empty_documents, odd_documents

PLAIN = [a + b for a in ("re", "on", "the", "an", "is", "to", "la", "mi") for b in ("ta", "ne", "so", "li", "du", "er", "ca")]
BAD = ["grumbleworth", "snarkfiddle", "blightmonger"]


def _texts(rng, n, bad=BAD):
    out = []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(20, 120))]
        if i % 4 == 0:
            for _ in range(max(1, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((" ".join(words), int(i % 4 == 0)))
    return out


def _train(rows):
    bags = toxicity.bags(pa.array([t for t, _ in rows], pa.large_string()))
    return toxicity.train(bags, np.array([y for _, y in rows]))


def test_unseen_misspellings_share_ngrams():
    rng = random.Random(1)
    model = _train(_texts(rng, 1200))
    spelled = _texts(rng, 400, ["grumbelworth", "snarkfiddel", "blightmongers"])
    for rows in (_texts(rng, 400), spelled):
        got = model.scores(pa.array([t for t, _ in rows], pa.large_string())) >= 0.5
        assert (got == np.array([bool(y) for _, y in rows])).mean() > 0.9


def test_bags_and_scores_agree():
    texts = pa.array(["one two two three", "", "é"], pa.large_string())
    model = toxicity.ToxicityModel(np.random.default_rng(0).normal(size=toxicity.BUCKETS), 0.3)
    by_bag = [model.weight[b] @ w + model.bias for b, w in toxicity.bags(texts)]
    assert np.allclose(1 / (1 + np.exp(-np.array(by_bag))), model.scores(texts))


def _plain_toxicity(rows, asked):
    """The same training, a text, a word and a feature at a time, with features by name instead of by hash."""

    def features(text):
        words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
        share = {w: math.sqrt(n) for w, n in collections.Counter(words).items()}
        whole, out = sum(share.values()) + toxicity.BLANKS, collections.defaultdict(float)
        for word, part in share.items():
            bag = [word] + [
                (word[i : i + k], i == 0, i + k == len(word)) for k in toxicity.SIZES for i in range(len(word) - k + 1)
            ]
            for feature in bag:
                out[feature] += part / len(bag) / whole
        return out

    rng, size = np.random.default_rng(0), toxicity.DIMENSION
    bags, embed = [features(t) for t, _ in rows], collections.defaultdict(lambda: np.zeros(size))
    soft, bias = rng.normal(0, 0.5, (size, 2)), np.zeros(2)
    moments = collections.defaultdict(lambda: [0.0, 0.0])
    batches = -(-len(rows) // toxicity.BATCH)
    epochs = max(toxicity.EPOCHS, -(-toxicity.LEAST_STEPS // batches))
    step = 0
    for f in {f for bag in bags for f in bag}:
        embed[f] = np.zeros(size)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), toxicity.BATCH):
            batch, step = order[low : low + toxicity.BATCH], step + 1
            slopes = {f: np.zeros(size) for f in embed} | {"soft": np.zeros((size, 2)), "bias": np.zeros(2)}
            for i in batch:
                vector = sum((w * embed[f] for f, w in bags[i].items()), np.zeros(size))
                odds = np.exp(vector @ soft + bias)
                miss = (odds / odds.sum() - np.eye(2)[rows[i][1]]) / len(batch)
                slopes["soft"] += np.outer(vector, miss)
                slopes["bias"] += miss
                for f, w in bags[i].items():
                    slopes[f] += w * (soft @ miss)
            for name, slope in slopes.items():
                m = moments[name]
                m[0], m[1] = 0.9 * m[0] + 0.1 * slope, 0.99 * m[1] + 0.01 * slope**2
                rate = toxicity.RATE * (1 - step / (epochs * batches + 1))
                move = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
                if name == "soft":
                    soft = soft - move
                elif name == "bias":
                    bias = bias - move
                else:
                    embed[name] = embed[name] - move
    out = []
    for text in asked:
        vector = sum((w * embed[f] for f, w in features(text).items() if f in embed), np.zeros(size))
        odds = np.exp(vector @ soft + bias)
        out.append(odds[1] / odds.sum())
    return np.array(out)


def test_training_against_a_plain_version(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 4)
    monkeypatch.setattr(toxicity, "BATCH", 8)
    rows = [("Some Plain words here, plain", 0), ("été snarkfiddle", 1), ("", 0), ("blightmonger and words", 1), ("ab c 12 34567", 0)] * 5
    asked = [t for t, _ in rows[:5]] + ["snarkfiddel", "PLAIN words words words", "?"]
    model = _train(rows)
    got = model.scores(pa.array(asked, pa.large_string()))
    assert np.allclose(got, _plain_toxicity(rows, asked), atol=1e-3)


def test_labels_beyond_the_sample_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(i, t, y) for i, (t, y) in enumerate(_texts(rng, 300))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    usable = remainder(F.col("doc_id"), 5) != 0
    flipped = labels.withColumn("toxic", F.when(usable, F.col("toxic")).otherwise(1 - F.col("toxic")))
    scores = [
        {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, known, usable)).collect()}
        for known in (labels, flipped)
    ]
    assert scores[0] == scores[1]


def test_toxicity_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame(
        [(1, 0), (3, 0), (6, 1), (6, 0), (8, 1), (None, 1), (4, None), (5, 7)], "doc_id long, toxic int"
    )
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ODD_TEXTS) + 3 and all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    none = empty_documents(spark)
    empty = toxicity.fit(none, labels)
    assert toxicity.score(none, empty).count() == 0 and toxicity.score(docs, empty).first().score == 0.5


def _quality_rows(rng, n):
    rows = []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice(PLAIN if good or rng.random() < 0.2 else ["buy", "now", "!!!", "$$$"]) for _ in range(60)]
        source = rng.choice(["a", "b"]) if good == (rng.random() < 0.9) else rng.choice(["x", "y"])
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), source, 60, int(good)))
    return rows


def test_quality_held_out(spark):
    rows = _quality_rows(random.Random(3), 900)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 2], "doc_id long, quality int")
    held = remainder(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, labels, ~held)
    got = {r.doc_id: r.score >= 0.5 for r in quality.score(docs, model).collect()}
    assert np.mean([got[r[0]] == bool(r[5]) for r in rows]) > 0.95
    # both views have learned something of their own
    metadata = quality.metadata_bags([r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows])
    alone = model.metadata.odds(metadata) > 0
    assert np.mean([a == bool(r[5]) for a, r in zip(alone, rows)]) > 0.7


def test_quality_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0), (3, 1), (6, 1), (None, 1), (4, None)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == len(ODD_TEXTS) + 3 and all(0 <= r.score <= 1 for r in rows)
    none = empty_documents(spark)
    assert quality.score(none, quality.fit(none, labels)).count() == 0


def test_rows_beyond_the_pool_teach(spark, monkeypatch):
    monkeypatch.setattr(quality, "POOL", 4)
    rng = random.Random(4)
    # sources that stand in few rows, none of them labelled
    rows = [(i, *r[1:3], "p" if r[5] and i % 40 == 39 else "q" if not r[5] and i % 40 == 3 else r[3], *r[4:]) for i, r in enumerate(_quality_rows(rng, 2400))]
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "doc_id")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 4 == 1], "doc_id long, quality int")
    assert not {"p", "q"} & {r[3] for r in rows if r[0] % 4 == 1}
    model = quality.fit(docs, labels)
    good, bad = model.metadata.odds(quality.metadata_bags(["en", "en"], ["p", "q"], [60, 60]))
    assert good - bad > 0.5


def test_thresholds_come_from_all_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = [r[1:5] for r in _quality_rows(rng, 700)] + [(None, None, None, None), ("", "en", "a", 0), ("$$$ " * 300, "de", "x", 1200)]
    rest = spark.createDataFrame(rows, "text string, lang string, source string, n_chars long").repartition(3)
    number = np.random.default_rng(0)
    models = tuple(quality.Logistic(number.normal(size=n), 0.1) for n in (quality.BUCKETS + quality.SHAPES * 9, quality.META_BUCKETS))
    texts, *metadata = zip(*rows)
    views = quality.content_bags(pa.array([t or "" for t in texts], pa.large_string())), quality.metadata_bags(*metadata)
    odds = [np.sort(model.odds(view)) for model, view in zip(models, views)]
    most = round(quality.SHARE * len(rows))
    wanted = [[o[most - 1], o[-most]] for o in odds]
    bags = quality.packed(rest)
    for pool in (quality.POOL, 100, 1):
        monkeypatch.setattr(quality, "POOL", pool)
        assert np.allclose(quality.thresholds(models, bags), wanted, rtol=1e-9)
    assert np.isinf(quality.thresholds(models, bags.limit(0))).all()


def test_selected_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(quality, "POOL", 3)
    numbers = np.array([0.0, -0.0, 1.5, 1.5, 1.5, 1.5, -2.25, -2.25, 1e-300, -1e-300, 7, -7, 1.5000000000000002, 30, -30] * 3)
    codes = quality.order_codes(numbers)
    frame = spark.createDataFrame([(int(c),) for c in codes], "a long")
    got = quality.selected(frame, [("a", k) for k in range(len(numbers))])
    assert [quality.from_code(c) for c in got] == sorted(numbers.tolist())
