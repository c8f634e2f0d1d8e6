import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import quality
from sparkwright.llm.common import remainder

SPACE = r"[\x20\x09-\x0D]+"


def plain(text):
    """The statistics, counted one by one."""
    text = text or ""
    words, lines = [w for w in re.split(SPACE, text) if w], text.split("\n")
    n, chars = max(len(words), 1), max(len(text), 1)
    letters = sum(c.isalpha() for c in text)
    return [
        len(text), len(words), len(lines) if text else 0, sum(map(len, words)) / n, max(map(len, words), default=0), len(words) / len(lines), len(set(words)) / n, len(set(words)) / math.sqrt(n),
        len(set(lines)) / len(lines) if text else 0, sum(len(w) == 1 for w in words) / n, letters / chars, sum(c.isupper() for c in text) / max(letters, 1), sum(c.isdecimal() for c in text) / chars,
        sum(c in "#$%&*|!~^+=<>{}[]\\/@_" for c in text) / chars, sum(c in ".?" for c in text) / n, text.count(",") / n, sum(c in ":;()" for c in text) / chars, (len(text) - sum(map(len, words))) / chars,
    ]


def by_hand(model, x):
    """A score from statistics, rule by rule."""
    if model.constant is not None:
        return model.constant
    z = model.bias
    for rule, w in zip(model.rules, model.weights, strict=True):
        if all((low is None or x[quality.STATISTICS.index(n)] > low) and (high is None or x[quality.STATISTICS.index(n)] <= high) for n, low, high in rule.bounds):
            z += w
    return 1 / (1 + math.exp(-z))


@pytest.fixture(scope="module")
def corpus(spark, make):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}o" for i in range(120)]
    texts, labels = [], []
    for i in range(600):
        t = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 4 == 0
        if bad and i % 8 == 0:
            t = [w + "$$" for w in t]
        elif bad:
            t = [t[0]] * max(20, len(t))
        texts.append(" ".join(t) + ".")
        labels.append((i, int(not bad), 0))
    return make([*texts, None, "", " \n ", "x" * 40_000, "a b " * 30_000]), spark.createDataFrame([*labels, (3, 0, 1), (9999, 0, 1), (None, 0, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")


def test_statistics(odd):
    got = quality.statistics(odd, "text", ("doc_id", "text")).collect()
    assert len(got) == odd.count()
    for r in got:
        assert [r[s] for s in quality.STATISTICS] == pytest.approx(plain(r["text"]), rel=1e-12), r["text"][:40]


def test_scores_are_the_rules(corpus):
    """Held-out labels are right, and the compiled expression gives what the rules give one by one."""
    docs, labels = corpus
    held = remainder(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, labels, ~held)
    assert 0 < len(model.rules) < 200 and all(w for w in model.weights)
    got = quality.score(docs, model).join(docs.select("doc_id", "text", held.alias("held")), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["score"] == pytest.approx(by_hand(model, plain(r["text"])), rel=1e-9)
    test = [r for r in got if r["held"] and r["doc_id"] < 600]
    assert len(test) > 100 and np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 4 != 0) for r in test]) > 0.97
    odd = {r["doc_id"]: r["score"] for r in got if r["doc_id"] >= 600}
    assert odd[600] == odd[601]
    assert abs(np.mean([r["score"] for r in got if r["doc_id"] < 600]) - 0.75) < 0.05  # a share of good documents


def test_lasso_meets_its_optimum():
    """Where a weight is 0 the gradient is within the penalty, elsewhere it equals it."""
    rng = np.random.default_rng(2)
    z = (rng.random((400, 30)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1])))).astype(float)
    weight = np.ones(400)
    w, b = quality.lasso(z, y, weight, 0.02, None, 5000, 1e-10)
    g = z.T @ ((1 / (1 + np.exp(-(z @ w + b))) - y) / 400)
    assert (np.abs(g[w == 0]) <= 0.02 + 1e-6).all() and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-6)
    assert w[0] > 0.5 and w[1] < -0.5 and (w == 0).sum() > 15


def test_few_or_no_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make(["a", None, "b c"])
    assert [r["score"] for r in quality.quality(docs, none, F.lit(True)).collect()] == [0.0] * 3
    ones = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.quality(docs, ones, F.lit(True)).collect()] == [1.0] * 3
    assert quality.quality(make([]), ones, F.lit(True)).collect() == []
    two = spark.createDataFrame([(0, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.quality(docs, two, F.lit(True)).collect())


def test_repeated_and_null_ids(make, corpus):
    """Each row is scored by its own text; the ids may be text."""
    _, labels = corpus
    rows = make(["same words here.", "same words here.", "x$$ y$$ z$$", None], ids=[7, 7, None, None]).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = quality.quality(rows, labels.withColumn("doc_id", F.col("doc_id").cast("string")), F.lit(True)).collect()
    assert len(got) == 4 and got[0]["score"] == got[1]["score"]
