import random

import numpy as np
from pyspark.sql import functions as F

from sparkwright.llm import toxicity
from sparkwright.llm.common import remainder


def test_gradients():
    """Back-propagation agrees with finite differences."""
    import pyarrow as pa

    from sparkwright.llm.common import blocks

    (_, _, raw, off), = blocks(pa.array(["a bad word here and there", "good day"]))
    words = toxicity.Words(raw, off)
    net = {k: v.astype(np.float64) for k, v in toxicity.new_net(1).items()}
    index = np.array([[0, 6], [1, 7], [2, 6], [3, 6]])
    real = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = np.array([1.0, 0.0])

    def loss():
        used, at = np.unique(words.token[index], return_inverse=True)
        z = toxicity.window_logits(net, toxicity.projections(net, words.inputs(net, used)), at.reshape(index.shape), real)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = toxicity.gradients(net, words, index, real, y)
    for name in ("Uzf", "Urb", "Unf", "Wnb", "czf", "af", "ob", "bias"):
        flat, at = net[name].reshape(-1), min(3, net[name].size - 1)
        old = flat[at]
        flat[at] = old + 1e-3
        up = loss()
        flat[at] = old - 1e-3
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-3 - g[name].reshape(-1)[at]) < 2e-3, name


def test_held_out_and_odd_rows(spark, make):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(80)]
    texts, labels = [], []
    for i in range(500):
        t = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        if i % 3 == 0:
            for _ in range(max(1, len(t) // 20)):
                t[rng.randrange(len(t))] = rng.choice(["nasty", "vile", "scum"])
        texts.append(" ".join(t))
        labels.append((i, 1, int(i % 3 == 0)))
    docs = make([*texts, None, "", "  ", "word1 " * 30000])
    known = spark.createDataFrame([*labels, (9999, 1, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    held = remainder(F.col("doc_id"), 5) == 0
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, known, ~held).collect()}
    assert len(scores) == 504 and all(0 <= s <= 1 for s in scores.values())
    test = [r["doc_id"] for r in docs.filter(held & (F.col("doc_id") < 500)).collect()]
    assert np.mean([(scores[i] >= 0.5) == (i % 3 == 0) for i in test]) > 0.93
    assert scores[500] == scores[501] == scores[502]


def test_no_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.toxicity(make(["a", None]), none, F.lit(True)).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(make([]), none, F.lit(True)).collect() == []


def test_windows_cover_everything():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    doc, start = toxicity.windows(counts)
    base = np.cumsum(counts) - counts
    for d, n in enumerate(counts):
        seen = {int(s) + k for s in start[doc == d] for k in range(toxicity.WINDOW)}
        assert set(range(base[d], base[d] + n)) <= seen


def test_rejected_rows_and_calibration(spark, make):
    """Whole rows come back, with a column of any name; scores are shares of toxic documents."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["vile", "scum"]) if i % 4 == 0 and rng.random() < 0.2 else f"word{rng.randrange(60)}" for _ in range(40)) for i in range(400)]
    docs = make([*texts, None, texts[0], texts[1]], ids=[*range(400), None, 1, 0])
    known = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    train = F.coalesce(F.col("doc_id"), F.lit(0)) >= 2
    left = toxicity.reject(docs, known, train)
    assert left.columns == docs.columns
    stays = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert (1, texts[1]) in stays and (0, texts[1]) in stays and (1, texts[0]) not in stays and (None, None) in stays
    scores = [r["score"] for r in toxicity.toxicity(docs, known, train).collect()]
    assert abs(np.mean(scores) - 0.25) < 0.05


def plain_score(model, text):
    """One text by loops over words, windows, steps and units, from the definition alone (only a word's hash is the module's)."""
    import re

    net, D, H = {k: v.astype(float) for k, v in model.net.items()}, toxicity.DIM, toxicity.HIDDEN
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    if not words:
        return model.constant

    def entry(word):
        raw = np.frombuffer(word, np.uint8)
        key = int(toxicity.span_hash(raw, np.array([0]), np.array([len(word)]))[0])
        mean, last = np.zeros(D), len(word) - 1
        for i, byte in enumerate(word):
            left = word[i - 1] if i > 0 else 2
            right = word[i + 1] if i < last else 3
            after = word[i + 2] if i + 1 < last else 4
            mixed = (left * 2654435761 ^ byte * 2246822519 ^ right * 3266489917 ^ after * 374761393) & 0xFFFFFFFF
            mixed = ((mixed ^ mixed >> 15) * 668265263) & 0xFFFFFFFF
            mean += net["chars"][mixed * toxicity.CHAR_ROWS >> 32] / len(word)
        return np.concatenate([net["words"][key % toxicity.WORD_ROWS], mean])

    x = [entry(w) for w in words]
    logistic = lambda v: 1 / (1 + np.exp(-v))
    best = -np.inf
    last = max(len(x) - toxicity.WINDOW, 0)
    for start in sorted({*range(0, last, toxicity.STRIDE), last}):
        part = x[start : start + toxicity.WINDOW]
        attend, value = np.zeros(len(part)), np.zeros(len(part))
        for side in "fb":
            h = np.zeros(H)
            for t in range(len(part)) if side == "f" else reversed(range(len(part))):
                gate = lambda g: part[t] @ net[f"W{g}{side}"] + net[f"c{g}{side}"]  # noqa: B023, E731
                z = logistic(gate("z") + h @ net[f"Uz{side}"])
                r = logistic(gate("r") + h @ net[f"Ur{side}"])
                c = np.tanh(gate("n") + r * (h @ net[f"Un{side}"]))
                h = (1 - z) * c + z * h
                attend[t] += h @ net[f"a{side}"]
                value[t] += h @ net[f"o{side}"]
        weight = np.exp(attend) / np.exp(attend).sum()
        best = max(best, float(weight @ value) + net["bias"][0])
    return float(logistic(model.scale * best + model.shift))


def test_scores_are_those_of_plain_loops(spark, make):
    """Every document's score through the operator against the definition: short and long texts, edges of windows, odd characters."""
    rng = random.Random(5)
    words = ["vile", "scum", "a", "ab", "abc", "Straße", "日本", "x" * 40, "don't", "e\u0301", *[f"word{i}" for i in range(60)]]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 5, 31, 32, 33, 47, 48, 49, 64, 65, 200) for _ in range(2)]
    texts += [None, "", " \n\t", "UPPER lower\x0bMiXed\r\nÄ", texts[5]]
    labels = np.array([int("vile" in (t or "")) for t in texts])
    net = toxicity.train([t or "" for t in texts], labels, steps=40, batch=8)
    model = toxicity.Model(net, 1.3, -0.4, 0.125)
    docs = make(texts)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    want = [plain_score(model, t) for t in texts]
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-4
    assert len({round(w, 4) for w in want}) > 15  # the scores do differ
