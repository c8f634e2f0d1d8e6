import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkwright.llm import lm_scoring as lm
from sparkwright.llm.common import blocks, remainder

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check(frame, rows, **kw):
    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None]) for d, t in rows]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), held(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens)
    got = lm.score_texts(frame, remainder(F.col("doc_id"), 7) != 2, **kw).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    return got


def test_base_and_odd_rows(odd, make):
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert lm.score_texts(make([]), F.lit(True)).collect() == []


def test_rare_words_and_repeated_rows(make):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(50)}"]) for _ in range(30)) for _ in range(60)] + ["the same", "the same"]
    ids = [*range(60), 77, 77]
    check(make(texts, ids=ids), list(zip(ids, texts, strict=True)), head_size=4)


def test_nothing_to_learn_from(make):
    (r,) = lm.score_texts(make(["a b"]), F.lit(False)).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0


def units(text):
    return [lm.Units(raw, off, (np.empty(0, np.uint64), np.empty(0, np.int64))) for _, _, raw, off in blocks(pa.array([text]))][0]


def test_probabilities_sum_to_one():
    """Of all next symbols at a word's start: a prefix code whose bits have complementary probabilities."""
    rng = np.random.default_rng(0)
    code = lm.Code(rng.integers(0, 50, (lm.TERM + 1, lm.SYMBOLS)))
    for before in (0, 97, lm.TERM):
        assert abs(sum(0.5 ** int(code.size[before * lm.SYMBOLS + s]) for s in range(lm.SYMBOLS)) - 1) < 1e-12
    model = lm.Model(code, rng.integers(0, 9, lm.SLOTS).astype(np.float32), rng.integers(0, 9, lm.SLOTS).astype(np.float32), (np.empty(0, np.uint64), np.empty(0, np.int64)))
    total = 0.0
    for s in range(lm.SYMBOLS):
        rows = code.rows(np.array([s]), np.array([0]))
        bits = lm.Bits(code, rows)
        slots = [bits.slots(i, h) for i, h in enumerate(lm.context_hashes(np.array([s]), np.array([0]), np.array([0])))]
        gate = model.gate([model.level[i][x] if i else None for i, x in enumerate(slots)])
        p = lm.squash(model.refined(model.mix([t[x] for t, x in zip(model.logit, slots, strict=True)], gate), gate).astype(float))
        total += float(np.prod(np.where(bits.bit == 1, p, 1 - p)))
    assert abs(total - 1) < 1e-4


def test_model_nears_the_entropy(make):
    """Words put together from parts: 2 to 5 of 10, which is log10(4) + 3.5 digits a word; most words are seen once or never."""
    rng = random.Random(4)
    parts = "ban dor kel mir sot vun tal rek lis gom".split()
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(60)) for _ in range(400)]
    rows = [r for r in lm.score_texts(make(texts), remainder(F.col("doc_id"), 7) != 2).collect() if r["held_out"]]
    digits = -sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert 3.9 < digits < 1.15 * (math.log10(4) + 3.5)


def test_kept_units_score_alike():
    code = lm.Code(np.ones((lm.TERM + 1, lm.SYMBOLS), int))
    rng = np.random.default_rng(2)
    model = lm.Model(code, rng.integers(0, 9, lm.SLOTS).astype(np.float32), rng.integers(0, 9, lm.SLOTS).astype(np.float32), (np.empty(0, np.uint64), np.empty(0, np.int64)))
    kept = lm.Kept()
    for text in ("one two three two", "two four one", "", "five " * 50):
        u = units(text)
        assert np.allclose(model.log10_known(u, kept), model.log10_units(u))


def test_rare_words_count_in_all_contexts(make):
    """What the model learns does not depend on how many words are told apart as frequent."""
    rng = random.Random(6)
    common = [f"{a}{b}" for a in "abcdefghijklmn" for b in "opqrstuvwxyzab"][: lm.MARKS]
    rarer = ["".join(rng.choice("kelmorti") for _ in range(7)) for _ in range(60)]
    texts = [" ".join([*common, *rng.sample(rarer, 20)]) for _ in range(40)]
    scores = [{r["doc_id"]: r["score"] for r in lm.score_texts(make(texts), remainder(F.col("doc_id"), 7) != 2, head_size=n).collect()} for n in (lm.MARKS, lm.HEAD)]
    assert all(abs(scores[0][d] - scores[1][d]) < 1e-6 for d in scores[0])


def test_all_training_documents_are_learnt_from(make):
    """The refining table's sums hold every bit of every document, and the groups the company of all of them."""
    texts = [f"north w{i % 7} east" if i % 2 else f"south w{i % 5} west x{i}" for i in range(1200)]
    docs = make(texts)
    words = [lm.span_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in ("north", "east", "south", "west")]
    marks = lm.word_groups(docs, np.array(words), groups=2)
    of = dict(zip(marks[0].tolist(), marks[1].tolist(), strict=True))
    north, east, south, west = (of[int(w)] for w in words)
    assert north == east != south == west
    code = lm.Code(np.ones((lm.TERM + 1, lm.SYMBOLS), int))
    sums = lm.learnt(docs, code, marks, np.ones(lm.SLOTS, np.float32), np.ones(lm.SLOTS, np.float32))
    want = 0
    for text in texts:
        u = units(text)
        symbols, unit, place = u.symbols()
        want += int((code.size[code.rows(symbols, place)] * np.bincount(u.unit, minlength=u.count)[unit]).sum())
    assert round(float(sums[-2 * lm.GATES * lm.BINS : -lm.GATES * lm.BINS].sum())) == want


def test_equal_bits_are_told_once(monkeypatch):
    """Words that begin alike share their bits: as many counts and the same scores as when each word is spelled, from far fewer bits."""
    text = b"the then there therefore them these thesis \xc3\xa9t\xc3\xa9 \x00 \x00\x01 the. then, there! " + b"x" * 300 + b" " + b" ".join(b"word%d word%d. word%d," % (i % 50, i % 50, i % 50) for i in range(400))
    raw, off = np.frombuffer(text + b"the", np.uint8), np.array([0, 40, 40, len(text), len(text) + 3])
    marks = (np.sort(lm.span_hash(raw, np.array([0]), np.array([3]))), np.array([3]))
    units = lm.Units(raw, off, marks)
    often = np.bincount(units.unit, minlength=units.count)
    code = lm.Code(np.random.default_rng(1).integers(0, 9, (lm.TERM + 1, lm.SYMBOLS)))
    symbols, unit, place = units.symbols()
    bits = lm.Bits(code, code.rows(symbols, place))
    every = np.repeat(often[unit], bits.size)
    want = [np.bincount(2 * bits.slots(i, h) + bits.bit, weights=every, minlength=2 * lm.SIZES[i]) for i, h in enumerate(lm.context_hashes(symbols, place, units.before[unit]))]
    seen, told = [np.zeros(2 * n) for n in lm.SIZES], 0
    lm.add_counts(code, units, often, seen)
    assert all((a == b).all() for a, b in zip(seen, want, strict=True))
    told = sum(len(w) for _, _, w in lm.weighed(code, units, often))
    assert told < 0.7 * len(bits.bit)
    zeros, ones = (np.concatenate([t[k::2] for t in seen]).astype(np.float32) for k in (0, 1))
    model = lm.Model(code, zeros, ones, marks)
    together = model.log10_units(units)
    monkeypatch.setattr(lm, "SHARE", 1)  # each unit for itself
    assert np.allclose(together, model.log10_units(units))
    order = units.alike()
    assert sorted(order) == list(range(len(units.start)))


def test_hashes_are_numbered_as_by_sorting():
    rng = np.random.default_rng(5)
    for keys in (np.empty(0, np.uint64), rng.integers(0, 1 << 62, 5000).astype(np.uint64)[rng.integers(0, 5000, 20_000)], rng.integers(0, 9, 500).astype(np.uint64)):
        assert (lm.ranked(keys) == np.argsort(keys, kind="stable")).all()  # small numbers differ in their lower bits alone
        assert all((a == b).all() for a, b in zip(lm.numbered(keys), np.unique(keys, return_inverse=True, return_counts=True), strict=True))
    small = rng.integers(0, 300, 1000)
    for limit in (300, 1 << 26):
        assert all((a == b).all() for a, b in zip(lm.numbered_small(small, limit), np.unique(small, return_index=True, return_inverse=True)[1:], strict=True))
