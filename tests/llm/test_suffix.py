import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from sparkwright.llm import suffix_dedup

N = suffix_dedup.LENGTH


def brute(rows):
    """Row by row, in the order of the rows: ids may be repeated or null."""
    first, out = {}, []
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - N + 1):
            first.setdefault(b[i : i + N], d)
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - N + 1):
            if d is not None and first[b[i : i + N]] < d:
                gone[i : i + N] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((d, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def told(frame):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame).collect()), key=str)


def corpus(rng):
    words = ["the", "of", "and", "ing", "tion", "é", "x", "alpha", "aa", "aaa"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 60))) for _ in range(8)] + ["a" * 90, "ab" * 50, "abc" * 40]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 20)
            parts.insert(rng.randint(0, len(parts)), p[cut:] if rng.random() < 0.5 else p[: len(p) - cut])
        texts.append("".join(parts) if rng.random() < 0.3 else " ".join(parts))
    return texts + texts[:5]


def test_against_brute_force(make):
    texts = corpus(random.Random(2))
    assert told(make(texts)) == brute(list(enumerate(texts)))


def test_hot_anchors_take_the_other_way(make, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    texts = corpus(random.Random(7))
    assert told(make(texts)) == brute(list(enumerate(texts)))


def test_odd_rows(odd, make):
    assert told(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    got = suffix_dedup.remove_repeats(odd, contents=True).collect()
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and sum(b - a for a, b in r["spans"]) == r["n_removed"] for r in got)
    assert suffix_dedup.remove_repeats(make([])).collect() == []


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 99, 400).astype(np.uint8)
    start = rng.integers(0, 350, 90)
    size = rng.integers(0, 50, 90)
    run = np.repeat([0, 10, 11, 60], [10, 1, 49, 30])
    order = suffix_dedup.Suffixes(raw).sort(start, size, run, np.repeat([10, 1, 49, 30], [10, 1, 49, 30]))
    keys = [(int(run[i]), raw[start[i] : start[i] + size[i]].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(90))


def test_repeated_ids_with_different_texts(make):
    """A row loses only what a smaller id has: nothing because another row of its id loses it, nothing to another row of its id."""
    a, b = "the first of two quite different passages, with some more words to it", "and another one of which no window is anywhere in the other of the two"
    rows = [(1, a), (2, a), (2, b), (2, b), (2, "x" + a), (3, b + a), (None, a), (None, b)]
    got = told(make([t for _, t in rows], ids=[i for i, _ in rows]))
    assert got == brute(rows)
    assert {(r[0], r[2]) for r in got} >= {(2, len(a)), (2, 0)}
    texts, rng = corpus(random.Random(9)), random.Random(1)
    ids = [rng.choice([None, *range(12)]) for _ in texts]
    assert told(make(texts, ids=ids)) == brute(list(zip(ids, texts, strict=True)))


def test_ids_that_are_text_or_large(make):
    texts = corpus(random.Random(3))[:40] * 2
    ids = [f"d{i % 30}" for i in range(80)]
    frame = make(texts).withColumn("doc_id", F.concat(F.lit("d"), (F.col("doc_id") % 30).cast("string")))
    assert told(frame) == brute(list(zip(ids, texts, strict=True)))
    large = [(i % 30) * 2**57 - 2**62 for i in range(80)]
    assert told(make(texts, ids=large)) == brute(list(zip(large, texts, strict=True)))
