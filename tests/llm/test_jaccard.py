import random
import re

import numpy as np

from sparkwright.llm import jaccard_join

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 40, 120, 300]))]
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += [rng.choice(vocabulary) for _ in range(rng.randint(1, 8))]
            texts.append(" ".join(words))
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(30)) + " " + passage for _ in range(30)]
    return texts


def test_against_all_pairs(make, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)  # blocks of several chunks, too
    texts = corpus(random.Random(5))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.class_components(make(texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_odd_rows(odd, make):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None]
    got = jaccard_join.class_components(odd).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute(rows) and len(got) == len(rows) + 2
    assert jaccard_join.class_components(make([])).collect() == []
    assert sorted(r["component_id"] for r in jaccard_join.class_components(make(["a b", "a b"], ids=[4, 4])).collect()) == [4, 4]


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)
        for _ in range(3):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 2**63, 3).astype(np.uint64)])))
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)}
    found = {(max(p), min(p)) for p in jaccard_join.tree_links(sets, np.arange(len(sets)))}
    assert found <= linked

    def groups(edges):
        label = list(range(len(sets)))
        for _ in range(len(sets)):
            for i, j in edges:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert groups(found) == groups(linked)


def test_pipeline_step(make):
    words = " ".join(f"w{i}" for i in range(100))
    docs = make([words, words + " more", "other text of no kin at all here", None, None])
    assert sorted(r["doc_id"] for r in jaccard_join.drop_near_copies(docs).collect()) == [0, 2, 3, 4]


def test_rows_are_dropped_by_id_and_text(make):
    words = [" ".join(f"{p}{i}" for i in range(100)) for p in "abcd"]
    docs = make([words[0], words[1], words[0] + " x", words[2], words[2] + " y", words[3], words[3], words[3] + " z", None, ""], ids=[5, 5, 6, None, None, 8, 8, 8, None, None])
    left = [(r["doc_id"], r["text"]) for r in jaccard_join.drop_near_copies(docs).collect()]
    assert len(left) == 6 and {t[:1] if t else "" for _, t in left} == {"a", "b", "c", "d", ""} and {i for i, _ in left} == {5, 8, None}
    assert {(5, words[0]), (5, words[1])} <= set(left)


def test_text_ids(make):
    docs = make(["one two three four five six"] * 2 + ["other"])
    docs = docs.withColumn("doc_id", docs["doc_id"].cast("string"))
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.class_components(docs).collect()} == {("0", "0"), ("1", "0"), ("2", "2")}
