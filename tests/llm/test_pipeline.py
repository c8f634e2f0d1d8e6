"""The pipeline against a plain one over a folder of its own."""

import hashlib
import random
import re
import struct

import pytest

import corpus_pipeline


def plain(rows, toxic_words, items):
    """(id, text) of what stays: plain Python for each stage."""
    rows = [r for r in rows if not set((r[1] or "").split()) & toxic_words]
    kept, seen = [], set()
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if text not in seen:
            seen.add(text)
            kept.append(r)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, group = [shingles(r[1]) for r in kept], list(range(len(kept)))
    for _ in kept:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    kept = [r for i, r in enumerate(kept) if group[i] == i]  # kept is in the order of ids, so each group's first is its least
    return [r for r in kept if not any(item in (r[1] or "") for item in items)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(12), str(tmp_path_factory.mktemp("corpus"))
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(5)]
    rows = [(i, " ".join(rng.choice(["scum", "vile", "nasty"]) if i % 5 == 0 and rng.random() < 0.25 or i % 5 == 0 and k == 3 else rng.choice(words) for k in range(40))) for i in range(300)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(300)]
    good = [t for i, t in rows if i % 5]
    rows += [(1000, good[0]), (1, good[0]), (1, good[1] + "  "), (None, good[2]), (None, "only here and nowhere else it stands"), (None, "only here and nowhere else it stands")]
    rows += [(1001, good[3] + " w1"), (2, good[4] + " w2 w3"), (1002, f"{good[5]} {items[0]} w5"), (1003, items[1]), (3, f"w9 {items[2]}"), (1004, None), (1005, ""), (1006, "w1 w2"), (1007, "z " * 30000)]
    docs = [(i, t, "en", "s", len(t or ""), 0.9, "k", "f", [1]) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double, _key string, found string, ids array<int>").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def digest(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens.no_truncation()
    tokens.no_padding()
    found = [tokens.encode(t or "", add_special_tokens=False).ids for t in texts]
    return [(len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()) for ids in found]


def test_against_a_plain_pipeline(spark, folder):
    at, rows, items = folder
    want = plain(rows, {"scum", "vile", "nasty"}, items)
    got = corpus_pipeline.run(spark, at).collect()
    expected = [(r[0], *d) for r, d in zip(want, digest([r[1] for r in want]), strict=True)]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got), key=str) == sorted(expected, key=str)


def test_stages_keep_columns_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder[0])
        assert left.columns == docs.columns and [f.dataType for f in left.schema] == [f.dataType for f in docs.schema], name
        assert stage(spark, docs.limit(0), folder[0]).count() == 0
    assert corpus_pipeline.tokenise(spark, docs.limit(0), folder[0]).count() == 0
