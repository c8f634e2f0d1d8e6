import random

import numpy as np
from pyspark.sql import functions as F

from sparkwright.llm import language_id
from sparkwright.llm.common import remainder

SYLLABLES = {"en": "the ing and ion ough ly er".split(), "de": "sch ung der ein keit über nicht".split(), "fr": "eau que ment elle é oi ç".split()}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_odd_rows(make):
    rng = random.Random(3)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(400)]
    texts = [text(lang, rng.randint(3, 60), rng) for lang in langs]
    docs = make([*texts, None, "", "12 34 !!", "x" * 3000], langs=[*langs, "en", None, "de", None])
    held = remainder(F.col("doc_id"), 5) == 0
    rows = {r["doc_id"]: r for r in language_id.identify(docs, ~held).collect()}
    assert len(rows) == 404 and all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (400, 401, 402))
    assert sum(rows[i]["lang_pred"] == langs[i] for i in range(400)) >= 396 and all(0 <= r["score"] <= 1 for r in rows.values())


def test_nothing_to_learn_from(make):
    docs = make(["abc def", None], langs=[None, None])
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(docs, F.lit(True)).collect()] == [("und", 0.0)] * 2
    assert language_id.identify(make([]), F.lit(True)).collect() == []


def test_penalties_make_weights_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(500, 20, replace=False)), np.full(20, 0.2)) for _ in range(200)]
    labels = [int(3 in r[0]) for r in rows]
    loose, _ = language_id.ftrl(rows, labels, 2, 500, l1=0.0)
    tight, _ = language_id.ftrl(rows, labels, 2, 500, l1=0.5)
    assert (tight == 0).sum() > (loose == 0).sum()


def test_characters_beyond_the_first_plane(make):
    """Emoji are no letters, and capitals there have lower case."""
    texts = ["the thing", "der schein", "😀😀 🎉", "😀 12 🚀 34", "𐐀𐐁 😀", "𐐨𐐩"]
    rows = {r["doc_id"]: r for r in language_id.identify(make(texts, langs=["en", "de", None, None, None, None]), F.lit(True)).collect()}
    assert all((rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0) for i in (2, 3))
    assert rows[4]["lang_pred"] != "und"
    parts = [language_id.characters(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in ("𐐀𐐁", "𐐨𐐩", "a😀b")]
    assert (parts[0] == parts[1]).all() and "".join(map(chr, parts[2])) == "a b"


def test_too_many_languages_are_told(make):
    import pytest

    docs = make(["abc def", "ghi jkl", "mno"], langs=["a", "b", "c"])
    with pytest.raises(ValueError):
        language_id.identify(docs, F.lit(True), max_languages=2)


def test_ties_repeated_rows_and_training_against_a_plain_loop(make):
    rows = language_id.identify(make(["same words here"] * 4, ids=[1, 1, 2, 2], langs=["b", "b", "a", "a"]), F.lit(True)).collect()
    assert len({(r["lang_pred"], r["score"]) for r in rows}) == 1
    blank = language_id.Model(["a", "b"], np.ones(language_id.DIMS, np.float32), np.zeros((language_id.DIMS, 2), np.float32), np.zeros(2), 1.0)
    assert [(r["lang_pred"], r["score"]) for r in language_id.predict(make(["words"]), blank).collect()] == [("a", 0.5)]
    rng = np.random.default_rng(5)
    data = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(30)]
    labels, alpha, beta, l1, l2 = [int(r[0][0] < 3) for r in data], 0.5, 1.0, 0.02, 0.02
    z, n = np.zeros((13, 2)), np.zeros((13, 2))

    def weight(i, k):
        return 0.0 if abs(z[i, k]) <= l1 else -(z[i, k] - np.sign(z[i, k]) * l1) / ((beta + n[i, k] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for r in order.permutation(30):
            x = [*zip(data[r][0].tolist(), data[r][1].tolist(), strict=True), (12, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in x for k in (0, 1)}
            s = [sum(v * w[i, k] for i, v in x) for k in (0, 1)]
            p = np.exp(np.array(s) - max(s))
            p /= p.sum()
            for i, v in x:
                for k in (0, 1):
                    g = v * (p[k] - (labels[r] == k))
                    z[i, k] += g - ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / alpha * w[i, k]
                    n[i, k] += g * g
    got, bias = language_id.ftrl(data, labels, 2, 12)
    assert np.allclose(got, [[weight(i, k) for k in (0, 1)] for i in range(12)], atol=1e-6) and np.allclose(bias, [weight(12, 0), weight(12, 1)])


def test_held_out_accuracy_on_the_tables(spark):
    from sparkwright.llm.queries import op2_language_id

    d = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = [r for r in op2_language_id(spark, d).collect() if r["held_out"] and known[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(got) > 100 and np.mean([r["lang_pred"] == known[r["doc_id"]] for r in got]) > 0.97
