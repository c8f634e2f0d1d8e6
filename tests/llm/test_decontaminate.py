import random

from sparkwright.llm import decontaminate


def words(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(4000)}" for _ in range(n)]


def test_copies_and_paraphrases(spark, make):
    rng = random.Random(9)
    items = [words(rng, rng.randint(15, 60)) for _ in range(40)]
    plain = [words(rng, rng.randint(5, 300)) for _ in range(60)]
    texts, want = [" ".join(p) for p in plain], set()
    for k, item in enumerate(items):
        changed = [w if (j % 7 or k % 2) else f"v{rng.randrange(4000)}" for j, w in enumerate(item)]
        body = plain[k]
        want.add((len(texts), k))
        texts.append(" ".join([*body[: len(body) // 2], *(x.capitalize() for x in changed), *body[len(body) // 2 :]]) + ".")
    benchmark = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (100, None), (101, ""), (102, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make([*texts, None, "", "of " * 20000]), benchmark).collect()}
    assert {p for p in want if p[1] % 2} <= got and len(want - got) <= 1 and got <= want
    left = {r["doc_id"] for r in decontaminate.drop_leaking(make(texts), benchmark).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}


def test_nothing_there(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert decontaminate.leaks(make(["x y"]), none).collect() == [] and decontaminate.leaks(make([]), some).collect() == [] and decontaminate.leaks(make([None]), some).collect() == []


def test_common_subsequence():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


def test_recall_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {(i, r["item_id"]) for r in items.collect() for i, t in rows if r["text"] in t}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == want


def test_short_items_are_found_whole(spark, make):
    items = [(0, "What is gold?"), (1, "ha ha ha ha ha ha ha ha ha"), (2, "gold"), (3, "seen never before"), (4, "...")]
    texts = ["So: what is GOLD made of", "what is not gold", "tell what is", "gold and more", "ha " * 8, "ho " + "ha " * 12, "seen before never", None, ""]
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["n_words"]) for r in decontaminate.leaks(make(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 0, 1, 3), (0, 2, 3, 1), (1, 2, 3, 1), (3, 2, 0, 1), (5, 1, 1, 9)}
    left = decontaminate.drop_leaking(make(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"] for r in left} == {2, 4, 6, 7, 8}


def test_recall_at_rates_of_change(spark):
    """Items of the tables with a share of their words changed, at random and the rarest first, within other documents' text."""
    from collections import Counter

    d, rng = "/root/testdata/sf0.01", random.Random(4)
    docs, benchmark = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet")
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").collect()]
    often = Counter(w.lower().strip(".,;:") for t in texts for w in t.split())
    pool = [w for t in texts[:200] for w in t.split()]
    rows, want = [], {}
    for kind, rate in (("random", 0.1), ("random", 0.2), ("random", 0.28), ("rarest", 0.1), ("rarest", 0.2)):
        for item in benchmark.collect():
            words = item["text"].split()
            places = rng.sample(range(len(words)), round(rate * len(words))) if kind == "random" else sorted(range(len(words)), key=lambda i: often[words[i].lower().strip(".,;:")])[: round(rate * len(words))]
            for i in places:
                words[i] = rng.choice(pool)
            body = texts[rng.randrange(900)].split()[:400]
            cut = rng.randrange(len(body) + 1)
            want[10**6 + len(rows)] = (kind, rate, item["item_id"])
            rows.append((10**6 + len(rows), " ".join([*body[:cut], *words, *body[cut:]])))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs.unionByName(spark.createDataFrame(rows, docs.schema)), benchmark).collect()}
    for group in {w[:2] for w in want.values()}:
        found = [(doc, w[2]) in got for doc, w in want.items() if w[:2] == group]
        assert sum(found) >= 0.9 * len(found), group


def test_against_every_window(spark, make):
    """Whatever has the share of common words and of answer words in a window of its length is found, and nothing far from it."""
    rng = random.Random(8)
    items = [words(rng, rng.randint(15, 40)) for _ in range(12)]
    texts = []
    for k in range(60):
        item = items[k % 12]
        kept = [w if rng.random() > (k % 6) / 8 else f"z{rng.randrange(10**6)}" for w in item]
        texts.append([*words(rng, rng.randrange(60)), *kept, *words(rng, rng.randrange(60))])

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    share = {(t, i): max(common(item, text[s : s + len(item)]) / len(item) for s in range(max(1, len(text) - len(item) + 1))) for t, text in enumerate(texts) for i, item in enumerate(items)}
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(make([" ".join(t) for t in texts]), benchmark).collect()}
    sure = {p for p, s in share.items() if s >= decontaminate.STRONG}
    assert len(sure) > 20 and len(sure - set(got)) <= 0.05 * len(sure)
    assert all(r["common_words"] >= decontaminate.SHARE * r["item_words"] and (r["answer_share"] >= 0.5 or r["common_words"] >= decontaminate.STRONG * r["item_words"]) for r in got.values())
    assert all(share[p] > 0.45 for p in got)
