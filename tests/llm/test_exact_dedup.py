import hashlib
import re

from sparkwright.llm import exact_dedup
from sparkwright.llm.queries import oracle_sql, queries


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_against_brute_force(spark, odd):
    rows = [(r["doc_id"], normal(r["text"])) for r in odd.collect()]
    got = exact_dedup.exact_dedup(odd, capacity=2, heavy=4).collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        same = [d for d, t in rows if t == text]
        keep = min((d for d in same if d is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        assert any((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"], r["kept"]) == (doc, keep, len(same), sha, doc == keep) for r in got), (doc, text[:20])


def test_empty_and_repeated_rows(spark, make):
    assert exact_dedup.exact_dedup(make([])).collect() == []
    got = exact_dedup.exact_dedup(make(["a", "a", "b"], ids=[1, 1, 2])).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(1, 1, 2), (1, 1, 2), (2, 2, 1)]
    assert exact_dedup.drop_copies(make(["a", "a ", "b"])).count() == 3 and exact_dedup.drop_copies(make(["a", "a", "b"])).columns == make([]).columns


def test_directory_doubles_and_splits_only_what_is_full():
    assert exact_dedup.directory({}, 4, 10) == (0, [(0, 0)])
    depth, slots = exact_dedup.directory({0: 30, 1: 5, 15: 3}, 4, 10)
    assert depth == 4 and len(slots) == 16 and slots[0] != slots[1] and len(set(slots[8:])) == 1


def test_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    cols = ["doc_id", "group_size", "keep_id", "kept", "text_sha256"]
    want = sorted(map(tuple, c.sql(oracle_sql()["op3_exact_dedup"]).select(*cols).fetchall()))
    assert sorted(map(tuple, queries()["op3_exact_dedup"](spark, d).select(*cols).collect())) == want


def test_rows_are_dropped_by_id_and_text(spark, make):
    """Repeated and null ids take no other text with them; of each text one row stays."""
    docs = make(["a", "b", "a", "c c", "c\tc", "d", "d", "e", "e", None, "", "a"], ids=[1, 2, 2, None, None, None, 7, 8, 8, 9, 10, 1])
    left = [(r["doc_id"], normal(r["text"])) for r in exact_dedup.drop_copies(docs).collect()]
    assert sorted(left, key=str) == sorted([(1, "a"), (2, "b"), (None, "c c"), (7, "d"), (8, "e"), (9, "")], key=str)
    assert exact_dedup.drop_copies(make([])).count() == 0
    more = docs.withColumn("keep_id", docs["doc_id"]).withColumn("_key", docs["doc_id"]).withColumn("_named_id", docs["doc_id"])
    assert exact_dedup.drop_copies(more).count() == len(left) and exact_dedup.drop_copies(more).columns == more.columns


def test_every_bucket_is_owned_and_no_hash_is_trusted(spark, make, monkeypatch):
    """Many small buckets, large groups, and texts that share a hash."""
    texts = [f"text {i % 700}" for i in range(3000)] + ["hot"] * 1500
    monkeypatch.setattr(exact_dedup, "LEAST_CAPACITY", 8)
    got = exact_dedup.exact_dedup(make(texts)).collect()
    assert all(r["keep_id"] == texts.index(texts[r["doc_id"]]) and r["group_size"] == texts.count(texts[r["doc_id"]]) for r in got) and len(got) == len(texts)
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    got = exact_dedup.exact_dedup(make(texts[:300]), capacity=2).collect()
    assert all(r["keep_id"] == texts.index(texts[r["doc_id"]]) for r in got) and len(got) == 300
