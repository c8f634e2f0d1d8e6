import json
import re

import pytest
from pyspark.sql import functions as F

from sparkwright import schemas
from sparkwright.operators import extraction
from sparkwright.operators.cache_store import CacheStore

CHUNKS = "chunk_id string, section_path string, text string, metadata map<string,string>"


def chunks(spark, rows):
    return spark.createDataFrame([(i, "s", t, {"company": "X"}) for i, t in rows], CHUNKS)


def answering():
    """Functions of their own, which travel to the workers by value."""

    def extractor(section, text, budget, filer):
        if text == "bad":
            return "no JSON"
        return json.dumps({"entities": [{"entity_type": "Company", "raw_name": text or "none", "confidence": 1.0}], "relationships": []})

    def never(section, text, budget, filer):
        raise AssertionError(text)

    return extractor, never


extractor, never = answering()


@pytest.fixture
def store(spark, tmp_path):
    made = CacheStore(spark, str(tmp_path / "cache"), 4)
    yield made
    made.close()


def told(frame):
    return sorted((r["chunk_id"], r["result"]["entities"][0]["raw_name"], r["from_cache"]) for r in frame.collect())


def test_each_chunk_is_asked_once(spark, store):
    first, rejects = store.extract(chunks(spark, [("a", "A"), ("b", "bad")]), extractor)
    assert told(first) == [("a", "A", False)] and [(r["chunk_id"], r["reason"]) for r in rejects.collect()] == [("b", "not JSON")]
    both = chunks(spark, [("a", "A"), ("c", "C")])
    second, rejects = store.extract(both, extractor)
    assert told(second) == [("a", "A", True), ("c", "C", False)] and rejects.count() == 0
    again, rejects = store.extract(both, never)
    assert told(again) == [("a", "A", True), ("c", "C", True)] and rejects.count() == 0 and store.rows().count() == 2
    assert told(second) == [("a", "A", True), ("c", "C", False)]  # a result stays what it was
    changed, rejects = store.extract(chunks(spark, [("a", "other")]), extractor)
    assert told(changed) == [("a", "other", False)] and store.rows().count() == 3


def test_same_results_as_a_cache_without_buckets(spark, store):
    rows = chunks(spark, [(f"c{i}", f"t{i % 7}" if i % 5 else "bad") for i in range(60)])
    want, bad = extraction.extract_all(rows, extractor)
    found, rejects = store.extract(rows, extractor)
    assert told(found) == told(want) and sorted(r["chunk_id"] for r in rejects.collect()) == sorted(r["chunk_id"] for r in bad.collect())
    known = store.rows()
    want, _ = extraction.extract_all(rows, extractor, known)
    found, _ = store.extract(rows, extractor)
    assert told(found) == told(want)


def test_adding_again_changes_nothing(spark, store):
    rows = spark.createDataFrame([(k, None, 1, n) for k, n in (("k1", 1), ("k1", 1), ("k2", 2))], schemas.CACHE)
    for _ in range(2):
        store.add(rows)
    assert sorted((r["cache_key"], r["output_tokens"]) for r in store.rows().collect()) == [("k1", 1), ("k2", 2)]
    other = CacheStore(spark, store.path, 4)
    other.add(rows.withColumn("cache_key", F.concat("cache_key", F.lit("x"))))
    other.close()
    assert extraction.total_cost(CacheStore(spark, store.path, 4).rows()).first()["results"] == 4


def test_repeated_chunks_null_and_no_texts(spark, store):
    found, _ = store.extract(chunks(spark, [("a", "A"), ("a", "A"), ("n", None), ("e", "")]), extractor)
    assert told(found) == [("a", "A", False), ("a", "A", False), ("e", "none", False), ("n", "none", False)]
    assert store.rows().count() == 3
    found, rejects = store.extract(chunks(spark, []), never)
    assert found.collect() == [] and rejects.collect() == []


def test_the_stored_side_is_not_shuffled(spark, store):
    store.extract(chunks(spark, [(f"c{i}", f"t{i}") for i in range(200)]), extractor)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed = extraction.with_keys(chunks(spark, [("c1", "t1")]), "rules")
        text = store.unknown(store.dealt(keyed))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in text and len(re.findall("Exchange", text)) == 1  # of the chunks
    assert "Exchange" not in re.split("Scan ExistingRDD|LocalTableScan", text)[-1]  # the stored side comes last
