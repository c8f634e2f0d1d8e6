import re

import pytest
from pyspark.sql import functions as F

from sparkwright.operators import graph_build
from sparkwright.operators.evidence_store import EvidenceStore

SHAPE = "src_type string, src string, relationship_type string, dst_type string, dst string, source_chunk_id string, confidence double"


def claims(spark, rows):
    return spark.createDataFrame([("Company", a, "SUPPLIES", "Company", b, c, x) for a, b, c, x in rows], SHAPE)


@pytest.fixture
def store(spark, tmp_path):
    made = EvidenceStore(spark, str(tmp_path / "graph"), 4)
    yield made
    made.close()


def told(frame):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in frame.collect())


def test_merges_are_those_of_whole_rows(spark, store):
    one = claims(spark, [("A", "B", "c1", 0.8), ("A", "B", "c2", 0.5), ("A", "C", "c1", 0.5), ("A", "B", "c1", 0.8)])
    two = claims(spark, [("A", "B", "c1", 0.9), ("A", "B", "c3", 0.1), ("D", "E", "c9", 0.2)])
    for batch in (one, two, two, one):
        store.merge(batch)
    want = graph_build.merge_edges(graph_build.collapse_claims(one), graph_build.collapse_claims(two))
    assert told(store.view()) == told(want)
    assert store.evidence().count() == 6 and store.edges().count() == 3  # what comes again adds nothing
    assert {(r["src"], r["dst"]): (r["chunks"], r["confidence"]) for r in store.strengths().collect()} == {("A", "B"): (3, 0.9), ("A", "C"): (1, 0.5), ("D", "E"): (1, 0.2)}
    assert {len(r["source_chunk_ids"]) for r in store.view(1).collect()} == {1}


def test_another_session_of_the_same_files(spark, store):
    store.merge(claims(spark, [("A", "B", "c1", 0.8)]))
    again = EvidenceStore(spark, store.path, 4)
    again.merge(claims(spark, [("A", "B", "c1", 0.8), ("A", "B", "c2", 0.8)]))
    assert told(again.view()) == [("Company", "A", "SUPPLIES", "Company", "B", ("c1", "c2"), 0.8)]
    again.close()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_stored_sides_are_not_shuffled(spark, store):
    """Reading joins and groups by bucket; a merge exchanges new claims alone."""
    store.merge(claims(spark, [(f"s{i % 50}", f"t{i % 7}", f"c{i}", 0.5) for i in range(500)]))
    with_join = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in with_join}
    try:
        for k, v in with_join.items():
            spark.conf.set(k, v)
        plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(store.view()) and "Exchange" not in plan(store.strengths())
        new = claims(spark, [("s1", "t1", "c1", 0.5)]).withColumnRenamed("relationship_type", "rel_type")
        text = plan(store.unseen(new.select(F.xxhash64(*graph_build.EDGE_KEY).alias("edge_id"), F.col("source_chunk_id").alias("chunk_id"), "confidence")))
        assert "Bucketed: true" in text and "Exchange" not in re.split("Scan ExistingRDD|LocalTableScan", text)[-1]  # the stored side comes last
        assert len(re.findall("Exchange", text)) == 2  # of the new claims: folded, then dealt to their buckets
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hub_has_no_wide_row(spark, store):
    store.merge(claims(spark, [("hub", "x", f"c{i}", 0.5) for i in range(3000)]))
    one = store.edges().filter("src = 'hub'").select("edge_id")
    assert store.of(one).count() == 3000 and store.strengths().first()["chunks"] == 3000


def test_nothing(spark, store):
    store.merge(claims(spark, []))
    assert store.view().collect() == [] and store.strengths().collect() == []


def test_buckets_follow_the_claims():
    from sparkwright.operators.evidence_store import BUCKET_CLAIMS, buckets_for

    assert buckets_for(0) == buckets_for(600_000) == 8 and buckets_for(216_000_000) == -(-216_000_000 // BUCKET_CLAIMS)


def test_the_write_does_not_deal_again(spark, tmp_path, monkeypatch):
    """What is appended is in its buckets already: evidence is folded and dealt, edges are dealt and folded there."""
    plans = []
    append = EvidenceStore._append
    monkeypatch.setattr(EvidenceStore, "_append", lambda self, kind, rows: (plans.append(rows.sortWithinPartitions("edge_id")._jdf.queryExecution().executedPlan().toString()), append(self, kind, rows)))
    store = EvidenceStore(spark, str(tmp_path / "graph"), 4)
    try:
        with_threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = [("Company", "A", "SUPPLIES", "Company", "B", f"c{i % 3}", 0.5) for i in range(6)]
        store.merge(spark.createDataFrame(rows, "src_type string, src string, relationship_type string, dst_type string, dst string, source_chunk_id string, confidence double"))
        assert store.evidence().count() == 3 and store.edges().count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_threshold)
        store.close()
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 1], plans
