from sparkwright.operators import graph_build
from sparkwright.operators.evidence_store import EvidenceStore
from sparkwright.streaming.incremental import merge_evidence

SHAPE = "src_type string, src string, relationship_type string, dst_type string, dst string, source_chunk_id string, confidence double"


def claims(spark, rows):
    return spark.createDataFrame([("Company", a, "SUPPLIES", "Company", b, c, x) for a, b, c, x in rows], SHAPE)


def told(frame):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in frame.collect())


def test_growing_input_and_replays(spark, tmp_path):
    """Two runs take only what is new; a replay of everything, and one after a loss between the tables, end in the same."""
    landed, at = str(tmp_path / "in"), str(tmp_path / "graph")
    one = claims(spark, [("A", "B", "c1", 0.8), ("A", "B", "c2", 0.5), ("A", "B", "c1", 0.8)])
    two = claims(spark, [("A", "B", "c1", 0.9), ("D", "E", "c9", 0.2)])

    def run(mark):
        query = merge_evidence(spark.readStream.schema(SHAPE).parquet(landed), at, str(tmp_path / mark), 4)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    def view():
        store = EvidenceStore(spark, at, 4)
        try:
            return told(store.view())
        finally:
            store.close()

    one.write.mode("append").parquet(landed)
    assert run("mark") == 3
    two.write.mode("append").parquet(landed)
    assert run("mark") == 2 and run("mark") == 0
    want = told(graph_build.merge_edges(graph_build.collapse_claims(one), graph_build.collapse_claims(two)))
    assert view() == want
    assert run("other") == 5 and view() == want
    (tmp_path / "graph" / "edges").rename(tmp_path / "lost")  # as if a run had ended before its edges were written
    (tmp_path / "graph" / "edges").mkdir()
    run("third")
    assert view() == want
