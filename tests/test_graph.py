import pytest

from sparkwright import schemas
from sparkwright.operators import answers, graph_build, graph_query
from sparkwright.operators.graph_query import GraphPlan
from sparkwright.ontology import Ontology


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("Company", "A", ["Alpha"]), ("Company", "B", []), ("Company", "C", []), ("Company", "D", None)], schemas.NODE)
    rows = [("A", "COMPETES_WITH", "B", ["c1"]), ("B", "SUPPLIES", "C", ["c2"]), ("B", "COMPETES_WITH", "A", ["c3"]), ("C", "SUPPLIES", "C", ["c4"])]
    edges = spark.createDataFrame([("Company", s, r, "Company", t, ids, 0.9) for s, r, t, ids in rows], schemas.EDGE)
    return nodes, edges


def run(graph, *args, **kw):
    return graph_query.execute(*graph, GraphPlan(*args, **kw)).collect()


def test_one_hop(graph):
    assert {(r["relationship_type"], r["neighbor"], r["outgoing"]) for r in run(graph, "one_hop", ("alpha",))} == {("COMPETES_WITH", "B", True), ("COMPETES_WITH", "B", False)}
    assert len(run(graph, "one_hop", ("C",), "SUPPLIES")) == 2  # the loop once


def test_two_hop(graph):
    rows = run(graph, "two_hop_chain", ("A",), "COMPETES_WITH", "SUPPLIES")
    assert {(r["via"], r["result"], tuple(r["source_chunk_ids"])) for r in rows} == {("B", "C", ("c1", "c2")), ("B", "C", ("c3", "c2"))}


def test_path(graph):
    (r,) = run(graph, "path_between", ("A", "C"))
    assert r["node_path"] == ["A", "B", "C"] and r["hops"] == 2 and len(r["source_chunk_ids_per_hop"]) == 2
    assert run(graph, "path_between", ("A", "D")) == [] and run(graph, "path_between", ("A", "A")) == [] and run(graph, "path_between", ("A", "C"), max_hops=1) == []


def test_count(graph):
    assert tuple(run(graph, "aggregate_count", ("A",), "COMPETES_WITH")[0]) == (1, ["B"])
    assert tuple(run(graph, "aggregate_count", ("A",), "ACQUIRED")[0]) == (0, [])


def test_bad_plans(graph):
    assert run(graph, "two_hop_chain", ("nobody",)) == []  # before the parameters are looked at
    for args in (("two_hop_chain", ("A",), "SUPPLIES"), ("path_between", ("A",)), ("aggregate_count", ("A",)), ("no_such", ("A",)), ("one_hop", ()), ("one_hop", ("A",), "x; DROP")):
        with pytest.raises(ValueError):
            run(graph, *args)
    with pytest.raises(ValueError):
        GraphPlan("path_between", max_hops=-1).hops
    assert GraphPlan("path_between", max_hops=0).hops == 3


def test_claims_to_edges_and_again(spark):
    mentions = spark.createDataFrame([("Company", "a inc", "A", "1", 1.0), ("Company", "b", "B", "1", 1.0)], schemas.MENTION)
    claims = spark.createDataFrame([("SUPPLIES", "a inc", "b", "c1", 0.8), ("SUPPLIES", "a inc", "b", "c2", 0.9), ("SUPPLIES", "a inc", "zzz", "c3", 0.9)], schemas.CLAIM)
    good, bad = graph_build.split_resolved(graph_build.resolve_endpoints(claims, mentions))
    edges = graph_build.collapse_claims(good)
    (e,) = edges.collect()
    assert (e["src"], e["dst"], e["source_chunk_ids"], e["confidence"]) == ("A", "B", ["c1", "c2"], 0.9) and bad.count() == 1
    assert [tuple(r) for r in graph_build.merge_edges(edges, edges).collect()] == [tuple(r) for r in graph_build.merge_edges(edges, edges.limit(0)).collect()]


def test_node_and_vector_merges(spark):
    old = spark.createDataFrame([("Company", "A", ["x", "y"])], schemas.NODE)
    new = spark.createDataFrame([("Company", "A", ["z", "x"]), ("Company", "B", [])], schemas.NODE)
    merged = graph_build.merge_nodes(old, new)
    assert {r["canonical_name"]: r["aliases"] for r in merged.collect()} == {"A": ["x", "y", "z"], "B": []}
    v = lambda *rows: spark.createDataFrame(rows, "chunk_id string, document_id string, text string")
    got = graph_build.merge_vectors(v(("1", "d", "old"), ("2", "d", "old")), v(("2", "e", "new"), ("3", "e", "new")))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "d", "old"), ("2", "d", "new"), ("3", "e", "new")]


def test_label_free(spark):
    nodes = spark.createDataFrame([("Company", "A", []), ("Product", "A", []), ("Company", "B", [])], schemas.NODE)
    edges = spark.createDataFrame([("Company", "A", "SUPPLIES", "Company", "B", ["c"], 1.0)], schemas.EDGE)
    assert graph_build.label_free_ends(edges, nodes).count() == 2


def test_statements(spark, graph):
    o = Ontology()

    def say(*args):
        plan = GraphPlan(*args)
        return [r["text"] for r in answers.statements(plan, graph_query.execute(*graph, plan), o).orderBy("text").collect()]

    assert say("one_hop", ("Alpha",)) == ["Alpha competes with B.", "B competes with Alpha."]
    assert say("two_hop_chain", ("A",), "COMPETES_WITH", "SUPPLIES") == ["A competes with B, and B supplies C."] * 2
    assert say("path_between", ("A", "C")) == ["A competes with B; then B supplies C."]
    assert say("aggregate_count", ("A",), "ACQUIRED") == ["A acquired 0 entities ()."]


def test_stored_graph_follows_its_tables(spark, tmp_path):
    """A folder whose tables are replaced is another graph, though its path is the same."""
    import shutil

    from pyarrow import parquet

    from sparkwright.plans import queries

    for name in ("lineitem", "orders", "supplier", "customer", "nation"):
        shutil.copyfile(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    at = str(tmp_path)
    before = queries.edges(spark, at).count()
    assert queries.edges(spark, at).inputFiles() == queries.edges(spark, at).inputFiles()  # stored once
    none = parquet.read_table(tmp_path / "lineitem.parquet").slice(0, 0)
    (tmp_path / "lineitem.parquet").unlink()
    parquet.write_table(none, tmp_path / "lineitem.parquet")
    after = queries.edges(spark, at).groupBy("rel_type").count().collect()
    assert before > 100 and "SUPPLIES" not in {r["rel_type"] for r in after}
