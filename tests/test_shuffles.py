"""What larger tables need: edges that stay where they are, inputs that are read once."""

import pandas as pd
from pyspark.sql import functions as F

from sparkwright.operators import graph_build, graph_plans, graph_query, resolve, validate
from sparkwright.sources import tables

EDGE = "src_type string, src string, rel_type string, dst_type string, dst string, source_chunk_ids array<string>, confidence double"


def graph(spark):
    rows = [("Company", a, t, "Company", b, [f"{a}{b}"], 0.5) for a, t, b in (("a", "SUPPLIES", "b"), ("b", "SUPPLIES", "c"), ("a", "SUPPLIES", "d"), ("d", "ACQUIRED", "c"), ("c", "SUPPLIES", "e"))]
    return spark.createDataFrame(rows, EDGE)


def test_batches_merge_at_once_as_one_after_the_other(spark):
    one, two = graph(spark), graph(spark).withColumn("source_chunk_ids", F.array(F.lit("z"))).withColumn("confidence", F.lit(0.9))
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(graph_build.merge_edges(one, two, two)) == rows(graph_build.merge_edges(graph_build.merge_edges(one, two), two))


def test_a_path_is_the_same_with_frontiers_sent_or_dealt(spark, monkeypatch):
    sent = graph_query.path_between(graph(spark), "a", "e", 3).collect()
    monkeypatch.setattr(graph_query, "SENT", 0)
    assert sent == graph_query.path_between(graph(spark), "a", "e", 3).collect()
    assert sent[0]["node_path"] == ["a", "b", "c", "e"]


def test_chains_read_the_types_of_their_plans(spark, monkeypatch):
    plans = spark.createDataFrame([(1, "a", "SUPPLIES", "ACQUIRED"), (2, "c", "ACQUIRED", None)], "plan_id int, name string, first string, second string")
    assert {r["rel_type"] for r in graph_plans._typed(graph(spark), plans, "second").collect()} == {"ACQUIRED"}
    few = sorted(map(tuple, graph_plans.two_hop_chain(graph(spark), plans).collect()))
    monkeypatch.setattr(graph_plans, "TYPES", 0)
    assert few == sorted(map(tuple, graph_plans.two_hop_chain(graph(spark), plans).collect())) != []


def test_each_name_is_embedded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def embed(names: pd.Series) -> pd.Series:
        calls.add(len(names))
        return names.map(lambda n: [float(len(n)), 1.0])

    mentions = spark.createDataFrame([("Company", n, None) for n in ("Acme", "Acme Inc", "Other", "Third one")], "entity_type string, raw_name string, canonical_name string")
    told, _ = resolve.resolve_entities(mentions, 0.9999999, None, embed)
    assert told.count() == 4
    assert calls.value == 3


def test_no_table_of_names_is_held(spark):
    entities = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", "b")], "source_chunk_id string, raw_name string")
    claims = spark.createDataFrame([("1", "a", "b"), ("1", "a", "x"), ("2", "a", "b")], "source_chunk_id string, source_entity string, target_entity string")
    kept = validate.drop_dangling(entities, claims)
    assert [tuple(r)[:3] for r in kept.select("source_chunk_id", "source_entity", "target_entity").collect()] == [("1", "a", "b")]
    assert "Aggregate" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_claims_of_a_type_fold_in_one_pass(spark, tmp_path):
    """The same edges as by aggregation, but without hash tables of sets and without a sort for the writer; settings are as before."""
    rows = [("a", "b", "2", 0.1), ("a", "b", "1", 0.4), ("a", "b", "2", 0.3), ("a", None, "3", None), ("b", "a", None, 0.2), ("a", None, "4", 0.5)]
    claims = spark.createDataFrame(rows, "src string, dst string, source_chunk_id string, confidence double")
    edges = graph_build.collapse_typed(claims, "Company", "SUPPLIES", "Person")
    want = graph_build.collapse_claims(claims.withColumns({"src_type": F.lit("Company"), "relationship_type": F.lit("SUPPLIES"), "dst_type": F.lit("Person")}))
    told = lambda frame: sorted(map(str, frame.select(want.columns).collect()))
    keys = ("spark.sql.execution.replaceHashWithSortAgg", "spark.sql.maxConcurrentOutputFileWriters")
    before = [spark.conf.get(k, None) for k in keys]
    with tables.in_one_pass(spark):
        plan = graph_build.collapse_typed(claims, "Company", "SUPPLIES", "Person")._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and plan.count("SortAggregate") == 1 and plan.count("Exchange") == 1
    assert [spark.conf.get(k, None) for k in keys] == before
    tables.write_edges(edges.unionByName(edges.withColumn("rel_type", F.lit("ACQUIRED"))), f"{tmp_path}/edges")
    assert told(tables.edges(spark, f"{tmp_path}/edges").filter("rel_type = 'SUPPLIES'")) == told(edges) == told(want)
    assert tables.edges(spark, f"{tmp_path}/edges").count() == 2 * len(told(want))
