from sparkwright.operators import answers, graph_plans, graph_query

EDGES = [
    ("Company", "A", "COMPETES_WITH", "Company", "B", ["c1"], 0.9),
    ("Company", "B", "SUPPLIES", "Company", "C", ["c2", "c3"], 0.8),
    ("Company", "A", "SUPPLIES", "Company", "D", ["c4"], 0.8),
    ("Company", "D", "SUPPLIES", "Company", "C", ["c5"], 0.8),
    ("Company", "C", "SUPPLIES", "Company", "C", ["c6"], 0.8),  # a loop
    ("Company", "C", "SUPPLIES", "Company", "B", ["c7"], 0.8),
    ("Company", "E", "REGULATED_BY", "RegulatoryBody", "R", ["c8"], 0.8),
    ("Company", "C", "REGULATED_BY", "RegulatoryBody", "C", ["c9"], 0.8),  # a name under two types
    ("Company", "C", "PARTNERS_WITH", "Company", "F", ["c10"], 0.8),
]
SHAPE = "src_type string, src string, rel_type string, dst_type string, dst string, source_chunk_ids array<string>, confidence double"
NAMES = "ABCDEF"


def graph(spark):
    nodes = [("Company", n, [n + n]) for n in NAMES] + [("RegulatoryBody", "R", []), ("RegulatoryBody", "C", [])]
    return spark.createDataFrame(nodes, "entity_type string, canonical_name string, aliases array<string>"), spark.createDataFrame(EDGES, SHAPE)


def rows(frame):
    return sorted(str(r.asDict(True)) for r in frame.collect())


def test_a_set_gives_what_its_plans_give(spark):
    """Every template, over names, aliases and unknown names: the set's rows are those of the single forms."""
    nodes, edges = graph(spark)
    plans = []
    for n in [*NAMES, "aa", "nobody"]:
        plans += [("one_hop", (n,), None, None, None), ("one_hop", (n,), "SUPPLIES", None, None), ("two_hop_chain", (n,), "SUPPLIES", "SUPPLIES", None), ("aggregate_count", (n,), "SUPPLIES", None, None)]
        plans += [("path_between", (n, m), None, None, k) for m in "CFR" for k in (None, 1, 2)]
    table = [(str(i), kind, list(names), first, second, hops) for i, (kind, names, first, second, hops) in enumerate(plans)]
    got, bad = graph_plans.statements(nodes, edges, spark.createDataFrame(table, graph_plans.PLAN))
    told = {}
    for r in got.collect():
        told.setdefault(r["plan_id"], []).append((r["text"], tuple(r["source_chunk_ids"])))
    refused = {r["plan_id"] for r in bad.collect()}
    assert refused == {str(i) for i, p in enumerate(plans) if "nobody" in p[1]}
    nodes, edges = nodes.cache(), edges.cache()
    for i, (kind, names, first, second, hops) in enumerate(plans):
        if kind != "path_between" and names[0] not in "ACaa" or str(i) in refused:
            continue  # some of each will do: every single form is a job of its own
        if kind == "path_between" and (names[0] not in "AE" or hops == 1):
            continue
        plan = graph_query.GraphPlan(kind, names, first, second, hops)
        one = answers.statements(plan, graph_query.execute(nodes, edges, plan))
        assert sorted(told.get(str(i), [])) == sorted((r["text"], tuple(r["source_chunk_ids"])) for r in one.collect()), plans[i]


def test_what_cannot_run(spark):
    nodes, edges = graph(spark)
    table = [("1", "one_hop", ["A"], "NOT_A_TYPE", None, None), ("2", "two_hop_chain", ["A"], "SUPPLIES", None, None), ("3", "path_between", ["A"], None, None, 3), ("4", "drop_all", ["A"], None, None, None), ("5", "one_hop", [], None, None, None), ("6", "path_between", ["A", "B"], None, None, -1), ("7", "drop_all", ["nobody"], None, None, None), ("8", None, ["A"], None, None, None)]
    got, bad = graph_plans.statements(nodes, edges, spark.createDataFrame(table, graph_plans.PLAN))
    assert got.collect() == []
    assert {r["plan_id"]: r["reason"] for r in bad.collect()} == {
        "1": "no such relationship type", "2": "no such relationship type", "3": "a path needs exactly two entities", "4": "no such query type", "5": "a plan needs an entity",
        "6": "max_hops is negative", "7": "a name is not known", "8": "no such query type",
    }


def test_no_plans(spark):
    nodes, edges = graph(spark)
    got, bad = graph_plans.statements(nodes, edges, spark.createDataFrame([], graph_plans.PLAN))
    assert got.collect() == [] and bad.collect() == []


def test_plans_with_one_end_share_its_frontier(spark, monkeypatch):
    """What is reached from an end is kept once, however many plans ask for that end."""
    links = [("Company", f"s{i}", "SUPPLIES", "Company", f"c{j}", [f"{i}-{j}"], 0.5) for i in range(30) for j in (i % 5, 5)]
    links += [("Company", f"c{j}", "HAS_SEGMENT", "BusinessSegment", "Hub", [f"h{j}"], 0.5) for j in range(20)]
    edges, sizes, keep = spark.createDataFrame(links, SHAPE), {}, graph_plans.Scratch.keep

    def counted(self, frame, name):
        sizes[name] = (out := keep(self, frame, name)).count()
        return out

    monkeypatch.setattr(graph_plans.Scratch, "keep", counted)
    plans = spark.createDataFrame([(f"p{i}", f"s{i}", "Hub", 3) for i in range(30)], "plan_id string, start string, end string, max_hops int")
    found = {r["plan_id"]: r for r in graph_plans.path_between(edges, plans).collect()}
    assert sizes["frontier1"] == 60 and sizes["frontier2"] == 20 and len(found) == 30
    assert found["p7"]["node_path"] == ["s7", "c2", "Hub"] and found["p7"]["source_chunk_ids_per_hop"] == [["7-2"], ["h2"]] and found["p7"]["hops"] == 2
