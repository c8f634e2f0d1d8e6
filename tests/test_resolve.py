import random

from sparkwright.operators import resolve
from sparkwright.operators.components import components

MENTION = "entity_type string, raw_name string, canonical_name string, source_chunk_id string, confidence double"


def mentions(spark, rows):
    return spark.createDataFrame([(t, n, None, f"c{i}", 1.0) for i, (t, n) in enumerate(rows)], MENTION)


def test_clusters_and_types(spark):
    rows = [("Company", "Acme Inc"), ("Company", "Acme Corp."), ("Company", "ACME"), ("Product", "Acme"), ("Company", "Unrelated Widgets")]
    told, registry = resolve.resolve_entities(mentions(spark, rows))
    found = {(r["entity_type"], r["raw_name"]): r["canonical_name"] for r in told.collect()}
    assert found["Company", "ACME"] == found["Company", "Acme Inc"] == "Acme Corp." and found["Product", "Acme"] == "Acme"
    assert {(r["entity_type"], r["canonical_name"]): r["aliases"] for r in registry.collect()}["Company", "Acme Corp."] == ["Acme Inc", "ACME"]


def test_seeds(spark):
    rows = [("Company", "QWX"), ("Company", "Quiet Willow Exchange"), ("Company", "Other")]
    seeds = spark.createDataFrame([("Company", ["QWX", "Quiet Willow Exchange, Inc."]), ("Company", ["Nobody", "Noone"])], "entity_type string, names array<string>")
    apart = {r["canonical_name"] for r in resolve.resolve_entities(mentions(spark, rows))[1].collect()}
    joined = {r["canonical_name"] for r in resolve.resolve_entities(mentions(spark, rows), seeds=seeds)[1].collect()}
    assert apart == {"QWX", "Quiet Willow Exchange", "Other"} and joined == {"Quiet Willow Exchange", "Other"}


def test_components_of_random_edges(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_blocks_meet(spark):
    rows = spark.createDataFrame([("t", i, [1.0, i / 50]) for i in range(20)], "entity_type string, norm int, embedding array<double>")
    pairs = lambda block: {(r["a"], r["b"]) for r in resolve.similar_pairs(rows, 0.999, block=block).collect()}
    assert pairs(3) == pairs(1000) and (0, 1) in pairs(3)


def test_pairs_of_clusters(spark):
    """Every pair of every group that reaches the threshold, and few of the blocks' pairs are looked at."""
    import numpy as np

    from sparkwright.plans.scratch import Scratch

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8))
    x = centres[rng.integers(0, 40, 1500)] + rng.normal(scale=0.1, size=(1500, 8))
    x[::3] = x[0]  # a hot vector
    data = [("t" if i % 5 else "u", i, v.tolist()) for i, v in enumerate(x)] + [("t", 5000, [0.0] * 8), ("t", 5001, None), ("w", 5002, [1.0] * 8)]
    rows = spark.createDataFrame(data, "entity_type string, norm int, embedding array<double>").cache()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, kind = unit @ unit.T >= 0.9, np.arange(1500) % 5 == 0
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(near & (kind[:, None] == kind)), strict=True) if a < b}
    got = [(r["a"], r["b"]) for r in resolve.similar_pairs(rows, 0.9, block=20).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    blocks = resolve.pair_blocks(rows, "norm", "embedding", "entity_type", 20, Scratch(spark, "test"))
    n = blocks.filter("entity_type = 't'").count()
    spread = resolve.meeting_blocks(blocks.filter("entity_type = 't'"), 0.9, "entity_type").count()
    assert spread < 0.45 * n * (n + 1) / 2


def test_pairs_of_no_rows(spark):
    none = spark.createDataFrame([], "entity_type string, norm int, embedding array<double>")
    assert resolve.similar_pairs(none).collect() == []


def test_look_up(spark):
    nodes = spark.createDataFrame([("Company", "Brell Corporation", ["BRLL"]), ("Company", "QXR", None)], "entity_type string, canonical_name string, aliases array<string>")
    asked = spark.createDataFrame([("brll",), ("Brell",), ("qxr",), ("zzz",)], "surface string")
    assert {r["surface"]: r["canonical_name"] for r in resolve.look_up(asked, nodes).collect()} == {"brll": "Brell Corporation", "Brell": "Brell Corporation", "qxr": "QXR", "zzz": None}


def test_blocks_are_sent_once_to_a_cell(spark, monkeypatch):
    """A block goes to each stripe that it meets, not to each block: what is sent grows with the rows."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("Company", i, v.tolist()) for i, v in enumerate(rng.normal(size=(640, 6)))]
    frame = spark.createDataFrame(rows, "entity_type string, id long, embedding array<double>")
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.3, 1))
    found = resolve.similar_pairs(frame, 0.3, "id", block=8, stripe=40)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(zip(a.tolist(), b.tolist(), strict=True))
    before = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    sent = max(before.apply(i).shuffleWriteBytes() for i in range(before.size()))
    assert sent < 12 * x.nbytes + 200_000  # eighty blocks to each other would be more than forty times
