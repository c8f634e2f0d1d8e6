import numpy as np
import pytest

from sparkwright.operators import vector_search as S


def table(spark, x, ids, name):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], f"{name}, embedding array<float>")


def brute(rows, asked, k):
    unit = lambda v: np.asarray(v, np.float32).astype(float) / max(np.linalg.norm(np.asarray(v, np.float32).astype(float)), 1e-300)
    out = {}
    for q, v in asked:
        near = sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w in rows)[:k]
        out[q] = [i for _, i in near]
    return out


def told(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


@pytest.mark.parametrize("few", [256, 0])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest_of_many_queries(spark, few, kind):
    """Both ways against all pairs: cells of any size, missing vectors, fewer rows than k."""
    rng = np.random.default_rng(3)
    name = (lambda i: i) if kind == "long" else (lambda i: f"k{i:04d}")
    x = rng.normal(size=(230, 6))
    rows, asked = [(name(i), v) for i, v in enumerate(x)], [(name(i), v) for i, v in enumerate(x[:40] + 0.1)]
    vectors = table(spark, [v for _, v in rows] + [None], [i for i, _ in rows] + [name(999)], f"vec_id {kind}")
    queries = table(spark, [v for _, v in asked] + [None], [i for i, _ in asked] + [name(998)], f"query_id {kind}")
    found = S.top_k_batch(vectors, queries, 5, few=few, cell_queries=16, cell_vectors=50)
    assert told(found) == brute(rows, asked, 5)
    small = vectors.filter(f"vec_id < {name(3)!r}")
    assert told(S.top_k_batch(small, queries, 5, few=few, cell_queries=16, cell_vectors=50)) == brute(rows[:3], asked, 5)


@pytest.mark.parametrize("few", [256, 0])
def test_repeated_rows_and_empty_tables(spark, few):
    """Copies that hold most rows each count as rows of their own, ties by key; empty sides give nothing."""
    x = [[1, 0]] * 120 + [[0, 1]] * 5 + [[0, 0]]
    vectors = table(spark, x, range(126), "vec_id long")
    queries = table(spark, [[1, 0], [0, 2]], [1, 2], "query_id long")
    go = lambda v, q: S.top_k_batch(v, q, 3, few=few, cell_queries=1, cell_vectors=20)
    assert told(go(vectors, queries)) == {1: [0, 1, 2], 2: [120, 121, 122]}
    assert go(vectors.limit(0), queries).collect() == [] and go(vectors, queries.limit(0)).collect() == []


def test_more_queries_do_not_pass_the_driver(spark):
    """Beyond a few, the plan holds no query: both sides are dealt to cells."""
    vectors = table(spark, np.eye(4), range(4), "vec_id long")
    plan = S.top_k_batch(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 1, few=2)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    with pytest.raises(ValueError, match="k must"):
        S.top_k_batch(vectors, vectors, 0)
