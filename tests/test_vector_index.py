import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.operators import vector_index as I
from sparkwright.operators import vector_search

SHAPE = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def vectors(spark):
    """Rows around twenty directions; a third of them are one vector."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 900)] + rng.normal(scale=0.4, size=(900, 16))
    x[::3] = centres[0]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SHAPE).cache()


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return I.build(vectors, str(tmp_path_factory.mktemp("ix") / "index"), 12, "vec_id")


def told(frame):
    return [(r["vec_id"], round(r["similarity"], 5)) for r in frame.collect()]


def test_all_lists_are_exact(spark, vectors, index):
    query = vectors.filter("vec_id = 7").first()["embedding"]
    want = told(vector_search.top_k(vectors, query, 5, -1.0, "vec_id"))
    assert told(I.search(index, query, 5, 12, 200)) == want
    assert sorted(I.open_index(spark, index.path).centres.ravel()) == sorted(index.centres.ravel())
    queries = vectors.filter("vec_id % 100 = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    key = lambda f: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["similarity"], 5)) for r in f.collect())
    assert key(I.search_many(index, queries, 5, 12)) == key(vector_search.top_k_batch(vectors, queries, 5))


def test_recall_with_few_lists(vectors, index):
    queries = vectors.filter("vec_id % 10 = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vector_search.top_k_batch(vectors, queries, 5)
    assert I.recall(I.search_many(index, queries, 5, 4), exact) >= 0.9
    query = vectors.filter("vec_id = 11").first()["embedding"]
    found, want = ({k for k, _ in told(f)} for f in (I.search(index, query, 5, 3), vector_search.top_k(vectors, query, 5, -1.0, "vec_id")))
    assert len(found & want) >= 4 and 11 in found


def test_only_probed_folders_are_read(index, vectors):
    query = vectors.first()["embedding"]
    plan = I.search(index, query, 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [cluster") >= 2 and all(str(c) in plan for c in index.near(query, 2))
    read = index.lists().filter(F.col("cluster").isin(index.near(query, 2)))
    assert {r["cluster"] for r in read.select("cluster").distinct().collect()} <= set(index.near(query, 2)) and len(read.inputFiles()) >= 1


def test_adding(spark, vectors, tmp_path):
    """New rows go to the lists that are there; what comes again changes nothing."""
    old, new = vectors.filter("vec_id < 600"), vectors.filter("vec_id >= 500")
    index = I.build(old, str(tmp_path / "index"), 8, "vec_id")
    assert I.add(index, new) == 300 and I.add(index, new) == 0
    assert index.lists().count() == 900 == index.lists().select("vec_id").distinct().count()
    query = vectors.filter("vec_id = 850").first()["embedding"]
    assert told(I.search(index, query, 1, 2))[0] == told(vector_search.top_k(vectors, query, 1, -1.0, "vec_id"))[0]


def test_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [-1.0, 0.0])], SHAPE)
    index = I.build(rows, str(tmp_path / "a"), 4, "vec_id")
    assert told(I.search(index, [2.0, 0.0], 5, 4)) == [(1, 1.0), (4, 1.0), (5, -1.0)]
    empty = I.build(rows.limit(0), str(tmp_path / "b"), 4, "vec_id")
    assert I.search(empty, [1.0], 5, 4).collect() == []
    with pytest.raises(ValueError, match="at least 1"):
        I.search(index, [1.0, 0.0], 0)
