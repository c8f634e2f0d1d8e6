import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import hard_negatives as H
from sparkwright.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, score double, pivot int, query string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 0.5, 1, "q") for i, v, y in rows], SCHEMA)


def brute(rows, anchor, k=5):
    """Every anchor against every row, with whole numbers of any size."""
    good = []
    for i, v, y in rows:
        if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], y))
    out = []
    for i, q, y in {(i, tuple(q), y) for i, q, y in good if anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j, z) for j, v, z in good if j != i)
        for ps, p, _ in [x for x in scored if x[2] == y][:k]:
            band = [(s, j) for s, j, z in scored if z != y and 80 * -ps <= 100 * -s <= 100 * -ps][:k]
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(band)]
    return sorted(out)


def mined(spark, rows):
    return sorted(tuple(r) for r in H.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).collect())


def clustered(n, seed=1, dim=6, groups=12, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    at = rng.integers(0, groups, n)
    return [(int(i), (centres[at[i]] * rng.uniform(0.5, 1.5) + rng.normal(scale=spread, size=dim)).tolist(), int(rng.integers(0, 3))) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "SEGMENT", 64)
    monkeypatch.setattr(H, "BLOCK", 8)
    rows = clustered(900)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and mined(spark, rows) == want


def test_odd_rows(spark):
    """Nulls, what is not finite, ties, repeated rows and ids, lengths that differ, one vector that a third of all rows have."""
    rows = clustered(150, 2)
    rows += [(1000 + i, [1.0, 0.5, 0, 0, 0, 0.25], i % 2) for i in range(80)]
    rows += [rows[0], rows[0], (10, [0.5] * 6, 1), (20, [0.25] * 3, 1), (30, [], 0), (2000, [0.0] * 6, 0), (40, [1.0] * 8, 2)]
    rows += [(None, [1.0] * 6, 1), (50, None, 1), (60, [1.0] * 6, None), (70, [None, 1.0], 1), (80, [float("nan")] * 6, 1), (90, [float("inf")] * 6, 1), (100, [-1.0] * 6, 9)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_large_components(spark):
    """Products beyond the whole numbers that doubles hold."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 1.2e5).astype(np.float32).tolist(), i % 2) for i in range(60)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="does not fit a long"):
        mined(spark, [(0, [1e30], 1), (10, [1.0], 0)])


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0)]) == []  # no anchor
    assert mined(spark, [(10, [1.0], 0)]) == []  # nobody else
    assert mined(spark, [(10, [1.0], 0), (11, [1.0], 0), (12, [0.9], 1)]) == [(10, 11, 1, 12, 65536, 58880)]


def test_annuli_leave_segments_out(spark, monkeypatch):
    """On clustered rows a search ends with few of the segments scanned, and its bound holds for those it left out."""
    monkeypatch.setattr(H, "SEGMENT", 64)
    rows = clustered(4000, 3, groups=20, spread=0.02)
    scratch = Scratch(spark, "test")
    kept = scratch.keep(H.quantised(frame(spark, rows), F.col("vec_id") == 70, "vec_id", "embedding", "label"), "rows")
    top = kept.agg(F.max("norm"), F.max("size"), F.max("largest")).first()
    space = H.Space(top[1], top[0], top[2], H.dense(kept.select("vector").limit(500).toArrow().column(0).combine_chunks(), top[1]), 16)
    index = H.build_index(kept, space, scratch)
    wide = index.toPandas()
    assert sum(len(b) // 8 for b in wide["ids"]) == len(rows)
    assert all(a <= b for a, b in zip(wide["low"], wide["high"], strict=True))
    scanned = []
    meets = H._scanned

    def counted(space_, targets, same, k):
        scanned.append(spark._jsparkSession)  # rounds
        return meets(space_, targets, same, k)

    monkeypatch.setattr(H, "_scanned", counted)
    one = kept.filter("anchor").select(F.lit(0).cast("long").alias("query"), F.col("vec_id").alias("anchor_id"), "label", "vector", "norm", F.array(F.lit(2**62)).alias("caps"), F.array(F.lit(-(2**62))).alias("floors"))
    found = [(r["vec_id"], r["score"]) for r in H.search(index, space, one, True, 1, 5, scratch, "s").orderBy("rank").collect()]
    q = np.floor(256 * np.float32(rows[70][1]).astype(float))
    every = sorted((-int(q @ np.floor(256 * np.float32(v).astype(float))), i) for i, v, y in rows if y == rows[70][2] and i != 70)[:5]
    assert found == [(i, -s) for s, i in every] and len(scanned) <= 4
    # the k-th best's annulus meets a small part of the keys
    kth, near = -every[-1][0], space.from_query(q[None])[0]
    gap = np.maximum(np.maximum(wide["low"] - near[wide["pivot"]], near[wide["pivot"]] - wide["high"]), 0)
    assert np.mean((space.norm + q @ q - gap**2) / 2 + space.slack >= kth) < 0.5
    scratch.clear()
