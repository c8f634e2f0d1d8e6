"""Exact top-k by cosine, for one query or many, and an optional cluster index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, literal


def top_k(vectors: DataFrame, query, k: int = 5, min_similarity: float = 0.0, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows with ``similarity``, ties by key; the least similarity is asked of these k, so fewer may come."""
    if k < 1:
        raise ValueError("k must be at least 1")
    scored = vectors.withColumn("similarity", cosine(F.col(vector), literal(query)))
    return scored.drop(vector).orderBy(F.desc_nulls_last("similarity"), F.asc(key)).limit(k).filter(F.col("similarity") >= min_similarity)


#: So many queries are one small matrix, which goes along with a scan of the vectors; more meet the vectors in cells.
FEW = 256
#: Rows of a cell: so many queries, so many vectors.
CELL_QUERIES, CELL_VECTORS = 1024, 32_768


def _unit(column: pa.Array) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _first(keys: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, similarities) of each line's k best, ties by key; a line for each query."""
    order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :k]
    return np.take_along_axis(np.broadcast_to(keys, s.shape), order, 1), np.take_along_axis(s, order, 1)


def _told(ids: pa.Array, keys: np.ndarray, s: np.ndarray, kind: pa.DataType) -> list[pa.Array]:
    return [ids.take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))), pa.array(keys.ravel(), kind), pa.array(s.ravel())]


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", few: int = FEW, cell_queries: int = CELL_QUERIES, cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """(query, key, similarity, rank) of each query's k nearest rows; rows and queries without a vector take no part.

    Up to ``few`` queries are one matrix beside a single scan of the vectors.  More never pass the driver: queries and vectors are dealt to the cells of a
    grid by hash, and every cell is one task's bounded work.  Either way a batch or cell keeps k rows for each query, and these meet in one ranking.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    kind, qkind = vectors.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    shape = f"{query_key} {qkind}, {key} {kind}, similarity double"
    rows = vectors.filter(F.col(vector).isNotNull()).select(key, vector)
    asked = queries.filter(F.col(vector).isNotNull()).select(query_key, vector)
    some = asked.limit(few + 1).collect()
    if not some:
        return vectors.sparkSession.createDataFrame([], f"{shape}, rank int")
    found = _in_one_scan(rows, some, k, shape) if len(some) <= few else _in_cells(rows, asked, k, shape, cell_queries, cell_vectors)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _in_one_scan(rows: DataFrame, asked: list, k: int, shape: str) -> DataFrame:
    matrix = _unit(pa.array([r[1] for r in asked], pa.list_(pa.float64())))
    ids, names = pa.array([r[0] for r in asked]), [c.split()[0] for c in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                best = _first(keys, matrix @ _unit(batch.column(1)).T, k)
                yield pa.record_batch(_told(ids, *best, batch.column(0).type), names=names)

    return rows.mapInArrow(run, shape)


def _in_cells(rows: DataFrame, asked: DataFrame, k: int, shape: str, cell_queries: int, cell_vectors: int) -> DataFrame:
    """Each row meets each query in one cell: rows go to a line of the grid and queries to a column, by hashes of all they hold (tables are keyed: no two rows are alike in key and vector by the thousand)."""
    across, down = -(-asked.count() // cell_queries), max(1, -(-rows.count() // cell_vectors))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda frame, n: F.pmod(F.xxhash64(*frame.columns), F.lit(n)).cast("int")
    left = asked.select("*", dealt(asked, across).alias("_x"), every(down).alias("_y"))
    right = rows.select("*", dealt(rows, down).alias("_y"), every(across).alias("_x"))
    names = [c.split()[0] for c in shape.split(", ")]

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        queries, vectors = queries.combine_chunks(), vectors.combine_chunks()
        whole = lambda t, i: t.column(i).combine_chunks() if t.num_rows else pa.array([], t.schema.field(i).type)
        out = [[pa.array([], queries.schema.field(0).type), pa.array([], vectors.schema.field(0).type), pa.array([], pa.float64())]]
        for q in range(0, queries.num_rows if vectors.num_rows else 0, 128):
            part = queries.slice(q, 128)
            matrix, keys, s = _unit(whole(part, 1)), None, None
            for v in range(0, vectors.num_rows, 4096):
                some = vectors.slice(v, 4096)
                best = _first(whole(some, 0).to_numpy(zero_copy_only=False), matrix @ _unit(whole(some, 1)).T, k)
                keys, s = best if keys is None else (np.concatenate([keys, best[0]], axis=1), np.concatenate([s, best[1]], axis=1))
                order = np.lexsort((keys, -s), axis=1)[:, :k]
                keys, s = np.take_along_axis(keys, order, 1), np.take_along_axis(s, order, 1)
            out.append(_told(whole(part, 0), keys, s, vectors.schema.field(0).type))
        return pa.table([pa.concat_arrays(c) for c in zip(*out, strict=True)], names=names)

    return left.groupBy("_x", "_y").cogroup(right.groupBy("_x", "_y")).applyInArrow(run, shape)


def fit_clusters(vectors: DataFrame, clusters: int = 64, sample: int = 20_000, rounds: int = 8, vector: str = "embedding", seed: int = 0) -> np.ndarray:
    """Centres for an index, from a bounded sample picked by a hash."""
    total = max(vectors.count(), 1)
    place = F.pmod(F.xxhash64(F.to_json(F.struct(vector))), F.lit(1 << 30)) / float(1 << 30)
    rows = np.array([r[0] for r in vectors.filter(place < min(1.0, sample / total)).select(vector).orderBy(F.xxhash64(F.to_json(F.struct(vector)))).collect()], np.float64)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    centres = rows[np.random.default_rng(seed).choice(len(rows), min(clusters, len(rows)), replace=False)]
    for _ in range(rounds):
        of = np.argmax(rows @ centres.T, axis=1)
        for c in range(len(centres)):
            if (of == c).any():
                centres[c] = rows[of == c].mean(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def assign_clusters(vectors: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Every row with its nearest centre's ``cluster``: the column to partition the table by."""

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.argmax(np.stack(batch.to_numpy()).astype(np.float64) @ centres.T, axis=1).astype(np.int32))

    return vectors.withColumn("cluster", nearest(F.col(vector)))


def top_k_clusters(indexed: DataFrame, centres: np.ndarray, query, k: int = 5, probes: int = 8, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """Approximate top-k: only the clusters nearest to the query are read."""
    near = np.argsort(-(centres @ np.asarray(query, np.float64)))[:probes].tolist()
    return top_k(indexed.filter(F.col("cluster").isin(near)), query, k, -1.0, key, vector)
