"""A stored inverted file over vectors: centres, lists in folders, short codes, exact ranking of what is probed.

``build`` fits centres to a bounded sample and writes every row to the folder of its
nearest centre, with a code of one byte a component (what the row differs from its
centre by, scaled).  ``add`` assigns new rows to the centres that are there.  A search
reads only the folders of the centres nearest to its query: first the codes alone, from
which ``shortlist`` x k rows are picked, then these rows' vectors, whose exact cosines rank them.

Rows without a vector, and vectors of no length, have no cosine and are not in the index.  Similarities
of equal rows are equal; ties go by the key.  With every centre probed and a shortlist as
long as the table, a search is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, literal
from .vector_search import fit_clusters

#: A list's rows go to so many files for each million rows of the table, so that a hot list is no single file.
FILES_A_MILLION = 4
BLOCK, ROWS, SALTS = 128, 2048, 8


@dataclass
class Index:
    """An index at ``path``; its centres (a stated, bounded number) are on the driver."""

    spark: SparkSession
    path: str
    key: str
    kind: str
    centres: np.ndarray
    scale: float

    @property
    def clusters(self) -> int:
        return len(self.centres)

    def lists(self) -> DataFrame:
        return self.spark.read.schema(f"{self.key} {self.kind}, code binary, embedding array<float>, cluster int").parquet(f"{self.path}/lists")

    def near(self, query, probes: int) -> list[int]:
        q = np.asarray(query, np.float64)
        return np.argsort(-(self.centres @ q), kind="stable")[:probes].tolist()


def _assigned(rows: DataFrame, key: str, vector: str, centres: np.ndarray, scale: float) -> DataFrame:
    """(key, code, embedding, cluster): unit vectors by their nearest centre."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            size = np.linalg.norm(x, axis=1)
            ok = size > 0
            x = x[ok] / size[ok, None]
            of = np.argmax(x @ centres.T, axis=1)
            code = np.clip(np.rint((x - centres[of]) / scale), -127, 127).astype(np.int8)
            keep = pa.array(ok)
            yield pa.record_batch([batch.column(0).filter(keep), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1).filter(keep), pa.array(of.astype(np.int32))], names=[key, "code", "embedding", "cluster"])

    told = rows.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<float>").alias("embedding"))
    return told.mapInArrow(run, f"{key} {kind}, code binary, embedding array<float>, cluster int")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _write(rows: DataFrame, path: str, count: int) -> None:
    """Lists in folders; a list's rows are dealt over several files by their key, so a hot list fills no task."""
    key = rows.columns[0]
    salt = F.pmod(F.xxhash64(key), F.lit(max(1, count * FILES_A_MILLION // 1_000_000)))
    rows.repartition("cluster", salt).write.mode("append").partitionBy("cluster").parquet(f"{path}/lists")


def build(vectors: DataFrame, path: str, clusters: int = 64, key: str = "chunk_id", vector: str = "embedding", sample: int = 20_000) -> Index:
    """A new index at ``path`` (a folder that is not there) over all rows."""
    spark = vectors.sparkSession
    there = vectors.filter(F.col(vector).isNotNull())
    count = there.count()
    centres = fit_clusters(there, clusters, sample, vector=vector) if count else np.zeros((1, 1))
    scale = 2.0 / 127  # components of unit vectors, less those of a centre, are within -2 and 2
    spark.createDataFrame([(i, c.tolist(), key, there.schema[key].dataType.simpleString(), scale) for i, c in enumerate(centres)], "cluster int, centre array<double>, key string, kind string, scale double").coalesce(1).write.mode("error").parquet(f"{path}/centres")
    _write(_assigned(there, key, vector, centres, scale), path, count)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    rows = spark.read.schema("cluster int, centre array<double>, key string, kind string, scale double").parquet(f"{path}/centres").orderBy("cluster").collect()  # as many as there are clusters
    return Index(spark, path, rows[0]["key"], rows[0]["kind"], np.array([r["centre"] for r in rows]), rows[0]["scale"])


def add(index: Index, rows: DataFrame, vector: str = "embedding") -> int:
    """Puts rows whose key the index does not have into their lists; how many they were.  Adding the same rows again adds none."""
    fresh = rows.filter(F.col(vector).isNotNull()).join(index.lists().select(index.key), index.key, "left_anti").dropDuplicates([index.key])
    count = fresh.count()
    if count:
        _write(_assigned(fresh, index.key, vector, index.centres, index.scale), index.path, count)
    return count


def search(index: Index, query, k: int = 5, probes: int = 8, shortlist: int = 10) -> DataFrame:
    """(key, similarity) of the k nearest rows of the probed lists."""
    if k < 1 or probes < 1 or shortlist < 1:
        raise ValueError("k, probes and shortlist must be at least 1")
    q = np.asarray(query, np.float64)
    size = np.linalg.norm(q)
    q = q / size if size else q
    near, base, scale, key = index.near(q, probes), index.centres @ q, index.scale, index.key

    def coarse(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(base[batch.column(2).to_numpy()] + scale * (code @ q))], names=[key, "cluster", "rough"])

    probed = index.lists().filter(F.col("cluster").isin(near))
    rough = probed.select(key, "code", "cluster").mapInArrow(coarse, f"{key} {index.kind}, cluster int, rough double")
    picked = rough.orderBy(F.desc("rough"), key).limit(k * shortlist).select(key, "cluster")  # k * shortlist rows: a bounded broadcast
    exact = probed.join(F.broadcast(picked), [key, "cluster"]).select(key, cosine(F.col("embedding"), literal(q)).alias("similarity"))
    return exact.orderBy(F.desc_nulls_last("similarity"), key).limit(k)


def search_many(index: Index, queries: DataFrame, k: int = 5, probes: int = 8, query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, key, similarity, rank) for a table of queries of any size: blocks of queries meet the rows of the lists they probe."""
    centres, key = index.centres, index.key
    qkind = queries.schema[query_key].dataType.simpleString()

    def probe(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(x)), near.shape[1])
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array([v.tobytes() for v in x[row]], pa.binary()), pa.array(near.ravel().astype(np.int32))], names=[query_key, "q", "cluster"])

    asked = queries.filter(F.col(vector).isNotNull()).select(query_key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(probe, f"{query_key} {qkind}, q binary, cluster int")
    # queries of one list in blocks by their key, so that a block and some rows are multiplied at a time
    parts = max(1, -(-queries.count() // BLOCK))
    grouped = asked.groupBy("cluster", F.pmod(F.xxhash64(query_key), F.lit(parts)).alias("block")).agg(F.collect_list(F.struct(query_key, "q")).alias("qs"))  # about BLOCK queries at most
    blocks = grouped.select("cluster", "qs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def packed(batches):
        for batch in batches:
            of = batch.column(2).to_numpy()
            order = np.argsort(of, kind="stable")
            x = _matrix(batch.column(1))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            cuts = np.flatnonzero(np.diff(of[order])) + 1
            for part in np.split(order, cuts) if len(order) else ():
                for lo in range(0, len(part), ROWS):
                    at = part[lo : lo + ROWS]
                    yield pa.record_batch([pa.array(of[at[:1]]), pa.array([batch.column(0).take(pa.array(at)).to_pylist()], pa.list_(batch.column(0).type)), pa.array([x[at].tobytes()], pa.binary())], names=["cluster", "keys", "m"])

    rows = index.lists().select(key, "embedding", "cluster").mapInArrow(packed, f"cluster int, keys array<{index.kind}>, m binary")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(SALTS)).cast("int"))  # a hot list is no single task

    def best(batches):
        for batch in batches:
            for keys, m, qs in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                names = keys.values.to_numpy(zero_copy_only=False)
                x = np.frombuffer(m.as_py(), np.float64).reshape(len(names), -1)
                ids, q = qs.values.field(0), np.frombuffer(b"".join(qs.values.field(1).to_pylist()), np.float64).reshape(len(qs), -1)
                s = q @ x.T
                order = np.lexsort((np.broadcast_to(names, s.shape), -s), axis=1)[:, :k]
                row = np.repeat(np.arange(len(q)), order.shape[1])
                yield pa.record_batch([ids.take(pa.array(row)), pa.array(names[order.ravel()]), pa.array(np.take_along_axis(s, order, 1).ravel())], names=[query_key, key, "similarity"])

    met = rows.join(blocks, ["cluster", "salt"]).select("keys", "m", "qs").mapInArrow(best, f"{query_key} {qkind}, {key} {index.kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), key))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, query_key: str = "query_id", key: str = "vec_id") -> float:
    """The share of the exact answers that were found."""
    both = exact.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("hit")), [query_key, key], "left")
    return float(both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0])
