"""Edges beside their evidence: a narrow table of edges, a long one of (edge, chunk), both in buckets of the edge.

No row grows with an edge's evidence: a chunk that supports an edge is a row of its own,
and lists are only made by who reads them.  Merging appends what is not there yet, so a
claim that comes again adds nothing.  Both tables are written in buckets of ``edge_id`` at
explicit paths; a merge shuffles the new claims alone, and reading an edge with its evidence shuffles nothing.

A claim raises an edge's confidence if it is higher; of one chunk's claims for an edge each
different confidence is kept once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph_build import EDGE_KEY

BUCKETS = 64
#: Claims of a bucket, where the number of buckets follows the claims.
BUCKET_CLAIMS = 1 << 20
EDGES = "edge_id BIGINT, src_type STRING, src STRING, rel_type STRING, dst_type STRING, dst STRING"
EVIDENCE = "edge_id BIGINT, chunk_id STRING, confidence DOUBLE"


def buckets_for(claims: int, least: int = 8) -> int:
    """So many buckets that no task's bucket grows with the claims."""
    return max(least, -(-claims // BUCKET_CLAIMS))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for as long as something runs; then what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class EvidenceStore:
    """The two tables under ``path``; the names that the session knows them by are this object's own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.names = {kind: f"{kind}_{uuid.uuid4().hex}" for kind in ("edges", "evidence")}
        for kind, columns in (("edges", EDGES), ("evidence", EVIDENCE)):
            spark.sql(f"CREATE TABLE {self.names[kind]} ({columns}) USING parquet CLUSTERED BY (edge_id) SORTED BY (edge_id) INTO {buckets} BUCKETS LOCATION '{self.path}/{kind}'")

    def close(self) -> None:
        """Forgets the names; the files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def edges(self) -> DataFrame:
        return self.spark.table(self.names["edges"])

    def evidence(self) -> DataFrame:
        """(edge_id, chunk_id, confidence): the long form, for edges with any number of chunks."""
        return self.spark.table(self.names["evidence"])

    def merge(self, claims: DataFrame) -> None:
        """Adds claims (the edge's key with relationship_type or rel_type, source_chunk_id, confidence) that are not there."""
        if "rel_type" not in claims.columns:
            claims = claims.withColumnRenamed("relationship_type", "rel_type")
        new = claims.select(F.xxhash64(*EDGE_KEY).alias("edge_id"), *EDGE_KEY, F.col("source_chunk_id").alias("chunk_id"), "confidence")
        # the stored side is in buckets of the edge alone, and may stay so though more than the edge is compared
        with setting(self.spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
            self._append("evidence", self.unseen(new))
            self._append("edges", self._dealt(new.select("edge_id", *EDGE_KEY)).distinct().join(self.edges().select("edge_id"), "edge_id", "left_anti"))

    def unseen(self, new: DataFrame) -> DataFrame:
        rows = self._dealt(new.select("edge_id", "chunk_id", "confidence").distinct())
        return rows.join(self.evidence(), ["edge_id", "chunk_id", "confidence"], "left_anti")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows in the tables' buckets: the join and the write after it keep to them."""
        return rows.repartition(self.buckets, "edge_id")

    def _append(self, kind: str, rows: DataFrame) -> None:
        # rows come dealt: a bucket's new rows are one file
        rows.sortWithinPartitions("edge_id").write.insertInto(self.names[kind])
        self.spark.catalog.refreshTable(self.names[kind])

    def strengths(self) -> DataFrame:
        """(edge_id and its key, chunks, confidence): how many chunks support each edge and the highest confidence; no lists."""
        sums = self.evidence().groupBy("edge_id").agg(F.count_distinct("chunk_id").alias("chunks"), F.max("confidence").alias("confidence"))
        return self.edges().join(sums, "edge_id")

    def view(self, most: int | None = None) -> DataFrame:
        """Edges in the form of the graph templates, lists made as they are read; with ``most`` the first so many chunks of each by id."""
        ids = F.array_sort(F.collect_set("chunk_id"))
        lists = self.evidence().groupBy("edge_id").agg((ids if most is None else F.slice(ids, 1, most)).alias("source_chunk_ids"), F.max("confidence").alias("confidence"))
        return self.edges().join(lists, "edge_id").select(*EDGE_KEY, "source_chunk_ids", "confidence")

    def of(self, edge_ids: DataFrame) -> DataFrame:
        """The evidence of some edges, a row for each chunk."""
        return self.evidence().join(edge_ids.select("edge_id").distinct(), "edge_id").groupBy("edge_id", "chunk_id").agg(F.max("confidence").alias("confidence"))
