"""Scans and sinks of the engine's own tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def documents(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Normalised documents: JSON files of one document each, or (``kind`` parquet) what :func:`write_documents` wrote."""
    reader = spark.read.schema(schemas.DOCUMENT)
    return reader.parquet(path) if kind == "parquet" else reader.option("multiLine", True).json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Always anew: documents are derived."""
    docs.select(schemas.DOCUMENT.names).write.mode("overwrite").parquet(path)


def extraction_cache(spark: SparkSession, path: str) -> DataFrame:
    """One row a key: a job that was run again may have added a key twice, with the same result."""
    return spark.read.schema(schemas.CACHE).json(path).dropDuplicates(["cache_key"])


def add_to_cache(rows: DataFrame, path: str) -> None:
    """Appends; :func:`extraction_cache` reads each key once."""
    rows.select(schemas.CACHE.names).write.mode("append").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Extraction results (document_id, source_chunk_id, result), a folder for each document that is written; others stay."""
    results.select("document_id", "source_chunk_id", "result").repartition("document_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)


def results(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_results` wrote; ids stay text."""
    return spark.read.schema(f"source_chunk_id string, result {schemas.EXTRACTION.simpleString()}, document_id string").parquet(path)


def extracted(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, claims) of all results ``(source_chunk_id, result)``."""
    mentions = results.select("source_chunk_id", F.explode("result.entities").alias("e")).select("e.entity_type", "e.raw_name", F.lit(None).cast("string").alias("canonical_name"), "source_chunk_id", "e.confidence")
    claims = results.select("source_chunk_id", F.explode("result.relationships").alias("r")).select("r.relationship_type", "r.source_entity", "r.target_entity", "source_chunk_id", "r.confidence")
    return mentions, claims


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden items: a JSON object with ``items``."""
    return spark.read.schema(f"items array<{schemas.GOLDEN.simpleString()}>").option("multiLine", True).json(path).select(F.inline("items"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("items array<struct<id string, question string>>").option("multiLine", True).json(path).select(F.inline("items"))


def benchmark_items(gold: DataFrame, asked: DataFrame) -> DataFrame:
    """Golden items with their questions."""
    return gold.join(asked, "id")


def log_decisions(rows: DataFrame, path: str) -> None:
    """Appends routing decisions with their latency, one JSON line each."""
    rows.select(schemas.DECISION.names).write.mode("append").json(path)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """The log; what a job that was run again wrote twice is read once."""
    return spark.read.schema(schemas.DECISION).json(path).dropDuplicates(["asked_at", "question"])


def log_batch(rows: DataFrame, path: str, batch: str) -> None:
    """Decisions of a set of questions (question_id beside the decision's columns) in the folder of their batch.

    A batch that is logged again takes its own place, so a job that is run again logs nothing twice; other batches stay.
    A set's questions are decided together, so that no single one has a latency."""
    have = [F.col(c) if c in rows.columns else F.lit(None).cast(schemas.DECISION[c].dataType).alias(c) for c in schemas.DECISION.names]
    told = rows.select(F.col("question_id").cast("string").alias("question_id"), *have, F.lit(batch).alias("batch"))
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)


def logged_batches(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`log_batch` wrote; ids and batches stay text."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.DECISION)
    return spark.read.schema(f"question_id string, {columns}, batch string").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The vector table, clustered by document so that a filter on documents prunes."""
    vectors.sortWithinPartitions("document_id", "chunk_id").write.mode("overwrite").parquet(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VECTOR).parquet(path)


def write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.select(schemas.NODE.names).write.mode("overwrite").parquet(path)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes with their aliases; without any it is an empty list."""
    rows = spark.read.schema(schemas.NODE).parquet(path)
    return rows.withColumn("aliases", F.coalesce("aliases", F.expr("cast(array() as array<string>)")))


@contextmanager
def in_one_pass(spark: SparkSession) -> Iterator[None]:
    """While a table is written by type: runs of sorted rows are folded as they come, and the rows of the few types are not sorted for the writer."""
    wanted = {"spark.sql.execution.replaceHashWithSortAgg": "true", "spark.sql.maxConcurrentOutputFileWriters": "32"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges by type: a typed query reads one folder."""
    with in_one_pass(edges.sparkSession):
        edges.select(schemas.EDGE.names).write.mode("overwrite").partitionBy("rel_type").parquet(path)


def edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EDGE).parquet(path).select(schemas.EDGE.names)


def key_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty where the key is one."""
    return table.groupBy(*keys).count().filter("count > 1")
