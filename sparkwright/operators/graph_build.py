"""Nodes and edges: endpoint resolution, collapse of claims, idempotent merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_KEY = ["src_type", "src", "rel_type", "dst_type", "dst"]
_NO_IDS = F.expr


def endpoint_types(mentions: DataFrame) -> DataFrame:
    """(raw_name, entity_type): of several types the one of the last chunk."""
    return mentions.groupBy("raw_name").agg(F.max_by("entity_type", F.struct("source_chunk_id", "entity_type")).alias("entity_type"))


def resolve_endpoints(claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """Claims with src_type, src, dst_type, dst; null where an end is no known name."""
    typed = endpoint_types(mentions)
    known = mentions.select("entity_type", "raw_name", "canonical_name").distinct()
    ends = typed.join(known, ["raw_name", "entity_type"], "left").select("raw_name", "entity_type", "canonical_name")
    out = claims
    for end, name in (("src", "source_entity"), ("dst", "target_entity")):
        side = ends.select(F.col("raw_name").alias(name), F.col("entity_type").alias(f"{end}_type"), F.col("canonical_name").alias(end))
        out = out.join(side, name, "left")
    return out


def split_resolved(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims with both ends, claims without)."""
    ok = F.col("src").isNotNull() & F.col("dst").isNotNull()
    return claims.filter(ok), claims.filter(~ok)


def collapse_claims(claims: DataFrame) -> DataFrame:
    """One edge for each (source, type, target): its chunks, each once, and the highest confidence."""
    return claims.groupBy(*[F.col(k) if k != "rel_type" else F.col("relationship_type").alias("rel_type") for k in EDGE_KEY]).agg(F.array_sort(F.collect_set("source_chunk_id")).alias("source_chunk_ids"), F.max("confidence").alias("confidence"))


def collapse_typed(claims: DataFrame, src_type: str, rel_type: str, dst_type: str) -> DataFrame:
    """The edges of claims (src, dst, source_chunk_id, confidence) of one type.

    They are dealt and sorted by their ends' names alone; :func:`~sparkwright.sources.tables.in_one_pass` folds the runs as they come."""
    rows = claims.select("src", "dst", "source_chunk_id", "confidence").repartition("src", "dst").sortWithinPartitions("src", "dst")
    edges = rows.groupBy("src", "dst").agg(F.sort_array(F.collect_set("source_chunk_id")).alias("source_chunk_ids"), F.max("confidence").alias("confidence"))
    return edges.select(F.lit(src_type).alias("src_type"), "src", F.lit(rel_type).alias("rel_type"), F.lit(dst_type).alias("dst_type"), "dst", "source_chunk_ids", "confidence")


def merge_edges(existing: DataFrame, *batches: DataFrame) -> DataFrame:
    """Upsert: chunks are added where unseen, confidence is the higher one; merging again changes nothing.  All batches meet in one shuffle."""
    every = reduce(DataFrame.unionByName, [x.select(*EDGE_KEY, "source_chunk_ids", "confidence") for x in (existing, *batches)])
    return every.groupBy(*EDGE_KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunk_ids")))).alias("source_chunk_ids"), F.max("confidence").alias("confidence"))


def merge_nodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: known nodes keep their aliases in order and gain those they did not have, these by alphabet."""
    key = ["entity_type", "canonical_name"]
    none = F.expr("cast(array() as array<string>)")
    old = existing.groupBy(*key).agg(F.first("aliases").alias("_old"))
    fresh = new.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("_new"))
    return old.join(fresh, key, "full_outer").select(*key, F.array_union(F.coalesce("_old", none), F.coalesce("_new", none)).alias("aliases"))


def label_free_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are matched by name alone: a name under two labels gives every combination."""
    src = nodes.select(F.col("canonical_name").alias("src"), F.col("entity_type").alias("src_type"))
    dst = nodes.select(F.col("canonical_name").alias("dst"), F.col("entity_type").alias("dst_type"))
    return edges.drop("src_type", "dst_type").join(src, "src").join(dst, "dst")


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """A stable id from the edge's key."""
    return edges.withColumn("edge_id", F.xxhash64(*EDGE_KEY))


def merge_vectors(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by chunk_id: known chunks take the new values but keep document_id and created_at; others are added; none goes."""
    kept = {"document_id", "created_at"}
    old = existing.select("chunk_id", *[F.col(c).alias(f"_{c}") for c in existing.columns if c != "chunk_id"], F.lit(True).alias("_there"))
    both = old.join(new.withColumn("_fresh", F.lit(True)), "chunk_id", "full_outer")
    value = lambda c: F.when(F.col("_there") & (F.lit(c in kept) | F.col("_fresh").isNull()), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return both.select("chunk_id", *[value(c) for c in existing.columns if c != "chunk_id"])
