"""Field checks, with what fails set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_hash


def in_unit(x: Column) -> Column:
    return F.coalesce(x.between(0.0, 1.0), F.lit(False))


def split_valid(rows: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that do not; null is no pass)."""
    ok = F.coalesce(ok, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def valid_document(c: str = "content_hash") -> Column:
    required = [F.col(x).isNotNull() for x in ("document_id", "source", "document_type", "title", "date", "sections", "text", "source_uri")]
    out = is_hash(F.col(c))
    for x in required:
        out = out & x
    return out


def valid_chunk() -> Column:
    """A chunk has its ids and text, and its index counts from 0."""
    return F.col("chunk_id").isNotNull() & F.col("document_id").isNotNull() & F.col("text").isNotNull() & (F.col("chunk_index") >= 0)


def normalised_documents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with lower-case hashes, rejected rows): the one gate to the corpus."""
    good, bad = split_valid(rows, valid_document())
    return good.withColumn("content_hash", F.lower("content_hash")), bad


def drop_dangling(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships whose two ends are entity names of the same chunk, letter by letter."""
    names = entities.select("source_chunk_id", F.col("raw_name").alias("_name"))  # names that repeat match once in a semi-join: no table of them is held
    for end in ("source_entity", "target_entity"):
        relationships = relationships.join(names.withColumnRenamed("_name", end), ["source_chunk_id", end], "left_semi")
    return relationships
