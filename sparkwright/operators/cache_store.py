"""Extraction results in buckets of their key: asked for, and added to, without shuffling what is stored.

The table stands at an explicit path, in buckets of ``cache_key``.  A run deals its chunks to
the buckets once; from there on, which of them are unknown, what is added and what every chunk's result
is are joins by bucket.  Adding takes keys that are not there, one row each, so a job that
is run again leaves the table as it is.  One job at a time may add.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..ontology import Ontology
from ..plans.scratch import Scratch
from . import extraction

BUCKETS = 64
COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.CACHE)


class CacheStore:
    """The table at ``path``; the name that the session knows it by is this object's own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets, self.name = spark, path.rstrip("/"), buckets, f"cache_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({COLUMNS}) USING parquet CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def close(self) -> None:
        """Forgets the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        """One row a key."""
        return self.spark.table(self.name)

    def dealt(self, keyed: DataFrame) -> DataFrame:
        return keyed.repartition(self.buckets, "cache_key")

    def unknown(self, dealt: DataFrame) -> DataFrame:
        """Dealt rows whose key is not stored."""
        return dealt.join(self.rows().select("cache_key"), "cache_key", "left_anti")

    def add(self, results: DataFrame) -> None:
        """Stores results whose key is not there yet; of equal keys one."""
        rows = self.unknown(self.dealt(results.select(schemas.CACHE.names))).dropDuplicates(["cache_key"])
        rows.sortWithinPartitions("cache_key").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def extract(self, chunks: DataFrame, extract: Callable[[str, str, int, str], str], model: str = "rules", ontology: Ontology | None = None, workers: int = 1) -> tuple[DataFrame, DataFrame]:
        """Results and rejects as :func:`extraction.extract_all` has them; what is unknown is asked once, stored, and read from the store with all else.

        Rejects are not stored: the next run asks them again."""
        keyed = self.dealt(extraction.with_keys(chunks, model))
        unknown = self.unknown(keyed).dropDuplicates(["cache_key"]).drop("cache_key")
        made, rejects = extraction.extract_all(unknown, extract, None, model, ontology, workers)
        # what was new to this run is settled before the store grows
        new = Scratch(self.spark, "cache").keep(made.select("chunk_id", *schemas.CACHE.names), "new")
        self.add(new)
        fresh = new.select("cache_key", F.lit(False).alias("_known"))
        told = keyed.select("chunk_id", "cache_key").join(self.rows(), "cache_key").join(fresh, "cache_key", "left")
        return told.select("chunk_id", "cache_key", "result", "input_tokens", "output_tokens", F.coalesce("_known", F.lit(True)).alias("from_cache")), rejects
