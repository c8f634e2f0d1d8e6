"""The stateless chain on streams, and idempotent merges of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.chunking import OVERLAP, TARGET, tokens, windows
from ..operators.evidence_store import BUCKETS, EvidenceStore
from ..operators.graph_build import collapse_claims, merge_edges
from ..plans.scratch import Scratch


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """Documents that land as JSON files."""
    return spark.readStream.schema(schemas.DOCUMENT).option("multiLine", True).json(path)


def piece_stream(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Windows of streamed sections: (document_id, section_pos, window_pos, section_path, piece), no state."""
    rows = docs.select("document_id", F.posexplode("sections").alias("section_pos", "s")).select("document_id", "section_pos", "s.section_path", tokens(F.col("s.text")).alias("tokens"))
    return windows(rows, "tokens", target, overlap).drop("tokens")


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by time window and type; what comes later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _pointers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that are whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointers")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit())


def _folders(spark: SparkSession, path: str, version: int) -> dict[str, str]:
    """Where a version has the edges of each type."""
    return {r["rel_type"]: r["folder"] for r in spark.read.schema("rel_type string, folder string").json(f"{path}/pointers/{version}").collect()}  # a row for each type


def current_edges(spark: SparkSession, path: str) -> DataFrame:
    """The edge table as the last whole version has it; empty before the first."""
    versions = _pointers(spark, path)
    folders = _folders(spark, path, versions[-1]) if versions else {}
    if not folders:
        return spark.createDataFrame([], schemas.EDGE)
    return spark.read.schema(schemas.EDGE).parquet(*[f"{path}/{f}" for f in folders.values()])


def merge_claims(claims: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the edge table at ``path`` up to date (read it by :func:`current_edges`): a batch that is replayed changes nothing.

    A batch writes new files for the relationship types that it has, then a pointer file that
    names each type's folder; the version before stays whole until then and for one batch more.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = [v for v in _pointers(spark, path) if v < number]  # a replay starts from the version before it
        folders = _folders(spark, path, versions[-1]) if versions else {}
        scratch = Scratch(spark, "stream")
        new = scratch.keep(collapse_claims(batch), "new")
        for (kind,) in new.select("rel_type").distinct().collect():  # types of the ontology
            mine = new.filter(F.col("rel_type") == kind)
            merged = merge_edges(spark.read.schema(schemas.EDGE).parquet(f"{path}/{folders[kind]}"), mine) if kind in folders else mine
            folders[kind] = f"versions/{number}/{kind}"
            merged.write.mode("overwrite").parquet(f"{path}/{folders[kind]}")
        named = spark.createDataFrame(sorted(folders.items()), "rel_type string, folder string")
        staged = f"{path}/staged/{number}"
        named.coalesce(1).write.mode("overwrite").json(staged)
        make = spark._jvm.org.apache.hadoop.fs.Path
        files = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(make(f"{path}/pointers"))
        files.delete(make(f"{path}/pointers/{number}"), True)
        files.rename(make(staged), make(f"{path}/pointers/{number}"))
        for old in versions[:-1]:  # what neither this version nor the one before it names
            used = set(folders.values()) | set(_folders(spark, path, versions[-1]).values())
            for folder in set(_folders(spark, path, old).values()) - used:
                files.delete(make(f"{path}/{folder}"), True)
            files.delete(make(f"{path}/pointers/{old}"), True)
        scratch.clear()

    return claims.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def merge_evidence(claims: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """Keeps edges and their evidence at ``path`` up to date (read them by :class:`EvidenceStore`): a batch appends what is not there and rewrites nothing.

    A batch that is replayed, or was ended between its two tables, adds what is missing: evidence comes first, and
    edges are looked for on their own."""

    def merge(batch: DataFrame, number: int) -> None:
        scratch, store = Scratch(batch.sparkSession, "stream"), EvidenceStore(batch.sparkSession, path, buckets)  # a batch has a session of its own
        try:
            store.merge(scratch.keep(batch, "new"))  # read once for both tables
        finally:
            store.close()
            scratch.clear()

    return claims.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def for_each(stream: DataFrame, work: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Any batch operator of the library over what is there now."""
    return stream.writeStream.foreachBatch(lambda b, _: work(b)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
