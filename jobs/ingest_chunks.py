"""Takes documents that have landed since the last run into the chunk table.

    python -m jobs.ingest_chunks --documents DIR --out DIR --checkpoint DIR [--config FILE]

A file stream with availableNow: the checkpoint knows which files were taken, so a run reads
only new ones and then ends.  Of a document that lands again, only a changed text is taken:
the ledger has each text's hash, and a document's chunks are those of its last version.

Output under ``out``, Parquet:

* ``chunks``, a folder for each batch and language: chunk_id, document_id, chunk_index, section_path, text, content_hash, tokens;
* ``ledger``, a folder for each batch: document_id, content_hash, chunks (0 where a text has none).

A batch overwrites its own folders and reads only the ledger of batches before it, so a batch
that was ended midway and comes again leaves the same files.  :func:`current` reads the table as it stands.
Checkpoint and output belong together: with a new checkpoint goes a new output.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions import text as X
from sparkwright.operators import chunking
from sparkwright.shipping import ship

log = logging.getLogger("jobs.ingest_chunks")
CONFIG = Path(__file__).with_suffix(".json")
LANDED = "doc_id long, text string, lang string, source string, n_chars long"
CHUNKS = "chunk_id string, document_id string, chunk_index int, section_path string, text string, content_hash string, tokens int, batch long, lang string"
LEDGER = "document_id string, content_hash string, chunks long, batch long"


def load(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def _table(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """A table of the output; empty before the first batch."""
    try:
        return spark.read.schema(shape).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], shape)


def _latest(ledger: DataFrame) -> DataFrame:
    """(document_id, batch, content_hash) of each document's last version."""
    return ledger.groupBy("document_id").agg(F.max("batch").alias("batch"), F.max_by("content_hash", "batch").alias("content_hash"))


def fresh(landed: DataFrame, ledger: DataFrame) -> DataFrame:
    """(document_id, text, lang, source, content_hash): one row for each document whose text is new; of one id's rows in a batch that of the newest file."""
    rows = landed.filter("doc_id is not null").select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.col("_metadata.file_modification_time").alias("_at"))
    rows = rows.withColumn("content_hash", X.content_hash(F.col("text")))
    newest = Window.partitionBy("document_id").orderBy(F.desc("_at"), "content_hash")
    rows = rows.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r", "_at")
    return rows.join(_latest(ledger).select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")


def chunked(docs: DataFrame, target: int, overlap: int) -> DataFrame:
    """Chunks of documents whose lines are their sections."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("section_path"), x.alias("text")))
    told = F.create_map(F.lit("company"), "source", F.lit("ticker"), "lang")
    rows = docs.select("document_id", told.alias("metadata"), F.lit("text").alias("document_type"), F.lit(None).cast("date").alias("date"), lines.alias("sections"))
    made = chunking.chunk_documents(rows, target, overlap)
    return made.select("chunk_id", "document_id", "chunk_index", "section_path", "text", X.content_hash(F.col("text")).alias("content_hash"), F.size(chunking.tokens(F.col("text"))).alias("tokens"), F.try_element_at("metadata", F.lit("ticker")).alias("lang"))


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> list[dict]:
    """Takes all new files of ``documents`` (a folder, or one file), then ends; what each batch read and wrote."""
    config = load() | (config or {})
    told: list[dict] = []

    def write(frame: DataFrame, name: str, *by: str) -> None:
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/{name}")

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        read, written = Observation("read"), Observation("written")
        ledger = _table(session, f"{out}/ledger", LEDGER).filter(F.col("batch") < number)
        seen = batch.observe(read, F.count(F.lit(1)).alias("rows"))
        chunks = chunked(fresh(seen, ledger), config["chunk_tokens"], config["chunk_overlap"]).withColumn("batch", F.lit(number).cast("long"))
        write(chunks.observe(written, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")), "chunks", "batch", "lang")
        # how many chunks each new document has, from what was just written
        sizes = _table(session, f"{out}/chunks", CHUNKS).filter(F.col("batch") == number).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
        rows = fresh(batch, ledger).select("document_id", "content_hash").join(sizes, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))
        taken = Observation("taken")
        write(rows.withColumn("batch", F.lit(number).cast("long")).observe(taken, F.count(F.lit(1)).alias("rows")), "ledger", "batch")
        told.append({"batch": number, "documents_read": read.get["rows"], "documents_taken": taken.get["rows"], "chunks_written": written.get["rows"], "tokens_written": written.get["tokens"]})
        log.info("batch %d of %s: %s", number, documents, json.dumps(told[-1]))

    at = documents.rstrip("/")
    at = f"{at[:-1]}[{at[-1]}]"  # as a pattern, the path may be of a folder or of a single file
    landed = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(at).select("*", "_metadata")
    query = landed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not told:
        log.info("nothing new in %s", documents)
    return told


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each document's last version."""
    last = _latest(_table(spark, f"{out}/ledger", LEDGER)).select("document_id", "batch")
    return _table(spark, f"{out}/chunks", CHUNKS).join(last, ["document_id", "batch"])


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.ingest_chunks", description="Takes newly landed documents into the chunk table.")
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("ingest_chunks").getOrCreate()
    try:
        ship(spark)
        run(spark, given.documents, given.out, given.checkpoint, load(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
