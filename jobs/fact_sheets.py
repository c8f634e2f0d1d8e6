"""Builds the evidence graph and publishes a fact sheet for every entity: what is stated of it, with a citation.

    python -m jobs.fact_sheets --tables DIR --out DIR [--config FILE]

Reads lineitem, orders, supplier, customer and nation under ``tables``.  Output under ``out``, Parquet:

* ``edges``, a folder for each relationship type: the collapsed claims with all their chunks;
* ``sheets``, a folder for each relationship type: entity_type, entity, neighbor, text, cited (the first chunk), chunks (how many support it), confidence;
* ``summary``: for each entity and type how many different neighbours it has.

Every edge is told from both of its ends, for all entities in one pass.  Every run writes its output anew from the tables, so a run that
was ended midway is run again, and a second run leaves the same rows.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkwright import schemas
from sparkwright.ontology import Ontology
from sparkwright.operators import answers, graph_query
from sparkwright.plans.queries import collapsed, typed_claims
from sparkwright.shipping import ship
from sparkwright.sources import tables as T

log = logging.getLogger("jobs.fact_sheets")
CONFIG = Path(__file__).with_suffix(".json")
SHEET = "entity_type string, entity string, neighbor string, text string, cited string, chunks int, confidence double, relationship_type string"
#: Pairs of names up to which they are sent to the sheets instead of dealing the sheets out.
SENT = 10_000
SUMMARY = "entity_type string, entity string, relationship_type string, neighbors long, statements long"


def load(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def sheets(edges: DataFrame, ontology: Ontology) -> DataFrame:
    """A statement for each edge and end; a loop is told once."""
    told = graph_query.undirected(edges, ("confidence",))
    told = told.select(F.col("a_type").alias("entity_type"), F.col("a").alias("entity"), F.col("rel_type").alias("relationship_type"), F.col("b").alias("neighbor"), "outgoing", "source_chunk_ids", "confidence")
    verb, out = ontology.verb(F.col("relationship_type")), F.col("outgoing")
    text = F.concat(F.when(out, F.col("entity")).otherwise(F.col("neighbor")), F.lit(" "), verb, F.lit(" "), F.when(out, F.col("neighbor")).otherwise(F.col("entity")), F.lit("."))
    return told.select("entity_type", "entity", "neighbor", text.alias("text"), answers.reference(F.col("source_chunk_ids"), F.lit(0)).alias("cited"), F.size("source_chunk_ids").alias("chunks"), "confidence", "relationship_type")


def summarised(spark: SparkSession, out: str) -> DataFrame:
    """Neighbours and statements of each entity and type, from the edges and sheets that are written.

    A neighbour is told twice only where two names have several edges of a type.  These are found by a hash of
    the pair, and only their names are told apart; all other rows are counted as they are read."""
    def pair(rel_type: str, *names: str) -> Column:
        return F.xxhash64(rel_type, F.least(*names), F.greatest(*names)).alias("pair")

    again = T.edges(spark, f"{out}/edges").groupBy(pair("rel_type", "src", "dst")).count().filter("count > 1").select("pair")
    few = again.limit(SENT + 1).collect()
    if len(few) <= SENT:
        again = F.broadcast(spark.createDataFrame(few, "pair long"))
    rows = read(spark, out).select("entity_type", "entity", "relationship_type", "neighbor", pair("relationship_type", "entity", "neighbor"))
    rows = rows.join(again.withColumn("twice", F.lit(True)), "pair", "left")
    once, others = F.count(F.when(F.col("twice").isNull(), F.col("neighbor"))), F.count_distinct(F.when(F.col("twice"), F.col("neighbor")))
    return rows.groupBy("entity_type", "entity", "relationship_type").agg((once + others).alias("neighbors"), F.count(F.lit(1)).alias("statements"))


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> dict:
    """Writes edges, sheets and summary anew; what was read and written."""
    config, ontology = load() | (config or {}), Ontology()
    wanted = [ontology.check_type(t) for t in config["relationship_types"]]
    kept, stated = Observation("edges"), Observation("sheets")

    claims = typed_claims(spark, tables)
    asked = {types: rows for types, rows in claims.items() if types[1] in wanted}
    seen = {types: Observation(f"claims {types[1]}") for types in asked}
    edges = collapsed({types: rows.observe(seen[types], F.count(F.lit(1)).alias("rows")) for types, rows in asked.items()}) if asked else spark.createDataFrame([], schemas.EDGE)
    edges = edges.filter(F.col("confidence") >= config["least_confidence"])
    T.write_edges(edges.observe(kept, F.count(F.lit(1)).alias("rows")), f"{out}/edges")

    made = sheets(T.edges(spark, f"{out}/edges"), ontology).observe(stated, F.count(F.lit(1)).alias("rows"))
    with T.in_one_pass(spark):
        made.write.mode("overwrite").partitionBy("relationship_type").parquet(f"{out}/sheets")
    summarised(spark, out).write.mode("overwrite").parquet(f"{out}/summary")

    told = {"claims_read": sum(seen[t].get["rows"] if t in seen else rows.count() for t, rows in claims.items()), "edges_written": kept.get["rows"], "statements_written": stated.get["rows"]}
    log.info("%s to %s: %s", tables, out, json.dumps(told))
    return told


def read(spark: SparkSession, out: str) -> DataFrame:
    """The published sheets."""
    return spark.read.schema(SHEET).parquet(f"{out}/sheets")


def summary(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SUMMARY).parquet(f"{out}/summary")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.fact_sheets", description="Publishes a fact sheet for every entity of the graph.")
    for name in ("tables", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("fact_sheets").getOrCreate()
    try:
        ship(spark)
        run(spark, given.tables, given.out, load(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
