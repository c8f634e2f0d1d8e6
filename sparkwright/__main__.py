"""The steps from documents to answers as commands over the tables of one warehouse.

    python -m sparkwright --warehouse DIR extract --names NAMES.json
    python -m sparkwright --warehouse DIR graph
    python -m sparkwright --warehouse DIR embed
    python -m sparkwright --warehouse DIR ask "Who is regulated by the FTC?"

Settings not given come from the environment (``SPARKWRIGHT_...``).  Each command prints
one JSON line for each row of its report.  Every step writes its table anew from the step
before it, so a step that was ended midway is run again; chunks that the cache has are
not extracted again.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions.vectors import embedder
from .operators import chunking, extraction, graph_build, resolve
from .operators.cache_store import CacheStore
from .plans import benchmark
from .plans.engine import Engine
from .shipping import ship
from .sources import tables


def chunks(spark: SparkSession, s: Settings) -> DataFrame:
    return chunking.chunk_documents(tables.documents(spark, s.table("documents"), "parquet"), s.chunk_tokens, s.chunk_overlap)


def extract(spark: SparkSession, s: Settings, names: str) -> DataFrame:
    """Chunks through the rule extractor (``names`` is a JSON object name -> type) into the cache and the results, those without a good answer into the rejects; what it cost."""
    rules = extraction.rule_extractor(json.loads("\n".join(r[0] for r in spark.read.text(names).collect())))
    rows, store = chunks(spark, s), CacheStore(spark, s.table("cache"))
    try:
        made, rejects = store.extract(rows, rules, s.extractor)
        rejects.write.mode("overwrite").parquet(s.table("rejects"))  # asked again by the next run: they are not in the cache
        found = made.join(rows.select("chunk_id", "document_id"), "chunk_id")
        tables.write_results(found.withColumnRenamed("chunk_id", "source_chunk_id"), s.table("results"))
        return spark.createDataFrame(extraction.total_cost(store.rows()).collect(), "results long, input_tokens long, output_tokens long, cost double")
    finally:
        store.close()


def graph(spark: SparkSession, s: Settings) -> DataFrame:
    """Names resolved, nodes and edges of all results; claims written and skipped."""
    mentions, claims = tables.extracted(tables.results(spark, s.table("results")))
    told, registry = resolve.resolve_entities(mentions, s.similarity_threshold)
    tables.write_nodes(registry, s.table("nodes"))
    ends = graph_build.resolve_endpoints(claims, told)
    tables.write_edges(graph_build.collapse_claims(graph_build.split_resolved(ends)[0]), s.table("edges"))
    ok = F.col("src").isNotNull() & F.col("dst").isNotNull()
    return ends.agg(F.count_if(ok).alias("written"), F.count_if(~ok).alias("skipped"))


def embed(spark: SparkSession, s: Settings) -> DataFrame:
    """Chunks with their vectors; how many there are."""
    told = lambda key: F.try_element_at("metadata", F.lit(key))
    rows = chunks(spark, s).select("chunk_id", "document_id", "section_path", "text", told("company").alias("company"), told("ticker").alias("ticker"), told("document_type").alias("document_type"), F.to_date(told("date")).alias("filing_date"), embedder(s.embedding_dim)("text").alias("embedding"), F.current_timestamp().alias("created_at"))
    tables.write_vectors(rows, s.table("vectors"))
    return tables.vectors(spark, s.table("vectors")).agg(F.count(F.lit(1)).alias("chunks"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs one command; the lines it printed."""
    parser = argparse.ArgumentParser(prog="sparkwright")
    parser.add_argument("--warehouse", help="folder of the tables; documents are there first")
    steps = parser.add_subparsers(dest="step", required=True)
    steps.add_parser("extract", help="chunks to results").add_argument("--names", required=True)
    steps.add_parser("graph", help="results to nodes and edges")
    steps.add_parser("embed", help="chunks to vectors")
    for name, said in (("search", "the passages nearest to a question"), ("ask", "an answer with its citations")):
        step = steps.add_parser(name, help=said)
        step.add_argument("question")
        step.add_argument("-k", type=int, default=5)
        step.add_argument("--vector-only", action="store_true")
    step = steps.add_parser("benchmark", help="golden items asked of the graph and of vectors alone")
    step.add_argument("--golden", required=True)
    step.add_argument("--questions", required=True)
    step.add_argument("-k", type=int, default=5)
    given = parser.parse_args(argv)

    values = dict(os.environ) | ({"SPARKWRIGHT_WAREHOUSE": given.warehouse} if given.warehouse else {})
    s = Settings.load(values)
    spark = spark or SparkSession.builder.appName("sparkwright").getOrCreate()
    ship(spark)
    if given.step == "extract":
        out = extract(spark, s, given.names)
    elif given.step == "graph":
        out = graph(spark, s)
    elif given.step == "embed":
        out = embed(spark, s)
    else:
        engine = Engine.open(spark, s.warehouse, dim=s.embedding_dim, log=s.table("decisions"))
        if given.step == "search":
            out = engine.passages(given.question, given.k).select("chunk_id", "section_path", "company", "text", "similarity")
        elif given.step == "ask":
            out = engine.ask(given.question, given.k, given.vector_only)
        else:
            out = benchmark.compare(engine, tables.golden(spark, given.golden), tables.questions(spark, given.questions), s.table("report"), given.k)
    lines = [r[0] for r in out.select(F.to_json(F.struct("*"))).collect()]  # a report: few rows at any scale
    for line in lines:
        print(line)
    return lines


if __name__ == "__main__":
    main()
