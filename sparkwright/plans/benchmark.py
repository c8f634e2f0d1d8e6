"""Runs a question set through the engine, hybrid and by vectors alone, and reports on both."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import grading
from ..sources import tables
from .engine import Engine


def run(engine: Engine, items: DataFrame, vector_only: bool = False, vector_k: int = 5) -> DataFrame:
    """Outcomes of all items (id, question, difficulty, gold_entities): each question is asked by itself, one after another, and timed.

    The items are a stated set of questions; they come to the driver, where questions are asked."""
    spark, rows = engine.spark, []
    for item in items.select("id", "question", "difficulty", "gold_entities").orderBy("id").collect():
        began = time.perf_counter()
        got = engine.ask(item["question"], vector_k, vector_only).first()
        rows.append((item["id"], item["difficulty"], item["gold_entities"], len(got["claims"]), got["answer_text"], got["route"], 1000 * (time.perf_counter() - began), got["graph_evidence_count"], got["vector_evidence_count"]))
    shape = "question_id string, difficulty string, gold_entities array<array<string>>, n_claims int, answer_text string, route string, latency_ms double, graph_evidence_count int, vector_evidence_count int"
    graded = grading.grade(spark.createDataFrame(rows, shape))
    return graded.select(*[F.col(c) for c in schemas.OUTCOME.names])


def compare(engine: Engine, gold: DataFrame, asked: DataFrame, path: str | None = None, vector_k: int = 5) -> DataFrame:
    """(system, difficulty or null, accuracy, n, avg_latency_ms) of the hybrid engine and of vectors alone; also written to ``path``."""
    items = tables.benchmark_items(gold, asked)
    report = grading.report({"hybrid": run(engine, items, False, vector_k), "vector_only": run(engine, items, True, vector_k)}, gold)
    if path:
        tables.write_report(report, path)
    return report
