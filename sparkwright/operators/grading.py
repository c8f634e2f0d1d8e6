"""Grading of answers against golden items, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correct(difficulty: Column, claims: Column, answer: Column, gold: Column) -> Column:
    """Out of scope: no claims.  Without gold names: at least one claim.  Else every group has some name in the answer, in any case."""
    every = F.forall(gold, lambda g: F.exists(g, lambda s: F.contains(F.lower(answer), F.lower(s))))
    return F.when(difficulty == "out_of_scope", claims == 0).when(gold.isNull() | (F.size(gold) == 0), claims > 0).otherwise(every)


def grade(items: DataFrame) -> DataFrame:
    """Items (difficulty, n_claims, answer_text, gold_entities) with ``correct``."""
    return items.withColumn("correct", correct(F.col("difficulty"), F.col("n_claims"), F.coalesce("answer_text", F.lit("")), F.col("gold_entities")))


def accuracy(outcomes: DataFrame, by: str = "difficulty") -> DataFrame:
    """Share of correct ones by group and in all (group null); null where there are none."""
    parts = [F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")]
    grouped = outcomes.groupBy(by).agg(*parts)
    total = outcomes.agg(*parts).select(F.lit(None).cast(outcomes.schema[by].dataType).alias(by), "accuracy", "n")
    return grouped.unionByName(total)


def mean_latency(outcomes: DataFrame) -> DataFrame:
    """One row; 0.0 where there are none."""
    return outcomes.agg(F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"))


def report(systems: dict[str, DataFrame], gold: DataFrame) -> DataFrame:
    """Accuracy by difficulty and mean latency of each system, beside each other."""
    out = None
    for name, outcomes in systems.items():
        joined = outcomes.join(gold.select(F.col("id").alias("question_id"), "difficulty"), "question_id")
        part = accuracy(joined).join(F.broadcast(mean_latency(joined))).select(F.lit(name).alias("system"), "*")
        out = part if out is None else out.unionByName(part)
    return out
