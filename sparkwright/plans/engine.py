"""Questions answered over a graph and a vector table."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.vectors import QUERY_PREFIX, embed_text
from ..ontology import Ontology
from ..operators import answers, graph_plans, graph_query, routing, vector_search
from ..sources import tables


@dataclass
class Engine:
    """Nodes, edges and chunk vectors, with a classifier, an embedder and an answerer that can be exchanged.

    The answerer is shown at most ``facts_shown`` statements of a hub (by text); all are counted, and
    :meth:`graph_rows` has them all.  With ``log`` every decision is appended there with its latency.
    """

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    ontology: Ontology = Ontology()
    classify: Callable[[DataFrame], DataFrame] | None = None
    embed: Callable[[str], list[float]] | None = None
    answerer: Callable | None = None
    dim: int = 256
    facts_shown: int = 10_000
    log: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, warehouse: str, **rest) -> "Engine":
        """Over the tables of a warehouse, as the sinks write them."""
        at = warehouse.rstrip("/")
        return cls(spark, tables.nodes(spark, f"{at}/nodes"), tables.edges(spark, f"{at}/edges"), tables.vectors(spark, f"{at}/vectors"), **rest)

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    def route(self, question: str) -> dict:
        """The decision for a question, low confidence overridden; logged with the time it took."""
        began, asked_at = time.perf_counter(), datetime.now(timezone.utc)
        asked = self.spark.createDataFrame([(question,)], "question string")
        if self.classify is None:
            q = F.lower(F.lit(question))
            known = [r[0] for r in self.nodes.filter(F.contains(q, F.lower("canonical_name"))).select("canonical_name").distinct().orderBy(F.length("canonical_name").desc(), "canonical_name").collect()]  # names that stand in the question
            decided = routing.classify(asked, known, self.ontology)
        else:
            decided = self.classify(asked)
        decision = routing.override(decided).first().asDict()
        if self.log:
            row = decision | {"asked_at": asked_at, "question": question, "latency_ms": 1000 * (time.perf_counter() - began)}
            tables.log_decisions(self.spark.createDataFrame([tuple(row.get(c) for c in schemas.DECISION.names)], schemas.DECISION), self.log)
        return decision

    def graph_rows(self, decision: dict) -> tuple[graph_query.GraphPlan, DataFrame] | None:
        if decision["route"] not in ("GRAPH", "BOTH") or not decision.get("query_type"):
            return None
        names = tuple(decision["entity_names"] or ())
        if not names:
            return None
        plan = graph_query.GraphPlan(decision["query_type"], names, decision.get("relationship_type"), decision.get("second_relationship_type"), decision.get("max_hops"))
        return plan, graph_query.execute(self.nodes, self.edges, plan, self.ontology)

    def decide(self, questions: DataFrame, key: str = "question_id") -> DataFrame:
        """The decisions for a table of questions (key, question), low confidence overridden."""
        return routing.override(routing.classify_set(questions, self.nodes.select(F.col("canonical_name").alias("name")), key, self.ontology))

    def facts(self, questions: DataFrame, key: str = "question_id", batch: str | None = None) -> tuple[DataFrame, DataFrame]:
        """((plan_id, text, source_chunk_ids), decisions) for a table of questions (key, question) as one job: the facts that :meth:`ask` shows for each.

        With ``log`` and a ``batch`` the decisions are logged beside those of single questions and read back, so that they are made once."""
        decided = self.decide(questions, key)
        if self.log and batch is not None:
            at = f"{self.log}_sets"
            tables.log_batch(decided.withColumn("asked_at", F.lit(datetime.now(timezone.utc))).withColumn("question_id", F.col(key)), at, batch)
            logged = tables.logged_batches(self.spark, at).filter(F.col("batch") == batch)
            kind = questions.schema[key].dataType
            decided = logged.select(F.col("question_id").cast(kind).alias(key), *(c for c in decided.columns if c in schemas.DECISION.names))
        plans = routing.graph_branch(decided).filter(F.size("entity_names") > 0).withColumn("plan_id", F.col(key))
        return graph_plans.statements(self.nodes, self.edges, plans, self.ontology)[0], decided

    def passages(self, question: str, k: int) -> DataFrame:
        # the prefix tells a model what the text is for; to the offline embedder its words would be words of the question
        query = self.embed(QUERY_PREFIX + question) if self.embed else embed_text(question, self.dim)
        # what its places have in common by chance may be less than nothing, and leaves no passage out
        return vector_search.top_k(self.vectors, query, k, 0.0 if self.embed else -1.0)

    def ask(self, question: str, vector_k: int = 5, vector_only: bool = False) -> DataFrame:
        """One row: answer_text, route, overridden, claims, rejected_claims and how much evidence of either kind there was."""
        if vector_k < 1:
            raise ValueError("vector_k must be at least 1")
        decision = {"route": "VECTOR", "overridden": False} if vector_only else self.route(question)
        stated = self.spark.createDataFrame([], "pos int, text string, source_chunk_ids array<string>")
        facts = 0
        if found := self.graph_rows(decision):
            said = answers.statements(*found, self.ontology)
            rows = said.orderBy("text", F.to_json("source_chunk_ids")).limit(self.facts_shown).collect()
            facts = len(rows) if len(rows) < self.facts_shown else said.count()
            stated = self.spark.createDataFrame([(i, r["text"], r["source_chunk_ids"]) for i, r in enumerate(rows)], stated.schema)
        passages = self.spark.createDataFrame([], "pos int, chunk_id string, section_path string, company string, text string")
        near = 0
        if decision["route"] in ("VECTOR", "BOTH"):
            rows = self.passages(question, vector_k).select("chunk_id", "section_path", "company", "text", "similarity").collect()
            rows.sort(key=lambda r: (-r["similarity"], r["chunk_id"]))
            near = len(rows)
            passages = self.spark.createDataFrame([(i, r["chunk_id"], r["section_path"], r["company"], r["text"]) for i, r in enumerate(rows)], passages.schema)
        out = answers.answer(answers.evidence(stated, passages), question, self.answerer)
        return out.select("answer_text", F.lit(decision["route"]).alias("route"), F.lit(bool(decision.get("overridden"))).alias("overridden"), "claims", F.size("rejected_claims").alias("rejected_claim_count"), F.lit(facts).alias("graph_evidence_count"), F.lit(near).alias("vector_evidence_count"))
