"""Statements from graph rows, evidence with citations, answers that cite only what was retrieved."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ontology import Ontology

NO_EVIDENCE = "(no evidence retrieved)"
NO_ANSWER = "No grounded answer could be produced from the retrieved evidence."


def one_hop_statements(rows: DataFrame, entity: Column, ontology: Ontology) -> DataFrame:
    """ "A verb B." in the edge's direction, with the name as it was asked."""
    verb = ontology.verb(F.col("relationship_type"))
    subject, thing = F.when(F.col("outgoing"), entity).otherwise(F.col("neighbor")), F.when(F.col("outgoing"), F.col("neighbor")).otherwise(entity)
    return rows.select(F.concat(subject, F.lit(" "), verb, F.lit(" "), thing, F.lit(".")).alias("text"), "source_chunk_ids")


def two_hop_statements(rows: DataFrame, entity: Column, first: str, second: str, ontology: Ontology) -> DataFrame:
    v1, v2 = ontology.verb(F.lit(first)), ontology.verb(F.lit(second))
    return rows.select(F.concat(entity, F.lit(" "), v1, F.lit(" "), F.col("via"), F.lit(", and "), F.col("via"), F.lit(" "), v2, F.lit(" "), F.col("result"), F.lit(".")).alias("text"), "source_chunk_ids")


def path_statements(rows: DataFrame, ontology: Ontology) -> DataFrame:
    """Hops joined by "; then ", chunks in hop order."""
    clause = F.transform("relationship_path", lambda t, i: F.concat(F.get("node_path", i), F.lit(" "), ontology.verb(t), F.lit(" "), F.get("node_path", i + 1)))
    return rows.select(F.concat(F.array_join(clause, "; then "), F.lit(".")).alias("text"), F.flatten("source_chunk_ids_per_hop").alias("source_chunk_ids"))


def count_statements(rows: DataFrame, entity: Column, rel_type: str, ontology: Ontology) -> DataFrame:
    text = F.concat(entity, F.lit(" "), ontology.verb(F.lit(rel_type)), F.lit(" "), F.col("count").cast("string"), F.lit(" entities ("), F.array_join("neighbors", ", "), F.lit(")."))
    return rows.select(text.alias("text"), F.expr("cast(array() as array<string>)").alias("source_chunk_ids"))


def statements(plan, rows: DataFrame, ontology: Ontology | None = None) -> DataFrame:
    """(text, source_chunk_ids) of a plan's rows."""
    ontology, name = ontology or Ontology(), F.lit(plan.entity_names[0])
    match plan.query_type:
        case "one_hop":
            return one_hop_statements(rows, name, ontology)
        case "two_hop_chain":
            return two_hop_statements(rows, name, plan.relationship_type, plan.second_relationship_type, ontology)
        case "path_between":
            return path_statements(rows, ontology)
        case "aggregate_count":
            return count_statements(rows, name, plan.relationship_type, ontology)
    raise ValueError(f"no query type {plan.query_type!r}")


def reference(ids: Column, pos: Column) -> Column:
    """What cites a statement: its first chunk, or its place among the facts."""
    return F.coalesce(F.get(ids, F.lit(0)), F.concat(F.lit("graph_fact_"), pos.cast("string")))


def evidence(stated: DataFrame, passages: DataFrame) -> DataFrame:
    """(kind, pos, ref, line) from statements (pos, text, source_chunk_ids) and passages (pos, chunk_id, section_path, company, text)."""
    facts = stated.withColumn("ref", reference(F.col("source_chunk_ids"), F.col("pos"))).select(F.lit(0).alias("kind"), "pos", "ref", F.concat(F.lit("["), F.col("ref"), F.lit("] "), F.col("text")).alias("line"))
    found = passages.select(F.lit(1).alias("kind"), "pos", F.col("chunk_id").alias("ref"), F.concat(F.lit("["), F.col("chunk_id"), F.lit("] ("), F.coalesce("section_path", F.lit("None")), F.lit(", "), F.coalesce("company", F.lit("None")), F.lit(") "), F.col("text")).alias("line"))
    return facts.unionByName(found)


def retrieved_ids(shown: DataFrame) -> DataFrame:
    return shown.select(F.col("ref").alias("chunk_id")).distinct()


def context(shown: DataFrame) -> DataFrame:
    """One row: the evidence as text, facts first, each part under its heading."""
    listed = F.array_sort(F.collect_list(F.struct("kind", "pos", "line")))
    one = shown.agg(listed.alias("all"))
    lines = lambda k: F.transform(F.filter("all", lambda x: x["kind"] == k), lambda x: x["line"])
    part = lambda k, head: F.when(F.size(lines(k)) > 0, F.concat(F.lit(head + "\n"), F.array_join(lines(k), "\n")))
    return one.select(F.when(F.size("all") == 0, NO_EVIDENCE).otherwise(F.concat_ws("\n", part(0, "=== GRAPH FACTS ==="), part(1, "\n=== VECTOR PASSAGES ==="))).alias("context"))


def split_claims(claims: DataFrame, retrieved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims that cite retrieved chunks, claims that do not)."""
    return claims.join(retrieved, "chunk_id", "left_semi"), claims.join(retrieved, "chunk_id", "left_anti")


def invalid_list(rejected: DataFrame) -> str:
    """The chunk ids that were cited without being retrieved, in order."""
    return rejected.agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), ", ")).first()[0]


def extractive(question: str, shown: list[tuple[str, str]], correction: str | None) -> tuple[list[tuple[str, str]], str | None]:
    """The offline answerer: a claim for each line of evidence."""
    return [(line.split("] ", 1)[1], ref) for ref, line in shown], None if shown else "The retrieved evidence does not answer the question."


def answer(shown: DataFrame, question: str = "", answerer: Callable | None = None) -> DataFrame:
    """One row (answer_text, claims, rejected_claims): claims that cite what was not retrieved are asked for once more, naming them, then dropped."""
    spark, answerer = shown.sparkSession, answerer or extractive
    lines = [(r["ref"], r["line"]) for r in shown.orderBy("kind", "pos").collect()]  # the evidence of one question
    correction, reason, accepted, rejected = None, None, [], []
    known = {ref for ref, _ in lines}
    for _ in range(2):
        claims, reason = answerer(question, lines, correction)
        accepted, rejected = [c for c in claims if c[1] in known], [c for c in claims if c[1] not in known]
        if not rejected:
            break
        correction = ", ".join(sorted({c[1] for c in rejected}))
    text = " ".join(t for t, _ in accepted) if accepted else reason or NO_ANSWER
    claim = "array<struct<text string, chunk_id string>>"
    return spark.createDataFrame([(text, accepted, rejected)], f"answer_text string, claims {claim}, rejected_claims {claim}")


def answer_text(accepted: DataFrame, key: str, order: str, reason: Column | None = None) -> DataFrame:
    """(key, answer_text) in batches: claims joined by spaces, else the reason, else the fixed sentence."""
    reason = F.lit(None).cast("string") if reason is None else reason
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    return accepted.groupBy(key).agg(joined.alias("_t"), F.max(reason).alias("_r")).select(key, F.coalesce(F.nullif("_t", F.lit("")), F.nullif("_r", F.lit("")), F.lit(NO_ANSWER)).alias("answer_text"))
