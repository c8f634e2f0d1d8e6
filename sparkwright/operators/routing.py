"""Routing of questions: a rule table (or any classifier), the low-confidence override, the branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ontology import Ontology
from .name_finder import find_names

#: The routes, and the confidence below which a single one becomes both.
ROUTES = ("GRAPH", "VECTOR", "BOTH")
LOW_CONFIDENCE = 0.6


def override(rows: DataFrame, least: float = LOW_CONFIDENCE) -> DataFrame:
    """Below the confidence a single route becomes BOTH, and is flagged."""
    low = (F.col("confidence") < least) & (F.col("route") != "BOTH")
    return rows.withColumn("overridden", F.coalesce(low, F.lit(False))).withColumn("route", F.when(low, "BOTH").otherwise(F.col("route")))


def classify(questions: DataFrame, names: list[str], ontology: Ontology | None = None) -> DataFrame:
    """Questions with a route and plan fields by rules: known names in the order they stand in, a verb's type, words that ask for counts, paths and chains."""
    q = F.lower("question")
    placed = F.array(*[F.struct(F.instr(q, n.lower()).alias("at"), F.lit(n).alias("name")) for n in names]) if names else F.expr("cast(array() as array<struct<at:int,name:string>>)")
    entities = F.transform(F.array_sort(F.filter(placed, lambda x: x["at"] > 0)), lambda x: x["name"])
    said = q  # a verb within a name says nothing
    for n in sorted(names, key=len, reverse=True):
        said = F.replace(said, F.lit(n.lower()), F.lit(" "))
    return _decided(questions.withColumn("entity_names", entities), said, ontology or Ontology())


def classify_set(questions: DataFrame, names: DataFrame, key: str = "question_id", ontology: Ontology | None = None) -> DataFrame:
    """The same for a table of questions and a table of names of any size: names are found by automata, and no plan grows with them."""
    found = find_names(questions, names, key, "question").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("_found"))
    rows = questions.join(found, key, "left").withColumn("entity_names", F.coalesce(F.transform("_found", lambda x: x["name"]), F.expr("cast(array() as array<string>)"))).drop("_found")
    longest = F.array_sort("entity_names", lambda a, b: F.length(b) - F.length(a))
    said = F.aggregate(longest, F.lower("question"), lambda text, n: F.replace(text, F.lower(n), F.lit(" ")))
    return _decided(rows, said, ontology or Ontology())


def _decided(questions: DataFrame, said: Column, ontology: Ontology) -> DataFrame:
    """Questions with ``entity_names`` by the rules; ``said`` is what they say beside the names."""
    q = F.lower("question")
    verbs = F.array(*[F.struct(F.instr(said, stem(v)).alias("at"), F.lit(r).alias("type")) for r, _, _, v in ontology.relationships])
    types = F.transform(F.array_sort(F.filter(verbs, lambda x: x["at"] > 0)), lambda x: x["type"])
    out = questions.withColumn("_types", types)
    n, first, second = F.size("entity_names"), F.get("_types", F.lit(0)), F.get("_types", F.lit(1))
    kind = (
        F.when((n >= 2) & q.rlike("connect|path|between|related"), "path_between")
        .when((n >= 1) & q.rlike("how many|number of|count") & first.isNotNull(), "aggregate_count")
        .when((n >= 1) & second.isNotNull(), "two_hop_chain")
        .when((n >= 1) & first.isNotNull(), "one_hop")
    )
    route = F.when(F.col("query_type").isNull(), "VECTOR").when(q.rlike("why|how does|describe|explain"), "BOTH").otherwise("GRAPH")
    out = out.withColumn("query_type", kind).withColumn("relationship_type", F.when(F.col("query_type") != "path_between", first)).withColumn("second_relationship_type", F.when(F.col("query_type") == "two_hop_chain", second))
    return out.withColumn("route", route).withColumn("confidence", F.when(F.col("query_type").isNull() & (n > 0), 0.5).otherwise(0.9)).withColumn("max_hops", F.lit(3)).drop("_types")


def stem(verb: str) -> str:
    """What of a verb also stands in a question: its main word without endings."""
    word = max(verb.lower().removeprefix("is a ").removeprefix("is an ").removeprefix("is ").split(), key=len)
    for end in ("ies", "es", "s", "ed"):
        if word.endswith(end) and len(word) - len(end) >= 4:
            return word[: -len(end)]
    return word


def graph_branch(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("route").isin("GRAPH", "BOTH") & F.col("query_type").isNotNull())


def vector_branch(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("route").isin("VECTOR", "BOTH"))


def valid_route(c: Column) -> Column:
    return c.isin(*ROUTES)
