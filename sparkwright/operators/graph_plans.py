"""The graph templates for a whole set of plans at once: every row carries the id of its plan.

A plan is a row (plan_id, query_type, entity_names, relationship_type,
second_relationship_type, max_hops).  Plans are a table like any other: they are never
collected, and one job answers all of them with the rows that the single forms in
:mod:`graph_query` give one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ontology import Ontology
from ..plans.scratch import Scratch
from . import graph_query
from .resolve import look_up

PLAN = "plan_id string, query_type string, entity_names array<string>, relationship_type string, second_relationship_type string, max_hops int"
HOPS = 3
#: Relationship types up to which a set of plans is read by type.
TYPES = 64


def one_hop(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans``: (plan_id, name, rel_type or null).  All edges at each plan's node, of its type where it names one."""
    asked = plans.select("plan_id", F.col("name").alias("a"), F.col("rel_type").alias("_wanted"))
    rows = graph_query.undirected(edges).join(asked, "a").filter(F.col("_wanted").isNull() | (F.col("rel_type") == F.col("_wanted")))
    return rows.select("plan_id", F.col("rel_type").alias("relationship_type"), F.col("b").alias("neighbor"), F.col("b_type").alias("neighbor_type"), "source_chunk_ids", "outgoing")


def _typed(edges: DataFrame, plans: DataFrame, column: str) -> DataFrame:
    """The edges of the types that plans name, where these are few: other folders are not read."""
    wanted = [r[0] for r in plans.select(column).distinct().limit(TYPES + 1).collect()]
    return edges if len(wanted) > TYPES else edges.filter(F.col("rel_type").isin([t for t in wanted if t is not None]))


def two_hop_chain(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans``: (plan_id, name, first, second).  Different chains over two different edges that don't lead back."""
    one_of, two_of = (graph_query.undirected(_typed(edges, plans, c)) for c in ("first", "second"))
    one = one_of.join(plans.select("plan_id", F.col("name").alias("a"), F.col("first").alias("rel_type"), F.col("second").alias("_next")), ["a", "rel_type"])
    one = one.select("plan_id", F.col("a").alias("_start"), F.col("_next").alias("rel_type"), F.col("b_type").alias("m_type"), F.col("b").alias("via"), F.col("source_chunk_ids").alias("i1"), F.col("edge_id").alias("e1"))
    two = two_of.select("rel_type", F.col("a_type").alias("m_type"), F.col("a").alias("via"), F.col("b").alias("result"), F.col("b_type").alias("result_type"), F.col("source_chunk_ids").alias("i2"), F.col("edge_id").alias("e2"))
    rows = one.join(two, ["m_type", "via", "rel_type"]).filter((F.col("e1") != F.col("e2")) & (F.col("result") != F.col("_start")))
    return rows.select("plan_id", "via", "result", "result_type", F.concat("i1", "i2").alias("source_chunk_ids")).distinct()


def aggregate_count(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans``: (plan_id, name, rel_type).  One row for each plan, 0 where nothing matches."""
    asked = plans.select("plan_id", F.col("name").alias("a"), "rel_type")
    # two steps, so that a hub's many edges are counted before its neighbours meet
    each = graph_query.undirected(edges).join(asked, ["a", "rel_type"]).select("plan_id", "b_type", "b").distinct()
    found = each.groupBy("plan_id").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set("b")).alias("neighbors"))
    return plans.select("plan_id").join(found, "plan_id", "left").select("plan_id", F.coalesce("count", F.lit(0).cast("long")).alias("count"), F.coalesce("neighbors", F.expr("cast(array() as array<string>)")).alias("neighbors"))


def path_between(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans``: (plan_id, start, end, max_hops).  Each plan's least shortest path; no row for a plan without one.

    Frontiers belong to the starts and the ends, not to the plans: plans that share one share what has been reached from it.
    They grow together, from the starts and the ends in turn, a round for each hop.  A plan leaves when its two frontiers have met,
    when one of them is empty or when its hops are used up.  Frontiers are tables in the shared folder, without the edges' chunks, which only the paths that are found look up;
    the driver sees how many plans and rows are left."""
    spark = edges.sparkSession
    u = graph_query.undirected(edges).select("a", "b", "rel_type", "source_chunk_ids", "edge_id")
    scratch = Scratch(spark, "paths")
    asked = plans.select("plan_id", "start", "end", F.coalesce(F.nullif("max_hops", F.lit(0)), F.lit(HOPS)).alias("max_hops")).filter("start <> end")
    left, found = scratch.keep(asked, "plans"), None
    most = left.agg(F.max("max_hops")).first()[0] or 0
    none = [F.expr("cast(array() as array<string>)").alias("types"), F.expr("cast(array() as array<bigint>)").alias("path_edges")]
    ends, parts = ("start", "end"), ("nodes", "types", "path_edges")
    sides = [left.select(F.col(end).alias("origin"), F.col(end).alias("node")).distinct().select("*", F.array("origin").alias("nodes"), *none) for end in ends]
    seen = [s.select("origin", "node") for s in sides]

    def longer(path: str, piece: str, from_end: bool) -> Column:
        return F.concat(F.array(piece), path) if from_end else F.concat(path, F.array(piece))

    def rows_of(going: DataFrame, side: int) -> int:
        return going.join(sides[side].groupBy(F.col("origin").alias(ends[side])).count(), ends[side]).agg(F.sum("count")).first()[0] or 0

    for hop in range(1, most + 1):
        side, from_end = (hop + 1) % 2, hop % 2 == 0
        going = left.filter(F.col("max_hops") >= hop)
        reached = seen[side].select("origin", F.col("node").alias("b"))
        step = sides[side].join(going.select(F.col(ends[side]).alias("origin")).distinct(), "origin", "left_semi").join(u.drop("source_chunk_ids"), F.col("node") == F.col("a")).join(reached, ["origin", "b"], "left_anti")
        grown = F.struct(longer("nodes", "b", from_end).alias("nodes"), longer("types", "rel_type", from_end).alias("types"), longer("path_edges", "edge_id", from_end).alias("path_edges"))
        sides[side] = scratch.keep(step.groupBy("origin", F.col("b").alias("node")).agg(F.min(grown).alias("p")).select("origin", "node", *[f"p.{c}" for c in parts]), f"frontier{hop}")
        seen[side] = seen[side].unionByName(sides[side].select("origin", "node"))
        near, far = (sides[i].select(F.col("origin").alias(ends[i]), "node", *[F.col(c).alias(f"{x}_{c}") for c in parts]) for i, x in ((0, "l"), (1, "r")))
        # the side with fewer rows is dealt to the plans, the other one meets it by its end and node
        one, other = ((near, "start"), (far, "end"))[:: 1 if rows_of(going, 0) <= rows_of(going, 1) else -1]
        whole = going.join(one[0], one[1]).join(other[0], [other[1], "node"]).select(
            "plan_id", F.concat("l_nodes", F.slice("r_nodes", F.lit(2), F.greatest(F.size("r_nodes") - 1, F.lit(0)))).alias("nodes"),
            *[F.concat(f"l_{c}", f"r_{c}").alias(c) for c in parts[1:]],
        )
        best = scratch.keep(whole.groupBy("plan_id").agg(F.min(F.struct(*parts)).alias("p")).select("plan_id", *[f"p.{c}" for c in parts], F.lit(hop).alias("hops")), f"met{hop}")
        found = best if found is None else found.unionByName(best)
        left = scratch.keep(left.join(best.select("plan_id"), "plan_id", "left_anti").join(sides[side].select(F.col("origin").alias(ends[side])).distinct(), ends[side], "left_semi").select(*asked.columns), f"left{hop}")
        if left.isEmpty():
            break
    shape = f"plan_id {plans.schema['plan_id'].dataType.simpleString()}, {graph_query.PATH}"
    if found is None:
        scratch.clear()
        return spark.createDataFrame([], shape)
    each = found.select("plan_id", "nodes", "types", F.posexplode("path_edges").alias("pos", "edge_id")).select("plan_id", "pos", "edge_id", F.get("nodes", F.col("pos")).alias("a"), F.get("nodes", F.col("pos") + 1).alias("b"), F.get("types", F.col("pos")).alias("rel_type"))
    chunks = each.join(u, ["edge_id", "a", "b", "rel_type"]).groupBy("plan_id", "pos").agg(F.min("source_chunk_ids").alias("ids")).groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("_c"))
    told = found.join(chunks, "plan_id").select("plan_id", F.col("nodes").alias("node_path"), F.col("types").alias("relationship_path"), F.transform("_c", lambda x: x["ids"]).alias("source_chunk_ids_per_hop"), "hops")
    out = scratch.keep(told, "found")
    for name in ("plans", *(f"{part}{hop}" for hop in range(1, most + 1) for part in ("frontier", "met", "left"))):
        scratch.drop(name)
    return out


def resolved(nodes: DataFrame, plans: DataFrame, ontology: Ontology | None = None) -> tuple[DataFrame, DataFrame]:
    """(plans that can run, with canonical ``names``; (plan_id, reason) of the others).

    A name that nothing matches comes before any other reason, as in the single form; what is not in the ontology never runs."""
    ontology = ontology or Ontology()
    surfaces = plans.select("plan_id", F.posexplode("entity_names").alias("pos", "surface"))
    known = surfaces.join(look_up(surfaces.select("surface"), nodes), "surface", "left")
    named = known.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "canonical_name"))), lambda x: x["canonical_name"]).alias("names"))
    rows = plans.join(named, "plan_id", "left")
    kind, first, second = F.col("query_type"), F.col("relationship_type"), F.col("second_relationship_type")
    typed = lambda c: F.coalesce(c.isin(*ontology.relationship_types), F.lit(False))
    reason = (
        F.when(F.exists("names", lambda x: x.isNull()), "a name is not known")
        .when(F.col("names").isNull(), "a plan needs an entity")
        .when(~F.coalesce(kind.isin(*graph_query.QUERY_TYPES), F.lit(False)), "no such query type")
        .when((kind == "one_hop") & first.isNotNull() & ~typed(first) | kind.isin("two_hop_chain", "aggregate_count") & ~typed(first) | (kind == "two_hop_chain") & ~typed(second), "no such relationship type")
        .when((kind == "path_between") & (F.size("names") != 2), "a path needs exactly two entities")
        .when((kind == "path_between") & (F.col("max_hops") < 0), "max_hops is negative")
    )
    told = Scratch(plans.sparkSession, "resolved").keep(rows.withColumn("reason", reason), "plans")
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null").select("plan_id", "reason")


def statements(nodes: DataFrame, edges: DataFrame, plans: DataFrame, ontology: Ontology | None = None) -> tuple[DataFrame, DataFrame]:
    """((plan_id, text, source_chunk_ids) of all plans, (plan_id, reason) of those that cannot run).

    Names stand in the statements as they were asked."""
    ontology = ontology or Ontology()
    good, bad = resolved(nodes, plans, ontology)
    there = {r[0] for r in good.select("query_type").distinct().collect()}  # four at most
    asked = F.get("entity_names", F.lit(0))
    name, other = F.get("names", F.lit(0)), F.get("names", F.lit(1))
    of = lambda kind: good.filter(F.col("query_type") == kind)
    told = good.select("plan_id", asked.alias("entity"), "relationship_type", "second_relationship_type")
    no_ids, first = F.expr("cast(array() as array<string>)"), F.col("relationship_type").alias("rel_type")
    every = []

    def say(rows: DataFrame, text: Column, ids="source_chunk_ids") -> None:
        every.append(rows.select("plan_id", text.alias("text"), F.col(ids).alias("source_chunk_ids") if isinstance(ids, str) else ids.alias("source_chunk_ids")))

    if "one_hop" in there:
        rows = one_hop(edges, of("one_hop").select("plan_id", name.alias("name"), first)).join(told.select("plan_id", "entity"), "plan_id")
        out = F.col("outgoing")
        say(rows, F.concat(F.when(out, F.col("entity")).otherwise(F.col("neighbor")), F.lit(" "), ontology.verb(F.col("relationship_type")), F.lit(" "), F.when(out, F.col("neighbor")).otherwise(F.col("entity")), F.lit(".")))
    if "two_hop_chain" in there:
        rows = two_hop_chain(edges, of("two_hop_chain").select("plan_id", name.alias("name"), F.col("relationship_type").alias("first"), F.col("second_relationship_type").alias("second"))).join(told, "plan_id")
        say(rows, F.concat("entity", F.lit(" "), ontology.verb(F.col("relationship_type")), F.lit(" "), "via", F.lit(", and "), "via", F.lit(" "), ontology.verb(F.col("second_relationship_type")), F.lit(" "), "result", F.lit(".")))
    if "aggregate_count" in there:
        rows = aggregate_count(edges, of("aggregate_count").select("plan_id", name.alias("name"), first)).join(told, "plan_id")
        say(rows, F.concat("entity", F.lit(" "), ontology.verb(F.col("relationship_type")), F.lit(" "), F.col("count").cast("string"), F.lit(" entities ("), F.array_join("neighbors", ", "), F.lit(").")), no_ids)
    if "path_between" in there:
        rows = path_between(edges, of("path_between").select("plan_id", name.alias("start"), other.alias("end"), "max_hops"))
        clause = F.transform("relationship_path", lambda t, i: F.concat(F.get("node_path", i), F.lit(" "), ontology.verb(t), F.lit(" "), F.get("node_path", i + 1)))
        say(rows, F.concat(F.array_join(clause, "; then "), F.lit(".")), F.flatten("source_chunk_ids_per_hop"))
    if not every:
        return plans.sparkSession.createDataFrame([], f"plan_id {plans.schema['plan_id'].dataType.simpleString()}, text string, source_chunk_ids array<string>"), bad
    return reduce(DataFrame.unionByName, every), bad
