"""The four graph templates over (src_type, src, rel_type, dst_type, dst, source_chunk_ids, confidence)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ontology import Ontology
from ..plans.scratch import Scratch
from .graph_build import with_edge_ids
from .resolve import look_up

ONE_HOP = "relationship_type string, neighbor string, neighbor_type string, source_chunk_ids array<string>, outgoing boolean"
TWO_HOP = "via string, result string, result_type string, source_chunk_ids array<string>"
PATH = "node_path array<string>, relationship_path array<string>, source_chunk_ids_per_hop array<array<string>>, hops int"
#: Rows of a frontier up to which it is sent to the edges instead of dealing the edges out.
SENT = 1_000
COUNT = "count long, neighbors array<string>"
QUERY_TYPES = ("one_hop", "two_hop_chain", "path_between", "aggregate_count")


@dataclass(frozen=True)
class GraphPlan:
    query_type: str
    entity_names: tuple[str, ...] = field(default_factory=tuple)
    relationship_type: str | None = None
    second_relationship_type: str | None = None
    max_hops: int | None = 3

    @property
    def hops(self) -> int:
        """None and 0 are 3; less than that is an error."""
        if (self.max_hops or 0) < 0:
            raise ValueError("max_hops is negative")
        return self.max_hops or 3


def undirected(edges: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Edges from both ends (a to b, outgoing or not), with ``more`` of their columns; a loop once."""
    rows = edges if "edge_id" in edges.columns else with_edge_ids(edges)
    rest = ("rel_type", "source_chunk_ids", "edge_id", *more)
    there = rows.select(F.col("src_type").alias("a_type"), F.col("src").alias("a"), F.col("dst_type").alias("b_type"), F.col("dst").alias("b"), *rest, F.lit(True).alias("outgoing"))
    back = rows.filter("src <> dst or src_type <> dst_type").select(F.col("dst_type").alias("a_type"), F.col("dst").alias("a"), F.col("src_type").alias("b_type"), F.col("src").alias("b"), *rest, F.lit(False).alias("outgoing"))
    return there.unionByName(back)


def one_hop(edges: DataFrame, name: str, rel_type: str | None = None) -> DataFrame:
    """All edges at a node (of a type), a row each; the filters reach both scans."""
    rows = undirected(edges).filter(F.col("a") == name)
    if rel_type is not None:
        rows = rows.filter(F.col("rel_type") == rel_type)
    return rows.select(F.col("rel_type").alias("relationship_type"), F.col("b").alias("neighbor"), F.col("b_type").alias("neighbor_type"), "source_chunk_ids", "outgoing")


def two_hop_chain(edges: DataFrame, name: str, first: str, second: str) -> DataFrame:
    """Different (via, result, type, chunks of both edges): two different edges, the result is not the start."""
    u = undirected(edges)
    one = u.filter((F.col("a") == name) & (F.col("rel_type") == first)).select(F.col("b_type").alias("m_type"), F.col("b").alias("via"), F.col("source_chunk_ids").alias("i1"), F.col("edge_id").alias("e1"))
    two = u.filter(F.col("rel_type") == second).select(F.col("a_type").alias("m_type"), F.col("a").alias("via"), F.col("b").alias("result"), F.col("b_type").alias("result_type"), F.col("source_chunk_ids").alias("i2"), F.col("edge_id").alias("e2"))
    rows = one.join(two, ["m_type", "via"]).filter((F.col("e1") != F.col("e2")) & (F.col("result") != name))
    return rows.select("via", "result", "result_type", F.concat("i1", "i2").alias("source_chunk_ids")).distinct()


def path_between(edges: DataFrame, start: str, end: str, max_hops: int = 3) -> DataFrame:
    """A shortest undirected path of 1 to ``max_hops`` edges: of several the least by (nodes, types, edges); no row if there is none.

    A frontier grows from either end, the smaller one first, until they meet.  It keeps
    one least path for each new node and leaves out nodes reached before; frontiers are
    tables in the shared folder (no lineage grows), and only how many nodes they have and
    the path itself come to the driver.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], PATH)
    if start == end:
        return none
    u = undirected(edges).select("a", "b", "rel_type", "source_chunk_ids", "edge_id")
    scratch = Scratch(spark, "path")
    shape = "node string, nodes array<string>, types array<string>, path_edges array<long>, ids array<array<string>>"
    sides = [spark.createDataFrame([(name, [name], [], [], [])], shape) for name in (start, end)]
    seen, sizes, known = [s.select("node") for s in sides], [1, 1], [1, 1]

    def grown(frontier: DataFrame, reached: DataFrame, from_end: bool, size: int, past: int) -> DataFrame:
        sent, before = (F.broadcast(x) if n <= SENT else x for x, n in ((frontier, size), (reached.withColumnRenamed("node", "_s"), past)))
        step = u.join(sent, frontier["node"] == u["a"]).join(before, F.col("b") == F.col("_s"), "left_anti")

        def longer(path: str, piece: str) -> F.Column:
            return F.concat(F.array(piece), path) if from_end else F.concat(path, F.array(piece))

        path = F.struct(longer("nodes", "b").alias("nodes"), longer("types", "rel_type").alias("types"), longer("path_edges", "edge_id").alias("path_edges"), longer("ids", "source_chunk_ids").alias("ids"))
        return step.groupBy(F.col("b").alias("node")).agg(F.min(path).alias("p")).select("node", "p.nodes", "p.types", "p.path_edges", "p.ids")

    try:
        for hop in range(1, max_hops + 1):
            side = 0 if sizes[0] <= sizes[1] else 1
            sides[side] = scratch.keep(grown(sides[side], seen[side], side == 1, sizes[side], known[side]), f"frontier{hop}")
            sizes[side] = sides[side].count()
            known[side] += sizes[side]
            if not sizes[side]:
                return none
            seen[side] = seen[side].unionByName(sides[side].select("node"))
            left = sides[0].select("node", *[F.col(c).alias(f"l_{c}") for c in ("nodes", "types", "path_edges", "ids")])
            whole = left.join(sides[1], "node").select(
                F.concat("l_nodes", F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 1, F.lit(0)))).alias("nodes"), F.concat("l_types", "types").alias("types"),
                F.concat("l_path_edges", "path_edges").alias("path_edges"), F.concat("l_ids", "ids").alias("ids"),
            )
            best = whole.agg(F.min(F.struct("nodes", "types", "path_edges", "ids")).alias("p")).first()["p"]
            if best:
                return spark.createDataFrame([(best["nodes"], best["types"], best["ids"], hop)], PATH)
        return none
    finally:
        scratch.clear()


def aggregate_count(edges: DataFrame, name: str, rel_type: str) -> DataFrame:
    """Always one row: how many different neighbours by an edge type, and their names."""
    rows = undirected(edges).filter((F.col("a") == name) & (F.col("rel_type") == rel_type))
    return rows.agg(F.count_distinct("b_type", "b").alias("count"), F.array_sort(F.collect_set("b")).alias("neighbors"))


def execute(nodes: DataFrame, edges: DataFrame, plan: GraphPlan, ontology: Ontology | None = None) -> DataFrame:
    """Resolves the plan's names, then runs its template; a name that nothing matches gives an empty result before any other check."""
    spark, ontology = edges.sparkSession, ontology or Ontology()
    shape = {"one_hop": ONE_HOP, "two_hop_chain": TWO_HOP, "path_between": PATH, "aggregate_count": COUNT}.get(plan.query_type, "empty string")
    asked = spark.createDataFrame([(n,) for n in plan.entity_names], "surface string")
    found = {r["surface"]: r["canonical_name"] for r in look_up(asked, nodes).collect()}
    names = [found.get(n) for n in plan.entity_names]
    if any(n is None for n in names):
        return spark.createDataFrame([], shape)
    if not names:
        raise ValueError("a plan needs an entity")
    match plan.query_type:
        case "one_hop":
            return one_hop(edges, names[0], ontology.check_type(plan.relationship_type) if plan.relationship_type else None)
        case "two_hop_chain":
            return two_hop_chain(edges, names[0], ontology.check_type(plan.relationship_type), ontology.check_type(plan.second_relationship_type))
        case "path_between":
            if len(names) != 2:
                raise ValueError("a path needs exactly two entities")
            return path_between(edges, names[0], names[1], plan.hops)
        case "aggregate_count":
            return aggregate_count(edges, names[0], ontology.check_type(plan.relationship_type))
    raise ValueError(f"no query type {plan.query_type!r}")
