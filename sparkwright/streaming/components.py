"""Connected components kept up to date: links arrive in batches, a component's name is its least node.

Two tables grow under a path, a folder for each batch: ``nodes`` (node, component), the
component that a node was in when it came, and ``merged`` (component, into), which
components a batch put together.  Nothing is rewritten.  A batch reads what batches before
it wrote and overwrites its own folders, so one that comes again changes nothing; a component keeps its
name until it meets one with a lesser node, whatever the order of the batches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.components import components
from ..plans.scratch import Scratch


def _table(spark: SparkSession, path: str, shape: str) -> DataFrame:
    try:
        return spark.read.schema(shape).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], shape)


def _shapes(kind: str) -> tuple[str, str]:
    return f"node {kind}, component {kind}, batch long", f"component {kind}, into {kind}, batch long"


def current(spark: SparkSession, path: str, kind: str = "long", before: int | None = None) -> DataFrame:
    """(node, component) as all batches (or those before a number) left it; nodes without links are not listed."""
    nodes, merged = (_table(spark, f"{path}/{name}", shape) for name, shape in zip(("nodes", "merged"), _shapes(kind), strict=True))
    if before is not None:
        nodes, merged = nodes.filter(F.col("batch") < before), merged.filter(F.col("batch") < before)
    return _renamed(nodes.select("node", "component"), merged)


def _renamed(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """Nodes with their component's present name: merges are links between names, and the least name stays."""
    now = components(merged.select(F.col("component").alias("a"), F.col("into").alias("b"))).withColumnsRenamed({"node": "_was", "component": "_is"})
    return nodes.join(now, nodes["component"] == now["_was"], "left").select("node", F.coalesce("_is", "component").alias("component"))


def add_links(links: DataFrame, number: int, path: str) -> None:
    """Takes a batch of ``links(a, b)`` into the tables; a link of a node to itself says that it is there."""
    spark = links.sparkSession
    kind = links.schema["a"].dataType.simpleString()
    nodes, merged = (_table(spark, f"{path}/{name}", shape).filter(F.col("batch") < number) for name, shape in zip(("nodes", "merged"), _shapes(kind), strict=True))
    scratch = Scratch(spark, "links")
    links = scratch.keep(links.filter("a is not null and b is not null").select("a", "b").distinct(), "links")  # whatever makes them runs once
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    known = _renamed(nodes.select("node", "component").join(ends, "node", "left_semi"), merged)  # only nodes that the batch names
    named = ends.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("name"), F.col("component").isNull().alias("fresh"))
    # the batch's links between names: a component that is there is one node of this small graph
    left, right = (named.select(F.col("node").alias(c), F.col("name").alias(f"_{c}")) for c in ("a", "b"))
    small = components(links.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))).withColumnsRenamed({"node": "name", "component": "_least"})
    told = named.join(small, "name", "left").withColumn("_least", F.coalesce("_least", "name")).withColumn("batch", F.lit(number).cast("long"))
    told = scratch.keep(told, "told")

    def write(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")

    write(told.filter("fresh").select("node", F.col("_least").alias("component"), "batch"), "nodes")
    write(told.filter("not fresh and name <> _least").select(F.col("name").alias("component"), F.col("_least").alias("into"), "batch").distinct(), "merged")
    scratch.clear()


def merge_links(links: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the components at ``path`` up to date with a stream of links."""
    return links.writeStream.foreachBatch(lambda batch, number: add_links(batch, number, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
