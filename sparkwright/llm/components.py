"""Connected components of an edge table of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components as distributed
from .common import Scratch, gathered

#: Edges that one task may hold: 16 MB.  More go through the distributed rounds.
ONE_TASK = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it reaches) of all nodes of some edges."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(one):
        low = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, label[one], low)
        np.minimum.at(new, label[two], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        open_ = new[one] != new[two]
        label, one, two = new, one[open_], two[open_]
    return nodes, nodes[label]


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the least node each node of ``edges(a, b)`` can reach; nodes without edges are not listed.

    The edges are written first.  While they are at most ``ONE_TASK``, one task settles
    them; beyond that, rounds of joins and aggregations do, in any number of tasks.
    """
    table = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    if table.count() > ONE_TASK:
        return distributed(table)

    def settle(batches):
        parts = list(gathered(batches))
        a, b = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in (0, 1))
        node, root = roots(a, b)
        yield pa.record_batch([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "component"])

    return table.select("a", "b").repartition(1).mapInArrow(settle, "node long, component long")
