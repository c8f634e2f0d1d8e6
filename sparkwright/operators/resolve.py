"""Entity resolution: normalised names, similarity of representatives, seeds, components, canonical names."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..functions.vectors import embed_text
from ..plans.scratch import Scratch
from .components import components

#: Fixed value: the cosine from which two names are one.
THRESHOLD = 0.87
#: Representatives of a type in a block; two blocks are compared at a time.
BLOCK = 512
#: Blocks of a stripe at most (about), and how many stripes there are at least, so that small tables keep all tasks busy.
STRIPE, LEAST_STRIPES = 64, 8
#: Vectors that blocks are told apart by, out of a sample of so many; parts of a hot group's blocks.
PIVOTS, SAMPLE, SALTS = 24, 2048, 8


def distinct_names(mentions: DataFrame) -> DataFrame:
    return mentions.select("entity_type", "raw_name").distinct()


def name_groups(mentions: DataFrame) -> DataFrame:
    """(entity_type, norm, names): raw names by their normalised form."""
    return distinct_names(mentions).groupBy("entity_type", normalize_name(F.col("raw_name")).alias("norm")).agg(F.array_sort(F.collect_set("raw_name")).alias("names"))


def _pivots(rows: DataFrame, key: str, vector: str) -> np.ndarray:
    """Unit vectors that lie far from each other, out of a bounded sample picked by a hash of the key."""
    total = rows.count()
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(place < min(1.0, SAMPLE / max(total, 1))).select(key, vector).limit(2 * SAMPLE).collect() or rows.select(key, vector).limit(1).collect()
    some.sort(key=lambda r: str(r[0]))
    x = _unit(np.array([np.asarray(r[1], np.float64) for r in some]))
    if not len(x):
        return np.zeros((1, 1))
    picked, nearest = [0], x @ x[0]
    while len(picked) < min(PIVOTS, len(x)) and nearest.min() < 1 - 1e-9:
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    return x[picked]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if len(m) else m


def pair_blocks(rows: DataFrame, key: str, vector: str, group: str, block: int, scratch: Scratch) -> DataFrame:
    """(group, block, keys, matrix, low, high): rows of a group that lie alike, with the least and greatest angle of a block's rows to each pivot."""
    rows = rows.filter(F.col(vector).isNotNull()).select(group, key, F.col(vector).cast("array<double>").alias("_v"))
    pivots = _pivots(rows, key, "_v")
    kind, key_kind = rows.schema[group].dataType.simpleString(), rows.schema[key].dataType.simpleString()

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            near = x @ pivots.T
            p = near.argmax(axis=1)
            yield pa.record_batch([*batch.columns[:2], pa.array([v.tobytes() for v in x], pa.binary()), pa.array(p.astype(np.int32)), pa.array(near[np.arange(len(p)), p])], names=[group, key, "_v", "_p", "_a"])

    def pack(batches):
        held = None

        def packed(t: pa.Table):
            x = np.frombuffer(b"".join(t.column(2).to_pylist()), np.float64).reshape(t.num_rows, -1)
            angles = np.arccos(np.clip(x @ pivots.T, -1, 1))
            keys = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(1).combine_chunks())
            return pa.record_batch([t.column(0).slice(0, 1).combine_chunks(), keys, pa.array([x.tobytes()], pa.binary()), pa.array([angles.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([angles.max(axis=0).tolist()], pa.list_(pa.float64()))], names=[group, "keys", "matrix", "low", "high"])

        def runs(t: pa.Table, last: bool):
            """Runs of one group and pivot, cut where they are full; the last one waits for what may follow."""
            g, p = t.column(0).to_pylist(), t.column(3).to_pylist()
            lo = 0
            for i in range(1, len(p) + 1):
                end = i == len(p)
                if i - lo == block or not end and (g[i], p[i]) != (g[lo], p[lo]) or end and last:
                    yield lo, i
                    lo = i

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            done = 0
            for a, b in runs(held, False):
                yield packed(held.slice(a, b - a))
                done = b
            held = held.slice(done)
        if held is not None:
            for a, b in runs(held, True):
                yield packed(held.slice(a, b - a))

    order = [group, "_p", "_a", key]
    placed = rows.mapInArrow(place, f"{group} {kind}, {key} {key_kind}, _v binary, _p int, _a double")
    made = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, f"{group} {kind}, keys array<{key_kind}>, matrix binary, low array<double>, high array<double>")
    return scratch.keep(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def meeting_blocks(blocks: DataFrame, threshold: float, group: str) -> DataFrame:
    """(i, j) with i <= j: blocks of a group of which some rows may reach the threshold.

    Two vectors at an angle t have angles to any pivot that differ by t at most: blocks whose angles to one pivot
    lie further apart than the threshold allows have no pair.  Only the blocks' bounds are compared, not their rows."""
    widest = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    side = lambda x: blocks.select(group, F.col("block").alias(x), F.col("low").alias(f"l{x}"), F.col("high").alias(f"h{x}"))
    # a hot group's blocks are dealt over several tasks
    left = side("i").withColumn("_s", F.pmod("i", F.lit(SALTS)).cast("int"))
    right = side("j").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    apart = F.exists(F.zip_with(F.arrays_zip("li", "hi"), F.arrays_zip("lj", "hj"), lambda x, y: (x["li"] - y["hj"] > widest) | (y["lj"] - x["hi"] > widest)), lambda x: x)
    met = left.join(right, [group, "_s"]).filter(F.col("i") <= F.col("j"))
    return (met if threshold <= 0 else met.filter(~apart)).select("i", "j")


def similar_pairs(rows: DataFrame, threshold: float = THRESHOLD, key: str = "norm", vector: str = "embedding", group: str = "entity_type", block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """(group, a, b, similarity) with a < b of one group whose cosine reaches the threshold.

    Rows that lie alike stand in a block; the blocks' angles to some pivots tell which two can hold a pair at
    all, and only those meet, as matrices.  Blocks are dealt to stripes, and two stripes meet in a cell: a block is sent once to
    each cell that has a pair of it, and a task holds one cell's blocks however large the group is; rows without a vector are in no pair."""
    scratch = Scratch(rows.sparkSession, "pairs")
    blocks = pair_blocks(rows, key, vector, group, block, scratch)
    count = blocks.count()
    stripes = max(1, min(count, max(LEAST_STRIPES, -(-count // stripe))))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(stripes))
    met = meeting_blocks(blocks, threshold, group).withColumn("_cell", F.least(of("i"), of("j")) * stripes + F.greatest(of("i"), of("j")))
    pairs = scratch.keep(met, "meet")
    kind, key_kind = rows.schema[group].dataType.simpleString(), rows.schema[key].dataType.simpleString()

    def meet(batches):
        cell, held = None, {}
        for batch in batches:
            cells, first, second, body = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(5)
            for r in range(batch.num_rows):
                if cells[r] != cell:
                    cell, held = cells[r], {}
                if second[r] is None:  # a block; a cell's blocks come before its pairs
                    keys = batch.column(4)[r].values.to_numpy(zero_copy_only=False)
                    held[first[r]] = batch.column(3).slice(r, 1), keys, np.frombuffer(body[r].as_py(), np.float64).reshape(len(keys), -1)
                    continue
                (of_group, ka, x), (_, kb, y) = held[first[r]], held[second[r]]
                s = x @ y.T
                a, b = np.nonzero(s >= threshold)
                left, right, s = ka[a], kb[b], s[a, b]
                keep = left < right if first[r] == second[r] else left != right
                low, high = np.where(left < right, left, right)[keep], np.where(left < right, right, left)[keep]
                kinds = batch.column(4).type.value_type
                yield pa.record_batch([of_group.take(pa.array(np.zeros(len(low), np.int64))), pa.array(low, kinds), pa.array(high, kinds), pa.array(s[keep])], names=[group, "a", "b", "similarity"])

    needed = pairs.select("_cell", "i").unionByName(pairs.select("_cell", F.col("j").alias("i"))).distinct()
    sent = needed.join(blocks.select(F.col("block").alias("i"), group, "keys", "matrix"), "i").select("_cell", "i", F.lit(None).cast("long").alias("j"), group, "keys", "matrix")
    asked = pairs.select("_cell", "i", "j", F.lit(None).cast(kind).alias(group), F.lit(None).cast(f"array<{key_kind}>").alias("keys"), F.lit(None).cast("binary").alias("matrix"))
    dealt = sent.unionByName(asked).repartition(max(1, stripes * (stripes + 1) // 2), "_cell").sortWithinPartitions("_cell", F.asc_nulls_first("j"))
    return dealt.mapInArrow(meet, f"{group} {kind}, a {key_kind}, b {key_kind}, similarity double")


def seed_edges(groups: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entity_type, a, b) from seeds ``(entity_type, names)``: members that are there, each hung on the first of them."""
    rows = seeds.select(F.xxhash64("entity_type", F.to_json("names")).alias("_seed"), "entity_type", F.explode("names").alias("n")).select("_seed", "entity_type", normalize_name(F.col("n")).alias("norm")).distinct()
    there = rows.join(groups.select("entity_type", "norm"), ["entity_type", "norm"], "left_semi")
    first = there.groupBy("_seed").agg(F.min("norm").alias("a"))
    return there.join(first, "_seed").filter("norm <> a").select("entity_type", "a", F.col("norm").alias("b"))


def manifest_seeds(manifest: DataFrame) -> DataFrame:
    """A company and its ticker are one."""
    return manifest.select(F.lit("Company").alias("entity_type"), F.array("ticker", "company").alias("names"))


def canonical(names: DataFrame) -> DataFrame:
    """(entity_type, cluster, canonical_name, aliases) from (entity_type, cluster, raw_name): the longest name, of equals the first by alphabet; the others by length."""
    ordered = F.array_sort(F.collect_set(F.struct((-F.length("raw_name")).alias("l"), "raw_name")))
    out = names.groupBy("entity_type", "cluster").agg(ordered.alias("o"))
    return out.select("entity_type", "cluster", F.get("o", F.lit(0))["raw_name"].alias("canonical_name"), F.transform(F.slice("o", F.lit(2), F.greatest(F.size("o") - 1, F.lit(0))), lambda x: x["raw_name"]).alias("aliases"))


def resolve_entities(mentions: DataFrame, threshold: float = THRESHOLD, seeds: DataFrame | None = None, embed=None) -> tuple[DataFrame, DataFrame]:
    """(mentions with canonical_name, registry (entity_type, canonical_name, aliases))."""
    scratch = Scratch(mentions.sparkSession, "names")
    groups = scratch.keep(name_groups(mentions), "groups")  # the mentions are read once for the names

    @F.pandas_udf("array<double>")
    def default(names: pd.Series) -> pd.Series:
        # letters in threes as words: names that differ little have near vectors
        return names.map(lambda n: embed_text(" ".join(f"  {n} "[i : i + 3].replace(" ", "_") for i in range(len(n) + 1)), 256).tolist())

    vectors = scratch.keep(groups.select("entity_type", "norm", (embed or default)(F.col("norm")).alias("embedding")), "vectors")
    edges = similar_pairs(vectors, threshold).select("entity_type", "a", "b")
    if seeds is not None:
        edges = edges.unionByName(seed_edges(groups, seeds))
    # a name belongs to its type: nodes are "type", a separator and the name
    node = lambda t, n: F.concat_ws("\u0001", t, n)
    found = components(edges.select(node(F.col("entity_type"), F.col("a")).alias("a"), node(F.col("entity_type"), F.col("b")).alias("b")))
    clustered = groups.withColumn("node", node(F.col("entity_type"), F.col("norm"))).join(found, "node", "left")
    names = clustered.select("entity_type", F.coalesce("component", "node").alias("cluster"), F.explode("names").alias("raw_name"))
    registry = canonical(names)
    lookup = names.join(registry, ["entity_type", "cluster"]).select("entity_type", "raw_name", "canonical_name")
    told = mentions.drop("canonical_name").join(lookup, ["entity_type", "raw_name"], "left")
    return told, registry.select("entity_type", "canonical_name", "aliases")


def look_up(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(surface, canonical_name or null): equal to a name or alias in any case, else equal once both are normalised; of several the first by alphabet."""
    known = nodes.select("canonical_name", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))).alias("name"))
    asked = names.select("surface").distinct()
    exact = asked.join(known, F.lower("surface") == F.lower("name")).select("surface", F.lit(0).alias("p"), "canonical_name")
    left = asked.join(exact, "surface", "left_anti")
    loose = left.join(known, normalize_name(F.col("surface")) == normalize_name(F.col("name"))).select("surface", F.lit(1).alias("p"), "canonical_name")
    best = exact.unionByName(loose).groupBy("surface").agg(F.min(F.struct("p", "canonical_name"))["canonical_name"].alias("canonical_name"))
    return asked.join(best, "surface", "left")

