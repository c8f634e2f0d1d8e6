"""Hard-negative mining: exact inner-product search by one-dimensional distance keys.

Components become floor(256 x), so scores are whole numbers.  A vector v gets one more
component, sqrt(M - |v|^2), with M the largest squared length there is, and a query gets
0 in its place: then the order by inner product is the order by distance.  Each row is
keyed by (pivot, distance): its nearest pivot and how far from it the row lies.  Rows are
stored sorted by this key, in segments of some hundred rows that know their key
interval.  A row at distance r of pivot p is at least |d(q, p) - r| from a query q, so
what may score s or more lies in an annulus around each pivot, an interval of keys.

A search goes in rounds over key intervals that grow: the first takes about a sixteenth
of the rows, the next reaches as far as the k-th best found so far (or four times as far
where fewer than k are found).  A query is done once nothing outside the scanned
intervals can beat, or tie with, its k-th best, or reach the least score asked for.  A
round sends blocks of queries to the segments that they ask for and keeps k rows for
each query and block; nothing is left out, whatever the data look like.  On directions
without any structure the annuli hold nearly all rows and the search is a product of
blocks.  Only the pivots, a bounded sample (``SAMPLE`` rows, by a hash of the id) and
counts reach the driver.  Recall is 1, by the bound.

:func:`hard_negatives` searches each anchor's nearest rows of its label, then for each
of these positives the rows of other labels in the score's band below it.

Rows with a null id, label or vector, or with a component that is null or not finite,
take no part.  Vectors of different lengths are taken as if the shorter had zeros at the end; an
empty vector is all zeros.  Of equal scores the smaller id comes first; an anchor never
finds rows with its own id.  Equal anchor rows ask once; as answers repeated rows count
as often as they are there.  With fewer rows than asked for, all are returned; an
empty table, or one without anchors, gives an empty result.  A hundred times a score must
fit a long: vectors whose squared length does not are a ValueError.  Ids and labels are whole numbers.  Other
columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

SAMPLE = 4096
MOST_PIVOTS = 48
SEGMENT, BLOCK = 1024, 128
SALTS = 8
#: Lower and upper bound of a negative's score, in hundredths of the positive's.
BAND = (80, 100)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, anchor, size, norm, largest, vector) of the rows that take part; the vector as 64-bit numbers."""
    rows = vectors.select(F.col(id_col).try_cast("long").alias("vec_id"), F.col(label_col).try_cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter("vec_id is not null and label is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")

    def run(batches):
        for batch in batches:
            column = batch.column(3)
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            x = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            largest = np.array([np.abs(x[a:b]).max(initial=0) for a, b in zip(at[:-1], at[1:], strict=True)])
            norm = np.array([float(x[a:b] @ x[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
            if (norm >= 2.0**55).any():
                raise ValueError("a hundred times a vector's squared length, in parts of 1/256, does not fit a long")
            whole = x.astype(np.int64)
            exact = [int(whole[a:b] @ whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            packed = pa.array([whole[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.record_batch([*batch.columns[:3], pa.array(np.diff(at)), pa.array(exact, pa.int64()), pa.array(largest.astype(np.int64)), packed], names=["vec_id", "label", "anchor", "size", "norm", "largest", "vector"])

    return rows.mapInArrow(run, "vec_id long, label long, anchor boolean, size long, norm long, largest long, vector binary")


def dense(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as rows of ``dim`` numbers."""
    parts = [np.frombuffer(v, np.int64) for v in column.to_pylist()]
    out = np.zeros((len(parts), dim), np.int64)
    for i, v in enumerate(parts):
        out[i, : len(v)] = v
    return out


class Space:
    """What all tasks know: the largest squared length, the pivots and the sample's keys."""

    def __init__(self, dim: int, norm: int, largest: int, sample: np.ndarray, pivots: int):
        self.dim, self.norm = dim, float(norm)
        #: Products of doubles are exact below 2**53; beyond it whole numbers are multiplied.
        self.exact = norm < 2**52
        self.kind = np.int16 if largest < 2**15 else np.int32 if largest < 2**31 else np.int64
        self.slack = 1.0 + 1e-9 * self.norm
        points = self.augmented(sample)
        centres = points[np.random.default_rng(3).permutation(len(points))[:pivots]]
        for _ in range(6):
            of = self.distances(points, centres).argmin(axis=1)
            centres = np.stack([points[of == c].mean(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
        self.pivots = np.unique(centres, axis=0)
        d = self.distances(points, self.pivots)
        self.sample_pivot = d.argmin(axis=1)
        self.sample_key = d[np.arange(len(d)), self.sample_pivot]

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.norm - np.einsum("ij,ij->i", x, x), 0))[:, None]], axis=1)

    @staticmethod
    def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        squares = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", pivots, pivots) - 2 * points @ pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def from_query(self, x: np.ndarray) -> np.ndarray:
        """Distances of queries, whose last component is 0, to the pivots."""
        return self.distances(np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1), self.pivots)

    def first_level(self, near: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The score down to which a sixteenth of the sample may lie."""
        gaps = np.abs(near[:, self.sample_pivot] - self.sample_key)
        k = min(gaps.shape[1] - 1, gaps.shape[1] // 16)
        return (self.norm + norms - np.partition(gaps, k, axis=1)[:, k] ** 2) / 2 - self.slack


def build_index(rows: DataFrame, space: Space, scratch: Scratch) -> DataFrame:
    """Segments (seg, pivot, low, high, ids, labels, vectors): all rows, stored in the order of (pivot, distance)."""

    def key(batches):
        for batch in batches:
            d = space.distances(space.augmented(dense(batch.column(2), space.dim)), space.pivots)
            p = d.argmin(axis=1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p]), batch.column(2)], names=["vec_id", "label", "pivot", "distance", "vector"])

    def pack(batches):
        wide = int(np.clip((1 << 20) // (8 * max(space.dim, 1)), 64, SEGMENT))

        def segments(held: pa.Table, last: bool) -> Iterator[tuple[int, int]]:
            p = held["pivot"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for lo in range(a, b, wide):
                    if lo + wide <= b or b < len(p) or last:
                        yield lo, min(lo + wide, b)

        def packed(held: pa.Table, last: bool):
            out, end = [], 0
            d = held["distance"].to_numpy()
            for a, b in segments(held, last):
                x = dense(held["vector"].slice(a, b - a).combine_chunks(), space.dim).astype(space.kind)
                out.append((held["pivot"][a].as_py(), d[a], d[b - 1], held["vec_id"].slice(a, b - a).to_numpy().tobytes(), held["label"].slice(a, b - a).to_numpy().tobytes(), x.tobytes()))
                end = b
            made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["pivot", "low", "high", "ids", "labels", "vectors"]) if out else None
            return made, held.slice(end)

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            made, held = packed(held, False)
            if made:
                yield made
        if held is not None and held.num_rows:
            yield packed(held, True)[0]

    keyed = rows.select("vec_id", "label", "vector").mapInArrow(key, "vec_id long, label long, pivot int, distance double, vector binary")
    order = ["pivot", "distance", "vec_id"]  # the id splits what lies at one key
    packed_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "pivot int, low double, high double, ids binary, labels binary, vectors binary")
    return scratch.keep(packed_rows.withColumn("seg", F.monotonically_increasing_id()), "index")


def _packed_queries(targets: int, space: Space):
    """Rows of open queries, in the order of their place, as blocks with the key intervals that they ask for."""
    reach = np.sqrt(space.norm) * 1e-6

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                t = batch.slice(lo, BLOCK)
                near = np.stack([np.frombuffer(v, np.float64) for v in t["near"].to_pylist()])
                norms, level, done = (t[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("norm", "level", "done"))
                caps, floors = (np.array(t[c].to_pylist(), np.int64).reshape(t.num_rows, targets) for c in ("caps", "floors"))
                wide = np.sqrt(np.maximum(space.norm + norms - 2 * (level - space.slack), 0)) + reach
                seen = np.sqrt(np.maximum(space.norm + norms - 2 * (np.minimum(done, 4e18) - space.slack), 0)) - reach
                asks = []
                for p in range(near.shape[1]):
                    d = near[:, p]
                    if (done < 4e18).all() and (seen > 0).all():  # what lies nearer was scanned before
                        asks += [(p, float((d - wide).min()), float((d - seen).max())), (p, float((d + seen).min()), float((d + wide).max()))]
                    else:
                        asks.append((p, float((d - wide).min()), float((d + wide).max())))
                more = np.concatenate([np.stack([norms, level, done], axis=1).view(np.int64), near.view(np.int64), caps, floors], axis=1)
                heads = [t[c].to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("query", "anchor_id", "label")]
                yield pa.record_batch([pa.array([h], pa.binary()) for h in (*heads, dense(t["vector"], space.dim).astype(space.kind).tobytes(), more.tobytes())] + [pa.array([[{"pivot": p, "low": a, "high": b} for p, a, b in asks]], pa.list_(pa.struct([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])))], names=["queries", "ids", "labels", "vectors", "more", "asks"])

    return run


def _scanned(space: Space, targets: int, same: bool, k: int):
    """Segments, each followed by the blocks that ask for it: the k best rows for each target of the queries."""
    high = np.int64(-(2**63))

    def best(q, t, ids, s):
        """Of candidates the k best for each query and target."""
        order = np.lexsort((ids, -s, t, q))
        q, t, ids, s = q[order], t[order], ids[order], s[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (t[1:] != t[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        keep = np.arange(len(q)) - first < k
        return q[keep], t[keep], ids[keep], s[keep]

    def meet(seg, row, out):
        pivot, low, far, ids, labels, x = seg
        query, anchor, label = (np.frombuffer(row[c], np.int64) for c in ("queries", "ids", "labels"))
        more = np.frombuffer(row["more"], np.int64).reshape(len(query), -1)
        norms, level, done = (more[:, i].copy().view(np.float64) for i in range(3))
        d = more[:, 3 + pivot].copy().view(np.float64)
        caps, floors = more[:, -2 * targets : -targets], more[:, -targets:]
        gap = np.maximum(np.maximum(low - d, d - far), 0)
        most = (space.norm + norms - gap**2) / 2 + space.slack
        least = (space.norm + norms - (d + far) ** 2) / 2 - space.slack
        on = np.flatnonzero((most >= level) & (most < done) & (least <= caps.max(axis=1)))
        if not len(on):
            return
        q = np.frombuffer(row["vectors"], space.kind).reshape(len(query), -1)[on]
        s = np.rint(q.astype(np.float64) @ x).astype(np.int64) if space.exact else q.astype(np.int64) @ x
        fits = ((label[on, None] == labels) == same) & (anchor[on, None] != ids)
        for t in range(targets):
            ok = fits & (s <= caps[on, t, None]) & (s >= floors[on, t, None])
            if not ok.any():
                continue
            held = np.where(ok, s, high)
            if held.shape[1] > k:
                ok &= held >= np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k, None]
            i, j = np.nonzero(ok)
            out.append(best(query[on[i]], np.full(len(i), t), ids[j], s[i, j]))

    def run(batches):
        seg = None
        for batch in batches:
            out: list = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    x = np.frombuffer(row["vectors"], space.kind).reshape(-1, space.dim) if space.dim else np.zeros((len(row["ids"]) // 8, 0))
                    seg = (row["pivot"], row["low"], row["high"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), np.ascontiguousarray(x.T, np.float64 if space.exact else np.int64))
                else:
                    meet(seg, row, out)
            if out:
                found = best(*(np.concatenate(c) for c in zip(*out, strict=True)))
                yield pa.record_batch([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2]), pa.array(found[3])], names=["query", "target", "vec_id", "score"])

    return run


def search(index: DataFrame, space: Space, queries: DataFrame, same: bool, targets: int, k: int, scratch: Scratch, name: str) -> DataFrame:
    """(query, target, vec_id, score, rank): the k best rows of the queries' label (or of others) within each target's scores.

    ``queries`` has query, anchor_id, label, vector, norm, and arrays ``caps`` and ``floors`` of so many targets (a target that
    is not there has a cap below its floor)."""
    spark = index.sparkSession

    def place(batches):
        for batch in batches:
            near = space.from_query(dense(batch["vector"], space.dim))
            norms = batch["norm"].to_numpy(zero_copy_only=False).astype(np.float64)
            caps, floors = (np.array(batch[c].to_pylist(), np.float64).reshape(batch.num_rows, targets) for c in ("caps", "floors"))
            there = caps >= floors
            top, bottom = np.where(there, caps, -np.inf).max(axis=1), np.where(there, floors, np.inf).min(axis=1)
            level = np.maximum(np.minimum(space.first_level(near, norms), top - 1), np.minimum(bottom, top))
            p = near.argmin(axis=1)
            yield pa.record_batch([*batch.columns, pa.array([v.tobytes() for v in near], pa.binary()), pa.array(p.astype(np.int32)), pa.array(near[np.arange(len(p)), p]), pa.array(level), pa.array(np.full(len(p), np.inf))], names=[*batch.schema.names, "near", "pivot", "away", "level", "done"])

    columns = ["query", "anchor_id", "label", "vector", "norm", "caps", "floors"]
    shape = "query long, anchor_id long, label long, vector binary, norm long, caps array<long>, floors array<long>, near binary, pivot int, away double, level double, done double"
    waiting = scratch.keep(queries.select(columns).filter("exists(zip_with(caps, floors, (c, f) -> c >= f), x -> x)").mapInArrow(place, shape), f"{name}-open0")
    directory = index.select("seg", "pivot", "low", "high", F.pmod("seg", F.lit(SALTS)).alias("salt"))
    found, left, k_round = spark.createDataFrame([], "query long, target int, vec_id long, score long"), waiting.count(), 0
    while left:
        k_round += 1
        order = ["pivot", "away", "query"]
        packed = waiting.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed_queries(targets, space), "queries binary, ids binary, labels binary, vectors binary, more binary, asks array<struct<pivot:int,low:double,high:double>>")
        blocks = scratch.keep(packed.withColumn("block", F.monotonically_increasing_id()), f"{name}-blocks{k_round}")
        asks = blocks.select("block", F.explode("asks").alias("a")).select("block", F.col("a.pivot").alias("pivot"), F.col("a.low").alias("_low"), F.col("a.high").alias("_high"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        pairs = asks.join(directory, ["pivot", "salt"]).filter((F.col("high") >= F.col("_low")) & (F.col("low") <= F.col("_high"))).select("block", "seg").distinct()
        empty = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
        sides = index.select("seg", F.lit(0).alias("kind"), "pivot", "low", "high", "ids", "labels", "vectors", *empty("binary", "queries", "more")).join(pairs.select("seg").distinct(), "seg", "left_semi")
        asked = pairs.join(blocks.drop("asks"), "block").select("seg", F.lit(1).alias("kind"), *empty("int", "pivot"), *empty("double", "low", "high"), "ids", "labels", "vectors", "queries", "more")
        dealt = sides.unionByName(asked).repartition("seg").sortWithinPartitions("seg", "kind")
        fresh = dealt.mapInArrow(_scanned(space, targets, same, k), "query long, target int, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query", "target").orderBy(F.desc("score"), "vec_id"))
        found = scratch.keep(found.unionByName(fresh).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), f"{name}-found{k_round}")
        # whose k-th best can still be beaten, and how far to look for it
        state = found.groupBy("query", "target").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        each = waiting.select("query", "norm", "level", F.posexplode(F.arrays_zip("caps", "floors")).alias("target", "band")).filter("band.caps >= band.floors").join(state, ["query", "target"], "left")
        full = F.coalesce(F.col("n") >= k, F.lit(False))
        bottom = F.greatest(F.col("band.floors").cast("double"), F.lit(-space.norm - 2 * space.slack))
        closed = (full & (F.col("kth") >= F.col("level"))) | (F.col("level") <= bottom)
        farther = F.col("level") - 1.5 * F.greatest(space.norm + F.col("norm") - 2 * F.col("level"), F.lit(space.norm / 64))
        still = each.filter(~closed).groupBy("query").agg(F.min(F.greatest(F.when(full, F.col("kth").cast("double")).otherwise(farther), bottom)).alias("next"))
        waiting = scratch.keep(waiting.join(still, "query").withColumn("done", F.col("level")).withColumn("level", F.least("next", "level")).drop("next"), f"{name}-open{k_round}")
        left = waiting.count()
        for old in (f"found{k_round - 1}", f"open{k_round - 1}", f"blocks{k_round}"):
            scratch.drop(f"{name}-{old}")
    rank = F.row_number().over(Window.partitionBy("query", "target").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, band: tuple[int, int] = BAND) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its ``positives`` best rows of the same label; for each of them the ``negatives`` best rows of
    other labels whose score is from ``band[0]`` to ``band[1]`` hundredths of the positive's."""
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.keep(quantised(vectors, is_anchor, id_col, vector_col, label_col), "rows")
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.max("size").alias("size"), F.max("largest").alias("largest"), F.count_if("anchor").alias("anchors")).first()
    if not told["anchors"]:
        scratch.clear()
        return spark.createDataFrame([], RESULT)
    place = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter(place < min(1.0, SAMPLE / told["n"])).select("vec_id", "vector").limit(2 * SAMPLE).collect() or rows.select("vec_id", "vector").limit(1).collect()
    picked.sort(key=lambda r: (r["vec_id"], bytes(r["vector"])))
    sample = dense(pa.array([bytes(r["vector"]) for r in picked], pa.binary()), told["size"])
    space = Space(told["size"], told["norm"], told["largest"], sample, int(np.clip(told["n"] ** 0.5 / 8, 1, MOST_PIVOTS)))
    index = build_index(rows, space, scratch)

    any_score = (2**63 - 1, -(2**63) + 1)
    anchors = rows.filter("anchor").select("vec_id", "label", "vector", "norm").dropDuplicates(["vec_id", "label", "vector"])
    asked = scratch.keep(anchors.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("anchor_id"), "label", "vector", "norm", F.array(F.lit(any_score[0])).alias("caps"), F.array(F.lit(any_score[1])).alias("floors")), "anchors")
    near = scratch.keep(search(index, space, asked, True, 1, positives, scratch, "positive"), "positives")

    low, high = (F.col("score") * hundredths for hundredths in band)
    # the band's ends in whole numbers: a quotient rounded down, and one rounded up
    ends = near.select("query", "rank", (high - F.pmod(high, F.lit(100))).alias("h"), (low + F.pmod(-low, F.lit(100))).alias("l"))
    listed = ends.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", F.expr("h div 100").alias("cap"), F.expr("l div 100").alias("floor")))).alias("p"))  # at most ``positives`` each
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.get("p", i))
    listed = listed.select("query", F.transform(filled, lambda x: F.coalesce(x["cap"], F.lit(0).cast("long"))).alias("caps"), F.transform(filled, lambda x: F.coalesce(x["floor"], F.lit(1).cast("long"))).alias("floors"))
    bounded = asked.drop("caps", "floors").join(listed, "query")
    far = search(index, space, bounded, False, positives, negatives, scratch, "negative")

    named = near.join(asked.select("query", "anchor_id"), "query").select("query", (F.col("rank") - 1).cast("int").alias("target"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    result = named.join(far, ["query", "target"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    result = scratch.keep(result, "result")
    for name in ("rows", "index", "anchors", "positives"):
        scratch.drop(name)
    return result
