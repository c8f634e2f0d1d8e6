"""N-gram Jaccard join: signature trees with dual traversal, over blocks that lose no link.

A document's set holds the hashes of its different 5-word shingles (words are runs
of ``[^\\x20\\x09-\\x0D]``, A-Z in lower case; fewer words make one shingle; none make
an empty set, linked with nothing).  Sets link when 100 * shared >= 80 * united.

1. Equal sets are one class, represented by its least document; only
   representatives go on.
2. A set can only link if at most a fifth of it is missing elsewhere.  Shingles below
   a hash limit (1 for small sets, about a third for large ones) are counted over
   all sets; a set of which more than a fifth is seen to occur nowhere else goes.
   Sets near each other in size use compatible limits, so this drops no link.
3. What remains is ordered by how often shingles occur, rarest first.  Two linked
   sets share one of the first n - ceil(0.8 n) + 1 shingles; sharing one joins them in
   a block (connected components; a run of equal shingles is cut where sizes
   differ too much to link).
4. In a block a signature tree holds sets by size: a node has the OR of its sets'
   bitmaps, its range of sizes, and how many shingles at most share bits.  Two nodes
   are left when shared bits cannot reach the overlap that their sizes need, or when
   all their sets are connected already.  Leaves are compared exactly.  Blocks over
   ``BLOCK`` sets are cut into chunks, runs of their order by size and least hash (which
   near copies mostly share), and compared chunk against chunk, so a task holds at most
   two chunks; chunks whose sizes cannot link are not paired.  The order is dealt over
   tasks by ranges, so a block of any size is cut by many tasks.
5. Components of the links, then every document takes its class's component.

Links found are verified on whole sets of 64-bit hashes.  Copies are never expanded
into pairs.  Null texts count as empty; repeated rows are copies; an empty table
gives an empty result; very long texts are read whole.  A null id is never a
component's id while another document is in the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, drop_rows, gathered, lowered, mix64, span_hash, text_key, tidy, trim, word_spans
from .components import components

SHINGLE = 5
BLOCK = 512
LEAF = 8
SMALL_IDS = 1_000_000  # ids that may be broadcast: 8 MB
#: (largest set, share of the hashes that are counted)
_LIMITS = ((64, 1.0), (200, 0.5), (1000, 0.35), (4000, 0.28))
_LAST_LIMIT = 0.24
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(raw: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's different shingles, in order."""
    raw = lowered(raw)
    starts, ends, doc = word_spans(raw, off)
    n = len(off) - 1
    word = span_hash(raw, starts, ends)
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    parts, owners = [], []
    if len(word) >= size:
        run = word[: len(word) - size + 1].copy()
        for k in range(1, size):
            run = run * _STEP + word[k : len(word) - size + 1 + k]
        whole = doc[: len(word) - size + 1] == doc[size - 1 :]
        parts.append(mix64(run[whole]))
        owners.append(doc[: len(word) - size + 1][whole])
    for k in range(1, size):
        few = np.flatnonzero(words == k)
        if len(few):
            run = np.full(len(few), k, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for j in range(k):
                run = run * _STEP + word[first[few] + j]
            parts.append(mix64(run ^ np.uint64(k)))
            owners.append(few)
    if not parts:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    h, d = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))]).astype(np.int64)


def set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set."""
    one, two = np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=one[1:])
    np.cumsum(mix64(h + np.uint64(0x632BE59BD9B4E019)), out=two[1:])
    return (one[at[1:]] - one[at[:-1]]).view(np.int64), (two[at[1:]] - two[at[:-1]]).view(np.int64)


def limits(n: np.ndarray) -> np.ndarray:
    """The share of hashes that is counted for sets of these sizes; it never rises with size."""
    out = np.full(len(n), _LAST_LIMIT)
    for most, share in reversed(_LIMITS):
        out[n <= most] = share
    return out


def least_overlap(a, b):
    """The least overlap that links sets of these sizes: 100 i >= 80 (a + b - i)."""
    return -(-4 * (a + b) // 9)


class Node:
    __slots__ = ("bits", "low", "high", "extra", "kids", "rows")

    def __init__(self, bits, low, high, extra, kids, rows):
        self.bits, self.low, self.high, self.extra, self.kids, self.rows = bits, low, high, extra, kids, rows


def signature_tree(sizes: np.ndarray, bits: np.ndarray, extra: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """A tree over rows that are sorted by size; each node ORs the bitmaps below it."""
    level = [Node(np.bitwise_or.reduce(bits[r], axis=0), int(sizes[r].min()), int(sizes[r].max()), int(extra[r].max()), None, r) for r in (rows[i : i + leaf] for i in range(0, len(rows), leaf))]
    while len(level) > 1:
        level = [Node(np.bitwise_or.reduce([k.bits for k in g], axis=0), min(k.low for k in g), max(k.high for k in g), max(k.extra for k in g), g, np.concatenate([k.rows for k in g])) for g in (level[i : i + leaf] for i in range(0, len(level), leaf))]
    return level[0]


def may_link(a: Node, b: Node) -> bool:
    """Whether sizes and shared bits allow any two sets of the nodes to link."""
    if 5 * min(a.high, b.high) < 4 * max(a.low, b.low):
        return False
    shared = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.extra, b.extra)
    return min(shared, a.high, b.high) >= least_overlap(a.low, b.low)


def tree_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect all linked sets of ``left`` (or of left with right); pairs connected already are left out."""
    everything = left if right is None else np.concatenate([left, right])
    sizes = np.array([len(s) for s in sets])
    width = 1 << max(8, int(4 * max(int(sizes[everything].max()), 1) - 1).bit_length())
    width = min(width, 1 << 15)
    bits = np.zeros((len(sets), width // 64), np.uint64)
    extra = np.zeros(len(sets), np.int64)
    for i in everything:
        at = np.unique(sets[i] & np.uint64(width - 1))
        np.bitwise_or.at(bits[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        extra[i] = len(sets[i]) - len(at)
    parent = {int(i): int(i) for i in everything}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def together(a: Node, b: Node) -> bool:
        root = find(int(a.rows[0]))
        return all(find(int(r)) == root for r in a.rows) and all(find(int(r)) == root for r in b.rows)

    def ordered(rows):
        return rows[np.lexsort(([int(sets[r][0]) if len(sets[r]) else 0 for r in rows], sizes[rows]))]

    one = signature_tree(sizes, bits, extra, ordered(left))
    two = one if right is None else signature_tree(sizes, bits, extra, ordered(right))
    todo = [(one, two)]
    while todo:
        a, b = todo.pop()
        if a is not b and not may_link(a, b) or together(a, b) and (a is not b or len(a.rows) > 1):
            continue
        if a.kids is None and b.kids is None:
            for x in a.rows:
                for y in b.rows:
                    x, y = int(x), int(y)
                    if a is b and y <= x or find(x) == find(y):
                        continue
                    need = least_overlap(int(sizes[x]), int(sizes[y]))
                    if min(sizes[x], sizes[y]) < need or int(np.bitwise_count(bits[x] & bits[y]).sum()) + min(extra[x], extra[y]) < need:
                        continue
                    small, large = (sets[x], sets[y]) if sizes[x] <= sizes[y] else (sets[y], sets[x])
                    at = np.searchsorted(large, small)
                    if int((large[np.minimum(at, len(large) - 1)] == small).sum()) >= need:
                        parent[find(x)] = find(y)
                        yield x, y
        elif a is b:
            todo += [(a.kids[i], a.kids[j]) for i in range(len(a.kids)) for j in range(i, len(a.kids))]
        elif b.kids is None or a.kids is not None and len(a.rows) >= len(b.rows):
            todo += [(k, b) for k in a.kids]
        else:
            todo += [(a, k) for k in b.kids]


def _leaders(docs: DataFrame, live: DataFrame, count: int) -> DataFrame:
    """Texts of the rows that lead a class; their names are broadcast while they are few, and shuffled otherwise."""
    named = live.select(F.col("class_id").alias("_id"), F.col("lead_row").alias("_row"), "ka")
    named = F.broadcast(named) if count <= SMALL_IDS else named
    return docs.join(named, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["row"] == F.col("_row"))).select("text", "ka")


def _cut_into_chunks(batches):
    """Numbers runs of at most ``BLOCK`` rows of one component; rows are sorted by component, and the numbers are this task's own."""
    base, last, chunk, filled = TaskContext.get().partitionId() << 32, None, -1, 0
    for component, ka, n in gathered(batches):
        first = np.flatnonzero(np.append(True, component[1:] != component[:-1]))
        out = np.empty(len(component), np.int64)
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(component)], strict=True):
            if component[lo] != last:
                last, chunk, filled = component[lo], chunk + 1, 0
            at = filled + np.arange(hi - lo)
            out[lo:hi] = chunk + at // BLOCK
            chunk, filled = chunk + (filled + hi - lo - 1) // BLOCK, (filled + hi - lo - 1) % BLOCK + 1
        yield pa.record_batch([pa.array(component), pa.array(base + out), pa.array(ka), pa.array(n)], names=["component", "chunk", "ka", "n"])


def class_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, class_id (the least document with an equal set), row (the text's key) and stays (whether it is the one of its component that stays)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("row"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def describe(batches):
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, raw, off in blocks(batch.column(1)):
                h, at = shingles(raw, off, size)
                n = np.diff(at)
                ka, kb = set_keys(h, at)
                owner = np.repeat(np.arange(len(n)), n)
                place = h.astype(np.float64) / 2.0**64
                tested = place < limits(n)[owner]
                sent = place < limits(-(-4 * n // 5))[owner]
                new = np.array([k not in seen and not seen.add(k) for k in ka.tolist()], bool) & (n > 0)
                sent &= new[owner]  # of copies in a task the first speaks for all
                token = ((h & ~np.uint64(1)) | tested.astype(np.uint64)).view(np.int64)[sent]
                lengths = np.bincount(owner[sent], minlength=len(n))
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ka), pa.array(kb), pa.array(np.bincount(owner[tested], minlength=len(n)), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(token))],
                    names=["doc_id", "row", "n", "ka", "kb", "tested", "tokens"],
                )

    described = scratch.keep(docs.mapInArrow(describe, f"doc_id {kind}, row long, n long, ka long, kb long, tested long, tokens array<long>"), "described")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("lead")  # a null id comes last
    classes = described.filter("n > 0").groupBy("ka", "kb").agg(lead, F.first("n").alias("n"), F.first("tested").alias("tested"))
    classes = scratch.keep(classes.select("ka", "kb", F.col("lead.doc_id").alias("class_id"), F.col("lead.row").alias("lead_row"), "n", "tested"), "classes")

    # 2. sets of which too much occurs nowhere else
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = described.filter(F.size("tokens") > 0).select(F.explode("tokens").alias("t"), "ka")
    tokens = tokens.select(F.shiftright("t", 1).alias("h"), F.col("t").bitwiseAND(1).cast("tinyint").alias("tested"), "ka").repartition(parts, "h").sortWithinPartitions("h", "ka")

    @tidy
    def shared(batches):
        """Rows of hashes that two sets have, counted by set; runs may go on from batch to batch."""
        held = None
        for columns in gathered(batches):
            now = [np.concatenate([a, b]) if held else b for a, b in zip(held or [None] * 3, columns, strict=True)]
            h, flag, ka = now
            if not len(h):
                continue
            cut = int(np.searchsorted(h, h[-1], "left"))  # the last run may go on
            if len(h) - cut > 100_000:  # a long run: enough rows to know it is shared or one set
                tail = (h[cut:], flag[cut:], ka[cut:])
                several = tail[2][0] != tail[2][-1]
                yield from _counted(h[:cut], flag[:cut], ka[:cut])
                if several:
                    yield from _counted(*tail, force=True)
                    held = [tail[0][-1:], np.zeros(1, flag.dtype), tail[2][:1]]  # a witness that does not count again
                else:
                    held = [x[:1] for x in tail]
                continue
            yield from _counted(h[:cut], flag[:cut], ka[:cut])
            held = [h[cut:], flag[cut:], ka[cut:]]
        if held:
            yield from _counted(*held)

    marked = tokens.select("h", "tested", "ka").mapInArrow(shared, "ka long, n long").groupBy("ka").agg(F.sum("n").alias("found"))
    live = classes.join(marked, "ka", "left").filter(F.coalesce("found", F.lit(0)) >= F.col("tested") - F.floor(F.col("n") / 5)).select("class_id", "lead_row", "ka")
    live = scratch.keep(live, "live")
    count = live.count()

    @tidy
    def sets_of(batches):
        for batch in batches:
            for lo, hi, raw, off in blocks(batch.column(0)):
                h, at = shingles(raw, off, size)
                ka, _ = set_keys(h, at)
                same = np.flatnonzero(ka == batch.column(1).slice(lo, hi - lo).to_numpy())
                yield pa.record_batch([pa.array(ka[same]), pa.array(np.diff(at)[same], pa.int64()), pa.array([h[at[i] : at[i + 1]].view(np.int64) for i in same], pa.list_(pa.int64()))], names=["ka", "n", "hashes"])

    sets = _leaders(docs, live, count).mapInArrow(sets_of, "ka long, n long, hashes array<long>")
    sets = scratch.keep(sets.dropDuplicates(["ka"]), "sets")

    # 3. blocks by shared rare shingles
    each = sets.select("ka", "n", F.explode("hashes").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often.filter("often > 1"), "h").groupBy("ka", "n").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("r"))
    # shingles that occur once come first and link nothing, so they only shorten what is left of the prefix
    prefix = ranked.withColumn("left", F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1 - (F.col("n") - F.size("r"))).filter("left > 0")
    prefix = prefix.select("ka", "n", F.explode(F.slice("r", F.lit(1), F.col("left").cast("int"))).alias("x")).select("ka", "n", F.col("x.h").alias("h"))

    @tidy
    def neighbours(batches):
        """Edges between neighbours in size within a run of equal hashes, while their sizes can link."""
        last = None
        for h, n, d in gathered(batches):
            if last is not None:
                h, n, d = (np.concatenate([[x], y]) for x, y in zip(last, (h, n, d), strict=True))
            if not len(h):
                continue
            ok = (h[1:] == h[:-1]) & (5 * n[:-1] >= 4 * n[1:]) & (d[1:] != d[:-1])
            pairs = np.unique(np.stack([np.minimum(d[1:], d[:-1])[ok], np.maximum(d[1:], d[:-1])[ok]]), axis=1)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
            last = (h[-1], n[-1], d[-1])

    near = prefix.select("h", "n", "ka").repartition(parts, "h").sortWithinPartitions("h", "n", "ka").mapInArrow(neighbours, "a long, b long")
    block_of = scratch.keep(components(near, scratch, "near"), "blocks")

    # 4. links within blocks: chunks of a component are runs of its order by size and least hash, dealt over tasks by ranges of it
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int").alias("band")
    in_block = sets.select("ka", "n", band, F.element_at("hashes", 1).alias("least")).join(block_of.withColumnRenamed("node", "ka"), "ka")
    in_block = scratch.keep(in_block.select("component", "band", "least", "ka", "n"), "in_block")
    order = ["component", "band", "least", "ka"]
    ranked = in_block.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("component", "ka", "n")
    chunked = scratch.keep(ranked.mapInArrow(_cut_into_chunks, "component long, chunk long, ka long, n long"), "chunked")
    spans = chunked.groupBy("component", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = spans.select("component", F.col("chunk").alias("chunk_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    pairs = spans.join(other, "component").filter("chunk <= chunk_b and 5 * least(high, high_b) >= 4 * greatest(low, low_b)").select("component", F.col("chunk").alias("one"), F.col("chunk_b").alias("two"))
    members = pairs.select("*", F.explode(F.array_distinct(F.array("one", "two"))).alias("chunk")).join(chunked.drop("n"), ["component", "chunk"])
    work = members.join(sets.select("ka", "hashes"), "ka").select("component", "one", "two", "chunk", "ka", "hashes")

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ka", ignore_index=True)
        hashes = [np.sort(np.asarray(x, np.int64).view(np.uint64)) for x in frame["hashes"]]
        ids, chunk = frame["ka"].to_numpy(), frame["chunk"].to_numpy()
        one, two = frame["one"].iloc[0], frame["two"].iloc[0]
        left = np.flatnonzero(chunk == one)
        right = None if one == two else np.flatnonzero(chunk == two)
        if not len(left) or right is not None and not len(right):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        found = np.array(list(tree_links(hashes, left, right)), np.int64).reshape(-1, 2)
        trim()
        return pd.DataFrame({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    links = work.groupBy("component", "one", "two").applyInPandas(link, "a long, b long")
    final = components(scratch.keep(links, "links"), scratch, "final")

    # 5. documents: of a component's classes the one with the least document leads
    linked = classes.join(final.withColumnRenamed("node", "ka"), "ka")
    best = linked.groupBy("component").agg(F.min(F.struct(F.col("class_id").isNull().alias("no_id"), "class_id", "ka")).alias("best"))
    told = linked.join(best, "component").select("ka", "kb", F.col("best.class_id").alias("component_id"), (F.col("best.ka") == F.col("ka")).alias("leads"))
    joined = classes.join(told, ["ka", "kb"], "left")
    found = joined.select("ka", "kb", "class_id", "lead_row", F.when(F.col("leads").isNull(), F.col("class_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("leads", F.lit(True)).alias("leads"))
    found = scratch.keep(found, "found")
    base = described.select("doc_id", "row", "n", "ka", "kb")
    stays = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("row") == F.col("lead_row"))
    full = base.filter("n > 0").join(found, ["ka", "kb"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", "row", stays.alias("stays"))
    none = base.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), "row", F.lit(True).alias("stays"))
    return full.unionByName(none)


def _counted(h: np.ndarray, flag: np.ndarray, ka: np.ndarray, force: bool = False):
    """How many tested rows of each set lie in runs with two different sets."""
    if not len(h):
        return
    start = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    end = np.append(start[1:], len(h))
    several = np.repeat((ka[start] != ka[end - 1]) | force, end - start)
    again = np.zeros(len(h), bool)  # a set counts once in a run
    again[1:] = (h[1:] == h[:-1]) & (ka[1:] == ka[:-1])
    # of rows of one set in a run, any tested one makes it count; tested is the same for equal sets
    keys, n = np.unique(ka[several & ~again & (flag == 1)], return_counts=True)
    if len(keys):
        yield pa.record_batch([pa.array(keys), pa.array(n, pa.int64())], names=["ka", "n"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, of each component one row: that with the smallest id (null ids last; of equal ids the text with the least key, and any one of rows that repeat both).

    Rows are dropped by id and text together, so a repeated or null id takes no other text with it.  Texts without words are
    linked with nothing and all stay."""
    found = Scratch(docs.sparkSession, "near-copies").keep(class_components(docs, id_col, text_col).select("doc_id", F.col("row").alias("key"), "n_shingles", "stays"), "found")
    tied = found.filter("stays and n_shingles > 0").groupBy("doc_id", "key").count().filter("count > 1")
    return drop_rows(docs, found.filter("not stays"), tied, id_col, text_key(F.col(text_col)))
