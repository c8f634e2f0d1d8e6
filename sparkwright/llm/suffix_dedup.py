"""Suffix-array dedup: removes every byte of a repeated passage, exactly.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller id.  Matches never cross documents, overlaps count, and
strings are judged on the input.

1. Every window of ``LENGTH`` bytes is owned by the least-hashed ``GRAM``-byte string in
   it (its anchor), so equal windows have equal anchors wherever they stand.
   Neighbouring windows with one anchor form a stretch; a stretch is one row (hash of
   the anchor, hash of the stretch, document, place), about one for 17 bytes.
2. Rows meet by anchor.  A stretch that a smaller document has whole is removed
   whole.  Of the others only those stay whose anchor another stretch has too: edges
   of repeats, mostly.
3. Their bytes meet by anchor, and there a suffix sort decides: suffixes from the
   anchor on, and reversed prefixes before it, are merge-sorted; a comparison finds
   the common extension by binary search on prefix polynomial hashes, so it takes
   logarithmic time.  Neighbours in the sorted order give each row's longest common
   extension to either side; windows longer than both allow are dropped, the others
   are grouped by hash, compared byte by byte with their group's first, and removed
   where a smaller document has them.
4. Anchors with more than ``HOT`` rows (a line in very many documents) take the other
   way: their windows are rows of a distributed minimum by 128-bit hashes, which
   folds before it shuffles.

Copies of whole documents are folded first: of equal texts only the smallest id's
goes through the steps, the others are removed whole (if they have ``LENGTH`` bytes).

Null texts are empty.  Texts shorter than ``LENGTH`` lose nothing.  Rows with the same
doc_id do not remove each other, and each is judged by its own text: it loses only what
a smaller id's row has.  A row without an id is compared with nothing and stays whole.
Ids may be of any type that has an order (text by its bytes).  An empty table gives an
empty result.  Long texts are one block each.

Inside, a row goes by a number: its id, shifted by so many bits that the different texts
of one id have numbers of their own (none where no id is repeated).  Numbers compare as
ids do once they are shifted back.  Ids that are no whole numbers, or too large to
be shifted, are numbered by their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, gathered, mix64, prefix_hash, second_base, span_hash

LENGTH = 50
GRAM = 16
REACH = LENGTH - GRAM + 1
HOT = 200_000
CHUNK_BYTES = 2 << 20


def _sliding_min(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(least value, its offset) of each window; of equal values the leftmost counts, so it depends on the window's content alone."""
    y, at, n = x, np.zeros(len(x), np.uint8), 1
    while n < width:
        step = min(n, width - n)
        left, right = y[:-step], y[step:]
        at = np.where(left <= right, at[:-step], at[step:] + np.uint8(step))
        y, n = np.minimum(left, right), n + step
    return y, at


def gram_hash(raw: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes from each byte on (the last ones run into zeros)."""
    padded = np.concatenate([raw, np.zeros(GRAM + 8, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(raw) + 8]).view(np.uint64).ravel()
    return mix64(eight[: len(raw)] * np.uint64(0x9E3779B97F4A7C15) + mix64(eight[8 : len(raw) + 8]))


def stretches(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, number of windows, anchor's place) of a block's stretches; places are within the block."""
    none = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return none.astype(np.uint64), none, none, none
    place = np.arange(len(raw))
    least, at = (x[: len(raw) - LENGTH + 1] for x in _sliding_min(gram_hash(raw), REACH))
    ends = np.repeat(off[1:], np.diff(off))[: len(least)]
    valid = place[: len(least)] + LENGTH <= ends
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] + np.uint8(1) != at[:-1])
    first = np.flatnonzero(new)
    # a stretch ends where the next begins or where windows stop being valid
    stop = np.flatnonzero(np.append(valid[:-1] & (~valid[1:] | new[1:]), valid[-1])) + 1
    return least[first], first, stop - first, first + at[first]


def pack(start, windows, anchor):
    return (start << 16) | (windows << 8) | anchor


def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 16, (x >> 8) & 255, x & 255


class Meetings:
    """Rows sorted by (anchor, stretch, document), batch by batch: what to remove, and what the suffix sort must see."""

    def __init__(self, bits: int = 0):
        self.bits = bits  # of a number that tell the texts of one id apart
        self.carry: tuple[np.ndarray, ...] | None = None
        self.told = None  # an anchor of which several stretches are known, whose rows so far were passed on

    def feed(self, h, u, d, p) -> Iterator[pa.RecordBatch]:
        held = 0
        if self.carry is not None:
            held = len(self.carry[0])
            h, u, d, p = (np.concatenate([a, b]) for a, b in zip(self.carry, (h, u, d, p), strict=True))
        if not len(h):
            return
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (u[1:] == u[:-1])
        first = np.flatnonzero(~same)
        least = np.repeat(d[first], np.diff(np.append(first, len(h))))
        gone = (d >> self.bits) > (least >> self.bits)
        gone_new = gone.copy()
        gone_new[:held] = False
        if gone_new.any():
            yield self.rows(True, h[gone_new], d[gone_new], p[gone_new])
        h, u, d, p = (x[~gone] for x in (h, u, d, p))
        cut = int(np.searchsorted(h, h[-1], "left"))
        yield from self.decided(h[:cut], u[:cut], d[:cut], p[:cut])
        self.carry = (h[cut:], u[cut:], d[cut:], p[cut:])
        h, u, d, p = self.carry
        if len(h) > 100_000 and (self.told == h[0] or (u[0] != u[-1] and (d != d[0]).any())):
            yield from self.decided(h, u, d, p)
            last = int(np.searchsorted(u, u[-1], "left"))
            self.carry, self.told = (h[last : last + 1], u[last : last + 1], d[last : last + 1], np.full(1, -1)), h[0]

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.carry is not None:
            yield from self.decided(*self.carry)

    def decided(self, h, u, d, p) -> Iterator[pa.RecordBatch]:
        if not len(h):
            return
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(first, len(h)))
        last = first + size - 1
        many = (u[first] != u[last]) & (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first))
        keep = np.repeat(many | (h[first] == self.told if self.told is not None else False), size) & (p >= 0)
        if keep.any():
            yield self.rows(False, h[keep], d[keep], p[keep])

    @staticmethod
    def rows(gone: bool, h, d, p) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(h), gone)), pa.array(h), pa.array(d), pa.array(p)], names=["gone", "h", "doc_id", "p"])


class Suffixes:
    """Suffixes of a byte array, compared through prefix polynomial hashes."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.sums, self.down = prefix_hash(raw)

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Lengths of the common beginnings of suffixes a and b, at most ``most``, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        sa, sb, da, db = self.sums[a], self.sums[b], self.down[a], self.down[b]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            equal = (self.sums[a + mid] - sa) * da == (self.sums[b + mid] - sb) * db
            low, high = np.where(open_ & equal, mid, low), np.where(open_ & ~equal, mid - 1, high)

    def less(self, a, la, b, lb, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a (of length la) comes before b, or is equal where that counts."""
        most = np.minimum(la, lb)
        e = self.extension(a, b, most)
        ended = e == most
        last = len(self.raw) - 1
        byte = self.raw[np.minimum(a + e, last)] < self.raw[np.minimum(b + e, last)]
        return np.where(ended, (la < lb) | (la == lb) & or_equal, byte)

    def sort(self, start: np.ndarray, size: np.ndarray, run: np.ndarray, run_size: np.ndarray) -> np.ndarray:
        """Merge sort within runs (run: where each row's run begins); all merges of a level at once."""
        n = len(start)
        order, width, most = np.arange(n), 1, int(run_size.max(initial=1))
        row = np.arange(n)
        while width < most:
            at = np.flatnonzero(run_size > width)
            base, local = run[at], row[at] - run[at]
            pair = base + local // (2 * width) * (2 * width)
            left = local % (2 * width) < width
            end = base + run_size[at]
            low = np.minimum(np.where(left, pair + width, pair), end)
            other = low.copy()
            high = np.minimum(low + width, end)
            x = order[at]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                y, me = order[mid], x[open_]
                # rows of the left block stay before equal ones of the right block
                before = self.less(start[y], size[y], start[me], size[me], ~left[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            new = order.copy()
            new[pair + local % width + (low - other)] = x
            order, width = new, 2 * width
        return order

    def longest(self, start, size, run, run_size) -> np.ndarray:
        """Each row's longest common extension with any other row of its run: that with a neighbour in sorted order."""
        order = self.sort(start, size, run, run_size)
        best = np.zeros(len(start), np.int64)
        if len(order) > 1:
            a, b = order[:-1], order[1:]
            near = np.flatnonzero(run[a] == run[b])
            a, b = a[near], b[near]
            e = self.extension(start[a], start[b], np.minimum(size[a], size[b]))
            np.maximum.at(best, a, e)
            np.maximum.at(best, b, e)
        return best


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for each i, one after another."""
    total = np.cumsum(size)
    return np.repeat(first - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)


def judged(h: np.ndarray, d: np.ndarray, p: np.ndarray, raw: np.ndarray, off: np.ndarray, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, window start) of windows that a smaller document has; rows are whole runs of anchors with their stretches' bytes."""
    none = np.empty(0, np.int64)
    if len(h) < 2:
        return none, none
    start, windows, anchor = unpack(p)
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    sizes = np.diff(np.append(first, len(h)))
    run, run_size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    length = np.diff(off)
    right = Suffixes(raw).longest(off[:-1] + anchor, length - anchor, run, run_size)
    mirrored = Suffixes(raw[::-1].copy())
    left = mirrored.longest(len(raw) - (off[:-1] + anchor), anchor, run, run_size)
    live = np.flatnonzero(left + right >= LENGTH)
    if not len(live):
        return none, none
    # windows whose part before the anchor and whose part from it on are both within reach
    low = np.maximum(0, anchor[live] - left[live])
    high = np.minimum(windows[live] - 1, anchor[live] - LENGTH + right[live])
    count = np.maximum(high - low + 1, 0)
    row = np.repeat(live, count)
    inner = ragged(low, count)
    at = off[row] + inner
    if not len(at):
        return none, none
    key = span_hash(raw, at, at + LENGTH)
    order = np.lexsort((d[row], key, run[row]))
    row, inner, at, key = row[order], inner[order], at[order], key[order]
    new = np.append(True, (key[1:] != key[:-1]) | (run[row][1:] != run[row][:-1]))
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    step = np.arange(LENGTH)
    bad = np.zeros(len(at), bool)
    for lo in range(0, len(at), 100_000):  # collisions: the bytes themselves
        part = slice(lo, lo + 100_000)
        bad[part] = (raw[at[part, None] + step] != raw[at[head[group[part]], None] + step]).any(axis=1)
    gone = d[row] >> bits > d[row[head]][group] >> bits
    for g in np.unique(group[bad]):  # a group of several strings: each by itself
        members = np.flatnonzero(group == g)
        least: dict[bytes, int] = {}
        for i in members:
            s = raw[at[i] : at[i] + LENGTH].tobytes()
            least[s] = min(least.get(s, d[row[i]]), d[row[i]])
        for i in members:
            gone[i] = d[row[i]] >> bits > least[raw[at[i] : at[i] + LENGTH].tobytes()] >> bits
    return d[row[gone]], start[row[gone]] + inner[gone]


def _spans(d: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """Removed windows as packed runs of at most 255."""
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.append(True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)) if len(d) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    span = s[last] - s[first] + 1 if len(d) else s
    pieces = -(-span // 255)
    k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(s[first], pieces) + 255 * k
    width = np.minimum(np.repeat(span, pieces) - 255 * k, 255)
    return pa.record_batch([pa.array(np.repeat(d[first], pieces)), pa.array(pack(begin, width, 0))], names=["doc_id", "p"])


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """((id, doc_id, text), (doc_id, k, m), bits): rows by their numbers, the numbers' digests, and the bits that tell one id's texts apart."""
    digest = [F.xxhash64("text").alias("k"), F.md5(F.col("text").cast("binary")).alias("m")]
    whole = docs.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    digests = scratch.keep(docs.filter("id is not null").select(F.col("id").cast("long").alias("id") if whole else "id", *digest), "digests")
    different = digests.groupBy("id", "k", "m").agg(F.count(F.lit(1)).alias("_n"))
    told = different.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    bits = int((told["n"] or 1) - 1).bit_length()
    if whole and not bits:
        return docs.withColumn("doc_id", F.col("id").cast("long")), digests.withColumnRenamed("id", "doc_id"), 0
    place = F.row_number().over(Window.partitionBy("id").orderBy("k", "m")) - 1
    texts = different.select("id", "k", "m", place.alias("place"))
    if whole and max(abs(told["low"]), abs(told["high"])) < 1 << (62 - bits):
        numbers = texts.withColumn("doc_id", F.shiftleft("id", bits) + F.col("place"))
    else:
        ids = texts.select("id").distinct().orderBy("id")
        order = ids.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF(f"id {ids.schema['id'].dataType.simpleString()}, _at long")
        numbers = texts.join(order, "id").withColumn("doc_id", F.shiftleft("_at", bits) + F.col("place"))
    numbers = scratch.keep(numbers.select(F.col("id").alias("_id"), "doc_id", "k", "m"), "numbers")
    there = docs.select("id", "text", *digest)
    rows = there.join(numbers.withColumnsRenamed({"k": "_k", "m": "_m"}), (F.col("id") == F.col("_id")) & (F.col("k") == F.col("_k")) & (F.col("m") == F.col("_m")), "left")
    return scratch.keep(rows.select("id", "doc_id", "text"), "numbered"), numbers.select("doc_id", "k", "m"), bits


def removed_spans(docs: DataFrame, digests: DataFrame, bits: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((doc_id, array of packed windows), (doc_id) of whole copies)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folded = digests.groupBy("k", "m").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = scratch.keep(digests.join(folded, ["k", "m"]).filter("doc_id > least").select("doc_id").distinct(), "copies")

    def anchors(batches):
        seen: dict[bytes, int] = {}
        for batch in batches:
            for lo, hi, raw, off in blocks(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo).to_numpy()
                h, first, windows, anchor = stretches(raw, off)
                if not len(h):
                    continue
                doc = np.searchsorted(off, first, "right") - 1
                skip = np.zeros(len(ids), bool)
                for i in np.unique(doc).tolist():  # a copy of a smaller document in this task is removed whole anyway
                    key = hashlib.md5(raw[off[i] : off[i + 1]]).digest()
                    least = seen.get(key)
                    if least is not None and least < ids[i]:
                        skip[i] = True
                    else:
                        seen[key] = int(ids[i])
                u = span_hash(raw, first, first + windows - 1 + LENGTH)
                keep = ~skip[doc]
                h, u, d = h[keep], u[keep], ids[doc][keep]
                p = pack(first - off[doc], windows, anchor - first)[keep]
                # of a stretch that several documents of the block have, only the smallest one's goes to the meeting;
                # the others are settled, and are dealt by a key of their own, so that no line fills a task
                order = np.lexsort((d, u, h))
                h, u, d, p = h[order], u[order], d[order], p[order]
                head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (u[1:] != u[:-1]))) if len(h) else np.empty(0, np.int64)
                gone = d >> bits > np.repeat(d[head], np.diff(np.append(head, len(h)))) >> bits
                h = np.where(gone, mix64(d.astype(np.uint64) ^ (p.astype(np.uint64) << np.uint64(20))), h)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(u.view(np.int64)), pa.array(d), pa.array(p), pa.array(gone.astype(np.int8))], names=["h", "u", "doc_id", "p", "gone"])

    rows = docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(anchors, "h long, u long, doc_id long, p long, gone tinyint")

    def meet(batches):
        meetings = Meetings(bits)
        for h, u, d, p, gone in gathered(batches):
            settled = gone == 1
            if settled.any():
                yield meetings.rows(True, h[settled], d[settled], p[settled])
            yield from meetings.feed(h[~settled], u[~settled], d[~settled], p[~settled])
        yield from meetings.finish()

    met = scratch.keep(rows.repartition(parts, "h").sortWithinPartitions("h", "u", "doc_id").mapInArrow(meet, "gone boolean, h long, doc_id long, p long"), "met")
    whole = met.filter("gone").select("doc_id", "p")
    unsure = met.filter("not gone").join(copies, "doc_id", "left_anti")
    size = unsure.count()
    hot_limit = max(HOT, size // 1000)
    hot = scratch.keep(unsure.groupBy("h").count().filter(F.col("count") > hot_limit).select("h"), "hot")  # at most 1000 rows
    lists = unsure.groupBy("doc_id").agg(F.collect_list("p").alias("ps"))

    def contents(batches):
        for batch in batches:
            for lo, hi, raw, off in blocks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                ps = part.column(2)
                count = np.diff(np.asarray(ps.offsets))
                p = ps.flatten().to_numpy()
                row = np.repeat(np.arange(hi - lo), count)
                start, windows, anchor = unpack(p)
                first = off[:-1][row] + start
                last = first + windows - 1 + LENGTH
                h = gram_hash(raw)[first + anchor].view(np.int64)
                size = last - first
                where = np.concatenate([[0], np.cumsum(size)])
                ids = part.column(0).to_numpy()[row]
                for k in range(0, len(h), 20_000):
                    j = min(k + 20_000, len(h))
                    data = raw[ragged(first[k:j], size[k:j])]
                    bytes_ = pa.Array.from_buffers(pa.binary(), j - k, [None, pa.py_buffer((where[k : j + 1] - where[k]).astype(np.int32)), pa.py_buffer(data)])
                    yield pa.record_batch([pa.array(h[k:j]), pa.array(ids[k:j]), pa.array(p[k:j]), bytes_], names=["h", "doc_id", "p", "bytes"])

    held = docs.select("doc_id", "text").join(lists, "doc_id").select("doc_id", "text", "ps").mapInArrow(contents, "h long, doc_id long, p long, bytes binary")
    held = scratch.keep(held, "held")
    cold_rows = held.join(F.broadcast(hot), "h", "left_anti").repartition(parts, "h").sortWithinPartitions("h")

    def judge(batches):
        waiting: list[pa.RecordBatch] = []
        size = 0

        def work(table: pa.Table):
            raw, off = _binary(table.column(3))
            d, s = judged(table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy(), raw, off, bits)
            if len(d):
                yield _spans(d, s)

        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size > CHUNK_BYTES:
                table = pa.Table.from_batches(waiting)
                h = table.column(0).to_numpy()
                cut = int(np.searchsorted(h, h[-1], "left"))
                if cut:
                    yield from work(table.slice(0, cut))
                    waiting = table.slice(cut).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in waiting)
        if waiting:
            yield from work(pa.Table.from_batches(waiting))

    cold = cold_rows.mapInArrow(judge, "doc_id long, p long")

    def windows_of(batches):
        for batch in batches:
            raw, off = _binary(batch.column(3))
            start, windows, _ = unpack(batch.column(2).to_numpy())
            row = np.repeat(np.arange(batch.num_rows), windows)
            inner = ragged(np.zeros(batch.num_rows, np.int64), windows)
            at = off[row] + inner
            a, b = span_hash(raw, at, at + LENGTH), span_hash(raw, at, at + LENGTH, second_base())
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(batch.column(1).to_numpy()[row]), pa.array(start[row] + inner)], names=["a", "b", "doc_id", "s"])

    windows = held.join(F.broadcast(hot), "h", "left_semi").select("h", "doc_id", "p", "bytes").mapInArrow(windows_of, "a long, b long, doc_id long, s long")
    least = windows.groupBy("a", "b").agg(F.min("doc_id").alias("least"))
    by_hash = windows.join(least, ["a", "b"]).filter(f"shiftright(doc_id, {bits}) > shiftright(least, {bits})").select("doc_id", F.expr("shiftleft(s, 16) + 256").alias("p"))
    spans = scratch.keep(whole.unionByName(cold).unionByName(by_hash).join(copies, "doc_id", "left_anti").distinct(), "spans")
    return spans.groupBy("doc_id").agg(F.collect_list("p").alias("ps")), copies


def _binary(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def keep_mask(size: int, packed: np.ndarray) -> np.ndarray:
    """Which bytes stay."""
    start, windows, _ = unpack(packed)
    start = np.minimum(start, size)
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, np.minimum(start + windows - 1 + LENGTH, size), -1)
    return np.cumsum(change[:-1]) == 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contents: bool = False) -> DataFrame:
    """Per document n_bytes, n_removed, n_spans and kept_sha256; with ``contents`` also the kept bytes and removed spans."""
    scratch = Scratch(docs.sparkSession, "suffix")
    docs, digests, bits = numbered(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), scratch)
    lists, copies = removed_spans(docs, digests, bits, scratch)
    kind = docs.schema["id"].dataType
    marks = lists.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", F.lit(None).cast("array<long>").alias("ps"), F.lit(True).alias("copy")))
    schema = f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<array<long>>" if contents else "")

    def finish(batches):
        empty = np.empty(0, np.int64)
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            if contents:
                out |= {"kept": [], "spans": []}
            lists_, whole = batch.column(2), batch.column(3).to_pylist()
            for lo, hi, raw, off in blocks(batch.column(1)):
                for i in range(lo, hi):
                    text = raw[off[i - lo] : off[i - lo + 1]]
                    packed = lists_[i].values.to_numpy() if lists_[i].is_valid else empty
                    if whole[i] and len(text) >= LENGTH:
                        stay = np.zeros(len(text), bool)
                    elif len(packed):
                        stay = keep_mask(len(text), packed)
                    else:
                        stay = None
                    if stay is None:
                        kept, removed, runs = text, 0, empty.reshape(0, 2)
                    else:
                        edge = np.diff(np.concatenate([[False], ~stay, [False]]).astype(np.int8))
                        runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
                        kept, removed = text[stay], int((~stay).sum())
                    out["n_bytes"].append(len(text))
                    out["n_removed"].append(removed)
                    out["n_spans"].append(len(runs))
                    out["kept_sha256"].append(hashlib.sha256(kept.tobytes()).hexdigest())
                    if contents:
                        out["kept"].append(kept.tobytes())
                        out["spans"].append(runs.tolist())
            kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.list_(pa.int64()))}
            yield pa.record_batch([batch.column(0), *(pa.array(v, kinds[k]) for k, v in out.items())], names=["doc_id", *out])

    return docs.join(marks, "doc_id", "left").select("id", "text", "ps", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(finish, schema)
