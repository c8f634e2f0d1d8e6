"""Shared pieces: Arrow text blocks as numpy bytes, word hashing, scratch tables.

Text reaches Python as Arrow buffers and stays there: a block is one byte array
plus document offsets, cut so that a task holds about ``BLOCK_BYTES`` of text at
a time (a single longer document is a block of its own).  A null text is empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch

BLOCK_BYTES = 1 << 19
#: Rows in an Arrow batch, where the session has Spark's default (10,000 whole texts take too much of an executor's memory).
BATCH_ROWS = 1000

#: The white space of the contracts: 0x20 and 0x09-0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_R1 = np.uint64(0x9E3779B97F4A7C15)
_R2 = np.uint64(0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) for runs of rows of about ``limit`` bytes."""
    raw, off = text_buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def gathered(batches, rows: int = 50_000) -> Iterator[list[np.ndarray]]:
    """Columns of numbers, from so many small batches that they are worth a call of numpy."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield [c.to_numpy() for c in pa.Table.from_batches(waiting).columns]
            waiting, n = [], 0
    if n:
        yield [c.to_numpy() for c in pa.Table.from_batches(waiting).columns]


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the words ``[^\\x20\\x09-\\x0D]+``; none crosses documents."""
    n = len(raw)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~_SPACE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = off[:-1][off[:-1] < n]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[raw]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n; kept up to eight blocks' length."""
    key = int(base)
    if key in _POWERS and len(_POWERS[key][0]) > n:
        return _POWERS[key]
    size = max(n + 1, BLOCK_BYTES + 65536)
    inverse = np.uint64(pow(key, -1, 1 << 64))
    up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    made = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size <= 8 * BLOCK_BYTES + (1 << 17):
        _POWERS[key] = made
    return made


def prefix_hash(raw: np.ndarray, base: np.uint64 = _R1) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash modulo 2**64, and the inverse powers that shift it."""
    up, down = _powers(len(raw), base)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums, down


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _R1) -> np.ndarray:
    """64-bit hashes of byte spans; of long texts with spans in order, a stretch at a time."""
    if len(raw) > 2 * BLOCK_BYTES and len(starts) > 1 and (np.diff(starts) >= 0).all() and int((ends - starts).max()) < BLOCK_BYTES:
        cuts = np.searchsorted(starts, np.arange(0, len(raw) + BLOCK_BYTES, BLOCK_BYTES))
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                low = starts[a]
                parts.append(span_hash(raw[low : ends[a:b].max()], starts[a:b] - low, ends[a:b] - low, base))
        return np.concatenate(parts)
    sums, down = prefix_hash(raw, base)
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix64(value ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


def second_base() -> np.uint64:
    """A base independent of the default one, for 128-bit keys."""
    return _R2


class Scratch(scratch.Scratch):
    """Tables in the shared folder, in a session whose Arrow batches are small."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        super().__init__(spark, name)

    def keep_by(self, frame: DataFrame, name: str, column: str) -> DataFrame:
        """Writes a table with a folder for each value of a column and reads it again."""
        frame.write.mode("overwrite").partitionBy(column).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.root}/{name}").select(frame.columns)


def release() -> None:
    """Gives memory that a fit on the driver used back to the system."""
    gc.collect()
    trim()


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A function of batches that gives the memory it used back to the system when its task ends: workers stay for later tasks."""

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold of a document."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def unused(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: Column) -> Column:
    """Tells the rows of one id apart; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_rows(docs: DataFrame, gone: DataFrame, tied: DataFrame, id_col: str, key: Column) -> DataFrame:
    """The rows of ``docs`` without those that ``gone(doc_id, key)`` names, and one row of each that ``tied(doc_id, key)`` names.

    A row is named by its id and its text's key together, and a null id equals a null id:
    a text that nobody else has never goes because another row has the same id."""
    mark = unused(docs, "_key")
    marked = docs.withColumn(mark, key)

    def without(rows: DataFrame, named: DataFrame, how: str) -> DataFrame:
        named = named.select(F.col("doc_id").alias("_named_id"), F.col("key").alias("_named_key"))
        return rows.join(named, rows[id_col].eqNullSafe(named["_named_id"]) & (rows[mark] == named["_named_key"]), how)

    left = without(marked, gone.select("doc_id", "key").distinct(), "left_anti")
    if not tied.isEmpty():
        once = without(left, tied, "left_semi").dropDuplicates([id_col, mark])
        left = without(left, tied, "left_anti").unionByName(once)
    return left.drop(mark)
