"""Token counts: an exact length histogram and suffix sums over it.

Documents are encoded whole (an Arrow batch at a time) and only their lengths are
kept: each batch sends one row per different length.  Sums over the histogram in
two levels (within blocks of ``BLOCK`` lengths, then over the blocks) give, for
every length that occurs, how many documents and tokens lie at or above it, and
from these totals, quantiles and the tokens left by any context limit, exactly.

Null and empty texts have 0 tokens.  Ties and repeated rows count each time.  An
empty table gives an empty histogram.  Very long texts are encoded whole, long runs of
white space in them too: the pattern makes all of a run but its last character one
piece, so that piece goes straight to the merges and what stands before and after it
through the pattern.  The histogram's size is bounded by the number of different
lengths; the running sum over blocks sees one row for each ``BLOCK`` lengths that occur.
"""

from __future__ import annotations

import base64
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 1024
#: Runs of white space (Unicode's, as the pattern has it) that the pattern's engine is spared; it goes as deep as a run is long.
_LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """A byte-level BPE from a file of ranks; one per process."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(encode, text: str | None) -> int:
    """How many tokens a text has."""
    if not text:
        return 0
    n, at = 0, 0
    for run in _LONG_RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1  # the last one belongs to the word that follows, if there is one
        n += len(encode.encode_ordinary(text[at : run.start()])) + len(encode._encode_single_piece(text[run.start() : stop]))
        at = stop
    return n + len(encode.encode_ordinary(text[at:]))


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def length_histogram(docs: DataFrame, text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(length, docs): how many documents have each encoded length."""
    path = ranks or default_ranks()

    def counts(batches):
        encode = encoder(path)
        for batch in batches:
            found = Counter(token_count(encode, x.as_py()) for x in batch.column(0))
            yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["length", "docs"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(counts, "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))
    return Scratch(docs.sparkSession, "lengths").keep(counted, "histogram")  # sums read it more than once; texts are encoded once


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per length: documents and tokens at or above it, and what a context limit of that length leaves."""
    rows = histogram.withColumn("_block", F.floor(F.col("length") / block)).withColumn("tokens", F.col("length") * F.col("docs"))
    down = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per_block = rows.groupBy("_block").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    above = per_block.select("_block", F.coalesce(F.sum("_d").over(down), F.lit(0)).alias("_docs_above"), F.coalesce(F.sum("_t").over(down), F.lit(0)).alias("_tokens_above"), F.sum("_d").over(whole).alias("all_docs"), F.sum("_t").over(whole).alias("all_tokens"))
    inner = Window.partitionBy("_block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.join(above, "_block").withColumn("docs_from", F.sum("docs").over(inner) + F.col("_docs_above")).withColumn("tokens_from", F.sum("tokens").over(inner) + F.col("_tokens_above"))
    longer = F.col("docs_from") - F.col("docs")
    up_to = F.col("all_tokens") - F.col("tokens_from") + F.col("tokens")
    return summed.select(
        F.col("length").alias("context_limit"), "docs", "tokens", "docs_from", "tokens_from",
        longer.alias("docs_cut"), (up_to + F.col("length") * longer).alias("tokens_kept"),
        (F.col("all_tokens") - up_to - F.col("length") * longer).alias("tokens_cut"),
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("quantile"), "all_docs", "all_tokens",
    )


def quantiles(sums: DataFrame, at: list[float]) -> DataFrame:
    """For each share, the least length that at least that share of the documents does not exceed."""
    wanted = sums.sparkSession.createDataFrame([(float(q),) for q in at], "share double")
    return wanted.join(sums, F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("context_limit").alias("length"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For any limits, also ones that are no document's length: documents cut and tokens kept."""
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    first = wanted.join(sums, F.col("context_limit") > F.col("limit"), "left").groupBy("limit").agg(F.min_by(F.struct("docs_from", "tokens_from"), "context_limit").alias("s"))
    total = sums.agg(F.max("all_tokens").alias("all_tokens"))
    return first.crossJoin(F.broadcast(total)).select("limit", F.coalesce("s.docs_from", F.lit(0)).alias("docs_cut"), (F.col("all_tokens") - F.coalesce("s.tokens_from", F.lit(0)) + F.col("limit") * F.coalesce("s.docs_from", F.lit(0))).alias("tokens_kept"))
