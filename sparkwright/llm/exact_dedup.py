"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

A text's key is a 64-bit hash of its normalised form (runs of ``[\\x20\\x09-\\x0D]``
are one space).  The directory maps a key's leading bits to a bucket: it starts with one
slot, and while a bucket holds more than ``capacity`` different keys it splits by one
more bit of its own (its local depth), for which the directory doubles when that
bucket is as deep as the directory.  It has at most ``2**max_depth`` slots at any size of
the corpus (at the default depth and capacity that is enough for 1.3 billion different
keys; beyond that buckets hold longer lists), so it is a bounded literal of the plan.

Buckets are ranges of keys, and every owner task has a range of buckets: the texts are
shuffled once, to their owners, and there chained by key and compared byte by byte (the
text itself is a grouping key, so texts that share a hash stay two entries).  The index
files have a folder for each bucket, with one row per different text: bucket, key, digest,
smallest id, number of rows.  Documents are looked up bucket by bucket: their digests go
to their bucket's owner, and so do the index rows with copies.

The at most ``heavy`` texts that own more than one ``heavy``-th of the rows are dealt over
the owners by the part of the input that they come from, chained there, and their
chains (one row a task) are joined by key and SHA-256; their documents look them up in a
broadcast of at most ``heavy`` rows.

Null texts count as empty, so they equal the empty text.  Of equal texts the row
with the smallest doc_id stays; rows repeating a doc_id stay rows, and are copies
of each other if their texts are equal.  Rows with a null doc_id are never chosen
while another row has that text.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, drop_rows

CAPACITY = 20_000
LEAST_CAPACITY = 256
MAX_DEPTH = 16
HEAVY = 256


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; single spaces are left alone, which is most of them."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def directory(histogram: dict[int, int], max_depth: int, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """(global depth, (local depth, prefix) of each slot's bucket) from key counts by leading ``max_depth`` bits."""
    level = [histogram.get(i, 0) for i in range(1 << max_depth)]
    keys = [level]
    while len(level) > 1:
        level = [level[i] + level[i + 1] for i in range(0, len(level), 2)]
        keys.append(level)
    keys.reverse()  # keys[d][p]: keys whose first d bits are p
    depth, slots = 0, [(0, 0)]
    while True:
        full = {(d, p) for d, p in slots if keys[d][p] > capacity and d < max_depth}
        if not full:
            return depth, slots
        if any(d == depth for d, _ in full):  # a bucket as deep as the directory: it doubles, and both halves of a slot share its bucket
            depth, slots = depth + 1, [b for b in slots for _ in (0, 1)]
        slots = [(d + 1, slot >> (depth - d - 1)) if (d, p) in full else (d, p) for slot, (d, p) in enumerate(slots)]


def leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, heavy: int = HEAVY) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_text"))
    entries = scratch.keep(rows.select("doc_id", F.xxhash64("_text").alias("key"), F.sha2("_text", 256).alias("text_sha256")), "entries")

    # the directory: from how many different keys there are below each prefix
    counted = entries.select("key").distinct().groupBy(leading(F.col("key"), max_depth).alias("slot")).count()
    found = {r["slot"]: r["count"] for r in counted.collect()}  # at most 2**max_depth rows
    depth, slots = directory(found, max_depth, min(capacity, max(LEAST_CAPACITY, sum(found.values()) // (4 * owners))))
    number = {b: i for i, b in enumerate(dict.fromkeys(slots))}  # buckets in the order of their keys
    places = F.split(F.lit(",".join(str(number[b]) for b in slots)), ",").cast("array<int>")

    def placed(frame: DataFrame) -> DataFrame:
        """With each key's bucket, and the task that owns it."""
        with_bucket = frame.withColumn("bucket", F.get(places, leading(F.col("key"), depth)))
        return with_bucket.withColumn("owner", F.floor(F.col("bucket").cast("long") * owners / len(number)).cast("int"))

    total = entries.count()
    most = max(1, total // heavy)
    large = scratch.keep(entries.groupBy("key").count().filter(F.col("count") > most).select("key", F.lit(True).alias("is_large")), "large")  # at most ``heavy`` keys

    # texts go to their buckets' owners, which chain them
    sent = placed(rows.withColumn("key", F.xxhash64("_text"))).join(F.broadcast(large), "key", "left")
    sent = sent.withColumn("owner", F.when(F.col("is_large"), F.spark_partition_id() % owners).otherwise(F.col("owner")))
    chains = sent.repartitionById(owners, F.col("owner")).groupBy("owner", "bucket", "key", "_text", "is_large").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    chains = scratch.keep(chains.select("bucket", "key", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size", "is_large"), "chains")
    joined = chains.filter("is_large").groupBy("bucket", "key", "text_sha256").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.lit(True).alias("is_large"))
    index = scratch.keep_by(chains.filter("is_large is null").unionByName(joined), "index", "bucket")

    # documents are looked up
    copies = index.filter("group_size > 1")
    broad = F.broadcast(copies.filter("is_large").select("key", "text_sha256", F.col("keep_id").alias("keep_l"), F.col("group_size").alias("size_l")))
    looked = entries.join(F.broadcast(large), "key", "left")
    done = looked.filter("is_large").join(broad, ["key", "text_sha256"], "left")
    done = done.select("doc_id", "text_sha256", F.when(F.col("size_l").isNull(), F.col("doc_id")).otherwise(F.col("keep_l")).alias("keep_id"), F.coalesce("size_l", F.lit(1)).alias("group_size"))
    asked = placed(looked.filter("is_large is null").select("doc_id", "key", "text_sha256")).repartitionById(owners, F.col("owner"))
    known = placed(copies.filter("is_large is null").select("key", "text_sha256", F.col("keep_id").alias("keep_s"), F.col("group_size").alias("size_s"))).repartitionById(owners, F.col("owner"))
    rest = asked.join(known, ["owner", "bucket", "key", "text_sha256"], "left")
    rest = rest.select("doc_id", "text_sha256", F.when(F.col("size_s").isNull(), F.col("doc_id")).otherwise(F.col("keep_s")).alias("keep_id"), F.coalesce("size_s", F.lit(1)).alias("group_size"))
    return done.unionByName(rest).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, of equal texts one row: that with the smallest id, any one of those that repeat it.

    Rows are dropped by id and text together, so a repeated or null id takes no other text with it;
    null ids come last, and of rows with a null id that alone have a text, any one stays."""
    found = Scratch(docs.sparkSession, "copies").keep(exact_dedup(docs, id_col, text_col), "found").withColumnRenamed("text_sha256", "key")
    tied = found.filter("kept and group_size > 1").groupBy("doc_id", "key").count().filter("count > 1")
    return drop_rows(docs, found.filter("not kept"), tied, id_col, F.sha2(normalised(F.col(text_col)), 256))
