"""Benchmark decontamination: latent semantic retrieval, then longest common subsequence and answer checks.

Documents and benchmark items are words (runs of ``[^\\x20\\x09-\\x0D]``, A-Z in lower
case, marks around them dropped) hashed into ``BUCKETS`` columns; a passage is their
TF-IDF vector, with document frequencies over all documents.

Items are searched in blocks of about ``ITEMS``.  Each block has a latent space of its own,
by a distributed randomised SVD of the TF-IDF passages of its items (even cuts of at
most ``PASSAGE`` words): a random basis is multiplied by the passage matrix and its
transpose ``ROUNDS`` times on the executors (each round sums matrices of fixed size),
and orthonormalised on the driver.  Items of which the space shows less than ``SHOWN`` go
to a next space with fewer items, so none is left out.

Every window of every document is searched: windows of the passages' lengths (rounded up to
``LENGTHS``), each starting a third of its length after the one before, are folded into the latent space and
multiplied with all passages of that length.  A window is a candidate for an item if
its cosine in the latent space is at least ``COSINE`` and the part of it that lies in the space is at
least ``ENERGY`` of the passage's part, and if it has at least ``OVERLAP`` of the passage's
words in any order.  Candidates that fit one another are one region of a document.  A region is a
leak if the longest common subsequence has at least ``SHARE`` of the item's words and at
least half of its ``ANSWER`` rarest words stand in it, or if it has at least ``STRONG`` of
the words of an item of ``LONG`` words or more, whichever words those are.  What is not a
leak by these rules: a text in which more than ``1 - SHARE`` of the words changed, one in
which most answer words and more than ``1 - STRONG`` of the words changed, and one whose
halves changed places.  Words that occur in no document are no answers.  The search is not
exact; its recall is measured in the tests (copies, and items with up to 28 % of their words changed).

Items of fewer than ``LEAST`` words, or with fewer than ``FEW`` different ones, say too
little for that: they are leaks where all their words stand in a row, found by their
rarest word (cosine and answer share are told as 1).  An item without words is no item.
Documents are read once for each ``GROUP`` spaces.  Null and empty texts leak nothing, and
a null item is no item.  Of several places in one document the
best is told (longest, then first); rows that repeat a doc_id are told as one document,
while :func:`drop_leaking` judges each row by its own text.  Texts of any length are searched in
stretches of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lowered, release, small_batches, span_hash, word_spans
from .suffix_dedup import ragged

BUCKETS = 1 << 15
RANK = 48
PASSAGE = 48
ROUNDS = 2
SHOWN = 0.25
#: Words of a chunk, chunks of the windows, and chunks that are folded at a time.
CHUNK = 4
LENGTHS = (3, 4, 5, 6, 8, 10, 12)
STRETCH = 1 << 13
COSINE, ENERGY, OVERLAP = 0.6, 0.35, 0.4
SHARE = 0.55
STRONG, LONG = 0.7, 12
FEW = 3
ANSWER = 5
LEAST = 8
ITEMS, GROUP = 256, 4

_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]{}<>"]] = True


def bare_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of words without marks at their ends; words of marks alone are left out."""
    raw = lowered(raw)
    starts, ends, doc = word_spans(raw, off)
    for _ in range(3):
        if not len(starts):
            break
        last = _TRIM[raw[ends - 1]] & (ends > starts)
        ends = ends - last
        some = ends > starts
        starts, ends, doc = starts[some], ends[some], doc[some]
        if len(starts):
            starts = starts + _TRIM[raw[starts]]
            some = ends > starts
            starts, ends, doc = starts[some], ends[some], doc[some]
    return span_hash(raw, starts, ends), doc


def buckets_of(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(BUCKETS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all documents: in how many each bucket occurs, and how many there are."""

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for lo, hi, raw, off in blocks(batch.column(0)):
                key, doc = bare_words(raw, off)
                pairs = np.unique(doc * np.int64(BUCKETS) + buckets_of(key))
                df += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
                n += hi - lo
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, BUCKETS), pa.int32()), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in got:
        df[r["bucket"]] = r["n"]
    return df[:BUCKETS], int(df[BUCKETS])


def passages(key: np.ndarray, doc: np.ndarray, size: int = PASSAGE) -> np.ndarray:
    """Numbers the passages: each text in even cuts of at most ``size`` words."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
    words = np.diff(np.append(first, len(doc)))
    cuts = -(-words // size)
    local = np.arange(len(doc)) - np.repeat(first, words)
    return np.repeat(np.cumsum(cuts) - cuts, words) + local * np.repeat(cuts, words) // np.repeat(words, words)


def latent_basis(texts: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = ROUNDS, seed: int = 17) -> np.ndarray:
    """The latent space of the texts' passages by randomised SVD; ``texts`` has few partitions."""
    spark = texts.sparkSession
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(BUCKETS, rank)))[0].astype(np.float32)
    r = np.eye(rank)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((q, idf))

        def multiply(batches, shared=shared):
            basis, weights = shared.value
            z = np.zeros((BUCKETS, rank))
            for batch in batches:
                for _, _, raw, off in blocks(batch.column(0)):
                    key, doc = bare_words(raw, off)
                    if not len(key):
                        continue
                    b, p = buckets_of(key), passages(key, doc)
                    w = weights[b]
                    w = (w / np.maximum(np.sqrt(np.bincount(p, weights=w * w)), 1e-9)[p]).astype(np.float32)
                    y = np.add.reduceat(basis[b] * w[:, None], np.flatnonzero(np.append(True, np.diff(p) > 0)), axis=0)
                    np.add.at(z, b, w[:, None] * y[p])
            yield pa.record_batch([pa.array([z.astype(np.float32).tobytes()], pa.binary())], names=["z"])

        got = texts.select("text").mapInArrow(multiply, "z binary").collect()  # one row of 6 MB for each of few partitions
        q, r = np.linalg.qr(sum(np.frombuffer(x["z"], np.float32).reshape(BUCKETS, rank).astype(float) for x in got))
        q = q.astype(np.float32)
        shared.unpersist()
    u, s, _ = np.linalg.svd(r)
    return np.ascontiguousarray((q @ u) * (s > 1e-6 * max(s[0], 1e-9)), dtype=np.float32)  # directions of no passage are none


class Items:
    """A block of benchmark items: words, answers, and the latent vectors of their passages."""

    def __init__(self, texts: list[str], df: np.ndarray, idf: np.ndarray, basis: np.ndarray):
        self.idf, self.basis, self.words, self.answers = idf, basis, [], []
        holds = np.zeros((len(texts), BUCKETS), bool)
        whole_key, whole_item, whole_at = [], [], []
        vectors, pieces = [], []
        for i, text in enumerate(texts):
            raw = np.frombuffer(text.encode(), np.uint8)
            key, doc = bare_words(raw, np.array([0, len(raw)]))
            self.words.append(key)
            bucket = buckets_of(key)
            rare = np.lexsort((np.arange(len(key)), df[bucket]))
            _, once = np.unique(key[rare], return_index=True)
            rare = rare[np.sort(once)]  # each word once, the rarest first
            few = len(key) < LEAST or len(rare) < FEW
            rare = rare[df[bucket[rare]] > 0]  # words of no document at all tell nothing
            self.answers.append(key[rare[:ANSWER]])
            if few:
                if len(key) and (df[bucket] > 0).all():  # else it stands nowhere
                    whole_key.append(key[rare[0]])
                    whole_item.append(i)
                    whole_at.append(rare[0])
                continue
            holds[i, bucket] = True
            cuts = np.flatnonzero(np.append(True, np.diff(passages(key, doc)) > 0))
            for at, size in zip(cuts.tolist(), np.diff(np.append(cuts, len(key))).tolist(), strict=True):
                w = idf[bucket[at : at + size]]
                vectors.append(w @ basis[bucket[at : at + size]] / max(float(np.sqrt(w @ w)), 1e-9))
                pieces.append((i, at, size))
        self.piece_item, self.piece_at, self.piece_size = (np.array(x, np.int64) for x in (zip(*pieces, strict=True) if pieces else ([], [], [])))
        vectors = np.array(vectors, np.float32).reshape(-1, basis.shape[1])
        self.energy = np.linalg.norm(vectors, axis=1)
        self.vectors = vectors / np.maximum(self.energy, 1e-9)[:, None]
        long_enough = np.searchsorted(np.array(LENGTHS) * CHUNK, self.piece_size)
        self.lengths = [(m, np.flatnonzero((long_enough == k) & (self.energy > 1e-6))) for k, m in enumerate(LENGTHS)]
        self.lengths = [(m, of) for m, of in self.lengths if len(of)]
        self.holds = np.packbits(holds, axis=1)
        self.size = np.array([len(w) for w in self.words], np.int64)
        order = np.argsort(np.array(whole_key, np.uint64), kind="stable")
        self.whole_key, self.whole_item, self.whole_at = np.array(whole_key, np.uint64)[order], np.array(whole_item, np.int64)[order], np.array(whole_at, np.int64)[order]
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([np.empty(0, np.uint64), *self.words])

    def hidden(self) -> set[int]:
        """Items with a passage of which the space shows too little."""
        return set(self.piece_item[self.energy < SHOWN].tolist())


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        hit = np.where(b == x, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], hit))
    return int(row[-1])


def _windows(chunks: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(first chunk, last chunk + 1) of the windows of ``m`` chunks of texts with so many chunks; the last one ends with its text."""
    stride = max(1, m // 3)
    count = np.maximum(-(-(chunks - m) // stride), 0) + 1
    text = np.repeat(np.arange(len(chunks)), count)
    start = np.minimum(ragged(np.zeros(len(chunks), np.int64), count) * stride, np.maximum(chunks - m, 0)[text])
    base = (np.cumsum(chunks) - chunks)[text]
    return base + start, base + np.minimum(start + m, chunks[text])


def candidates(key: np.ndarray, doc: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(first word, last word + 1, passage, cosine) of the windows that lie near a passage in the latent space and have enough of its words."""
    none = np.empty(0, np.int64)
    found = [(none, none, none, np.empty(0))]
    bucket = buckets_of(key)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else none
    words = np.diff(np.append(first, len(doc)))
    chunks = -(-words // CHUNK)
    begin = np.append(np.repeat(first, chunks) + CHUNK * ragged(np.zeros(len(chunks), np.int64), chunks), len(key))  # first word of each chunk
    windows = [(of, *_windows(chunks, m)) for m, of in items.lengths]
    for lo in range(0, len(begin) - 1, STRETCH):
        hi = min(len(begin) - 1, lo + STRETCH + LENGTHS[-1])
        part = bucket[begin[lo] : begin[hi]]
        at = begin[lo:hi] - begin[lo]
        w = items.idf[part]
        x = items.basis.take(part, axis=0)
        x *= w[:, None]
        sums, norm = np.zeros((hi - lo + 1, x.shape[1]), np.float32), np.zeros(hi - lo + 1)
        np.cumsum(np.add.reduceat(x, at, axis=0), axis=0, out=sums[1:])
        np.cumsum(np.add.reduceat(w * w, at), out=norm[1:])
        for of, starts, stops in windows:
            a, b = np.searchsorted(starts, [lo, lo + STRETCH])
            s, t = starts[a:b], stops[a:b]
            y = sums.take(t - lo, axis=0)
            y -= sums.take(s - lo, axis=0)
            length = np.sqrt(np.einsum("ij,ij->i", y, y))
            shown = length / np.sqrt(np.maximum(norm[t - lo] - norm[s - lo], 1e-9))
            some = np.flatnonzero(shown >= ENERGY * items.energy[of].min())
            dots = y.take(some, axis=0) @ items.vectors[of].T
            row, col = np.nonzero((dots >= COSINE * length[some, None]) & (shown[some, None] >= ENERGY * items.energy[of]))
            cosine = dots[row, col] / length[some[row]]
            s, t, piece = begin[s[some[row]]], begin[t[some[row]]], of[col]
            for k in range(0, len(s), 1 << 14):
                near = slice(k, k + (1 << 14))
                place = s[near, None] + np.arange(LENGTHS[-1] * CHUNK)
                inside = place < t[near, None]
                b_ = bucket[np.minimum(place, len(bucket) - 1)]
                shared = ((items.holds[items.piece_item[piece[near], None], b_ >> 3] >> (7 - (b_ & 7)).astype(np.uint8)) & 1 & inside).sum(axis=1)
                good = np.flatnonzero(shared >= OVERLAP * items.piece_size[piece[near]]) + k
                found.append((s[good], t[good], piece[good], cosine[good]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def regions(key: np.ndarray, doc: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(document, item, first word, last word + 1, best cosine) of candidates that stand in fitting places."""
    start, _, piece, cosine = candidates(key, doc, items)
    item = items.piece_item[piece]
    begin, d = start - items.piece_at[piece], doc[start]
    order = np.lexsort((begin, item, d))
    begin, item, d, cosine = begin[order], item[order], d[order], cosine[order]
    if not len(d):
        return (np.empty(0, np.int64),) * 5
    slack = np.maximum(8, items.size[item] // 4 + 4)
    head = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[1:])))
    last = np.append(head[1:], len(d)) - 1
    of, pad = item[head], slack[head]
    low, high = np.searchsorted(doc, d[head], "left"), np.searchsorted(doc, d[head], "right")
    return d[head], of, np.maximum(begin[head] - pad, low), np.minimum(begin[last] + items.size[of] + pad, high), np.maximum.reduceat(cosine, head)


def whole_places(key: np.ndarray, doc: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, first word) of the first place of each short item whose words all stand in a row."""
    low = np.searchsorted(items.whole_key, key, "left")
    n = np.searchsorted(items.whole_key, key, "right") - low
    whole = ragged(low, n)
    item = items.whole_item[whole]
    begin = np.repeat(np.arange(len(key)), n) - items.whole_at[whole]
    alive = np.flatnonzero((begin >= 0) & (begin + items.size[item] <= len(key)))
    item, begin = item[alive], begin[alive]
    alive = doc[begin] == doc[begin + items.size[item] - 1]
    item, begin = item[alive], begin[alive]
    for j in range(int(items.size[item].max(initial=0))):
        at = np.minimum(j, items.size[item] - 1)
        alive = key[begin + at] == items.flat[items.first[item] + at]
        item, begin = item[alive], begin[alive]
    order = np.lexsort((begin, item, doc[begin]))
    item, begin = item[order], begin[order]
    new = np.append(True, (np.diff(doc[begin]) != 0) | (np.diff(item) != 0)) if len(item) else np.empty(0, bool)
    return doc[begin[new]], item[new], begin[new]


def judge(words: np.ndarray, item: int, items: Items) -> tuple[int, float] | None:
    """(common words in order, share of answer words) of a leak, else None."""
    n = len(items.words[item])
    # the stretch of the region that the item's words cover is what is compared
    inside = np.flatnonzero(np.isin(words, items.words[item]))
    if len(inside) < SHARE * n:
        return None
    span = words[inside[0] : inside[-1] + 1]
    common = common_subsequence(items.words[item], span)
    answers = items.answers[item]
    share = float(np.isin(answers, span).mean()) if len(answers) else 0.0
    leak = common >= SHARE * n and share >= 0.5 or n >= LONG and common >= STRONG * n
    return (common, share) if leak else None


def _asked(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> list:
    """Groups of up to ``GROUP`` blocks, each with the ids of its items and the items with their latent space, broadcast; ``docs`` has the column text."""
    spark = docs.sparkSession
    small_batches(spark)
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(1e-3)
    asked = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    block_of = F.floor(F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 30)) * F.lit(max(1, -(-asked.count() // ITEMS))) / float(1 << 30)).cast("int")
    asked = asked.withColumn("block", block_of)
    found = []
    for (block,) in asked.select("block").distinct().orderBy("block").collect():
        todo = [asked.filter(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").collect()]  # about ITEMS
        while todo:
            rows = todo.pop()
            space = latent_basis(spark.createDataFrame([(r["text"],) for r in rows], "text string").repartition(2), idf)
            items = Items([r["text"] for r in rows], df, idf, space)
            hidden = items.hidden() if len(rows) > 1 else set()
            if hidden and len(hidden) == len(rows):
                todo += [rows[::2], rows[1::2]]
                continue
            if hidden:
                todo.append([r for i, r in enumerate(rows) if i in hidden])
                rows = [r for i, r in enumerate(rows) if i not in hidden]
                items = Items([r["text"] for r in rows], df, idf, space)
            found.append(([r["item_id"] for r in rows], items))
    release()
    return [([ids for ids, _ in found[k : k + GROUP]], spark.sparkContext.broadcast([items for _, items in found[k : k + GROUP]])) for k in range(0, len(found), GROUP)]  # 8 MB a block


def told_of(texts: pa.Array, group: list[Items]) -> list[tuple]:
    """(row, block, item, first word, words, cosine, common words, item's words, answer share) of the leaks in some texts."""
    out = []
    for lo, _, raw, off in blocks(texts):
        key, doc = bare_words(raw, off)
        for block, items in enumerate(group):
            for d, i, a, b, cosine in zip(*(x.tolist() for x in regions(key, doc, items)), strict=True):
                told = judge(key[a:b], i, items)
                if told:
                    out.append((lo + d, block, i, a - int(np.searchsorted(doc, d, "left")), b - a, cosine, told[0], len(items.words[i]), told[1]))
            if len(items.whole_key):
                for d, i, a in zip(*(x.tolist() for x in whole_places(key, doc, items)), strict=True):
                    n = len(items.words[i])
                    out.append((lo + d, block, i, a - int(np.searchsorted(doc, d, "left")), n, 1.0, n, n, 1.0))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, cosine, common_words, item_words, answer_share): one row per document and leaked item."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {kind}, item_id {item_kind}, first_word long, n_words long, cosine double, common_words long, item_words long, answer_share double"
    found = spark.createDataFrame([], schema)
    for ids, group in _asked(docs, benchmark, item_col, item_text):

        def search(batches, group=group, ids=ids):
            for batch in batches:
                got = told_of(batch.column(1), group.value)
                columns = list(zip(*got, strict=True)) if got else [[]] * 9
                item_ids = pa.array([ids[block][i] for block, i in zip(columns[1], columns[2], strict=True)], pa.infer_type([x for block in ids for x in block]))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
                rest = [pa.array(c, k) for c, k in zip(columns[3:], kinds, strict=True)]
                yield pa.record_batch([batch.column(0).take(pa.array(columns[0], pa.int64())), item_ids, *rest], names=["doc_id", "item_id", "first_word", "n_words", "cosine", "common_words", "item_words", "answer_share"])

        found = found.unionByName(docs.mapInArrow(search, schema))
    best = F.max_by(F.struct("first_word", "n_words", "cosine", "common_words", "item_words", "answer_share"), F.struct("common_words", -F.col("first_word"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows in whose text no benchmark item is found.

    Each row is judged by its own text, without a join: null and repeated ids and extra columns of any name make no difference."""
    known = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = _asked(known, benchmark, item_col, item_text)
    at = docs.columns.index(text_col)
    for _, group in asked:

        def clean(batches, group=group):
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[row for row, *_ in told_of(batch.column(at), group.value)]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
