"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its hashed embedding beside the mean of its hashed character
4-grams' embeddings.  Windows of ``WINDOW`` words, one every ``STRIDE`` words and
one at the very end, cover the whole text; each goes through a forward and a
backward GRU, attention pools the states, and a document's logit is that of its
most toxic window.  Training (AdaGrad, back-propagation through time, the top
window of each document) uses at most about ``PER_CLASS`` labelled documents and
``SAMPLE_BYTES`` of text of each label, picked by a hash of the id; the first column of the
embeddings starts from smoothed log-odds in that sample.  A logistic calibration, weighted
to the labels' shares among all training rows, makes the logit a probability: it is fitted
on logits that networks trained without each of ``FOLDS`` parts give to that part, while
the network that scores learns from all parts.  The trainings run side by side on
executors; the driver sees only networks (1 MB each) and logits.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case.  Every text is read
whole; a null or empty text, or one of white space, has no window and gets the share of
label 1 among the training rows.  Without labels of both kinds every score is the labels' mean (0 if
there are none).  Repeated rows score alike; an empty table gives an empty result.
Equal windows tie without effect, since only the largest logit counts.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, lowered, release, span_hash, tidy, word_spans

WINDOW, STRIDE = 32, 16
PER_CLASS = 1500
SAMPLE_BYTES = 32 << 20
FOLDS = 3
WORD_ROWS, CHAR_ROWS, DIM, HIDDEN = 1 << 14, 1 << 14, 8, 8
BATCH = 2048
TRAIN_BYTES = 1 << 20


class Words:
    """The different words of a block: embedding rows, 4-gram rows, and each token's word."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        raw = lowered(raw)
        starts, ends, doc = word_spans(raw, off)
        self.counts = np.bincount(doc, minlength=len(off) - 1)
        key = span_hash(raw, starts, ends)
        self.keys, first, self.token = np.unique(key, return_index=True, return_inverse=True)
        self.row = (self.keys & np.uint64(WORD_ROWS - 1)).astype(np.int64)
        a, b = starts[first], ends[first]
        # four bytes of "<word>": one gram for each byte, with a mark beyond either end
        size = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum())) if len(a) else np.empty(0, np.int64)
        owner_first, owner_last = np.repeat(a, size), np.repeat(b - 1, size)
        here = raw[at].astype(np.uint32)
        left = np.where(at > owner_first, raw[np.maximum(at - 1, 0)], 2).astype(np.uint32)
        right = np.where(at < owner_last, raw[np.minimum(at + 1, max(len(raw) - 1, 0))], 3).astype(np.uint32) if len(raw) else here
        after = np.where(at + 1 < owner_last, raw[np.minimum(at + 2, max(len(raw) - 1, 0))], 4).astype(np.uint32) if len(raw) else here
        mixed = (left * np.uint32(2654435761)) ^ (here * np.uint32(2246822519)) ^ (right * np.uint32(3266489917)) ^ (after * np.uint32(374761393))
        mixed ^= mixed >> np.uint32(15)
        self.grams = ((mixed * np.uint32(668265263)) >> np.uint32(32 - CHAR_ROWS.bit_length() + 1)).astype(np.int64)
        self.gram_start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(4-gram rows, how many of them each word has) of some words."""
        size = np.diff(self.gram_start)[words]
        total = np.cumsum(size)
        return self.grams[np.repeat(self.gram_start[words] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)], size

    def inputs(self, net: dict, words: np.ndarray | None = None) -> np.ndarray:
        words = np.arange(len(self.row)) if words is None else words
        out = np.zeros((len(words), 2 * DIM), np.float32)
        out[:, :DIM] = net["words"][self.row[words]]
        for lo in range(0, len(words), 20_000):
            grams, size = self.grams_of(words[lo : lo + 20_000])
            out[lo : lo + 20_000, DIM:] = np.add.reduceat(net["chars"][grams], np.cumsum(size) - size, axis=0) / size[:, None].astype(np.float32)
        return out


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first token within the block) of all windows; documents without words have none."""
    base = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.empty(0, np.int64)
    n = np.where(counts > WINDOW, -((WINDOW - counts) // STRIDE) + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, base[doc] + np.minimum(k * STRIDE, np.maximum(counts[doc] - WINDOW, 0))


def new_net(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net = {"words": rng.normal(0, 0.05, (WORD_ROWS, DIM)), "chars": rng.normal(0, 0.05, (CHAR_ROWS, DIM))}
    for side in "fb":
        for gate in "zrn":
            net[f"W{gate}{side}"] = rng.normal(0, 0.3, (2 * DIM, HIDDEN))
            net[f"U{gate}{side}"] = rng.normal(0, 0.2, (HIDDEN, HIDDEN))
            net[f"c{gate}{side}"] = np.zeros(HIDDEN)
        net[f"a{side}"] = rng.normal(0, 0.3, HIDDEN)
        net[f"o{side}"] = rng.normal(0, 0.3, HIDDEN)
    net["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in net.items()}


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def window_logits(net: dict, tables: dict, index: np.ndarray, real: np.ndarray | None, tape: dict | None = None) -> np.ndarray:
    """Logits of windows; index (steps, windows) into the tables of input projections, real marks true tokens."""
    steps, n = index.shape
    attend, value = np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
    for side in "fb":
        Uz, Ur, Un = net[f"Uz{side}"], net[f"Ur{side}"], net[f"Un{side}"]
        Pz, Pr, Pn = tables[f"z{side}"], tables[f"r{side}"], tables[f"n{side}"]
        ends = np.stack([net[f"a{side}"], net[f"o{side}"]], axis=1)
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            i = index[t]
            z = sigmoid(Pz.take(i, axis=0) + h @ Uz)
            r = sigmoid(Pr.take(i, axis=0) + h @ Ur)
            q = h @ Un
            c = np.tanh(Pn.take(i, axis=0) + r * q)
            new = c + z * (h - c)
            if real is not None:
                new = np.where(real[t][:, None], new, h)
            if tape is not None:
                tape[side, t] = (h, z, r, q, c, new)
            h = new
            s = h @ ends
            attend[t] += s[:, 0]
            value[t] += s[:, 1]
    if real is not None:
        attend = np.where(real, attend, -1e9)
    e = np.exp(attend - attend.max(axis=0))
    weight = e / e.sum(axis=0)
    logit = (weight * value).sum(axis=0)
    if tape is not None:
        tape["pool"] = (weight, value, logit)
    return logit + net["bias"][0]


def projections(net: dict, x: np.ndarray) -> dict:
    return {f"{g}{s}": x @ net[f"W{g}{s}"] + net[f"c{g}{s}"] for g in "zrn" for s in "fb"}


def block_logits(net: dict, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(each document's largest window logit, its window, windows' documents, windows' starts)."""
    docs = len(words.counts)
    doc, start = windows(words.counts)
    tables = projections(net, words.inputs(net))
    logits = np.empty(len(doc), np.float32)
    short = words.counts[doc] < WINDOW
    step = np.arange(WINDOW)[:, None]
    for picked, partial in ((np.flatnonzero(~short), False), (np.flatnonzero(short), True)):
        for lo in range(0, len(picked), BATCH):
            w = picked[lo : lo + BATCH]
            if partial:
                real = step < words.counts[doc[w]]
                logits[w] = window_logits(net, tables, words.token[np.where(real, start[w] + step, start[w])], real)
            else:
                logits[w] = window_logits(net, tables, words.token[start[w] + step], None)
    best, where = np.full(docs, -np.inf, np.float32), np.full(docs, -1, np.int64)
    if len(doc):
        order = np.lexsort((-logits, doc))
        top = order[np.unique(doc[order], return_index=True)[1]]
        best[doc[top]], where[doc[top]] = logits[top], top
    return best, where, doc, start


def gradients(net: dict, words: Words, index: np.ndarray, real: np.ndarray, label: np.ndarray) -> dict:
    """Of the mean cross-entropy of some windows."""
    used, at = np.unique(words.token[index], return_inverse=True)
    at = at.reshape(index.shape)
    x = words.inputs(net, used)
    tape: dict = {}
    logit = window_logits(net, projections(net, x), at, real, tape)
    steps, n = at.shape
    d_logit = (sigmoid(logit) - label) / n
    weight, value, pooled = tape["pool"]
    d_value = weight * d_logit
    d_attend = weight * (value - pooled) * d_logit
    g = {k: np.zeros_like(v) for k, v in net.items() if k not in ("words", "chars")}
    g["bias"][0] = d_logit.sum()
    dx = np.zeros_like(x)
    for side in "fb":
        dh = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
            h, z, r, q, c, new = tape[side, t]
            g[f"a{side}"] += (new * d_attend[t][:, None]).sum(axis=0)
            g[f"o{side}"] += (new * d_value[t][:, None]).sum(axis=0)
            dh = dh + d_attend[t][:, None] * net[f"a{side}"] + d_value[t][:, None] * net[f"o{side}"]
            m = real[t][:, None]
            dn = np.where(m, dh, 0)
            keep = np.where(m, 0, dh)
            dz = dn * (h - c) * z * (1 - z)
            dc = dn * (1 - z) * (1 - c * c)
            dr = dc * q * r * (1 - r)
            dq = dc * r
            back = dn * z + keep + dz @ net[f"Uz{side}"].T + dr @ net[f"Ur{side}"].T + dq @ net[f"Un{side}"].T
            g[f"Uz{side}"] += h.T @ dz
            g[f"Ur{side}"] += h.T @ dr
            g[f"Un{side}"] += h.T @ dq
            xi = x[at[t]]
            for gate, d in (("z", dz), ("r", dr), ("n", dc)):
                g[f"W{gate}{side}"] += xi.T @ d
                g[f"c{gate}{side}"] += d.sum(axis=0)
                np.add.at(dx, at[t], d @ net[f"W{gate}{side}"].T)
            dh = back
    g["word rows"], g["word grads"] = words.row[used], dx[:, :DIM]
    g["char rows"], size = words.grams_of(used)
    g["char grads"] = np.repeat(dx[:, DIM:] / size[:, None], size, axis=0)
    return g


def _start_from_log_odds(net: dict, parts: list[Words], labels: list[np.ndarray]) -> None:
    everything = np.concatenate(labels)
    nb, ng = max(everything.sum(), 1), max((1 - everything).sum(), 1)
    for name, size in (("words", WORD_ROWS), ("chars", CHAR_ROWS)):
        bad, good = np.zeros(size), np.zeros(size)
        for words, y in zip(parts, labels, strict=True):
            doc = np.repeat(np.arange(len(words.counts)), words.counts)
            if name == "words":
                pairs = np.unique(doc * np.int64(size) + words.row[words.token])
            else:
                each = np.unique(doc * np.int64(max(len(words.row), 1)) + words.token)
                d, u = each // max(len(words.row), 1), each % max(len(words.row), 1)
                grams, n = words.grams_of(u)
                pairs = np.unique(np.repeat(d, n) * np.int64(size) + grams)
            d, row = pairs // size, pairs % size
            bad += np.bincount(row, weights=y[d], minlength=size)
            good += np.bincount(row, weights=1 - y[d], minlength=size)
        p, q = (bad + 1) / (nb + 2), (good + 1) / (ng + 2)
        sure = np.abs(p - q) / np.sqrt(p * (1 - p) / nb + q * (1 - q) / ng + 1e-9) > 3.5
        net[name][:, 0] += np.where(sure, np.clip(np.log(p / q), -3, 3), 0).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, steps: int = 600, batch: int = 32, rate: float = 0.05, seed: int = 3) -> dict:
    """A network fitted to whole labelled texts."""
    net = new_net(seed)
    rng = np.random.default_rng(seed)
    mixed = rng.permutation(len(texts))
    column = pa.array([texts[i] for i in mixed], pa.large_string())
    parts, ys = [], []
    for lo, hi, raw, off in blocks(column, TRAIN_BYTES):
        parts.append(Words(raw, off))
        ys.append(labels[mixed[lo:hi]].astype(np.float64))
    _start_from_log_odds(net, parts, ys)
    square = {k: np.full_like(v, 1e-4) for k, v in net.items()}
    step = np.arange(WINDOW)[:, None]
    for _ in range(max(4, -(-steps * batch // max(len(texts), 1)))):
        for k in rng.permutation(len(parts)):
            words, y = parts[k], ys[k].astype(np.float32)
            base = np.concatenate([[0], np.cumsum(words.counts)[:-1]])
            _, where, _, start = block_logits(net, words)
            usable = np.flatnonzero(words.counts > 0)
            for docs in np.array_split(rng.permutation(usable), max(1, len(usable) // batch)):
                if not len(docs):
                    continue
                at = start[where[docs]]
                real = step < np.minimum(words.counts[docs] - (at - base[docs]), WINDOW)
                g = gradients(net, words, np.where(real, at + step, at), real, y[docs])
                for name in ("word", "char"):
                    key, rows, d = name + "s", g.pop(f"{name} rows"), g.pop(f"{name} grads")
                    r, inv = np.unique(rows, return_inverse=True)
                    total = np.zeros((len(r), DIM), np.float32)
                    np.add.at(total, inv, d)
                    square[key][r] += total * total
                    net[key][r] -= rate * total / np.sqrt(square[key][r])
                for name, d in g.items():
                    square[name] += d * d
                    net[name] -= rate * d / np.sqrt(square[name])
    return net


def calibrate(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a weighted logistic fit (Newton steps, a little ridge, scale above 0)."""
    x = np.stack([logits, np.ones_like(logits)], axis=1).astype(float)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - labels)) + 1e-3 * (w - [1.0, 0.0])
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return max(float(w[0]), 0.05), float(w[1])


class Model:
    def __init__(self, net: dict | None, scale: float, shift: float, constant: float = 0.0):
        self.net, self.scale, self.shift, self.constant = net, scale, shift, constant

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.constant)
        if self.net is None:
            return out
        for lo, hi, raw, off in blocks(column):
            best = block_logits(self.net, Words(raw, off))[0].astype(float)
            out[lo:hi] = np.where(np.isfinite(best), sigmoid(self.scale * np.where(np.isfinite(best), best, 0) + self.shift), self.constant)
        return out


def _logits(net: dict, texts: list[str]) -> np.ndarray:
    raw = np.clip(Model(net, 1.0, 0.0).scores(pa.array(texts, pa.large_string())), 1e-7, 1 - 1e-7)
    return np.log(raw / (1 - raw))


def _trained(frame: pd.DataFrame) -> pd.DataFrame:
    """One training: job k < ``FOLDS`` learns without part k and gives its logits, the last job learns from all rows."""
    job = int(frame["job"].iloc[0])
    frame = frame.sort_values(["label", "id", "text"], kind="stable", ignore_index=True)
    texts, y, held = frame["text"].tolist(), frame["label"].to_numpy(), (frame["part"] == job).to_numpy()
    if len(set(y[~held])) < 2 or job < FOLDS and (len(y) < 60 or not held.any()):
        return pd.DataFrame({"job": [job], "net": [None], "logits": [None], "labels": [None]})
    net = train([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
    told = (held if job < FOLDS else np.ones(len(y), bool)) & np.array([bool(t.split()) for t in texts])
    logits = _logits(net, [t for t, h in zip(texts, told, strict=True) if h])
    release()  # what the training took
    return pd.DataFrame({"job": [job], "net": [pickle.dumps(net) if job == FOLDS else None], "logits": [logits.tobytes()], "labels": [y[told].astype(np.int64).tobytes()]})


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, shares: dict[int, int] | None = None) -> Model:
    """A model from rows with a label of 0 or 1; ``shares``: how often each label is there, if the rows are a sample."""
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"))
    there = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if len(there) < 2:
        return Model(None, 1.0, 0.0, float(max(there, default=0)))
    wanted = {y: min(1.0, per_class / r["n"], SAMPLE_BYTES / max(r["size"], 1)) for y, r in there.items()}
    place = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(place < F.when(F.col("label") == 1, wanted[1]).otherwise(wanted[0]))
    sample = sample.withColumn("part", F.crc32(F.concat(F.lit("t"), F.coalesce("id", F.lit(""))).cast("binary")) % FOLDS)
    jobs = sample.withColumn("job", F.explode(F.array(*map(F.lit, range(FOLDS + 1))))).repartitionById(FOLDS + 1, F.col("job"))
    got = {r["job"]: r for r in jobs.groupBy("job").applyInPandas(_trained, "job int, net binary, logits binary, labels binary").collect()}
    true = shares or {k: r["n"] for k, r in there.items()}
    constant = Model(None, 1.0, 0.0, true[1] / (true[0] + true[1]))
    if FOLDS not in got or got[FOLDS]["net"] is None:  # the sample has one label only
        return constant
    unseen = [r for k, r in sorted(got.items()) if k < FOLDS and r["logits"] is not None] or [got[FOLDS]]
    z, y = np.concatenate([np.frombuffer(r["logits"]) for r in unseen]), np.concatenate([np.frombuffer(r["labels"], np.int64) for r in unseen])
    if len(set(y)) < 2:
        return constant
    weight = np.where(y == 1, true[1] / (y == 1).sum(), true[0] / (y == 0).sum())
    return Model(pickle.loads(got[FOLDS]["net"]), *calibrate(z, y, weight / weight.mean()), constant.constant)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.scores(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def _learn(docs: DataFrame, labels: DataFrame, is_training: Column, id_col: str, text_col: str, per_class: int) -> Model:
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    rows = docs.filter(is_training).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # which documents to read is settled on ids alone; their texts are taken by a broadcast of about 3 * per_class ids
    there = rows.select("doc_id").join(known, F.col("doc_id") == F.col("_id")).select("_id", "_toxic").distinct()
    there = Scratch(docs.sparkSession, "toxic").keep(there, "labelled")
    shares = {r["_toxic"]: r["count"] for r in there.groupBy("_toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("_toxic") == 1, min(1.0, 1.5 * per_class / max(shares.get(1, 1), 1))).otherwise(min(1.0, 1.5 * per_class / max(shares.get(0, 1), 1)))
    picked = rows.join(F.broadcast(there.filter(place < share)), rows["doc_id"] == F.col("_id")).select("doc_id", "text", F.col("_toxic").alias("toxic"))
    return fit(picked, "doc_id", "text", "toxic", per_class, shares if len(shares) == 2 else None)


def toxicity(docs: DataFrame, labels: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """Learns from labelled training rows and scores every document: doc_id and score."""
    return score(docs, _learn(docs, labels, is_training, id_col, text_col, per_class), id_col, text_col)


def reject(docs: DataFrame, labels: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """Learns likewise and returns the whole rows whose score is below the threshold.

    Each row is judged by its own text, without a join: null and repeated ids and extra columns of any name make no difference."""
    model = _learn(docs, labels, is_training, id_col, text_col, per_class)
    at = docs.columns.index(text_col)

    @tidy
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
