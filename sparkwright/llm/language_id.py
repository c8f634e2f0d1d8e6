"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased by single characters, everything but letters becomes a space
(runs of them one), and the n-grams of 1 to 3 characters are hashed into ``DIMS``
columns.  A row is sqrt(tf) * idf, scaled to unit length.  Document frequencies cover
every training document.  The weights are trained by follow-the-regularised-leader
with elastic-net penalties on at most about ``PER_LANGUAGE`` documents of each
language (picked by a hash of the id; of about ``SAMPLE_BYTES`` of text in all, so that neither long texts
nor many languages fill the driver), and a temperature is fitted on a held-back tenth of them.  More than ``max_languages`` different languages are an error, since
the weights have a column for each; none is left out silently.

Documents are scored whole.  A null text, or one without letters, is ``und`` with
score 0; so is every document if there is nothing to learn from.  Languages that
occur in no training row are never predicted.  Ties go to the first language in
alphabetical order.  Repeated rows are predicted alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks

DIMS = 1 << 14
PER_LANGUAGE = 1500
SAMPLE_BYTES = 24 << 20
MAX_LANGUAGES = 1000
ROWS = 32  # documents that are held as dense rows at a time


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """``_letter`` of the first 65,536 characters."""
    return np.array([_letter(c) for c in range(65536)], np.uint32)


def _letter(c: int) -> int:
    """A character's lower case if it is a letter, else a space."""
    s = chr(c)
    if not s.isalpha():
        return 32
    low = s.lower()
    return ord(low) if len(low) == 1 else c


def characters(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters and single spaces, offsets) of a block; every document starts with a space."""
    if not len(raw):
        return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=first[1:])
    where = first[off]
    text = _letters()[np.minimum(points, 65535)]
    beyond = np.flatnonzero(points >= 65536)
    if len(beyond):
        different, inverse = np.unique(points[beyond], return_inverse=True)
        text[beyond] = np.array([_letter(c) for c in different.tolist()], np.uint32)[inverse]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    keep[where[:-1][where[:-1] < len(text)]] = True
    kept = np.zeros(len(text) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return text[keep], kept[where]


def gram_counts(text: np.ndarray, off: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed 1- to 3-grams, a dense row for each document."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    one = text * np.uint32(2654435761)
    keys = [(doc * dims) + (one >> shift)]
    if len(text) > 1:
        two = (one[:-1] ^ (text[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        same = doc[1:] == doc[:-1]
        keys.append(((doc[1:] * dims) + (two >> shift))[same])
        if len(text) > 2:
            three = (two[:-1] ^ (text[2:] * np.uint32(668265263))) * np.uint32(374761393)
            keys.append(((doc[2:] * dims) + (three >> shift))[doc[2:] == doc[:-2]])
    return np.bincount(np.concatenate(keys), minlength=n * dims).reshape(n, dims)


def dense_rows(column: pa.Array, dims: int = DIMS):
    """(first row, counts, whether there are letters) for runs of documents."""
    for lo, _, raw, off in blocks(column):
        text, at = characters(raw, off)
        for k in range(0, len(at) - 1, ROWS):
            cut = at[k : k + ROWS + 1]
            part = text[cut[0] : cut[-1]]
            counts = gram_counts(part, cut - cut[0], dims)
            letters = np.zeros(len(part) + 1, np.int64)
            np.cumsum(part != 32, out=letters[1:])
            yield lo + k, counts, np.diff(letters[cut - cut[0]]) > 0


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.sqrt(counts.astype(np.float32)) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.maximum(norm, 1e-12)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, dims: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dims, classes) and bias by per-coordinate FTRL-proximal."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    rng = np.random.default_rng(seed)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x = rows[k]
            i, x = np.append(i, dims), np.append(x, 1.0)
            w = weights(i)
            g = softmax(x @ w)
            g[labels[k]] -= 1
            g = x[:, None] * g[None, :]
            old = n[i]
            new = old + g * g
            z[i] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[i] = new
    w = weights(np.arange(dims + 1))
    return w[:dims].astype(np.float32), w[dims]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, languages, idf, weights, bias, heat):
        self.languages, self.idf, self.weights, self.bias, self.heat = languages, idf, weights, bias, heat

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return softmax((tfidf(counts, self.idf) @ self.weights + self.bias) / self.heat)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, dims: int = DIMS, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """A model from rows with a language; None if there are none.  ValueError beyond ``max_languages``."""
    rows = train.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"))

    def frequencies(batches):
        df, docs = np.zeros(dims, np.int64), 0
        for batch in batches:
            for _, counts, some in dense_rows(batch.column(0), dims):
                df += (counts[some] > 0).sum(axis=0)
                docs += int(some.sum())
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, dims), pa.int32()), pa.array(np.append(df[at], docs), pa.int64())], names=["column", "n"])

    found = rows.select("text").mapInArrow(frequencies, "column int, n long").groupBy("column").agg(F.sum("n").alias("n")).collect()  # dims + 1 rows at most
    df = np.zeros(dims + 1)
    for r in found:
        df[r["column"]] = r["n"]
    idf = (np.log((1 + df[dims]) / (1 + df[:dims])) + 1).astype(np.float32)

    told = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).limit(max_languages + 1).collect()}
    sizes = {lang: r["n"] for lang, r in told.items()}
    if not sizes:
        return None
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages")
    most = SAMPLE_BYTES / len(sizes)
    shares = F.create_map(*[F.lit(x) for lang, r in told.items() for x in (lang, min(1.0, per_language / r["n"], most / max(r["size"], 1)))])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(place < F.coalesce(shares[F.col("lang")], F.lit(0.0))).withColumn("part", F.crc32(F.concat(F.lit("t"), F.col("id")).cast("binary")) % 10)

    def vectors(batches):
        for batch in batches:
            for at, counts, some in dense_rows(batch.column(0), dims):
                x = tfidf(counts, idf)
                picked = np.flatnonzero(some)
                cols = [np.flatnonzero(counts[i]) for i in picked]
                yield pa.record_batch([batch.column(1).take(pa.array(picked + at)), batch.column(3).take(pa.array(picked + at)), batch.column(2).take(pa.array(picked + at)), pa.array([c.astype(np.int32).tobytes() for c in cols], pa.binary()), pa.array([x[i, c].tobytes() for i, c in zip(picked, cols, strict=True)], pa.binary())], names=["lang", "part", "id", "columns", "values"])

    got = sample.select("text", "lang", "id", "part").mapInArrow(vectors, "lang string, part long, id string, columns binary, values binary").collect()
    got.sort(key=lambda r: (r["lang"], r["id"], r["values"]))
    languages = sorted({r["lang"] for r in got})
    if not languages:
        return None
    data = [(np.frombuffer(r["columns"], np.int32), np.frombuffer(r["values"], np.float32).astype(float)) for r in got]
    labels = [languages.index(r["lang"]) for r in got]
    held = [i for i, r in enumerate(got) if r["part"] == 0 and len(got) >= 50]
    held_set = set(held)
    used = [i for i in range(len(got)) if i not in held_set]
    w, b = ftrl([data[i] for i in used], [labels[i] for i in used], len(languages), dims)
    logits = np.array([data[i][1] @ w[data[i][0]] + b for i in held]).reshape(len(held), len(languages))
    return Model(languages, idf, w, b, temperature(logits, np.array([labels[i] for i in held], int)))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        names = np.array([*model.languages, "und"], object) if model else None
        for batch in batches:
            n = batch.num_rows
            best, score = np.full(n, len(model.languages) if model else 0), np.zeros(n)
            for at, counts, some in dense_rows(batch.column(1)) if model else ():
                p = model.probabilities(counts)
                top = p.argmax(axis=1)
                best[at : at + len(top)] = np.where(some, top, len(model.languages))
                score[at : at + len(top)] = np.where(some, p.max(axis=1), 0.0)
            said = pa.array(names[best] if model else ["und"] * n, pa.string())
            yield pa.record_batch([batch.column(0), said, pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """Learns from the training rows and predicts every row."""
    return predict(docs, fit(docs.filter(is_training), id_col, text_col, lang_col, per_language, max_languages=max_languages), id_col, text_col)
