"""Quality: a sparse ensemble of rules over statistics of a text, compiled to Spark expressions.

Statistics (:data:`STATISTICS`) are DataFrame expressions over the whole text.  A
bounded sample of labelled rows (about ``PER_CLASS`` of each label, picked by a hash
of the id; 20 numbers a row, no texts) comes to the driver.  Boosted trees of
``DEPTH`` levels are grown on it; the path to each of their nodes is a rule, a
conjunction of bounds on statistics.  A lasso logistic regression, its penalty
chosen by cross-validation, gives most rules the weight 0, and what is left is one
Spark column: no Python runs where documents are scored.  Rows of the sample weigh
as much as their label has in all training labels, so a score is the share of good
documents among those of its kind.

A null text counts as empty, and an empty text gets the score of its statistics (all
0).  Texts of any length are taken whole.  A document that is labelled twice has the
higher label; labels other than 0 and 1, and labels without a document, teach
nothing.  With only one label to learn from, it is every document's score; with none
it is 0.  Ids may be null, repeated or of any type, and rows that are equal have equal
scores; an empty table gives an empty result.  Other columns of the tables are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS = 3000
TREES, DEPTH, BINS = 40, 3, 32
SYMBOLS = r"#$%&*|!~^+=<>{}\[\]\\/@_"

#: The statistics in order; shares are of characters, words or lines.
STATISTICS = (
    "chars", "words", "lines", "word_chars", "longest_word", "words_a_line", "different_words", "word_variety", "different_lines", "single_characters",
    "letters", "capitals", "digits", "symbols", "stops", "commas", "other_marks", "spaces",
)


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the statistics of every row."""
    told = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("#text"))
    told = told.select(*keep, "#text", F.filter(F.split("#text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("#words"), F.split("#text", "\n").alias("#lines"))
    # what several statistics need is a column, so that it is worked out once
    told = told.select(
        *keep, "#text", F.length("#text").alias("#chars"), F.size("#words").alias("#n"), F.size("#lines").alias("#rows"), F.transform("#words", F.length).alias("#sizes"),
        F.size(F.array_distinct("#words")).alias("#kinds"), F.size(F.array_distinct("#lines")).alias("#line_kinds"), F.length(F.regexp_replace("#text", r"\P{L}+", "")).alias("#letters"),
    ).withColumn("#in_words", F.aggregate("#sizes", F.lit(0), lambda a, x: a + x))
    text, chars, n, rows = F.col("#text"), F.col("#chars"), F.col("#n"), F.col("#rows")

    def of_kind(kind: str) -> Column:
        """How many characters are of a kind: the others go a run at a time."""
        return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))

    def marks(these: str) -> Column:
        """How many characters are one of a few: each is searched for by itself."""
        return reduce(lambda a, b: a + b, [chars - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in these])

    def share(k: Column, of: Column) -> Column:
        return k.cast("double") / F.greatest(of, F.lit(1)).cast("double")

    made = {
        "chars": chars.cast("double"), "words": n.cast("double"), "lines": F.when(chars > 0, rows).otherwise(0).cast("double"),
        "word_chars": share(F.col("#in_words"), n), "longest_word": F.coalesce(F.array_max("#sizes"), F.lit(0)).cast("double"), "words_a_line": share(n, rows),
        "different_words": share(F.col("#kinds"), n), "word_variety": F.col("#kinds") / F.sqrt(F.greatest(n, F.lit(1)).cast("double")),
        "different_lines": F.when(chars > 0, share(F.col("#line_kinds"), rows)).otherwise(0.0), "single_characters": share(F.size(F.filter("#sizes", lambda x: x == 1)), n),
        "letters": share(F.col("#letters"), chars), "capitals": share(of_kind(r"\p{Lu}"), F.col("#letters")), "digits": share(of_kind(r"\p{Nd}"), chars), "symbols": share(of_kind(SYMBOLS), chars),
        "stops": share(marks(".?"), n), "commas": share(marks(","), n), "other_marks": share(marks(":;()"), chars), "spaces": share(chars - F.col("#in_words"), chars),
    }
    return told.select(*keep, *[made[s].alias(s) for s in STATISTICS])


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, above or None, up to or None), each statistic once."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, low, high in self.bounds:
            v = x[:, STATISTICS.index(name)]
            if low is not None:
                out &= v > low
            if high is not None:
                out &= v <= high
        return out

    def column(self) -> Column:
        parts = [F.col(n) > F.lit(low) for n, low, _ in self.bounds if low is not None] + [F.col(n) <= F.lit(high) for n, _, high in self.bounds if high is not None]
        return reduce(lambda a, b: a & b, parts)

    def __str__(self) -> str:
        return " and ".join((f"{low:.4g} < " if low is not None else "") + n + (f" <= {high:.4g}" if high is not None else "") for n, low, high in self.bounds)


@dataclass(frozen=True)
class Model:
    """Rules with their weights; without any, ``constant`` is every score."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float
    constant: float | None = None

    def column(self) -> Column:
        """The score as one expression over the statistics."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        terms = [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights, strict=True)]
        return 1.0 / (1.0 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.bias))))


def _tree(binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, least: float, found: list) -> list[tuple[np.ndarray, float]]:
    """Grows a tree by Newton gain on binned statistics; adds (path, rows) of its nodes to ``found`` and returns its leaves."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, -1, -1)
    if depth:
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            sg, sh, n = (np.cumsum(np.bincount(b, weights, BINS))[:-1] for weights in (g[rows], h[rows], None))
            ok = (n >= least) & (len(rows) - n >= least)
            gain = np.where(ok, sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
    if best[1] < 0:
        return [(rows, -total_g / (total_h + 1))]
    _, f, k = best
    leaves = []
    for above in (False, True):
        part = rows[(binned[rows, f] > k) == above]
        step = (*path, (f, k, above))
        found.append(step)
        leaves += _tree(binned, g, h, part, depth - 1, step, least, found)
    return leaves


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Rule]:
    """The paths of boosted trees, each grown on half of the rows and three quarters of the statistics."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf")) for f in range(x.shape[1])]
    # a bound lies midway between two values that occur
    for f, c in enumerate(cuts):
        values = np.unique(x[:, f])
        after = values[np.minimum(np.searchsorted(values, c, "right"), len(values) - 1)]
        cuts[f] = (c + after) / 2
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    rng, logit, paths = np.random.default_rng(seed), np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        rows = np.flatnonzero(rng.random(len(y)) < 0.5) if len(y) > 40 else np.arange(len(y))
        columns = np.sort(rng.permutation(x.shape[1])[: max(1, x.shape[1] * 3 // 4)])
        found: list = []
        _tree(binned[:, columns], g, h, rows, depth, (), max(2, len(rows) // 500), found)
        every = [tuple((int(columns[f]), k, above) for f, k, above in path) for path in found]
        for path in every:
            inside = np.ones(len(y), bool)
            for f, k, above in path:
                inside &= (binned[:, f] > k) == above
            if not any(p[: len(path)] == path and len(p) > len(path) for p in every):  # a leaf
                logit[inside] -= 0.3 * g[inside].sum() / (h[inside].sum() + 1)
        paths += every
    rules = {}
    for path in paths:
        low: dict[int, float] = {}
        high: dict[int, float] = {}
        for f, k, above in path:
            if above:
                low[f] = max(low.get(f, -np.inf), float(cuts[f][k]))
            else:
                high[f] = min(high.get(f, np.inf), float(cuts[f][k]))
        rule = Rule(tuple((STATISTICS[f], low.get(f), high.get(f)) for f in sorted({*low, *high})))
        rules.setdefault(rule.holds(x).tobytes(), rule)  # of rules that hold for the same rows the first
    return [r for key, r in rules.items() if 0 < sum(key) < len(y)]


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: tuple[np.ndarray, float] | None = None, rounds: int = 150, still: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-penalised logistic regression, by accelerated proximal gradients; the bias has no penalty."""
    weight = weight / weight.sum()
    w, b = start or (np.zeros(z.shape[1]), 0.0)
    v = np.ones(z.shape[1])
    for _ in range(20):  # the largest eigenvalue sets the step
        v = z.T @ (weight * (z @ v)) + v.sum() * 1e-12
        v /= max(np.linalg.norm(v), 1e-300)
    rate = 1 / (0.25 * (1.05 * float(v @ (z.T @ (weight * (z @ v)))) + 1))
    u, c, t = w, b, 1.0
    for _ in range(rounds):
        r = weight * (1 / (1 + np.exp(-(z @ u + c))) - y)
        new = u - rate * (z.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = c - rate * r.sum()
        if (r @ (z @ (new - w))) + r.sum() * (nb - b) > 0:  # it went too far: begin anew from here
            t = 1.0
        tn = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / tn * (new - w), nb + (t - 1) / tn * (nb - b)
        moved = float(np.abs(new - w).max(initial=0)) + abs(nb - b)
        w, b, t = new, nb, tn
        if moved < still:
            break
    return w, float(b)


def fit_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, folds: int = 5) -> Model:
    """Trees, rules and the lasso over them; the penalty has the least loss on rows left out, or one nearly as small with fewer rules."""
    rules = tree_rules(x, y, weight)
    if not rules:
        return Model((), (), 0.0, float(np.average(y, weights=weight)))
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    scale = np.maximum(z.std(axis=0), 0.05)
    z /= scale
    top = float(np.abs(z.T @ (weight / weight.sum() * (np.average(y, weights=weight) - y))).max())
    path = top * np.geomspace(0.5, 0.001, 10)
    part = np.random.default_rng(11).permutation(len(y)) % folds
    loss = np.zeros((folds, len(path)))
    for k in range(folds):
        a, held, at = part != k, part == k, None
        if len(set(y[a])) < 2 or not held.any():
            continue
        for j, penalty in enumerate(path):
            at = lasso(z[a], y[a], weight[a], penalty, at)
            s = z[held] @ at[0] + at[1]
            loss[k, j] = np.average(np.logaddexp(0, s) - y[held] * s, weights=weight[held])
    mean, spread = loss.mean(axis=0), loss.std(axis=0) / np.sqrt(folds)
    least = int(mean.argmin())
    pick = int(np.flatnonzero(mean <= mean[least] + 0.5 * spread[least])[0])
    at = None
    for penalty in path[: pick + 1]:
        at = lasso(z, y, weight, penalty, at, 1000, 1e-6)
    used = np.flatnonzero(at[0])
    return Model(tuple(rules[i] for i in used), tuple(float(at[0][i] / scale[i]) for i in used), at[1])


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """A model from the labels of training rows, of which about ``per_class`` of each label are read."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    rows = docs.filter(is_training).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    there = rows.select("doc_id").join(known, F.col("doc_id") == F.col("_id")).select("_id", "_label").distinct()
    sizes = {r["_label"]: r["count"] for r in there.groupBy("_label").count().collect()}  # two rows
    if len(sizes) < 2:
        return Model((), (), 0.0, float(max(sizes, default=0)))
    place = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    picked = there.filter(place < F.when(F.col("_label") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0])))
    # about 2 * per_class ids are broadcast, so no text is shuffled; a repeated id brings each of its rows
    sample = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_id", "text", "_label")
    got = statistics(sample, "text", ("_id", "_label")).collect()
    got.sort(key=lambda r: (r["_label"], str(r["_id"]), tuple(r)[2:]))
    y = np.array([r["_label"] for r in got], float)
    if len(set(y)) < 2:
        return Model((), (), 0.0, sizes[1] / (sizes[0] + sizes[1]))
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    return fit_rules(np.array([[r[s] for s in STATISTICS] for r in got]), y, weight / weight.mean())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return statistics(rows, "text", ("doc_id",)).select("doc_id", model.column().alias("score"))


def quality(docs: DataFrame, labels: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """Learns from labelled training rows and scores every document: doc_id and score."""
    return score(docs, fit(docs, labels, is_training, id_col, text_col, label_col, per_class), id_col, text_col)
