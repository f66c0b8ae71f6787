"""Quality scores from a generalised additive model with pairwise interactions.

Every whole text becomes a few numbers (FEATURES).  Each number is put in one of at
most BINS bins with edges at the quantiles of the training rows.  Training is
cyclic boosting: in every round each feature in turn gets a small tree over its own
bins, fitted to the gradient of the log loss, whose leaf values are added to the
feature's lookup table.  The pairs of features that explain most of what is left
then get tables of two dimensions in the same way.  A score is a sum of table
look-ups over all terms, through the logistic function.

Training rows: at most TRAIN_ROWS (a parameter) labelled rows, those with the
smallest hash of doc_id among the labels that are not held out.  Only their
features reach the driver.  Everything else covers all rows and whole texts.

Defined results
    null or empty text   features of the empty text, scored like any other
    null doc_id          scored, not held out
    no labelled rows     score 0.5 for every row
    one label only       that label's rate as the score
    repeated rows        one output row each; repeated labels count repeatedly
    very long text       counted as a whole
    empty table          an empty result
    extra columns        ignored
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, map_batches, table
from .langid import held_out

FEATURES = (
    "log_words",
    "word_length",
    "longest_word",
    "capitals",
    "capital_words",
    "digits",
    "symbols",
    "exclamations",
    "bars",
    "stops",
    "wide",
    "distinct_words",
    "top_word",
    "word_repeats",
    "line_repeats",
    "line_length",
)
BINS = 24
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.1
TRAIN_ROWS = 20_000
THRESHOLD = 0.7

_ALL = np.arange(256)
_UPPER = (_ALL >= 65) & (_ALL <= 90)
_LOWER = (_ALL >= 97) & (_ALL <= 122)
_DIGIT = (_ALL >= 48) & (_ALL <= 57)
_SYMBOL = np.isin(_ALL, list(b"#$%&*@^~<>{}[]\\/_=+"))
_STOP = np.isin(_ALL, list(b".,;:?"))


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    n_words = max(1, len(words))
    letters = max(1, int(seen[_UPPER | _LOWER].sum() + seen[128:].sum()))
    times = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n_words,
        float(np.log1p(max(map(len, words), default=0))),
        seen[_UPPER].sum() / letters,
        sum(map(bytes.isupper, words)) / n_words,
        seen[_DIGIT].sum() / n,
        seen[_SYMBOL].sum() / n,
        seen[33] / n,
        seen[124] / n,
        seen[_STOP].sum() / n,
        seen[128:].sum() / n,
        len(times) / n_words,
        max(times.values(), default=0) / n_words,
        sum(map(eq, words, words[1:])) / n_words,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(raw) / max(1, len(lines)))),
    ]


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.edges and len(x):
            bins = self.bins(x)
            for f, values in enumerate(self.tables):
                total += values[bins[:, f]]
            for f, g, values in self.pairs:
                total += values[bins[:, f], bins[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


_RIDGE = 2.0


def _best_cut(grad: np.ndarray, hess: np.ndarray) -> tuple[float, int]:
    """(gain, cut) of the best split of bins in [:cut] and [cut:]."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    all_g, all_h = grad.sum(), hess.sum()
    gain = g**2 / (h + _RIDGE) + (all_g - g) ** 2 / (all_h - h + _RIDGE) - all_g**2 / (all_h + _RIDGE)
    cut = int(gain.argmax()) if len(gain) else 0
    return (float(gain[cut]), cut + 1) if len(gain) else (0.0, 0)


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values over the bins of one feature."""
    gain, cut = _best_cut(grad, hess) if depth else (0.0, 0)
    if gain <= 1e-6:
        return np.full(len(grad), grad.sum() / (hess.sum() + _RIDGE))
    return np.concatenate([_tree(grad[:cut], hess[:cut], depth - 1), _tree(grad[cut:], hess[cut:], depth - 1)])


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values) of a tree that cuts one feature and then, in both parts, the other."""
    best = (-1.0, np.zeros_like(grad))
    for flip in (False, True):
        g, h = (grad.T, hess.T) if flip else (grad, hess)
        _, cut = _best_cut(g.sum(axis=1), h.sum(axis=1))
        total, parts = 0.0, []
        for part in (slice(None, cut), slice(cut, None)):
            pg, ph = g[part].sum(axis=0), h[part].sum(axis=0)
            total += pg.sum() ** 2 / (ph.sum() + _RIDGE)
            gain, inner = _best_cut(pg, ph)
            total += gain
            values = _tree(pg, ph, 1)
            parts.append(np.repeat(values[None], g[part].shape[0], axis=0))
        if total > best[0]:
            leaf = np.concatenate(parts)
            best = (total, leaf.T if flip else leaf)
    return best


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the tables; equal inputs give equal tables."""
    if not len(y):
        return Model()
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(base=float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    bins = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f, n in enumerate(sizes):
            grad, hess = slopes()
            at = bins[:, f]
            step = RATE * _tree(np.bincount(at, grad, n), np.bincount(at, hess, n), 2)
            model.tables[f] += step
            total += step[at]

    def cells(f: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grad, hess = slopes()
        at = bins[:, f] * sizes[g] + bins[:, g]
        shape, n = (sizes[f], sizes[g]), sizes[f] * sizes[g]
        return at, np.bincount(at, grad, n).reshape(shape), np.bincount(at, hess, n).reshape(shape)

    ranked = sorted(
        ((_pair_tree(*cells(f, g)[1:])[0], f, g) for f, g in combinations(range(len(sizes)), 2)), reverse=True
    )
    model.pairs = [(f, g, np.zeros((sizes[f], sizes[g]))) for _, f, g in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for f, g, values in model.pairs:
            at, grad, hess = cells(f, g)
            step = RATE * _pair_tree(grad, hess)[1]
            values += step
            total += step.reshape(-1)[at]
    return model


def _feature_rows(docs: DataFrame, carry: str) -> DataFrame:
    """``carry`` (a double) and the features of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(carry), pa.array(made, pa.list_(pa.float64()))], [carry, "x"])

    return map_batches(docs.select(F.col(carry), "text"), run, f"{carry} double, x array<double>")


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled rows, also where a doc_id repeats among the labels or the documents."""
    marked = labels.filter(
        ~held_out(F.col("`doc_id`")) & F.col("`doc_id`").isNotNull() & F.col("`quality`").isNotNull()
    ).select(F.col("`doc_id`").cast("long").alias("labelled"), F.col("`quality`").cast("double").alias("y"))
    # Of the labels of one doc_id each value counts once.
    sample = hash_sample(marked.distinct(), "labelled", rows)
    texts = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    # The sample has two numbers a row and at most ``rows`` rows; of the texts of one doc_id the one with the least hash learns.
    wanted = sample.select(F.col("labelled").alias("doc_id")).distinct()
    first = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    picked = first.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("y", "text")
    found = sorted((r.x, r.y) for r in _feature_rows(picked, "y").collect())
    x = np.array([f for f, _ in found], dtype=float).reshape(-1, len(FEATURES))
    return x, np.array([y for _, y in found], dtype=float)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = train(*training_rows(docs, labels))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    scored = map_batches(rows, run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
