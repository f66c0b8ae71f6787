"""Language identification with a byte convolutional network in numpy.

A text's UTF-8 bytes are cut into fixed windows of WINDOW bytes, which cover the
whole text.  A window's bytes are embedded, passed through filters of several
widths, max-pooled over the window and classified by softmax.  A text's
distribution is the mean of its windows', weighted by their letters.  The network
is trained with Adam on windows of labelled rows; embedding, filters and
classifier are plain arrays that travel with the task.

Training rows: at most TRAIN_ROWS (a parameter) among the rows with a doc_id and a
language that are not held out, shared out by language, so that a rare language gets
rows as long as there are at most TRAIN_ROWS languages; of a language those with the
smallest hash of doc_id, language and text, so that rows of one doc_id don't come or
go together.  All windows of these rows' whole texts train the network, up to
TRAIN_WINDOWS of them (a parameter too); of more, those with the smallest hash,
wherever they are in their text.  An epoch takes the next EPOCH_WINDOWS of them in
shuffled order, and over EPOCHS each window trains at least twice.  Everything else
covers all rows and whole texts.

Defined results
    null text, or none with a letter   und, score 0
    null doc_id                        not held out, not learned from, predicted like any other
    ties                               of equal scores the language that sorts first
    no labelled rows                   und, score 0 for every row
    very long text                     windows are scored in blocks of bounded size
    repeated rows                      one output row each
    empty table                        an empty result
    extra columns                      ignored by the report, kept by ``accepted``
    more languages than TRAIN_ROWS     those with the most rows are learned
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, table

WINDOW = 256
EMBED = 8
#: (width, filters)
FILTERS = ((2, 8), (3, 12), (4, 12))
WIDEST = max(w for w, _ in FILTERS)
TRAIN_ROWS = 3000
TRAIN_WINDOWS = 40_000
#: Windows that one epoch sees, so that training takes the same time for any sample; EPOCHS of them are twice TRAIN_WINDOWS.
EPOCH_WINDOWS = 12_000
EPOCHS = 7
BATCH = 64
SEED = 11
UNDETERMINED = "und"
#: Texts whose best language scores less are rejected by ``accepted``.
MIN_SCORE = 0.3
_PAD = 256
_BLOCK = 128
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # (257, EMBED); the pad's row is zero
    kernel: np.ndarray  # (WIDEST * EMBED, filters); narrow filters are zero in their last rows
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled activations of windows (n, WINDOW) of byte codes, and the unfolded input."""
        n = len(codes)
        vectors = self.embed[codes].reshape(n, -1)
        steps = WINDOW - WIDEST + 1
        unfolded = np.lib.stride_tricks.sliding_window_view(vectors, WIDEST * EMBED, axis=1)[:, ::EMBED]
        unfolded = np.ascontiguousarray(unfolded).reshape(n * steps, WIDEST * EMBED)
        return (unfolded @ self.kernel).reshape(n, steps, -1), unfolded

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(codes), _BLOCK):
            hidden = np.maximum(self.pooled(codes[at : at + _BLOCK])[0].max(axis=1) + self.bias, 0)
            logits = hidden @ self.out + self.out_bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            parts.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(parts)


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text's bytes, the last one padded."""
    n = -(-len(raw) // WINDOW)
    codes = np.full(n * WINDOW, _PAD, dtype=np.int16)
    codes[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return codes.reshape(n, WINDOW)


def _letter_weight(codes: np.ndarray) -> np.ndarray:
    low = codes | 32
    return (((low >= 97) & (low <= 122) & (codes < 128)) | ((codes >= 128) & (codes < _PAD))).sum(axis=1) + 1e-6


def train(windows: list[bytes], langs: list[str], epochs: int = EPOCHS) -> Network:
    """Fit the network to labelled windows of at most WINDOW bytes; equal inputs give equal networks."""
    rng = np.random.default_rng(SEED)
    labels = sorted(set(langs))
    place = {lang: k for k, lang in enumerate(labels)}
    codes = np.full((len(windows), WINDOW), _PAD, dtype=np.int16)
    for row, window in zip(codes, windows):
        row[: len(window)] = np.frombuffer(window, dtype=np.uint8)
    target = np.array([place[lang] for lang in langs], dtype=np.int64)
    n_filters = sum(n for _, n in FILTERS)
    mask = np.zeros((WIDEST * EMBED, n_filters), dtype=np.float32)
    at = 0
    for width, n in FILTERS:
        mask[: width * EMBED, at : at + n] = 1
        at += n
    net = Network(
        labels,
        (rng.standard_normal((257, EMBED)) * 0.5).astype(np.float32),
        (rng.standard_normal(mask.shape) * 0.3).astype(np.float32) * mask,
        np.zeros(n_filters, dtype=np.float32),
        (rng.standard_normal((n_filters, len(labels))) * 0.3).astype(np.float32),
        np.zeros(len(labels), dtype=np.float32),
    )
    net.embed[_PAD] = 0
    share = np.bincount(target, minlength=len(labels)) / max(1, len(target))
    weight = (1 / np.maximum(share, 1e-3)) ** 0.5
    params = [net.embed, net.kernel, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = WINDOW - WIDEST + 1
    # Epochs take the windows in turn, so none is left out while others train again.
    share_of = min(EPOCH_WINDOWS, len(codes))
    turns = np.concatenate([rng.permutation(len(codes)) for _ in range(-(-epochs * share_of // len(codes)))])
    for epoch in range(epochs):
        order = turns[epoch * share_of : (epoch + 1) * share_of]
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            x, y = codes[pick], target[pick]
            response, unfolded = net.pooled(x)
            peak = response.argmax(axis=1)
            top = np.take_along_axis(response, peak[:, None, :], axis=1)[:, 0] + net.bias
            hidden = np.maximum(top, 0)
            logits = hidden @ net.out + net.out_bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            grad = e / e.sum(axis=1, keepdims=True)
            grad[np.arange(len(y)), y] -= 1
            grad *= (weight[y] / weight[y].sum())[:, None]
            grad = grad.astype(np.float32)
            d_top = (grad @ net.out.T) * (top > 0)
            at_peak = unfolded.reshape(len(x), steps, -1)[np.arange(len(x))[:, None], peak]
            d_kernel = np.einsum("bf,bfk->kf", d_top, at_peak) * mask
            d_input = d_top[:, :, None] * net.kernel.T[None]
            seen = x[np.arange(len(x))[:, None, None], peak[:, :, None] + np.arange(WIDEST)]
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, seen.reshape(-1), d_input.reshape(-1, EMBED))
            d_embed[_PAD] = 0
            step += 1
            rate = 0.01 * 0.5 ** (epoch / max(1, epochs - 1) * 3)
            grads = [d_embed, d_kernel, d_top.sum(axis=0), hidden.T @ grad, grad.sum(axis=0)]
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _row_sample(docs: DataFrame, rows: int) -> DataFrame:
    """(key, lang, text) of at most ``rows`` labelled rows, shared out by language."""
    doc_id, text = F.col("`doc_id`"), F.col("`text`").cast("string")
    labelled = docs.filter(
        ~held_out(doc_id) & doc_id.isNotNull() & F.col("`lang`").isNotNull() & text.isNotNull() & text.rlike(r"\p{L}")
    ).select(
        F.xxhash64(doc_id.cast("string"), F.col("`lang`").cast("string"), text).alias("key"),
        F.col("`lang`").cast("string").alias("lang"),
        text.alias("text"),
    )
    # The languages with the most rows, at most ``rows`` of them.
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    quota, left = {}, rows
    for k, r in enumerate(reversed(counts)):  # rare ones first; what they leave goes to the others
        quota[r.lang] = (r["count"], min(r["count"], left // (len(counts) - k)))
        left -= quota[r.lang][1]
    unit = 1 << 31
    # A threshold on the hash passes some more rows than wanted, so that what is sorted stays bounded.
    shares = [(lang, n, min(unit, int((1.3 * n + 50) / total * unit) + 1)) for lang, (total, n) in quota.items()]
    if not shares:
        return labelled.limit(0)
    table_of = docs.sparkSession.createDataFrame(shares, "wanted string, n long, below long")
    hashed = labelled.withColumn("place", F.pmod("key", F.lit(unit)))
    passed = hashed.join(F.broadcast(table_of), (F.col("lang") == F.col("wanted")) & (F.col("place") < F.col("below")))
    best = Window.partitionBy("lang").orderBy("place", "key", "text")  # about 1.3 times the wanted rows
    return passed.withColumn("nth", F.row_number().over(best)).filter("nth <= n").select("key", "lang", "text")


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS) -> tuple[list[bytes], list[str]]:
    """Windows and their languages: all of at most ``rows`` labelled rows, but at most ``windows``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                for at in range(0, len(raw), WINDOW * _BLOCK):
                    parts = [raw[a : a + WINDOW] for a in range(at, min(len(raw), at + WINDOW * _BLOCK), WINDOW)]
                    marks = np.array([xxhash.xxh64_intdigest(p, (key + at + k) % 2**63) for k, p in enumerate(parts)], dtype=np.uint64)
                    columns = [pa.array((marks >> np.uint64(1)).astype(np.int64)), pa.array([lang] * len(parts), pa.string()), pa.array(parts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["mark", "lang", "window"])

    pieces = _row_sample(docs, rows).mapInArrow(cut, "mark long, lang string, window binary")
    picked = pieces.orderBy("mark", "lang", "window").limit(windows).collect()
    return [bytes(r.window) for r in picked], [r.lang for r in picked]


def _classify(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    blocks, weights, owners = [], [], []
    total = np.zeros((len(texts), len(net.labels)))
    mass = np.zeros(len(texts))

    def flush() -> None:
        if blocks:
            codes, who = np.concatenate(blocks), np.concatenate(owners)
            w = _letter_weight(codes)
            np.add.at(total, who, net.probabilities(codes) * w[:, None])
            np.add.at(mass, who, w)
            blocks.clear(), owners.clear()

    waiting = 0
    for i, text in enumerate(texts):
        if text and _LETTER.search(text):
            raw = text.encode("utf-8", "surrogatepass")
            for at in range(0, len(raw), WINDOW * 4096):
                codes = windows_of(raw[at : at + WINDOW * 4096])
                blocks.append(codes)
                owners.append(np.full(len(codes), i))
                waiting += len(codes)
                if waiting >= 4096:
                    flush()
                    waiting = 0
    flush()
    named = mass > 0
    share = total / np.maximum(mass, 1e-12)[:, None]
    best = share.argmax(axis=1)
    langs = [net.labels[b] if ok else UNDETERMINED for b, ok in zip(best, named)]
    scores = np.clip(share[np.arange(len(texts)), best], 0, 1) * named
    return langs, scores.tolist()


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        langs, scores = _classify(net, texts) if net else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
            ["doc_id", "lang_pred", "score"],
        )

    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Network | None:
    windows, langs = training_sample(docs, rows)
    return train(windows, langs) if windows else None


def lang_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows with a determined language, with all columns.

    Rows pass through one Arrow map with their columns, so nothing is joined back.
    A table without any labelled row is returned as it is.
    """
    net = fit(docs)
    if net is None:
        return docs
    text_at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = _classify(net, batch.column(text_at).to_pylist())
        stay = pa.array([lang != UNDETERMINED and s >= min_score for lang, s in zip(langs, scores)], pa.bool_())
        return batch.filter(stay)

    return map_batches(docs, run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_report(table(spark, sf_dir, "documents"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
