"""Maximal periodic runs of words, and texts with their repetitions collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) that no neighbouring word extends; runs of at least four periods and six
words are reported.

Every run holds a Lyndon word of its period's length that is the longest one starting
where it starts, under the usual order of words or under the reversed one.  A scan from
right to left with a stack finds the longest Lyndon word at every place: the word at i
swallows the word at j, on top of the stack, while the suffix at i is less than the
suffix at j.  Two suffixes are compared by the length of their common extension: the
first words one by one, then by binary search over prefix hashes modulo 2^61 - 1, and
what the hashes call equal is compared word for word.  Stretches known to be equal are
kept per distance, so a periodic text is compared about once per distance and not once
per place.  Each longest Lyndon word is then extended to both sides at its length.  There
is no suffix array.

Before the scan a document is cut where no run can be: all five-word sequences inside a
run of four periods and six words recur in the same run (a run of length L and period q
has L > 2q + 3), so words outside of every recurring five-word sequence belong to no run,
and no run crosses them.  What remains is scanned whole; the cut drops no run.

Defined results
    null or empty text   no words, no runs, the collapsed text is empty
    null doc_id          processed like any other row (the query plants nothing in it)
    very long text       read in blocks; memory follows the number of its words and its vocabulary
    ties                 of runs of one length the one that starts first, then of the smallest period, is the longest
    repeated rows        one output row each
    empty table          an empty result
    extra columns        ignored
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

#: What is reported: at least so many periods, and so many words.
LEAST_PERIODS = 4
LEAST_WORDS = 6
_GRAM = 5
_PRIME = (1 << 61) - 1
_BASE = 0x1F0A3C5D7E9B2468 % _PRIME
#: Common extensions up to so many words are found one by one.
_DIRECT = 12
_BLOCK_BYTES = 1 << 22
#: A task starts a new vocabulary beyond so many words.
_VOCABULARY = 1 << 18
RUN = "struct<start long, length long, period long>"


class Sequence:
    """A sequence of word numbers with common extensions of its places."""

    def __init__(self, items: list[int]):
        self.items, self.n = items, len(items)
        self.hashes: list[int] | None = None
        self.powers: list[int] = []
        self.equal: dict[int, tuple[int, int]] = {}

    def _hash(self, a: int, b: int) -> int:
        return (self.hashes[b] - self.hashes[a] * self.powers[b - a]) % _PRIME

    def _prepare(self) -> None:
        h, p = [0], [1]
        for x in self.items:
            h.append((h[-1] * _BASE + x + 1) % _PRIME)
            p.append(p[-1] * _BASE % _PRIME)
        self.hashes, self.powers = h, p

    def _ahead(self, i: int, j: int, most: int) -> int:
        """Equal words from i and j on (i < j), at most ``most``."""
        w, k, near = self.items, 0, min(most, _DIRECT)
        while k < near and w[i + k] == w[j + k]:
            k += 1
        if k < near or k == most:
            return k
        if self.hashes is None:
            self._prepare()
        low, step = k, 2 * _DIRECT
        while low + step <= most and self._hash(i + low, i + low + step) == self._hash(j + low, j + low + step):
            low, step = low + step, 2 * step
        high = min(most, low + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            if self._hash(i + k, i + mid) == self._hash(j + k, j + mid):
                low = mid
            else:
                high = mid - 1
        if w[i + k : i + low] != w[j + k : j + low]:  # the hashes collided
            low = next(x for x in range(k, low) if w[i + x] != w[j + x])
        return low

    def behind(self, i: int, j: int) -> int:
        """Equal words before i and j (i < j), going left."""
        w, k, most = self.items, 0, i
        near = min(most, _DIRECT)
        while k < near and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
        if k < near or k == most:
            return k
        if self.hashes is None:
            self._prepare()
        low, step = k, 2 * _DIRECT
        while low + step <= most and self._hash(i - low - step, i - low) == self._hash(j - low - step, j - low):
            low, step = low + step, 2 * step
        high = min(most, low + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            if self._hash(i - mid, i - k) == self._hash(j - mid, j - k):
                low = mid
            else:
                high = mid - 1
        if w[i - low : i - k] != w[j - low : j - k]:  # the hashes collided
            low = next(x for x in range(k, low) if w[i - 1 - x] != w[j - 1 - x])
        return low

    def common(self, i: int, j: int) -> int:
        """The length of the longest common extension of the suffixes at i and j (i < j)."""
        w = self.items
        if w[i] != w[j]:
            return 0
        d = j - i
        known = self.equal.get(d)
        if known:
            low, high = known  # equal at this distance from low on, up to high and no further
            if low <= i <= high:
                return high - i
            if i < low:
                k = self._ahead(i, j, low - i)
                end = high if k == low - i else i + k
                self.equal[d] = (i, end)
                return end - i
        k = self._ahead(i, j, self.n - j)
        if k > _DIRECT:
            self.equal[d] = (i, i + k)
        return k


def word_runs(items: list[int], least_periods: int = LEAST_PERIODS, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start, then period."""
    n = len(items)
    found: set[tuple[int, int, int]] = set()
    longest = n // least_periods
    for up in (True, False):
        s = Sequence(items)
        common, w = s.common, items
        end = [0] * n
        last: dict[int, tuple[int, int]] = {}
        for i in range(n - 1, -1, -1):
            # The stack is threaded through ``end``: above the word at j lies the one at end[j].
            j, x = i + 1, w[i]
            while j < n:
                y = w[j]
                if x == y:
                    k = common(i, j)
                    if j + k == n:
                        break  # the suffix at j is a prefix of the one at i, and less
                    less = (w[i + k] < w[j + k]) == up
                else:
                    less = (x < y) == up
                if not less:
                    break
                j = end[j]
            end[i] = j
            p = j - i
            if p > longest:
                continue
            low, high = last.get(p, (n, n))
            if low <= i and j <= high:
                continue
            ahead = common(i, j) if j < n else 0
            first = i - s.behind(i, j)
            past = j + ahead
            if past - first >= 2 * p:
                last[p] = (first, past)
                if past - first >= max(least_words, least_periods * p):
                    found.add((first, past - first, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


_FACTORS = np.random.default_rng(7).integers(1 << 40, 1 << 62, _GRAM, dtype=np.uint64) | np.uint64(1)


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """The parts of a document outside of which no run can be."""
    m = len(ids) - _GRAM + 1
    if m < 2:
        return []
    grams = np.zeros(m, dtype=np.uint64)
    for k, factor in enumerate(_FACTORS):
        grams += (ids[k : k + m].astype(np.uint64) + np.uint64(1)) * factor
    order = np.sort(grams)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return []
    again = np.unique(again)
    at = np.minimum(np.searchsorted(again, grams), len(again) - 1)
    starts = np.flatnonzero(again[at] == grams)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + _GRAM, -1)
    inside = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(inside))
    return [(a, b) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()) if b - a >= LEAST_WORDS]


def document_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of a document's word numbers, by start, then period."""
    out = []
    for a, b in stretches(ids):
        out += [(a + start, length, period) for start, length, period in word_runs(ids[a:b].tolist())]
    return out


def collapsed_words(ids: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The word numbers without those that a run repeats after its first period."""
    if not runs:
        return ids
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return ids[np.cumsum(edge)[:-1] == 0]


class Vocabulary(dict):
    """Numbers for words, and the words back."""

    def __init__(self) -> None:
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number

    def ids(self, raw: bytes) -> np.ndarray:
        """The numbers of the words between ASCII white space."""
        parts, at = [], 0
        while at < len(raw):
            to = min(len(raw), at + _BLOCK_BYTES)
            while to < len(raw) and not raw[to : to + 1].isspace():
                to += 1
            words = raw[at:to].split()
            parts.append(np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words)))
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def text(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.words.__getitem__, ids.tolist()))


def planted(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of every tenth document, by a hash of its id, repeat with a period from some place on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(ids)
    if doc_id is None or h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return ids[at]


def periodic_runs(docs: DataFrame, arrange: Callable[[np.ndarray, int | None], np.ndarray] | None = None) -> DataFrame:
    """Per row: doc_id, its runs by start and period, and the collapsed text: the words outside of the runs' repetitions.

    ``arrange`` may rearrange the word numbers of a document before.
    """
    kept = {"known": Vocabulary()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, texts = [], []
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist()):
            if len(kept["known"]) > _VOCABULARY:
                kept["known"] = Vocabulary()
            known = kept["known"]
            ids = known.ids(raw or b"")
            if arrange:
                ids = arrange(ids, doc_id)
            found = document_runs(ids)
            runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            texts.append(known.text(collapsed_words(ids, found)))
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"]
        )

    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").cast("binary").alias("raw"))
    return map_batches(rows, run, f"doc_id long, runs array<{RUN}>, collapsed string")


def run_report(found: DataFrame) -> DataFrame:
    """What ``periodic_runs`` found, in numbers and digests."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"], F.lit("")))
    # "start,length,period," without its last comma, and a line feed
    lines = F.transform(lines, lambda x: F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best")["s"]).alias("start"),
        F.col("best")["length"].alias("length"),
        (-F.col("best")["p"]).alias("period"),
        F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(periodic_runs(table(spark, sf_dir, "documents"), planted))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
