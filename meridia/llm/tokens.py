"""Token counts of byte-level BPE vocabularies by rank-synchronous array merging.

Texts are split into pre-tokens by the vocabulary's pattern.  Pre-tokens not met
before are laid out together as ragged numpy arrays: symbols, their neighbours, the
rank of the pair that begins at each, and sequence numbers.  A round finds each
sequence's lowest rank and merges all occurrences of that pair in that sequence,
left to right, for all sequences at once; only the ranks beside a merge change.  A
sequence without a pair that merges leaves the rounds with its count of surviving
symbols.  Merging the lowest rank everywhere in a sequence is what the sequential
algorithm does, for no pair that a merge makes ranks before the merge itself.

A round looks only at the pairs of a sequence's lowest ranks, its band; when the band
is used up the next BAND pairs form one.  Sequences of up to BAND pairs are one band.
A long sequence, which may take thousands of rounds, thus pays for a band and for its
merges in a round and not for its length.

Defined results
    null or empty text   0 tokens, 0 bytes
    special strings      an added token of the vocabulary counts as one token, as the
                         library does it by default
    very long text       split as a whole; pre-tokens are counted in blocks of bounded size
    null doc_id          counted like any other row
    other vocabularies   options that this counter doesn't know raise an error on load
    repeated rows        one output row each
    empty table          an empty result
    extra columns        ignored
"""

from __future__ import annotations

import json
from collections import OrderedDict
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Pairs of a long sequence that rounds look at together.
BAND = 4096
#: Pre-tokens whose counts a worker remembers.
CACHE = 400_000
_BLOCK_TOKENS = 200_000
_BLOCK_BYTES = 4 << 20
#: The byte-level pattern of the vocabulary's pre-tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: printable ones as themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _check_options(spec: dict) -> None:
    """Raise for what would change the tokens and isn't handled here."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    known = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", False)
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    added = [t for t in spec.get("added_tokens", []) if any(t.get(k) for k in ("lstrip", "rstrip", "single_word"))]
    if spec.get("normalizer") or not known or not plain or added or model.get("type", "BPE") != "BPE":
        raise ValueError("the vocabulary has options that token counts don't support")


class Counter:
    """Counts the tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        _check_options(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.symbol = np.zeros(256, dtype=np.int64)
        for letter, byte in _byte_letters().items():
            self.symbol[byte] = vocab[letter]
        self.pattern = regex.compile(PATTERN)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known: OrderedDict[str, int] = OrderedDict()

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.made))

    def merged_sizes(self, pieces: list[bytes]) -> np.ndarray:
        """Surviving symbols of each byte sequence."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out, n, none = sizes.copy(), int(sizes.sum()), len(self.made)
        symbols = self.symbol[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        ends = np.cumsum(sizes)
        # Neighbours by place; n stands for none, and so does the rank of a place whose pair can't merge.
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[ends - sizes] = n, n
        rank = np.full(n + 1, none, dtype=np.int64)

        def rerank(at: np.ndarray) -> None:
            right = after[at]
            found = np.full(len(at), none, dtype=np.int64)
            inner = np.flatnonzero(right < n)
            found[inner] = self._lookup(symbols[at[inner]] << 32 | symbols[right[inner]])
            rank[at] = found

        rerank(np.arange(n))
        # Pairs above a sequence's limit wait for a later band.
        limit = np.full(len(pieces) + 1, none - 1, dtype=np.int64)
        waiting = np.flatnonzero(sizes > BAND).tolist()

        def next_band(who: int) -> np.ndarray:
            """The places of the lowest ranks of a long sequence, and its new limit."""
            first = int(ends[who] - sizes[who])
            ranks = rank[first : int(ends[who])]
            open_ = ranks[ranks < none]
            limit[who] = np.partition(open_, BAND - 1)[BAND - 1] if len(open_) > BAND else none - 1
            return first + np.flatnonzero(ranks <= limit[who])

        for who in waiting:
            next_band(who)
        work = np.flatnonzero(rank[:n] <= limit[owner])
        listed = np.zeros(n + 1, dtype=bool)
        listed[work] = True
        lowest = np.full(len(pieces), none, dtype=np.int64)
        while True:
            used_up = [w for w in waiting if lowest[w] == none and limit[w] < none - 1] if waiting else []
            if used_up:
                busy = set(owner[work].tolist()) if len(work) else set()
                more = [next_band(w) for w in used_up if w not in busy]
                if more:
                    work = np.concatenate([work, *more])
                    listed[work] = True
                waiting = [w for w in waiting if limit[w] < none - 1]
            if not len(work):
                break
            who = owner[work]
            ranks = rank[work]
            np.minimum.at(lowest, who, ranks)
            at = np.sort(work[ranks == lowest[who]])
            lowest[who] = none
            # Of overlapping occurrences (aaa), those at even places of a run of neighbours merge.
            fresh = np.concatenate(([True], after[at[:-1]] != at[1:]))
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            right = after[at]
            beyond = after[right]
            symbols[at] = self.made[rank[at]]
            rank[right] = none
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            np.subtract.at(out, owner[at], 1)
            left = before[at]
            touched = np.concatenate([at, left[left < n]])
            rerank(touched)
            new = np.unique(touched[~listed[touched]])
            work = np.concatenate([work, new]) if len(new) else work
            stays = rank[work] <= limit[owner[work]]
            listed[work] = stays
            work = work[stays]
        return out

    def _learn(self, tokens: set[str]) -> dict[str, int]:
        """Counts of pre-tokens, remembered for later texts."""
        found: dict[str, int] = {}
        part: list[str] = []
        raw: list[bytes] = []
        size = 0
        for token in tokens:
            part.append(token)
            raw.append(token.encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            if size >= _BLOCK_BYTES:
                found |= zip(part, self.merged_sizes(raw).tolist())
                part, raw, size = [], [], 0
        if part:
            found |= zip(part, self.merged_sizes(raw).tolist())
        for token, n in found.items():
            if len(token) <= 64:
                self.known[token] = n
        return found

    def _pieces(self, text: str) -> tuple[int, list[str]]:
        """(added tokens, the stretches between them)."""
        if self.added is None or not self.added.search(text):
            return 0, [text]
        parts = self.added.split(text)
        return len(parts) - 1, [p for p in parts if p]

    def count(self, texts: list[str | None]) -> list[int]:
        totals, waiting = [0] * len(texts), []
        fresh: set[str] = set()
        known = self.known
        for i, text in enumerate(texts):
            if not text:
                continue
            added, parts = self._pieces(text)
            totals[i] += added
            for part in parts:
                found = (m.group() for m in self.pattern.finditer(part)) if len(part) > 1 << 22 else iter(self.pattern.findall(part))
                while block := list(islice(found, _BLOCK_TOKENS)):
                    missing = [t for t in block if t not in known]
                    if not missing:
                        totals[i] += sum(map(known.__getitem__, block))
                    else:
                        waiting.append((i, block, missing))
                        fresh.update(missing)
                        if len(waiting) >= 64 or len(fresh) > _BLOCK_TOKENS:
                            self._settle(waiting, fresh, totals)
                            waiting, fresh = [], set()
        self._settle(waiting, fresh, totals)
        return totals

    def _settle(self, waiting: list, fresh: set[str], totals: list[int]) -> None:
        # What was known when a block was read may be forgotten by now: look those up again.
        fresh |= {t for _, block, _ in waiting for t in block if t not in self.known}
        found = self._learn(fresh) if fresh else {}
        for i, block, _ in waiting:
            totals[i] += sum(found[t] if t in found else self.known[t] for t in block)
        while len(self.known) > CACHE:
            self.known.popitem(last=False)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per vocabulary and worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.  ``path`` is the vocabulary file on the executors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = counter(path).count(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
        )

    rows = docs.select(
        F.col("`doc_id`").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col("`text`")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("`text`").cast("string").alias("text"),
    )
    counted = map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path(VOCABULARY)))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
