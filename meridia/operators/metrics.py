"""Counters of a run: observed while a query executes, or counted from stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

RATE_PER_SECOND, BURST = 50.0, 100


def observed_verdicts(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows unchanged, and counts per verdict that are known once an action has run over them."""
    seen = Observation("ingress")
    v = F.col("verdict")
    return rows.observe(
        seen,
        F.count(F.lit(1)).alias("events_received"),
        F.count_if(v == "accepted").alias("events_accepted"),
        F.count_if(v == "duplicate").alias("events_duplicate"),
        F.count_if(v.isin("rejected", "conflict")).alias("events_rejected"),
    ), seen


def observed_evaluations(verdicts: DataFrame, names: list[str]) -> tuple[DataFrame, Observation]:
    """Verdict columns with the number of evaluations and matches per rule."""
    seen = Observation("segments")
    counts = [F.count_if(F.col(n)).alias(f"matched_{n}") for n in names]
    return verdicts.observe(seen, F.count(F.lit(1)).alias("evaluated"), *counts), seen


def counters(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(metric, value) of row counts under conditions: name -> (table, SQL condition)."""
    out = None
    for name, (df, where) in sorted(tables.items()):
        row = df.agg(F.count_if(F.expr(where)).alias("value")).select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def lag_histogram(df: DataFrame, start: str, end: str, base: float, factor: float, buckets: int) -> DataFrame:
    """(upper bound in seconds, cumulative count) of delays, with exponential bounds; the last bound is infinite."""
    delay = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    bounds = [base * factor**i for i in range(buckets)] + [float("inf")]
    counts = df.agg(*(F.count_if(delay <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    rows = F.array(*(F.struct(F.lit(b).alias("upper_bound"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)))
    return counts.select(F.inline(rows))


class Bucket:
    """A token bucket: BURST tokens at first, RATE_PER_SECOND more each second up to BURST."""

    def __init__(self, rate: float = RATE_PER_SECOND, burst: int = BURST):
        self.rate, self.burst, self.tokens, self.at = rate, burst, float(burst), None

    def allow(self, now: int) -> bool:
        """``now`` in whole microseconds, so that waiting times are exact."""
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + max(0, now - self.at) * self.rate / 1e6)
        self.at = now if self.at is None else max(self.at, now)
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False


def rate_limited(requests: DataFrame, rate: float = RATE_PER_SECOND, burst: int = BURST) -> DataFrame:
    """Adds ``allowed`` to (source_id, seq, received_at): a bucket per source, requests in order of arrival.

    A source's requests are a sequence by nature; they stream through one task
    with a bucket's two numbers as state.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, bucket = None, Bucket(rate, burst)
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                if r.source_id != source:
                    source, bucket = r.source_id, Bucket(rate, burst)
                out.append(bucket.allow(r.received_at.value // 1000))
            yield pdf.assign(allowed=out)

    rows = requests.select("source_id", "seq", "received_at").repartition("source_id").sortWithinPartitions("source_id", "received_at", "seq")
    return rows.mapInPandas(run, "source_id string, seq long, received_at timestamp, allowed boolean")
