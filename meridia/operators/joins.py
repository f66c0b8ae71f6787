"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the smaller side that go to every executor; callers keep a row to some hundred bytes.
BROADCAST_ROWS = 100_000


def attach(
    left: DataFrame, right: DataFrame, on: list[str], weight: str, spread: Column, how: str = "left", rows: int | None = None
) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per key ``on`` and in ``weight`` the rows of ``left`` with it.

    Keys over the average load of ``rows`` keys (BROADCAST_ROWS by default; fewer than
    that can be) are broadcast; only the others, each with a bounded share of the rows, meet in
    a shuffle, where rows that have found their key are spread by ``spread``.  ``right``
    is read several times, so it should be a checkpoint.  ``how`` is left, inner or anti.
    """
    payload = [c for c in right.columns if c not in on and c != weight]
    rows = rows or BROADCAST_ROWS
    n, total = right.agg(F.count(F.lit(1)), F.sum(weight)).first()
    limit = -1 if n <= rows else -(-total // rows)
    packed = right.select(*on, F.struct(F.lit(1).alias("_one"), *payload).alias("_cold"), F.col(weight).alias("_weight"))
    hot = packed.filter(F.col("_weight") > limit).select(*on, F.col("_cold").alias("_hot"))
    out = left.join(F.broadcast(hot), on, "left")
    found = F.col("_hot")
    if limit >= 0:
        place = F.when(found.isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 30)) + 1).otherwise(0)
        cold = packed.filter(F.col("_weight") <= limit).select(*on, F.lit(0).cast("long").alias("_place"), "_cold")
        out = out.withColumn("_place", place.cast("long")).join(cold, [*on, "_place"], "left")
        found = F.coalesce(F.col("_hot"), F.col("_cold"))
    if how != "left":
        out = out.filter(found.isNotNull() if how == "inner" else found.isNull())
    more = [] if how == "anti" else [found.getField(c).alias(c) for c in payload]
    return out.select(*left.columns, *more)


def small_enough(df: DataFrame, max_bytes: int = 32 << 20, text: str | None = None) -> bool:
    """Whether the rows of a checkpointed ``df`` may be broadcast: 64 bytes a row and the bytes of column ``text``."""
    size = F.lit(64) + (F.octet_length(text) if text else F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes
