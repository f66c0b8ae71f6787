"""An outbox published in order: what was sent before the first failure is committed, the rest stays.

``claimed`` takes the oldest pending rows.  ``sent`` publishes them, each key's rows in
order in one task, and stops a key at its first failure.  ``committed`` marks the longest
prefix of a key that was sent; rows behind a failure wait, even where a send of theirs
went through, so that a repeated run sends them again in order (at least once).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from .joins import attach

PENDING, PUBLISHED = "pending", "published"
#: Rows that one run takes.
LIMIT = 100


def claimed(outbox: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The oldest pending rows of an outbox (id, created_at, status, ...)."""
    return outbox.filter(F.col("status") == PENDING).orderBy("created_at", "id").limit(limit)


def sent(rows: DataFrame, send: Callable[[str, str], bool], key: str = "partition_key", value: str = "payload") -> DataFrame:
    """``rows`` with ``ok``: whether ``send(key, value)`` took the row; null for rows behind their key's first failure.

    A send that raises has failed.  The result must be kept before it is read twice: each reading sends.
    """
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stopped = None, False
        for pdf in parts:
            out: list[bool | None] = []
            for k, v in zip(pdf[key], pdf[value]):
                if k != current:
                    current, stopped = k, False
                if stopped:
                    out.append(None)
                    continue
                try:
                    good = bool(send(k, v))
                except Exception:  # a failed send is an outcome, like a refused one
                    good = False
                stopped = not good
                out.append(good)
            yield pdf.assign(ok=pd.Series(out, index=pdf.index, dtype=object))

    ordered = rows.repartition(key).sortWithinPartitions(key, "created_at", "id")
    return ordered.select(*names).mapInPandas(run, f"{rows._jdf.schema().toDDL()}, ok boolean")


def committed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (id, created_at, ok, ...) with ``status``: published before the key's first row that wasn't sent, pending from it on.

    With no keys the whole outbox is one order.  Only a key's first failure is needed, so nothing is sorted.
    """
    place = F.struct("created_at", "id")
    failed = F.coalesce(~F.col("ok"), F.lit(True))
    on = keys or ["_all"]
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    stops = rows.groupBy(*on).agg(F.min(F.when(failed, place)).alias("_stop"), F.count(F.lit(1)).alias("_n"))
    found = attach(rows, checkpointed(stops.filter("_stop is not null")), on, "_n", F.col("id"))
    stop = F.col("_stop")
    open_ = stop.isNull() | (F.col("created_at") < stop["created_at"]) | ((F.col("created_at") == stop["created_at"]) & (F.col("id") < stop["id"]))
    return found.withColumn("status", F.when(open_, PUBLISHED).otherwise(PENDING)).drop("_stop", "_all")
