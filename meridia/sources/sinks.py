"""Sinks: partitioned logs, keyed files for a bus, and signed webhooks."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ops import with_week

DEFAULT_TIMEOUT_MS = 5000
PARTITIONS = 6


def append_log(log: DataFrame, path: str) -> None:
    """The behavioural log by week, so that windows and retention prune whole folders."""
    with_week(log).repartition("week").write.mode("append").partitionBy("week").parquet(path)


def append_raw(raw: DataFrame, path: str) -> None:
    raw.withColumn("day", F.to_date("received_at")).write.mode("append").partitionBy("day").parquet(path)


def publish(rows: DataFrame, path: str, key: str, value: str = "payload", partitions: int = PARTITIONS) -> None:
    """Keyed messages as JSON lines: one writer per partition of the key, so a key's order is kept.

    With a bus connector on the class path, ``rows`` with key and value columns
    can be written to it in the same way.
    """
    out = rows.select(F.col(key).alias("key"), F.col(value).alias("value"))
    out.repartition(partitions, "key").write.mode("append").json(path)


def signature(secret: str, body: bytes) -> str:
    return hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def sign(rows: DataFrame, secret: str, value: str = "payload") -> DataFrame:
    """Adds ``signature``: HMAC-SHA256 of the payload in hex, by Arrow batches."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else signature(secret, v.encode()))

    return rows.withColumn("signature", run(F.col(value)))


def http_post(config: dict, key: str, body: str) -> int | None:
    """Status of one request, or None for a network failure."""
    import urllib.error
    import urllib.request

    headers = {"Content-Type": "application/json", "Idempotency-Key": key, **config.get("headers", {})}
    if config.get("secret"):
        headers["X-Signature"] = "sha256=" + signature(config["secret"], body.encode())
    request = urllib.request.Request(config["url"], body.encode(), headers, method=config.get("method", "POST"))
    try:
        with urllib.request.urlopen(request, timeout=config.get("timeout_ms", DEFAULT_TIMEOUT_MS) / 1000) as answer:
            return answer.status
    except urllib.error.HTTPError as error:
        return error.code
    except OSError:
        return None


def deliver(tasks: DataFrame, send: Callable[[dict, str, str], int | None] = http_post) -> DataFrame:
    """Send due tasks (with destination ``config`` JSON): adds ``http_status``.

    A task that is sent again carries the same idempotency key, so a repeated
    attempt after a lost executor is harmless to the receiver.
    """
    columns = [f"{n} {t}" for n, t in tasks.dtypes] + ["http_status int"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            sent = [send(json.loads(r.config or "{}"), r.idempotency_key, r.payload) for r in pdf.itertuples(index=False)]
            yield pdf.assign(http_status=pd.array(sent, dtype="Int32"))

    return tasks.mapInPandas(run, ", ".join(columns))
