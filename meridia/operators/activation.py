"""Activation: membership changes become consent-gated, idempotent tasks with retries and a breaker."""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MAX_ATTEMPTS, idempotency_key, retry_delay_seconds
from ..plans.compiler import moment
from .prefix import recent

#: HTTP statuses worth a retry.
RETRYABLE = (408, 429, 500, 502, 503, 504)
#: Fixed values of the breaker.
FAILURES, WINDOW_SECONDS, COOLDOWN_SECONDS = 5, 60, 30


def consent_status(profiles: DataFrame, consent: DataFrame, channel: Column, purpose: Column) -> DataFrame:
    """Adds ``consent``: the stored status, or unknown."""
    c = consent.select("tenant_id", "profile_id", F.col("channel").alias("_c"), F.col("purpose").alias("_p"), F.col("status").alias("_s"))
    df = profiles.withColumns({"_channel": channel, "_purpose": purpose})
    same = (df.tenant_id == c.tenant_id) & (df.profile_id == c.profile_id) & (F.col("_channel") == F.col("_c")) & (F.col("_purpose") == F.col("_p"))
    out = df.join(c, same, "left").select(*(df[x] for x in profiles.columns), F.coalesce("_s", F.lit("unknown")).alias("consent"))
    return out


def subscriptions_of(subscriptions: DataFrame, destinations: DataFrame) -> DataFrame:
    """Active subscriptions of active destinations, with the destination's channel and purpose."""
    d = destinations.filter("status = 'active'").select(
        "tenant_id",
        "destination_id",
        F.coalesce(F.get_json_object("config", "$.channel"), F.col("type")).alias("channel"),
        F.coalesce(F.get_json_object("config", "$.purpose"), F.lit("marketing")).alias("purpose"),
    )
    return subscriptions.filter("status = 'active'").select("tenant_id", "subscription_id", "destination_id", "segment_id").join(
        d, ["tenant_id", "destination_id"]
    )


def payload() -> Column:
    customer = F.struct(
        F.col("canonical_user_id").alias("id"),
        F.parse_json("traits").alias("traits"),
        F.parse_json("computed_attributes").alias("computed_attributes"),
    )
    return F.to_json(
        F.struct(
            F.lit("segment_membership_changed").alias("type"),
            "tenant_id",
            "segment_id",
            customer.alias("customer"),
            "change",
            "transition_seq",
            F.col("changed_at").alias("occurred_at"),
        )
    )


def tasks(feed: DataFrame, subscriptions: DataFrame, destinations: DataFrame, profiles: DataFrame, consent: DataFrame) -> DataFrame:
    """One task per change and active subscription of its segment; denied consent makes a skipped one.

    Subscriptions are a catalog; the join's strategy is left to its size.
    """
    fan = feed.join(subscriptions_of(subscriptions, destinations), ["tenant_id", "segment_id"])
    fan = fan.join(profiles.select("tenant_id", "profile_id", "canonical_user_id", "traits", "computed_attributes"), ["tenant_id", "profile_id"])
    gated = consent_status(fan, consent, F.col("channel"), F.col("purpose"))
    denied = F.col("consent") == "denied"
    key = idempotency_key(*(F.col(c) for c in ("tenant_id", "destination_id", "subscription_id", "profile_id", "reason", "change")))
    return gated.select(
        "tenant_id",
        "destination_id",
        "subscription_id",
        "profile_id",
        F.col("reason").alias("source_event_id"),
        key.alias("idempotency_key"),
        F.when(denied, "skipped").otherwise("pending").alias("status"),
        F.when(denied, "consent_denied").alias("last_error"),
        F.lit(0).alias("attempt_count"),
        F.lit(None).cast("timestamp").alias("next_attempt_at"),
        F.when(~denied, payload()).alias("payload"),
    ).dropDuplicates(["tenant_id", "idempotency_key"])


def due(task_rows: DataFrame, at: dt.datetime, limit: int = 50) -> DataFrame:
    ready = F.col("status").isin("pending", "failed_retryable")
    now = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= moment(at))
    return task_rows.filter(ready & now).orderBy(F.col("next_attempt_at").asc_nulls_first(), "idempotency_key").limit(limit)


def outcome_class(http_status: Column) -> Column:
    """success, retryable or permanent; no status is a network failure."""
    return (
        F.when(http_status.between(200, 299), "success")
        .when(http_status.isNull() | http_status.isin(*RETRYABLE), "retryable")
        .otherwise("permanent")
    )


def after_send(rows: DataFrame, at: dt.datetime) -> DataFrame:
    """Next status, attempt count and retry time of tasks with ``http_status``."""
    attempt = F.col("attempt_count") + 1
    kind = outcome_class(F.col("http_status"))
    again = (kind == "retryable") & (attempt < MAX_ATTEMPTS)
    return rows.withColumns(
        {
            "attempt_count": attempt,
            "status": F.when(kind == "success", "succeeded").when(again, "failed_retryable").otherwise("failed_permanent"),
            "next_attempt_at": F.when(
                again, F.timestamp_micros(F.unix_micros(moment(at)) + retry_delay_seconds(attempt) * 1_000_000)
            ),
        }
    )


class Breaker:
    """Per destination: opens after FAILURES within the window, lets one trial through after the cooldown."""

    def __init__(self) -> None:
        self.failures: deque[float] = deque()
        self.opened: float | None = None
        self.trial = False

    def allow(self, now: float) -> bool:
        if self.opened is None:
            return True
        if now - self.opened >= COOLDOWN_SECONDS and not self.trial:
            self.trial = True
            return True
        return False

    def record(self, now: float, success: bool) -> None:
        if success:
            self.failures.clear()
            self.opened, self.trial = None, False
        elif self.trial:
            self.failures.clear()
            self.opened, self.trial = now, False
        else:
            while self.failures and self.failures[0] <= now - WINDOW_SECONDS:
                self.failures.popleft()
            self.failures.append(now)
            if len(self.failures) >= FAILURES:
                self.failures.clear()
                self.opened = now


def breaker(attempts: DataFrame) -> DataFrame:
    """Replay sends per destination in order: adds ``allowed``.  ``attempts`` has destination_id, sent_at, seq, success.

    Rows stream through sorted partitions; only the breaker's few failure times are held.
    """
    columns = ["destination_id", "seq", "sent_at", "success"]

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Breaker()
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                if r.destination_id != key:
                    key, state = r.destination_id, Breaker()
                now = r.sent_at.timestamp()
                ok = state.allow(now)
                if ok:
                    state.record(now, r.success)
                out.append(ok)
            yield pdf.assign(allowed=out)

    rows = attempts.select(*columns).repartition("destination_id").sortWithinPartitions("destination_id", "sent_at", "seq")
    return rows.mapInPandas(replay, "destination_id string, seq long, sent_at timestamp, success boolean, allowed boolean")


def hot_destinations(deliveries: DataFrame) -> DataFrame:
    """Failures of the last WINDOW_SECONDS before each failed delivery; a destination's failures are counted in slices of time."""
    failed = deliveries.filter("not success").withColumn("_us", F.unix_micros("sent_at"))
    return recent(failed, ["destination_id"], "_us", WINDOW_SECONDS * 1_000_000, "recent_failures").drop("_us")


def destination_error(kind: str, config: dict) -> str | None:
    """Why a destination can't be stored, or None."""
    if kind == "webhook":
        return None if config.get("url") else "webhook destination requires config.url"
    if kind == "kafka":
        return None if config.get("topic") else "kafka destination requires config.topic"
    return "type must be webhook or kafka"


def with_consent_target(config: dict, channel: str = "", purpose: str = "") -> dict:
    """The config with the channel and purpose whose consent gates it."""
    return {**config, **({"channel": channel} if channel else {}), **({"purpose": purpose} if purpose else {})}


def subscription_view(subscriptions: DataFrame, destinations: DataFrame) -> DataFrame:
    """All subscriptions with their destination, whatever the status, by destination name."""
    d = destinations.select("tenant_id", "destination_id", "name", F.col("status").alias("destination_status"))
    return subscriptions.join(d, ["tenant_id", "destination_id"]).orderBy("tenant_id", "name", "subscription_id")


def delivery_log(sent: DataFrame) -> DataFrame:
    """Log rows of tasks with ``http_status`` and ``sent_at``."""
    kind = outcome_class(F.col("http_status"))
    return sent.select(
        "tenant_id", "destination_id", "profile_id", "source_event_id", "idempotency_key",
        F.when(kind == "success", "success").otherwise("failed").alias("status"), "http_status",
        (F.col("attempt_count") + 1).alias("attempt_count"), "sent_at",
    )


def deliveries(log: DataFrame, tenant: str, destination: str | None = None, limit: int = 200) -> DataFrame:
    rows = log.filter(F.col("tenant_id") == tenant)
    if destination:
        rows = rows.filter(F.col("destination_id") == destination)
    return rows.orderBy(F.col("sent_at").desc(), "idempotency_key").limit(limit)
