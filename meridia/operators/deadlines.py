"""When a rule's verdict can flip next without a new event, and work queues over such deadlines.

A window is closed on both ends, so a flip shows at the first instant strictly
after its due time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import PARK_AFTER, park_delay_seconds
from ..plans.compiler import KEYS, micros, moment
from ..plans.rules import Behavior, Rule, parse_window, references_event


def boundaries(b: Behavior) -> list[int]:
    """The ranks, from the newest, whose ageing out changes a count leaf's verdict."""
    k = int(b.value) if b.value is not None else 0
    if k < 1:
        return []
    return {"gte": [k], "lt": [k], "gt": [k + 1], "lte": [k + 1], "eq": [k, k + 1]}.get(b.op, [])


def _candidates(rule: Rule) -> list[tuple[str, str, list[int] | None]]:
    """(event name, window, ranks) of every leaf with a deadline; ranks None: the last occurrence without a lower bound."""
    out = []
    for b in (r.behavior for r in rule.walk() if r.behavior is not None):
        if b.kind in ("absence", "recency"):
            name = b.anchor.event_name if b.kind == "absence" and b.anchor else b.event_name
            out.append((name, b.window, None))
        elif b.kind == "count" and (ranks := boundaries(b)):
            out.append((b.event_name, b.window, ranks))
    return out


def depth(rules: list[Rule]) -> tuple[set[str], int, int]:
    """(event names, longest window in microseconds, largest rank) that the deadlines of the rules look at."""
    wanted = [c for rule in rules for c in _candidates(rule)]
    return {n for n, _, _ in wanted}, max((parse_window(w) for _, w, _ in wanted), default=0), max((max(r) if r else 1 for *_, r in wanted), default=1)


def next_due(log: DataFrame, rule: Rule, at: dt.datetime) -> DataFrame:
    """(tenant, profile, due_at): the earliest due time strictly after ``at``, for profiles that have one.

    One ranking per profile and event name serves all leaves; its limit (the
    largest rank any leaf needs) is pushed below the only shuffle.
    """
    wanted = _candidates(rule)
    if not wanted:
        return log.limit(0).select(*KEYS, F.lit(None).cast("timestamp").alias("due_at"))
    deepest = max(max(r) if r else 1 for _, _, r in wanted)
    newest = Window.partitionBy(*KEYS, "event_name").orderBy(F.col("occurred_at").desc(), F.col("event_id").desc())
    rows = log.filter(F.col("event_name").isin(sorted({n for n, _, _ in wanted})) & (F.col("occurred_at") <= moment(at)))
    ranked = rows.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= deepest)
    us = F.unix_micros("occurred_at")
    dues: list[Column] = []
    for name, window, ranks in wanted:
        span = parse_window(window)
        for rank in ranks or [1]:
            due = us + F.lit(span)
            hit = (F.col("event_name") == name) & (F.col("_rn") == rank) & (due > micros(at))
            if ranks:
                hit &= us >= micros(at) - span
            dues.append(F.min(F.when(hit, due)))
    earliest = F.least(*dues) if len(dues) > 1 else dues[0]
    out = ranked.groupBy(*KEYS).agg(earliest.alias("_due")).filter("_due is not null")
    return out.select(*KEYS, F.timestamp_micros("_due").alias("due_at"))


def fair_claim(
    pending: DataFrame,
    at: dt.datetime,
    batch: int,
    per_tenant: int,
    lease_seconds: int = 300,
    keys: tuple[str, ...] = ("segment_id", "profile_id"),
) -> DataFrame:
    """The earliest due rows, at most ``per_tenant`` of each tenant and ``batch`` in all.

    ``pending`` has tenant_id, ``keys``, due_at, parked_at; where it has claimed_at
    too, rows under a claim that is no older than the lease are left.
    """
    order = Window.partitionBy("tenant_id").orderBy("due_at", *keys)
    due = pending.filter((F.col("due_at") <= moment(at)) & F.col("parked_at").isNull())
    if "claimed_at" in pending.columns:
        stale = F.col("claimed_at") < moment(at, -lease_seconds * 1_000_000)
        due = due.filter(F.col("claimed_at").isNull() | stale)
    fair = due.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= per_tenant).drop("_rn")
    return fair.orderBy("due_at", "tenant_id", *keys).limit(batch)


def after_failure(pending: DataFrame, at: dt.datetime, base: int = 5, cap: int = 3600) -> DataFrame:
    """Failed rows: one more attempt and a doubling delay, or parked, with their due time, after PARK_AFTER attempts."""
    attempts = F.col("attempts") + 1
    later = F.timestamp_micros(F.lit(micros(at)) + park_delay_seconds(F.col("attempts"), base, cap) * 1_000_000)
    new = {
        "attempts": attempts,
        "due_at": F.when(attempts >= PARK_AFTER, F.col("due_at")).otherwise(later),
        "parked_at": F.when(attempts >= PARK_AFTER, moment(at)),
    }
    return pending.withColumns(new | ({"claimed_at": F.lit(None).cast("timestamp")} if "claimed_at" in pending.columns else {}))


def unparked(pending: DataFrame, at: dt.datetime) -> DataFrame:
    """Parked rows, due now with their attempts cleared."""
    return pending.filter("parked_at is not null").withColumns(
        {"attempts": F.lit(0), "due_at": moment(at), "parked_at": F.lit(None).cast("timestamp")}
    )


def coalesced(stored: DataFrame, planned: DataFrame, slack_seconds: int = 60) -> DataFrame:
    """Deadlines to store: planned ones, except where the stored one is within the slack and not parked."""
    keys = ["tenant_id", "segment_id", "profile_id"]
    old = stored.select(*keys, F.col("due_at").alias("_old"), F.col("parked_at").alias("_parked"))
    close = F.abs(F.unix_micros("due_at") - F.unix_micros("_old")) <= slack_seconds * 1_000_000
    keep = F.coalesce(close & F.col("_parked").isNull(), F.lit(False))
    joined = planned.join(old, keys, "left")
    return joined.select(*keys, F.when(keep, F.col("_old")).otherwise(F.col("due_at")).alias("due_at"))


def safety_page(memberships: DataFrame, pending: DataFrame, limit: int) -> DataFrame:
    """A page of active members without a stored deadline."""
    keys = ["tenant_id", "segment_id", "profile_id"]
    return memberships.filter("status = 'active'").join(pending.select(*keys), keys, "left_anti").select(*keys).orderBy(*keys).limit(limit)


def earliest(stored: DataFrame, planned: DataFrame) -> DataFrame:
    """Stored and planned deadlines merged: the earlier one of each key."""
    keys = ["tenant_id", "segment_id", "profile_id"]
    both = stored.select(*keys, "due_at").unionByName(planned.select(*keys, "due_at"))
    return both.groupBy(*keys).agg(F.min("due_at").alias("due_at"))


def sweepable(claimed: DataFrame, segments: DataFrame, rules: dict[str, Rule], profiles: DataFrame) -> DataFrame:
    """Claimed rows worth evaluating: the segment is active, its rule needs no event, and the profile exists."""
    free = [name for name, rule in sorted(rules.items()) if not references_event(rule)]
    live = segments.filter("status = 'active'").select("tenant_id", "segment_id")
    rows = claimed.filter(F.col("segment_id").isin(free)).join(live, ["tenant_id", "segment_id"], "left_semi")
    return rows.join(profiles.select(*KEYS), list(KEYS), "left_semi")
