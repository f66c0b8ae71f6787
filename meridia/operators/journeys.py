"""Journeys: versioned step definitions run over all enrolments at once.

Edges only lead forward, so one pass over the step indices moves every enrolment
as far as its deadlines allow: each index is one projection (or, for a condition
with behaviour, one evaluation), whatever the number of enrolments.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import idempotency_key, split_target
from . import deadlines
from ..plans.compiler import evaluate_rows, moment
from ..plans.rules import Rule, RuleError, analyze, parse_window, references_event, validate

MAX_WEIGHT = 1_000_000
KEYS = ["tenant_id", "journey_id", "profile_id"]
STATE = (
    "tenant_id string, journey_id string, profile_id string, enrollment_seq int, journey_version int, status string, "
    "current_step_index int, step_seq long, due_at timestamp"
)


@dataclass
class Step:
    type: str
    duration: str = ""
    destination_id: str = ""
    next: int = 0
    condition: Rule | None = None
    if_true: int = 0
    if_false: int = 0
    branches: list[tuple[int, int]] = field(default_factory=list)  # (weight, next)

    @staticmethod
    def of(raw: dict) -> Step:
        return Step(
            raw.get("type", ""),
            raw.get("duration", ""),
            raw.get("destination_id", ""),
            raw.get("next", 0),
            Rule.of(raw["condition"]) if raw.get("condition") is not None else None,
            raw.get("if_true", 0),
            raw.get("if_false", 0),
            [(b.get("weight", 0), b.get("next", 0)) for b in raw.get("branches") or []],
        )


#: What each kind of step may set.
_OWN = {
    "wait": {"duration", "next"},
    "send": {"destination_id", "next"},
    "condition": {"condition", "if_true", "if_false"},
    "split": {"branches"},
}


def parse(definition: str | dict) -> list[Step]:
    """Validated steps."""
    raw = json.loads(definition) if isinstance(definition, str) else definition
    steps = [Step.of(s) for s in raw.get("steps") or []]
    n = len(steps)

    def need(ok: bool, message: str) -> None:
        if not ok:
            raise RuleError(message)

    need(n > 0, "journey requires at least one step")
    for i, s in enumerate(steps):
        need(s.type in _OWN, f"step {i} unknown type {s.type!r}")
        filled = {k for k in ("duration", "destination_id", "next", "condition", "if_true", "if_false", "branches") if getattr(s, k)}
        need(filled <= _OWN[s.type], f"step {i} {s.type} must only set its own fields")
        targets = []
        if s.type == "wait":
            parse_window(s.duration)
        elif s.type == "send":
            need(bool(s.destination_id), f"step {i} send requires destination_id")
        elif s.type == "condition":
            need(s.condition is not None, f"step {i} condition requires a rule")
            validate(s.condition)
            need(not references_event(s.condition), f"step {i} condition must not reference event.* fields")
            targets = [s.if_true, s.if_false]
        else:
            need(len(s.branches) >= 2, f"step {i} split requires at least two branches")
            need(all(0 < w <= MAX_WEIGHT for w, _ in s.branches), f"step {i} split weights must be in 1..{MAX_WEIGHT}")
            targets = [t for _, t in s.branches]
        if s.next:
            targets = [s.next]
        need(all(i < t <= n for t in targets), f"step {i} targets must be forward (in {i + 1}..{n})")
    need(any(s.type == "send" for s in steps), "journey requires at least one send step")
    return steps


def metadata(steps: list[Step]) -> tuple[list[str], int]:
    """(event names, longest window in seconds) over all conditions."""
    found = [analyze(s.condition) for s in steps if s.condition is not None]
    return sorted(set().union(*(a.event_names for a in found)) if found else []), max((a.max_window_seconds for a in found), default=0)


def enroll(entries: DataFrame, journeys: DataFrame, existing: DataFrame, profiles: DataFrame, at: dt.datetime) -> DataFrame:
    """New enrolments.  ``entries`` has tenant_id, profile_id and segment_id (entered) or event_name (seen).

    A profile enters a journey whose entry matches, unless it has an active run or
    has used up its enrolments; vanished profiles don't enter.
    """
    j = journeys.filter("status = 'active'").select(
        F.col("tenant_id").alias("_t"), "journey_id", "entry_segment_id", "entry_event_name", "max_enrollments", "current_version"
    )
    by_segment = (F.col("entry_segment_id") == F.col("segment_id")) & (F.col("tenant_id") == F.col("_t"))
    by_event = (F.col("entry_event_name") == F.col("event_name")) & (F.col("tenant_id") == F.col("_t"))
    segment = entries.filter("segment_id is not null").join(j.filter("entry_segment_id is not null"), by_segment)
    event = entries.filter("event_name is not null").join(j.filter("entry_event_name is not null"), by_event)
    fan = segment.unionByName(event).dropDuplicates(KEYS)
    fan = fan.join(profiles.select("tenant_id", "profile_id"), ["tenant_id", "profile_id"], "left_semi")
    runs = existing.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("runs"), F.max("enrollment_seq").alias("last"), F.max(F.col("status") == "active").alias("active")
    )
    open_ = ~F.coalesce("active", F.lit(False)) & (F.coalesce("runs", F.lit(0)) < F.col("max_enrollments"))
    return fan.join(runs, KEYS, "left").filter(open_).select(
        *KEYS,
        (F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("enrollment_seq"),
        F.col("current_version").cast("int").alias("journey_version"),
        F.lit("active").alias("status"),
        F.lit(0).alias("current_step_index"),
        F.lit(0).cast("long").alias("step_seq"),
        moment(at).alias("due_at"),
    )


def exits(left: DataFrame, journeys: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Enrolments with those ended whose profile left the entry segment of a journey that asks for it."""
    j = journeys.filter("status = 'active' and exit_on_segment_leave").select("tenant_id", "journey_id", F.col("entry_segment_id").alias("segment_id"))
    gone = left.join(j, ["tenant_id", "segment_id"]).select(*KEYS).distinct().withColumn("_gone", F.lit(True))
    ended = F.coalesce("_gone", F.lit(False)) & (F.col("status") == "active")
    out = enrollments.join(gone, KEYS, "left")
    return out.withColumn("status", F.when(ended, "exited").otherwise(F.col("status"))).drop("_gone")


def split_key() -> Column:
    return F.concat_ws("|", "tenant_id", "journey_id", "profile_id", "enrollment_seq", "current_step_index")


def advance(
    enrollments: DataFrame, steps: list[Step], profiles: DataFrame, events: DataFrame, until: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """(enrolments after all steps due by ``until``, the sends they made)."""
    state, sends = enrollments.select(*(x.split()[0] for x in STATE.split(", "))), []
    n = len(steps)
    for i, s in enumerate(steps):
        here = (F.col("status") == "active") & (F.col("current_step_index") == i) & (F.col("due_at") <= moment(until))

        def move(target: Column, due: Column = F.col("due_at"), here: Column = here) -> dict[str, Column]:
            return {
                "status": F.when(here & (target >= n), "completed").otherwise(F.col("status")),
                "step_seq": F.when(here, F.col("step_seq") + 1).otherwise(F.col("step_seq")),
                "due_at": F.when(here, due).otherwise(F.col("due_at")),
                "current_step_index": F.when(here, target).otherwise(F.col("current_step_index")).cast("int"),
            }

        onward = F.lit(s.next or i + 1)
        if s.type == "wait":
            state = state.withColumns(move(onward, F.timestamp_micros(F.unix_micros("due_at") + parse_window(s.duration))))
        elif s.type == "split":
            state = state.withColumns(move(split_target(split_key(), s.branches)))
        elif s.type == "send":
            customer = ["canonical_user_id", "traits", "computed_attributes"]
            alive = profiles.select("tenant_id", "profile_id", *(F.col(c).alias(f"_{c}") for c in customer)).withColumn("_alive", F.lit(True))
            state = state.join(alive, ["tenant_id", "profile_id"], "left")
            sends.append(state.filter(here & F.col("_alive")).select(*_send(i, s)))
            erased = here & F.col("_alive").isNull()
            moved = move(onward, here=here & F.col("_alive"))
            moved["status"] = F.when(erased, "exited").otherwise(moved["status"])
            state = state.withColumns(moved).drop("_alive", *(f"_{c}" for c in customer))
        else:
            ready = state.filter(here).join(profiles, ["tenant_id", "profile_id"], "left")
            verdict = evaluate_rows(ready, events, s.condition, "due_at").select(*KEYS, "hit")
            state = state.join(verdict, KEYS, "left")
            state = state.withColumns(move(F.when(F.col("hit"), s.if_true).otherwise(s.if_false))).drop("hit")
    return state, reduce(DataFrame.unionByName, sends)


def _send(i: int, s: Step) -> list[Column]:
    source = F.concat_ws(":", F.lit("journey"), "journey_id", "journey_version", "enrollment_seq")
    change = F.lit(f"step:{i}")
    # A journey has one subscription per destination.
    subscription = F.concat_ws(":", F.lit("journey"), "journey_id", F.lit(s.destination_id))
    key = idempotency_key(F.col("tenant_id"), F.lit(s.destination_id), subscription, F.col("profile_id"), source, change)
    return [
        F.col("tenant_id"),
        F.col("journey_id"),
        F.col("profile_id"),
        F.lit(s.destination_id).alias("destination_id"),
        F.lit(i).alias("step_index"),
        F.col("due_at").alias("sent_at"),
        source.alias("source_event_id"),
        change.alias("change"),
        key.alias("idempotency_key"),
        payload(i, "_").alias("payload"),
    ]


def payload(step: int, prefix: str = "") -> Column:
    """What a send delivers: its step and the customer (a fixed format that destinations read)."""
    customer = F.struct(
        F.col(f"{prefix}canonical_user_id").alias("id"),
        F.parse_json(F.col(f"{prefix}traits")).alias("traits"),
        F.parse_json(F.col(f"{prefix}computed_attributes")).alias("computed_attributes"),
    )
    step_index = F.lit(step).alias("step_index")
    return F.to_json(F.struct(F.lit("journey_step").alias("type"), "tenant_id", "journey_id", step_index, customer.alias("customer")))


_RUN = ("journey_id", "profile_id", "enrollment_seq")


def claim(enrollments: DataFrame, at: dt.datetime, batch: int, per_tenant: int, lease_seconds: int = 300) -> DataFrame:
    """The earliest due active enrolments, a bounded number of each tenant, with ``claimed_at`` as the fence of what follows."""
    due = deadlines.fair_claim(enrollments.filter("status = 'active'"), at, batch, per_tenant, lease_seconds, _RUN)
    return due.withColumn("claimed_at", moment(at))


def fenced(enrollments: DataFrame, claimed: DataFrame, advanced: DataFrame) -> DataFrame:
    """``enrollments`` with the advanced rows of a claim, where the claim still holds.

    A row that ended, was claimed again or moved meanwhile keeps what it has.
    """
    keys = ["tenant_id", *_RUN]
    moved = ("status", "current_step_index", "step_seq", "due_at")
    fence = claimed.select(*keys, F.col("claimed_at").alias("_fence"), F.col("step_seq").alias("_seq"))
    new = advanced.select(*keys, *(F.col(c).alias(f"_{c}") for c in moved))
    joined = enrollments.join(fence.join(new, keys), keys, "left")
    holds = F.coalesce((F.col("status") == "active") & (F.col("claimed_at") == F.col("_fence")) & (F.col("step_seq") == F.col("_seq")), F.lit(False))
    cleared = {"claimed_at": F.lit(None).cast("timestamp"), "attempts": F.lit(0)}
    values = {c: F.col(f"_{c}") for c in moved} | {c: v for c, v in cleared.items() if c in enrollments.columns}
    return joined.select(*(F.when(holds, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in enrollments.columns))


def after_failure(enrollments: DataFrame, at: dt.datetime) -> DataFrame:
    """Active failed enrolments with a longer delay or parked; ended ones as they are."""
    failed = deadlines.after_failure(enrollments.filter("status = 'active'"), at)
    return failed.unionByName(enrollments.filter("status <> 'active'"))


def parked(enrollments: DataFrame, tenant: str, journey: str, limit: int = 100) -> DataFrame:
    """Parked enrolments of a journey, the latest parked first."""
    mine = enrollments.filter((F.col("tenant_id") == tenant) & (F.col("journey_id") == journey) & F.col("parked_at").isNotNull())
    return mine.orderBy(F.col("parked_at").desc(), "profile_id").limit(limit)


def backfill(memberships: DataFrame, journeys: DataFrame, existing: DataFrame, at: dt.datetime) -> DataFrame:
    """First enrolments of everyone who is in the entry segment of an active journey already.

    All pages of the population at once; who has an enrolment of the journey keeps it.
    """
    j = journeys.filter("status = 'active' and entry_segment_id is not null").select(
        "tenant_id", "journey_id", F.col("entry_segment_id").alias("segment_id"), "current_version"
    )
    inside = memberships.filter("status = 'active'").select("tenant_id", "segment_id", "profile_id")
    fresh = inside.join(j, ["tenant_id", "segment_id"]).join(existing.select(*KEYS), KEYS, "left_anti")
    return fresh.select(
        *KEYS,
        F.lit(0).alias("enrollment_seq"),
        F.col("current_version").cast("int").alias("journey_version"),
        F.lit("active").alias("status"),
        F.lit(0).alias("current_step_index"),
        F.lit(0).cast("long").alias("step_seq"),
        moment(at).alias("due_at"),
    )


def prune(enrollments: DataFrame, at: dt.datetime, days: int = 90) -> DataFrame:
    """Drop ended enrolments older than the retention."""
    old = (F.col("status") != "active") & (F.col("due_at") < moment(at, -days * 86_400_000_000))
    return enrollments.filter(~old)


def latest_run(enrollments: DataFrame) -> DataFrame:
    newest = Window.partitionBy(*KEYS).orderBy(F.col("enrollment_seq").desc())
    return enrollments.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")
