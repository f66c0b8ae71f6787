"""Rules as columns over all profiles at once.

``evaluate`` gathers the behaviour leaves of all rules, drops repeated ones, and
computes them in at most three passes over the behavioural log:

* counts, sums and last occurrences are conditional aggregates of one
  ``groupBy(tenant, profile)``, with partial aggregation before its only shuffle;
* sequences and absences after an anchor need the order of a profile's events, and
  read only the events they name.  Sequences look for chains in slices of time that
  overlap by the longest chain (``_sequences``), so a profile's events spread over
  tasks; absences after an anchor are windows over (tenant, profile).

The results are left-joined to the profiles, because a profile without events
counts 0 and satisfies absences.  The evaluation instant is always a literal.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..functions.scalars import rfc3339_text
from .rules import Behavior, Rule, parse_window, referenced_properties

KEYS = ("tenant_id", "profile_id")
Resolver = Callable[[str], values.Value]


#: An evaluation instant: a literal, or a timestamp column for rows with instants of their own.
Instant = dt.datetime | Column


def micros(at: Instant) -> int | Column:
    if isinstance(at, Column):
        return F.unix_micros(at)
    at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    return int((at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def moment(at: Instant, shift: int = 0) -> Column:
    return F.timestamp_micros(F.lit(micros(at) + shift))


def comparison(rule: Rule, resolve: Resolver) -> Column:
    value = resolve(rule.field)
    op, other = rule.op, rule.value
    if op == "exists":
        return value.present
    if op == "not_exists":
        return ~value.present
    if op in ("eq", "neq"):
        hit = value.equals(other)
    elif op in ("contains", "not_contains"):
        hit = value.contains(other)
    elif op in ("in", "not_in"):
        hit = reduce(or_, (F.coalesce(value.equals(x), F.lit(False)) for x in other), F.lit(False))
    else:
        hit = value.compare(op, other)
    hit = F.coalesce(hit, F.lit(False))
    return value.present & (~hit if op in ("neq", "not_contains", "not_in") else hit)


def condition(rule: Rule, resolve: Resolver, behaves: Callable[[Behavior], Column] | None) -> Column:
    """The rule as a two-valued column.  Without ``behaves``, behaviour leaves and their negations are false."""
    if rule.behavior is not None:
        return behaves(rule.behavior) if behaves else F.lit(False)
    if rule.operator == "not":
        inner = rule.conditions[0]
        if behaves is None and any(r.behavior is not None for r in inner.walk()):
            return F.lit(False)
        return ~condition(inner, resolve, behaves)
    if rule.operator:
        return reduce(and_ if rule.operator == "and" else or_, (condition(c, resolve, behaves) for c in rule.conditions))
    return comparison(rule, resolve)


def resolver(columns: dict[str, Column], documents: dict[str, Column]) -> Resolver:
    """Field paths to values: ``columns`` are whole fields, ``documents`` prefixes of parsed JSON; others are missing."""

    def resolve(path: str) -> values.Value:
        if path in columns:
            return values.plain(columns[path])
        for prefix, document in documents.items():
            if path.startswith(prefix + "."):
                return values.json_value(document, path[len(prefix) + 1 :].split("."))
        return values.absent()

    return resolve


def profile_resolver(event: dict[str, Column] | None = None) -> Resolver:
    """Fields of a profile row with parsed ``_traits`` and ``_computed``, and of an event where there is one."""
    columns = {
        "profile.canonical_user_id": F.col("canonical_user_id"),
        "profile.first_seen_at": rfc3339_text(F.col("first_seen_at")),
        "profile.last_seen_at": rfc3339_text(F.col("last_seen_at")),
    }
    documents = {"profile.traits": F.col("_traits"), "profile.computed_attributes": F.col("_computed")}
    if event:
        columns |= {f"event.{k}": event[k] for k in ("event_name", "type") if k in event}
        documents |= {f"event.{k}": event[k] for k in ("properties", "context") if k in event}
    return resolver(columns, documents)


def with_documents(profiles: DataFrame) -> DataFrame:
    return profiles.withColumns(
        {"_traits": values.parsed(F.col("traits")), "_computed": values.parsed(F.col("computed_attributes"))}
    )


def leaf_key(b: Behavior, at: Instant) -> str:
    """A short name that equal leaves share."""
    text = json.dumps([asdict(b), "row" if isinstance(at, Column) else micros(at)], sort_keys=True, default=str)
    return "leaf_" + hashlib.sha256(text.encode()).hexdigest()[:16]


def threshold(x: Column, op: str, value: float | None) -> Column:
    if op not in ("gte", "gt", "lte", "lt", "eq") or value is None:
        return F.lit(False)
    return {"gte": x >= value, "gt": x > value, "lte": x <= value, "lt": x < value, "eq": x == value}[op]


def in_window(ts: Column, window: str, at: Instant) -> Column:
    """Trailing and closed on both ends."""
    return ts.between(moment(at, -parse_window(window)), moment(at))


def where_column(b: Behavior) -> Column:
    """The filter of a leaf over log rows; only event properties are in scope there."""
    if b.where is None:
        return F.lit(True)
    return condition(b.where, resolver({}, {"event.properties": F.col("_props")}), None)


@dataclass(frozen=True)
class Simple:
    """A leaf that is one conditional aggregate; ``test`` maps the aggregate to the leaf's truth."""

    aggregate: Column
    test: Callable[[Column], Column]


def simple_leaf(b: Behavior, at: Instant) -> Simple | None:
    named = F.col("event_name") == b.event_name
    ts = F.col("occurred_at")
    if b.kind in ("count", "frequency"):
        hit = named & in_window(ts, b.window, at) & where_column(b)
        if b.kind == "frequency" and b.value_prop:
            amount = F.sum(F.when(hit, values.json_number(F.col("_props"), b.value_prop)))
            return Simple(amount, lambda x: threshold(F.coalesce(x, F.lit(0.0)), b.op, b.value))
        return Simple(F.count_if(hit), lambda x: threshold(F.coalesce(x, F.lit(0)), b.op, b.value))
    last = F.max(F.when(named & (ts <= moment(at)), ts))
    since = moment(at, -parse_window(b.window)) if b.window else None
    if b.kind == "recency":
        return Simple(last, lambda x: F.coalesce(x >= since, F.lit(False)))
    if b.kind == "absence" and b.anchor is None:
        return Simple(last, lambda x: F.coalesce(x < since, F.lit(True)))
    return None


def sliceable(b: Behavior) -> bool:
    """Whether a leaf only asks how often or when last an event occurred."""
    if b.kind in ("count", "frequency"):
        return b.where is None and not b.value_prop
    return b.kind == "recency" or b.kind == "absence" and b.anchor is None


def sliced_leaf(b: Behavior, at: Instant) -> Simple:
    """The leaf over hourly slices: whole slices by their count and ends, a slice across a bound by its exact times."""
    named, now = F.col("event_name") == b.event_name, moment(at)
    first, last, times = F.col("first_at"), F.col("last_at"), F.col("times")
    if b.kind in ("count", "frequency"):
        since = moment(at, -parse_window(b.window))
        part = F.size(F.filter(times, lambda t: t.between(since, now))).cast("long")
        n = F.when((first >= since) & (last <= now), F.col("count")).when((last < since) | (first > now), F.lit(0)).otherwise(part)
        return Simple(F.sum(F.when(named, n)), simple_leaf(b, at).test)
    newest = F.when(last <= now, last).otherwise(F.array_max(F.filter(times, lambda t: t <= now)))
    return Simple(F.max(F.when(named, newest)), simple_leaf(b, at).test)


#: A slice of time is so many times as long as the longest chain of its sequences.
SLICE_CHAINS = 4


def _sequences(log: DataFrame, found: dict[str, Behavior], chains: int = SLICE_CHAINS) -> DataFrame:
    """(tenant, profile, one boolean per sequence) over log rows with ``_us``.

    A chain spans at most ``within`` per step after the first.  Time is cut into slices of
    ``chains`` times the longest span; a row near the end of its slice is also in the next
    one, so every chain lies whole in the slice of its last event, and what a slice finds
    is a chain of the profile.  A profile's slices are apart in the shuffle and combined
    before the next one.
    """
    reach = max(parse_window(b.within) * (len(b.steps) - 1) for b in found.values())
    wide = reach * chains
    rest = F.pmod("_us", F.lit(wide))
    own = ((F.col("_us") - rest) / wide).cast("long")
    log = log.select(
        *KEYS, "event_name", "_us", F.explode(F.when(rest >= wide - reach, F.array(own, own + 1)).otherwise(F.array(own))).alias("_slice")
    )
    holds = []
    for name, b in found.items():
        near = Window.partitionBy(*KEYS, "_slice").orderBy("_us").rangeBetween(-parse_window(b.within), -1)
        step = f"{name}_0"
        log = log.withColumn(step, (F.col("event_name") == b.steps[0].event_name).cast("int"))
        for i, s in enumerate(b.steps[1:], 1):
            before = F.coalesce(F.max(step).over(near), F.lit(0))
            step = f"{name}_{i}"
            log = log.withColumn(step, F.when(F.col("event_name") == s.event_name, before).otherwise(0))
        holds.append((F.max(step) == 1).alias(name))
    return log.groupBy(*KEYS).agg(*holds)


def _anchored_leaf(events: DataFrame, b: Behavior, name: str, at: Instant) -> tuple[DataFrame, Column]:
    """(events with helper columns, aggregate that is true where the absence after an anchor holds)."""
    mine = Window.partitionBy(*KEYS)
    ts, now = F.col("_us"), micros(at)
    # The anchor is always a plain count.
    a, span = b.anchor, parse_window(b.window)
    anchored = (F.col("event_name") == a.event_name) & ts.between(now - parse_window(a.window), now)
    events = events.withColumns(
        {
            f"{name}_n": F.sum(anchored.cast("long")).over(mine),
            f"{name}_t": F.max(F.when(anchored, ts)).over(mine),
        }
    )
    start = F.col(f"{name}_t")
    after = (F.col("event_name") == b.event_name) & ts.between(start, start + span)
    ripe = threshold(F.max(f"{name}_n"), a.op, a.value) & (F.max(start) + span <= now)
    return events, ripe & (F.count_if(after) == 0)


def leaves(rules: list[Rule]) -> list[Behavior]:
    return [r.behavior for rule in rules for r in rule.walk() if r.behavior is not None]


def scan_bound(found: list[Behavior], at: dt.datetime) -> int | None:
    """Earliest microsecond that any leaf can see, or None: sequences see everything."""
    if any(b.kind == "sequence" for b in found):
        return None
    spans = [parse_window(w) for b in found for w in (b.window, b.anchor.window if b.anchor else "") if w]
    return micros(at) - max(spans, default=0)


def leaf_table(
    events: DataFrame, rules: list[Rule], at: Instant, slices: DataFrame | None = None
) -> tuple[list[DataFrame], dict[str, Column]]:
    """(tables keyed by tenant and profile to left-join, column of each leaf by its key).

    With ``slices``, hourly slices of the log, leaves that they can answer don't read the log.
    """
    found: dict[str, Behavior] = {leaf_key(b, at): b for b in leaves(rules)}
    columns: dict[str, Column] = {}
    tables: list[DataFrame] = []
    if slices is not None:
        quick = {k: sliced_leaf(b, at) for k, b in found.items() if sliceable(b)}
        if quick:
            mine = slices.filter(F.col("event_name").isin(sorted({found[k].event_name for k in quick})))
            tables.append(mine.groupBy(*KEYS).agg(*(s.aggregate.alias(k) for k, s in quick.items())))
            columns |= {k: s.test(F.col(k)) for k, s in quick.items()}
        found = {k: b for k, b in found.items() if k not in quick}
    simple = {k: s for k, b in found.items() if (s := simple_leaf(b, at)) is not None}
    ordered = {k: b for k, b in found.items() if k not in simple}

    def rows(these: dict[str, Behavior], bound: bool) -> DataFrame:
        names = sorted(set().union(*(b.names() for b in these.values())))
        out = events.filter(F.col("event_name").isin(names) & (F.col("occurred_at") <= moment(at)))
        since = scan_bound(list(these.values()), at) if bound and isinstance(at, dt.datetime) else None
        return out if since is None else out.filter(F.col("occurred_at") >= F.timestamp_micros(F.lit(since)))

    if simple:
        # Recency and absence only ask whether something is inside the window, so the bound holds for them too,
        # except that "before the window" and "never" then look alike: both satisfy absence and fail recency.
        log = rows({k: found[k] for k in simple}, bound=True)
        if any(b.where is not None or b.value_prop for b in found.values()):
            log = log.withColumn("_props", values.parsed(F.col("props")))
        tables.append(log.groupBy(*KEYS).agg(*(s.aggregate.alias(k) for k, s in simple.items())))
        columns |= {k: s.test(F.col(k)) for k, s in simple.items()}
    chained = {k: b for k, b in ordered.items() if b.kind == "sequence"}
    anchored = {k: b for k, b in ordered.items() if k not in chained}
    exact = F.unix_micros(F.col("occurred_at"))
    if chained:
        tables.append(_sequences(rows(chained, bound=True).withColumn("_us", exact), chained))
    if anchored:
        log = rows(anchored, bound=True).withColumn("_us", exact)
        aggregates = []
        for k, b in anchored.items():
            log, holds = _anchored_leaf(log, b, k, at)
            aggregates.append(holds.alias(k))
        tables.append(log.groupBy(*KEYS).agg(*aggregates))
    columns |= {k: F.coalesce(F.col(k), F.lit(False)) for k in ordered}
    return tables, columns


def evaluate(
    profiles: DataFrame,
    events: DataFrame,
    rules: dict[str, Rule],
    at: dt.datetime,
    event: dict[str, Column] | None = None,
    slices: DataFrame | None = None,
) -> DataFrame:
    """The profiles with one boolean column per rule; ``slices`` serve the leaves that they can."""
    tables, columns = leaf_table(events, list(rules.values()), at, slices)
    out = with_documents(profiles)
    for t in tables:
        out = out.join(t, list(KEYS), "left")
    resolve = profile_resolver(event)
    verdicts = {name: condition(rule, resolve, lambda b: columns[leaf_key(b, at)]) for name, rule in rules.items()}
    return out.select(*profiles.columns, *(v.alias(n) for n, v in verdicts.items()))


def evaluate_rows(rows: DataFrame, events: DataFrame, rule: Rule, at: str) -> DataFrame:
    """Rows (profile columns, unique by tenant and profile) with ``hit``: the rule at each row's own instant ``at``."""
    timed = events.join(rows.select(*KEYS, F.col(at).alias("_at")), list(KEYS))
    tables, columns = leaf_table(timed, [rule], F.col("_at"))
    out = with_documents(rows)
    for t in tables:
        out = out.join(t, list(KEYS), "left")
    # Leaf tests of the last occurrence compare with the instant, which is the row's own here.
    out = out.withColumn("_at", F.col(at))
    verdict = condition(rule, profile_resolver(), lambda b: columns[leaf_key(b, F.col("_at"))])
    return out.select(*rows.columns, verdict.alias("hit"))


def shape_drift(events: DataFrame, b: Behavior, at: dt.datetime) -> DataFrame:
    """(tenant, profile, property, kinds) where a property that the leaf reads has several JSON types in its window."""
    names = referenced_properties(b.where) + ([b.value_prop] if b.value_prop else [])
    log = events.filter((F.col("event_name") == b.event_name) & in_window(F.col("occurred_at"), b.window, at))
    log = log.withColumn("_props", values.parsed(F.col("props")))
    kinds = F.array(
        *(
            F.struct(
                F.lit(n).alias("property"),
                values.json_kind(F.try_variant_get(F.col("_props"), values.json_path([n]), "variant")).alias("kind"),
            )
            for n in sorted(set(names))
        )
    )
    seen = log.select(*KEYS, F.inline(kinds)).filter("kind is not null")
    return seen.groupBy(*KEYS, "property").agg(F.count_distinct("kind").alias("kinds")).filter("kinds > 1")
