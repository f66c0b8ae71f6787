"""The audience rule language: syntax tree, validation and analysis.

A rule is a logical node (operator, conditions), a comparison (field, op, value)
or a windowed behaviour.  Rules come as JSON and stay on the driver; compiler.py
turns them into columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

#: The words of the language.
LOGICAL = ("and", "or", "not")
COMPARISONS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "not_contains", "in", "not_in", "exists", "not_exists")
THRESHOLDS = ("gte", "gt", "lte", "lt", "eq")
KINDS = ("count", "frequency", "recency", "absence", "sequence")

_UNITS = {"ns": 0.001, "us": 1, "µs": 1, "μs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}
DAY = 86_400_000_000


class RuleError(ValueError):
    """A rule, definition or window that can't be accepted."""


def parse_window(text: str | None) -> int:
    """Microseconds of "7d", "24h", "1h30m", "1.5h"; days are whole and stand alone."""
    if not text:
        raise RuleError("empty window")
    if text.endswith("d"):
        if not re.fullmatch(r"[+-]?\d+", text[:-1]):
            raise RuleError(f"invalid window {text!r}")
        span = int(text[:-1]) * DAY
    else:
        sign, body = (-1, text[1:]) if text[0] == "-" else (1, text.removeprefix("+"))
        parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)", body)
        if "".join(a + b for a, b in parts) != body or not parts:
            raise RuleError(f"invalid window {text!r}")
        span = sign * int(sum(float(a) * _UNITS[b] for a, b in parts))
    if span <= 0:
        raise RuleError(f"window must be positive: {text!r}")
    return span


@dataclass
class Behavior:
    kind: str = ""
    event_name: str = ""
    window: str = ""
    op: str = ""
    value: float | None = None
    value_prop: str = ""
    where: Rule | None = None
    steps: list[Behavior] = field(default_factory=list)
    within: str = ""
    anchor: Behavior | None = None
    exact: bool = False

    @staticmethod
    def of(raw: dict) -> Behavior:
        value = raw.get("value")
        return Behavior(
            kind=raw.get("kind", ""),
            event_name=raw.get("event_name", ""),
            window=raw.get("window", ""),
            op=raw.get("op", ""),
            value=None if value is None else float(value),
            value_prop=raw.get("value_prop", ""),
            where=Rule.of(raw["where"]) if raw.get("where") is not None else None,
            steps=[Behavior.of(s) for s in raw.get("steps") or []],
            within=raw.get("within", ""),
            anchor=Behavior.of(raw["anchor"]) if raw.get("anchor") is not None else None,
            exact=bool(raw.get("exact", False)),
        )

    def names(self) -> set[str]:
        own = {self.event_name} | {s.event_name for s in self.steps}
        return (own | (self.anchor.names() if self.anchor else set())) - {""}


@dataclass
class Rule:
    operator: str = ""
    conditions: list[Rule] = field(default_factory=list)
    field: str = ""
    op: str = ""
    value: Any = None
    behavior: Behavior | None = None

    @staticmethod
    def of(raw: dict) -> Rule:
        return Rule(
            operator=raw.get("operator", ""),
            conditions=[Rule.of(c) for c in raw.get("conditions") or []],
            field=raw.get("field", ""),
            op=raw.get("op", ""),
            value=raw.get("value"),
            behavior=Behavior.of(raw["behavior"]) if raw.get("behavior") is not None else None,
        )

    def walk(self) -> Iterator[Rule]:
        yield self
        for c in self.conditions:
            yield from c.walk()


def parse(rule: str | dict) -> Rule:
    """A validated rule."""
    out = Rule.of(json.loads(rule) if isinstance(rule, str) else rule)
    validate(out)
    return out


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise RuleError(message)


def _validate_behavior(b: Behavior) -> None:
    _need(b.kind in KINDS, f"unknown behavior kind {b.kind!r}")
    # Hourly counts can't answer these.
    b.exact = b.exact or b.kind == "sequence" or b.where is not None or b.anchor is not None
    if b.kind == "sequence":
        _need(len(b.steps) >= 2, "sequence behavior requires at least two steps")
        _need(all(s.event_name for s in b.steps), "sequence step requires event_name")
        parse_window(b.within)
    else:
        _need(bool(b.event_name), f"{b.kind} behavior requires event_name")
        if b.kind in ("count", "frequency"):
            _need(b.op in THRESHOLDS, f"{b.kind} behavior requires op in {THRESHOLDS}")
            _need(b.value is not None, f"{b.kind} behavior requires a value threshold")
        parse_window(b.window)
    if b.where is not None:
        validate(b.where)
    if b.anchor is not None:
        _validate_behavior(b.anchor)


def validate(rule: Rule) -> None:
    if rule.behavior is not None:
        stray = rule.operator or rule.conditions or rule.field or rule.op or rule.value is not None
        _need(not stray, "behavior leaf must not set operator/conditions/field/op/value")
        _validate_behavior(rule.behavior)
        return
    if rule.operator in LOGICAL:
        _need(not (rule.field or rule.op or rule.value is not None), f"{rule.operator} must not set field/op/value")
        if rule.operator == "not":
            _need(len(rule.conditions) == 1, "not requires exactly one condition")
        else:
            _need(len(rule.conditions) > 0, f"{rule.operator} requires at least one condition")
        for c in rule.conditions:
            validate(c)
        return
    _need(not rule.operator, f"unknown logical operator {rule.operator!r}")
    _need(bool(rule.field), "condition requires a field")
    _need(rule.op in COMPARISONS, f"unknown operator {rule.op!r}")
    if rule.op in ("exists", "not_exists"):
        _need(rule.value is None, f"{rule.op} must not have a value")
    elif rule.op in ("in", "not_in"):
        _need(isinstance(rule.value, list), f"{rule.op} requires an array value")
    else:
        _need(rule.value is not None, f"{rule.op} requires a value")


def has_behavior(rule: Rule) -> bool:
    return any(r.behavior is not None for r in rule.walk())


def has_comparison(rule: Rule) -> bool:
    return any(r.field for r in rule.walk())


def references_event(rule: Rule) -> bool:
    """Whether a comparison reads the triggering event; such rules can't be swept."""
    return any(r.field.startswith("event.") for r in rule.walk())


def referenced_properties(rule: Rule | None) -> list[str]:
    """Top-level event properties under a filter."""
    names = {r.field.split(".")[2] for r in (rule.walk() if rule else []) if r.field.startswith("event.properties.")}
    return sorted(names)


def _longest(b: Behavior) -> int:
    own = [parse_window(w) for w in (b.window, b.within) if w]
    below = [_longest(x) for x in [*b.steps, *([b.anchor] if b.anchor else [])]]
    return max([0, *own, *below])


@dataclass(frozen=True)
class Analysis:
    stateful: bool
    stateless: bool
    event_names: tuple[str, ...]
    max_window_seconds: int
    sweepable: bool


def analyze(rule: Rule) -> Analysis:
    behaviors = [r.behavior for r in rule.walk() if r.behavior is not None]
    names = sorted(set().union(*(b.names() for b in behaviors))) if behaviors else []
    longest = max([0, *map(_longest, behaviors)])
    return Analysis(bool(behaviors), has_comparison(rule), tuple(names), longest // 1_000_000, not references_event(rule))
