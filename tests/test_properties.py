"""Randomised checks of value semantics, windows and rollups against plain Python."""

import datetime as dt
import json
import math
import random
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridia.functions import values
from meridia.operators import behavior, ingest
from meridia.plans import compiler
from meridia.plans.rules import DAY, Behavior, RuleError, parse, parse_window

AT = dt.datetime(2026, 6, 10, 12, 17)

LITERALS = ["5", 5, 5.5, "1e3", 1000, "x", "true", True, "", "-0.5", "<nil>", "NaN", " 5"]


def _text(x):
    if isinstance(x, str):
        return x
    return values.literal_text(x)


def _number(x):
    if isinstance(x, bool) or x is None or isinstance(x, list):
        return None
    if isinstance(x, (int, float)):
        return float(x)
    return float(x) if re.match(values.NUMBER, x) else None


def _equal(a, b):
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        return x == y
    return _text(a) == _text(b)


def test_equality_and_order_follow_the_model(spark):
    rng = random.Random(12)
    pool = [None, True, False, 5, 5.0, 5.5, -0.5, 1000, 999999, "5", " 5", "5d", "+5", "1e3", "x", "", "true", "<nil>", "NaN", "inf", ["5", 5], [], [None, True]]
    pool += [rng.choice([round(rng.uniform(-100, 100), rng.randrange(4)), str(rng.randrange(9)), rng.randrange(10**6)]) for _ in range(150)]
    frame = spark.createDataFrame([(i, json.dumps({"v": v})) for i, v in enumerate(pool)], "i int, j string")
    value = values.json_value(values.parsed(F.col("j")), ["v"])
    cols = [F.coalesce(value.equals(x), F.lit(False)).alias(f"e{k}") for k, x in enumerate(LITERALS)]
    cols += [F.coalesce(value.compare("lt", x), F.lit(False)).alias(f"l{k}") for k, x in enumerate(LITERALS)]
    for row in frame.select("i", *cols).collect():
        v = pool[row.i]
        for k, x in enumerate(LITERALS):
            assert row[f"e{k}"] == _equal(v, x), (v, x)
            a, b = _number(v), _number(x)
            less = a is not None and b is not None and not math.isnan(a) and not math.isnan(b) and a < b
            assert row[f"l{k}"] == less, (v, x)


@given(st.integers(1, 400))
def test_day_windows(n):
    assert parse_window(f"{n}d") == n * DAY == parse_window(f"{24 * n}h")


@given(st.text(alphabet="0123456789dhms.-+ ", max_size=6))
def test_windows_are_positive_or_refused(text):
    try:
        assert parse_window(text) > 0
    except RuleError:
        pass


def test_random_logs_agree_with_python(spark):
    rng = random.Random(3)
    names = ["view", "buy"]
    rows = []
    for p in range(25):
        for i in range(rng.randrange(0, 14)):
            at = AT - dt.timedelta(minutes=rng.randrange(-300, 6000))
            rows.append(("t", f"p{p}", f"e{p}_{i}", rng.choice(names), at, "{}"))
    log = spark.createDataFrame(rows, "tenant_id string, profile_id string, event_id string, event_name string, occurred_at timestamp, props string")
    people = spark.createDataFrame(
        [("t", f"p{p}", "c", "{}", "{}", AT, AT) for p in range(26)],
        "tenant_id string, profile_id string, canonical_user_id string, traits string, computed_attributes string, first_seen_at timestamp, last_seen_at timestamp",
    )
    specs = {
        "count": {"kind": "count", "event_name": "view", "window": "2d", "op": "gte", "value": 2},
        "few": {"kind": "count", "event_name": "view", "window": "30h", "op": "lt", "value": 2},
        "gone": {"kind": "absence", "event_name": "buy", "window": "1d"},
        "back": {"kind": "recency", "event_name": "buy", "window": "36h"},
        "chain": {"kind": "sequence", "within": "3h", "steps": [{"event_name": "view"}, {"event_name": "buy"}, {"event_name": "view"}]},
        "lost": {"kind": "absence", "event_name": "buy", "window": "5h", "anchor": {"kind": "count", "event_name": "view", "window": "4d", "op": "gte", "value": 2}},
    }
    got = compiler.evaluate(people, log, {k: parse({"behavior": s}) for k, s in specs.items()}, AT).collect()
    buckets = behavior.hourly_buckets(log)
    by_hour = {r.profile_id: r.n for r in behavior.bucket_counts(buckets, log, "view", "2d", AT).collect()}

    def span(b, text):
        return dt.timedelta(microseconds=parse_window(text))

    for r in got:
        mine = sorted((t, n) for _, p, _, n, t, _ in rows if p == r.profile_id and t <= AT)
        times = {n: [t for t, x in mine if x == n] for n in names}

        def within(name, text, at=AT):
            return [t for t in times[name] if at - span(None, text) <= t <= at]

        assert r["count"] == (len(within("view", "2d")) >= 2) and len(within("view", "2d")) == by_hour.get(r.profile_id, 0)
        assert r.few == (len(within("view", "30h")) < 2)
        assert r.gone == (not within("buy", "1d")) and r.back == bool(within("buy", "36h"))
        h3 = span(None, "3h")
        chain = any(a < b <= a + h3 and b < c <= b + h3 for a in times["view"] for b in times["buy"] for c in times["view"])
        assert r.chain == chain, r
        anchors = within("view", "4d")
        ta = max(anchors, default=None)
        lost = len(anchors) >= 2 and ta + span(None, "5h") <= AT and not any(ta <= t <= ta + span(None, "5h") for t in times["buy"])
        assert r.lost == lost, r


def test_normalisation_is_idempotent(spark):
    rng = random.Random(1)
    made = [tuple(rng.choice(["", " a ", "B ", "x@Y.z "]) for _ in range(11)) for _ in range(60)]
    names = ["event_id", "type", "event_name", "previous_id", "timestamp", *ingest.IDENTIFIERS]
    frame = spark.createDataFrame(made, ", ".join(f"{n} string" for n in names))
    frame = frame.withColumns({"tenant_id": F.lit("t"), "source_id": F.lit("s"), "received_at": F.lit(AT).cast("timestamp")})
    frame = frame.withColumns({c: F.lit(None).cast("string") for c in ("context", "properties", "traits")})
    frame = frame.withColumns({"timestamp": F.lit(""), "n": F.monotonically_increasing_id()})
    keep = ["type", "event_name", *ingest.IDENTIFIERS, "payload_hash", "error"]
    once = ingest.normalize(frame)
    again = ingest.normalize(once.select(*frame.columns[:-1], "n").withColumn("timestamp", F.lit("")))
    assert once.orderBy("n").select(*keep).collect() == again.orderBy("n").select(*keep).collect()


def test_scan_bound():
    b = [Behavior.of({"kind": "count", "event_name": "e", "window": "7d", "op": "gte", "value": 1})]
    assert compiler.scan_bound(b, AT) == compiler.micros(AT) - 7 * DAY
    assert compiler.scan_bound([*b, Behavior.of({"kind": "sequence", "within": "1h"})], AT) is None
