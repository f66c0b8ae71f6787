import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from meridia.functions import values
from meridia.plans import compiler, rules
from meridia.plans.rules import RuleError, parse, parse_window

AT = dt.datetime(2026, 6, 10, 12)
HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)


def leaf(field, op, value=None):
    return {"field": field, "op": op} if value is None else {"field": field, "op": op, "value": value}


def beh(**spec):
    return {"behavior": spec}


UNITS = {"ns": 1e-3, "us": 1, "ms": 1e3, "s": 1e6, "m": 60e6, "h": 3600e6, "d": 86400e6}


@pytest.mark.parametrize("seed", range(12))
def test_windows(seed):
    """Days stand alone; the other units add up, in any order and with fractions."""
    rng = random.Random(seed)
    days = rng.randrange(1, 400)
    assert parse_window(f"{days}d") == days * UNITS["d"]
    parts = [(rng.choice([rng.randrange(1, 50), rng.randrange(1, 40) / 4]), u) for u in rng.sample(["us", "ms", "s", "m", "h"], rng.randrange(1, 4))]
    assert parse_window("".join(f"{n}{u}" for n, u in parts)) == int(sum(n * UNITS[u] for n, u in parts))


@pytest.mark.parametrize("seed", range(12))
def test_bad_windows(seed):
    rng = random.Random(100 + seed)
    n = rng.randrange(1, 90)
    for text in (f"-{n}h", f"{n}", f"{n}w", f"{n} m", f"{n}d{n}m", f"{n}h{n}d", rng.choice("dhms"), f"0{rng.choice('hms')}", f" {n}s", f"{n}.5d"):
        with pytest.raises(RuleError):
            parse_window(text)


_SEEN = dict(event_name="signup", window="36h")
_MANY = dict(kind="count", **_SEEN, op="lt", value=7)
GOOD = {
    "plain": leaf("profile.traits.plan", "neq", None) | {"value": "pro"},
    "list": leaf("profile.traits.plan", "not_in", [3, "pro", True]),
    "present": leaf("profile.last_seen_at", "exists"),
    "three deep": {"operator": "not", "conditions": [{"operator": "or", "conditions": [beh(**_MANY), leaf("event.type", "eq", "alias")]}]},
    "seen": beh(kind="recency", **_SEEN),
    "sum": beh(kind="frequency", **_SEEN, value_prop="total", op="lte", value=12.5),
    "gone": beh(kind="absence", **_SEEN),
    "gone after": beh(kind="absence", event_name="renewal", window="45m", anchor=_MANY),
    "chain": beh(kind="sequence", within="90s", steps=[{"event_name": x} for x in ("open", "read", "open")]),
    "filtered": beh(**_MANY, where={"operator": "and", "conditions": [leaf("event.properties.k", "lt", 4), leaf("event.properties.s", "exists")]}),
}
#: What makes one of them wrong: (its name, a change of its behaviour or of the whole).
BAD = [
    ("plain", {"op": "like"}),
    ("plain", {"value": None}),
    ("plain", {"field": ""}),
    ("plain", {"conditions": [leaf("a", "exists")], "operator": "and"}),
    ("plain", beh(**_MANY)),
    ("list", {"value": "pro"}),
    ("present", {"value": 1}),
    ("three deep", {"conditions": [leaf("a", "exists"), leaf("b", "exists")]}),
    ("three deep", {"operator": "nand"}),
    ("three deep", {"operator": "or", "conditions": []}),
    ("seen", {"behavior.kind": "lately"}),
    ("seen", {"behavior.window": "36 hours"}),
    ("seen", {"behavior.event_name": ""}),
    ("sum", {"behavior.op": None}),
    ("sum", {"behavior.value": None}),
    ("gone", {"behavior.window": None}),
    ("gone after", {"behavior.anchor": {**_MANY, "kind": "often"}}),
    ("chain", {"behavior.within": None}),
    ("chain", {"behavior.steps": [{"event_name": "open"}]}),
    ("chain", {"behavior.steps": [{"event_name": "open"}, {"event_name": ""}]}),
    ("filtered", {"behavior.where": leaf("event.properties.k", "about", 4)}),
]


@pytest.mark.parametrize("name", GOOD)
def test_accepted(name):
    parse(json.dumps(GOOD[name]))


@pytest.mark.parametrize("name,change", BAD)
def test_rejected(name, change):
    rule = json.loads(json.dumps(GOOD[name]))
    for key, value in change.items():
        part, _, key = key.rpartition(".") if "." in key else ("", "", key)
        target = rule[part] if part else rule
        target.pop(key, None)
        if value is not None:
            target[key] = value
    with pytest.raises(RuleError):
        parse(rule)


def test_analysis():
    rule = {"operator": "and", "conditions": [GOOD[x] for x in ("gone after", "filtered", "chain", "three deep")]}
    a = rules.analyze(parse(rule))
    assert a.event_names == ("open", "read", "renewal", "signup") and a.max_window_seconds == 36 * 3600
    assert a.stateful and a.stateless and not a.sweepable and parse(GOOD["chain"]).behavior.exact
    assert rules.referenced_properties(parse(leaf("event.properties.cart.items", "exists"))) == ["cart"]


def _row(spark, traits="{}", computed="{}", props="{}", context="{}"):
    frame = spark.createDataFrame(
        [("t", "p", "customer_1", traits, computed, AT, AT, "product_viewed", "track", props, context)],
        "tenant_id string, profile_id string, canonical_user_id string, traits string, computed_attributes string, "
        "first_seen_at timestamp, last_seen_at timestamp, en string, ty string, pr string, cx string",
    )
    return compiler.with_documents(frame).withColumns({"pr": values.parsed(F.col("pr")), "cx": values.parsed(F.col("cx"))})


def _check(spark, rule_list, **kw):
    event = {"event_name": F.col("en"), "type": F.col("ty"), "properties": F.col("pr"), "context": F.col("cx")}
    resolve = compiler.profile_resolver(event)
    row = _row(spark, **kw).select(*(compiler.condition(parse(r), resolve, None).alias(f"c{i}") for i, r in enumerate(rule_list))).first()
    return list(row)


def _expected(op, value, other):
    """A plain reading of the operators, of values that are None where they are missing."""
    same = lambda a, b: float(a) == float(b) if _number(a) and _number(b) else str(a) == str(b)
    if op in ("exists", "not_exists"):
        return (value is not None) == (op == "exists")
    if value is None:
        return False
    if op in ("eq", "neq"):
        return same(value, other) == (op == "eq")
    if op in ("in", "not_in"):
        return any(same(value, x) for x in other) == (op == "in")
    if op in ("contains", "not_contains"):
        inside = any(same(x, other) for x in value) if isinstance(value, list) else str(other) in str(value)
        return inside == (op == "contains")
    if not _number(value) or not _number(other):
        return False
    x, y = float(value), float(other)
    return {"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[op]


def _number(x):
    try:
        return not isinstance(x, bool) and float(x) == float(x)
    except (TypeError, ValueError):
        return False


def test_operators_against_a_plain_reading(spark):
    rng = random.Random(21)
    stored = {"city": "Graz", "level": 42, "ratio": -0.5, "digits": "0042", "labels": ["x1", "7", "Graz"], "empty": ""}
    others = ["Graz", "ra", "", 42, 41.5, "42", -1, "x1", 7, "none"]
    cases = []
    for _ in range(160):
        key, op = rng.choice([*stored, "lost"]), rng.choice(["eq", "neq", "gt", "gte", "lt", "lte", "contains", "not_contains", "in", "not_in", "exists", "not_exists"])
        if key == "labels" and op in ("eq", "neq", "in", "not_in"):
            continue
        other = None if "exists" in op else rng.sample(others, rng.randrange(1, 4)) if op in ("in", "not_in") else rng.choice(others)
        place = rng.choice(["profile.traits", "profile.computed_attributes", "event.properties", "event.context"])
        rule, want = leaf(f"{place}.deep.{key}", op, other), _expected(op, stored.get(key), other)
        if rng.random() < 0.2:
            rule, want = {"operator": "not", "conditions": [rule]}, not want
        cases.append((rule, want))
    document = json.dumps({"deep": stored})
    got = _check(spark, [r for r, _ in cases], traits=document, computed=document, props=document, context=document)
    assert [(r, g) for (r, _), g in zip(cases, got)] == cases


def test_fields_outside_documents(spark):
    quiet = beh(kind="count", event_name="e", window="2h", op="lt", value=2)
    cases = [
        (leaf("event.type", "in", ["alias", "track"]), True),
        (leaf("event.event_name", "contains", "_viewed"), True),
        (leaf("profile.canonical_user_id", "not_contains", "omer"), False),
        (leaf("profile.last_seen_at", "eq", "2026-06-10T12:00:00Z"), True),
        (leaf("profile.last_seen_at", "lt", "2030-01-01T00:00:00Z"), False),
        (leaf("profile.tenant_id", "exists"), False),
        (leaf("session.id", "not_exists"), True),
        # Without a log, behaviour is false, and so is its negation.
        (quiet, False),
        ({"operator": "not", "conditions": [{"operator": "and", "conditions": [quiet]}]}, False),
    ]
    assert _check(spark, [r for r, _ in cases]) == [w for _, w in cases]


def test_numbers_print_alike_on_both_sides(spark):
    rng = random.Random(4)
    numbers = [0.0, -0.0, 1e6, 999999.5, 1234567, -1234567.25, 1e7, 1e-4, 0.00012345, 9.99e-5, 1e-5, 1e21, 1e22, 123456.789, 1.5e300, 9.58e21, 2e23]
    numbers += [round(rng.uniform(-10, 10), rng.randrange(9)) * 10.0 ** rng.randrange(-7, 22) for _ in range(600)]
    numbers = [x for x in numbers if len(repr(x).split("e")[0].strip("-0.").replace(".", "")) <= 15]
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(numbers)], "i int, x double")
    got = {r.i: r.t for r in rows.select("i", values.print_number(F.col("x")).alias("t")).collect()}
    assert [got[i] for i in range(len(numbers))] == [values.literal_text(float(x)) for x in numbers]


@pytest.mark.parametrize("x", [1e-7, 2.5e-5, 1e-4, 0.75, 999999, 1000000, 1234567, 1e7, 12345678.9, 1e21, 1e22, -3e8])
def test_a_number_contains_its_own_text(spark, x):
    cases = [leaf("profile.traits.x", "contains", x), leaf("profile.traits.x", "not_contains", x), leaf("profile.traits.l", "contains", values.literal_text(x)), leaf("profile.traits.l", "eq", f"[a {values.literal_text(x)}]")]
    assert _check(spark, cases, traits=json.dumps({"x": x, "l": ["a", x]})) == [True, False, True, True]


def test_loose_values(spark):
    traits = json.dumps({"n": None, "s5": "5", "f": 5.0, "big": 1000000, "t": True, "pad": " 5 ", "suffix": "5d", "l": ["a", 2], "nan": "NaN", "inf": "inf", "o": {"k": 1}})
    cases = [
        (leaf("profile.traits.n", "exists"), True),
        (leaf("profile.traits.n", "eq", "<nil>"), True),
        (leaf("profile.traits.s5", "eq", 5), True),
        (leaf("profile.traits.f", "eq", "5"), True),
        (leaf("profile.traits.big", "eq", "1e6"), True),
        (leaf("profile.traits.t", "eq", "true"), True),
        (leaf("profile.traits.t", "eq", True), True),
        (leaf("profile.traits.t", "gt", 0), False),
        (leaf("profile.traits.pad", "eq", 5), False),
        (leaf("profile.traits.suffix", "gt", 1), False),
        (leaf("profile.traits.l", "eq", "[a 2]"), True),
        (leaf("profile.traits.l", "contains", "2"), True),
        (leaf("profile.traits.nan", "eq", "NaN"), False),
        (leaf("profile.traits.nan", "neq", "NaN"), True),
        (leaf("profile.traits.nan", "gt", -1), False),
        (leaf("profile.traits.inf", "gt", 1e300), True),
        (leaf("profile.traits.o.k", "eq", 1), True),
        (leaf("profile.traits.l.0", "exists"), False),
        (leaf("profile.traits.s5", "in", [4, 5.0]), True),
    ]
    assert _check(spark, [r for r, _ in cases], traits=traits) == [w for _, w in cases]
    assert _check(spark, [leaf("profile.traits.a", "exists")], traits="not json") == [False]


def test_literal_texts():
    assert [values.literal_text(x) for x in (None, True, 5, 5.5, 1e6, 1234567.0, [1, "a"], "x")] == ["<nil>", "true", "5", "5.5", "1e+06", "1.234567e+06", "[1 a]", "x"]


LOG = "tenant_id string, profile_id string, event_id string, event_name string, occurred_at timestamp, props string"


def log(spark, rows):
    made = [("t", "p", f"e{i}", n, AT + d, json.dumps(p)) for i, (n, d, p) in enumerate((*r, {})[:3] for r in rows)]
    return spark.createDataFrame(made, LOG)


def holds(spark, rows, rule, at=AT):
    people = spark.createDataFrame(
        [("t", "p", "c", "{}", "{}", AT, AT), ("t", "dormant", "c", "{}", "{}", AT, AT), ("u", "p", "c", "{}", "{}", AT, AT)],
        "tenant_id string, profile_id string, canonical_user_id string, traits string, computed_attributes string, first_seen_at timestamp, last_seen_at timestamp",
    )
    out = {(r.tenant_id, r.profile_id): r.hit for r in compiler.evaluate(people, log(spark, rows), {"hit": parse(rule)}, at).collect()}
    assert out["t", "dormant"] == out["u", "p"]
    return out["t", "p"], out["t", "dormant"]


def test_count(spark):
    rows = [("view", -6 * DAY), ("view", -8 * DAY), ("view", 0 * DAY), ("view", -7 * DAY)]
    for op, value, want in (("eq", 3, True), ("gt", 3, False), ("gte", 3, True), ("lt", 4, True), ("lte", 2, False)):
        assert holds(spark, rows, beh(kind="count", event_name="view", window="7d", op=op, value=value))[0] is want
    assert holds(spark, rows, beh(kind="count", event_name="view", window="7d", op="lte", value=0)) == (False, True)


def test_recency_and_absence(spark):
    rows = [("login", -HOUR)]
    assert holds(spark, rows, beh(kind="recency", event_name="login", window="1d")) == (True, False)
    assert holds(spark, rows, beh(kind="absence", event_name="login", window="1d")) == (False, True)
    assert holds(spark, [("login", -DAY)], beh(kind="recency", event_name="login", window="1d"))[0] is True
    assert holds(spark, [("login", -2 * DAY), ("login", HOUR)], beh(kind="absence", event_name="login", window="1d"))[0] is True


def test_absence_after_anchor(spark):
    rule = beh(kind="absence", event_name="order", window="1d", anchor={"kind": "count", "event_name": "view", "window": "7d", "op": "gte", "value": 3})
    t0 = -3 * DAY
    views = [("view", t0), ("view", t0 + HOUR), ("view", t0 + 2 * HOUR)]
    assert holds(spark, [*views, ("order", t0 + 22 * HOUR)], rule) == (False, False)
    assert holds(spark, [*views, ("order", t0 + 28 * HOUR)], rule) == (True, False)
    assert holds(spark, views[1:], rule)[0] is False
    assert holds(spark, [("view", -HOUR)] * 3, rule)[0] is False


@pytest.mark.parametrize("third,want", [(20, True), (120, False)])
def test_sequences(spark, third, want):
    m = dt.timedelta(minutes=1)
    steps = [{"event_name": x} for x in "abc"]
    rows = [("a", -2 * DAY), ("b", -2 * DAY + 10 * m), ("c", -2 * DAY + third * m)]
    assert holds(spark, rows, beh(kind="sequence", within="1h", steps=steps))[0] is want
    assert holds(spark, rows, beh(kind="sequence", within="1h", steps=steps[:2])) == (True, False)
    twice = beh(kind="sequence", within="1h", steps=[steps[0]] * 2)
    assert holds(spark, rows, twice)[0] is False
    assert holds(spark, [*rows, ("a", -2 * DAY + 60 * m)], twice)[0] is True


@pytest.mark.parametrize("chains", [1, 3])
def test_sequences_in_slices(spark, chains):
    """Chains across the bounds of slices are found, and ones that are a microsecond too long are not."""
    rng = random.Random(chains)
    rows = [(f"p{i}", "t", rng.choice("abc"), rng.randrange(-40, 40)) for i in range(60) for _ in range(rng.randrange(12))]
    rows += [("edge", "t", x, at) for x, at in [("a", -20), ("b", -10), ("c", 0), ("a", 20), ("b", 31)]]
    rows += [("late", "t", x, at) for x, at in [("a", 19), ("b", 29), ("c", 40), ("c", 29)]]
    specs = {n: rules.Behavior.of({"kind": "sequence", "within": "10s", "steps": [{"event_name": x} for x in n]}) for n in ("abc", "aa", "abab", "ba")}
    df = spark.createDataFrame(rows, "profile_id string, tenant_id string, event_name string, _s long").selectExpr("*", "_s * 1000000 _us")
    got = {r.profile_id: r for r in compiler._sequences(df, specs, chains).collect()}
    assert got["edge"].abc and not got["late"].abc

    def chain(names, times, after=None):
        if not names:
            return True
        return any(n == names[0] and (after is None or after < t <= after + 10) and chain(names[1:], times, t) for t, n in times)

    for p, r in got.items():
        mine = [(t, n) for q, _, n, t in rows if q == p]
        assert {n: r[n] for n in specs} == {n: chain(n, mine) for n in specs}
    assert sum(r.abc for r in got.values()) > 3


def test_a_profile_is_several_groups_of_sequences(spark):
    spec = {"s": rules.Behavior.of({"kind": "sequence", "within": "1s", "steps": [{"event_name": x} for x in "ab"]})}
    df = spark.range(3000).selectExpr("'t' tenant_id", "'hot' profile_id", "if(id % 2 = 0, 'a', 'b') event_name", "id * 1000000 _us")
    plan = compiler._sequences(df, spec)._jdf.queryExecution().executedPlan().toString()
    assert any("_slice#" in p.split(")")[0] for p in plan.split("hashpartitioning(")[1:])
    assert compiler._sequences(df, spec).collect()[0].s is True


def test_where_and_sum(spark):
    rows = [("cart", -DAY, {"price": 150}), ("cart", -DAY, {"price": 50})]
    where = leaf("event.properties.price", "gte", 100)
    assert holds(spark, rows, beh(kind="count", event_name="cart", window="3d", op="eq", value=1, where=where))[0] is True
    orders = [("o", -DAY, {"revenue": 300}), ("o", -2 * DAY, {"revenue": 250}), ("o", -40 * DAY, {"revenue": 999}), ("o", -3 * DAY, {"revenue": "free"})]
    total = dict(kind="frequency", event_name="o", value_prop="revenue", window="30d", op="eq", value=550)
    assert holds(spark, orders, beh(**total))[0] is True
    pending = [*orders, ("o", -DAY, {"revenue": 100, "status": "pending"})]
    assert holds(spark, pending, beh(**total))[0] is False
    not_pending = {"operator": "not", "conditions": [leaf("event.properties.status", "eq", "pending")]}
    assert holds(spark, pending, beh(**total, where=not_pending))[0] is True


def test_drift(spark):
    frame = log(spark, [("o", -DAY, {"a": 10}), ("o", -DAY, {"a": "10"}), ("o", -DAY, {"b": None})])
    spec = rules.Behavior.of({"kind": "frequency", "event_name": "o", "window": "7d", "op": "gte", "value": 1, "value_prop": "a"})
    assert [tuple(r) for r in compiler.shape_drift(frame, spec, AT).collect()] == [("t", "p", "a", 2)]
