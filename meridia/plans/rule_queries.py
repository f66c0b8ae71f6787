"""Registered queries of the rule language and of windowed behaviour."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import behavior, deadlines
from . import fixtures
from .compiler import KEYS, evaluate, shape_drift
from .fixtures import AT, AT_SQL, LATER, LATER_SQL, with_sql
from .rules import Behavior, parse

FLAGSHIP = {
    "operator": "and",
    "conditions": [
        {"behavior": {"kind": "count", "event_name": "view", "window": "7d", "op": "gte", "value": 3}},
        {
            "behavior": {
                "kind": "absence",
                "event_name": "purchase",
                "window": "24h",
                "anchor": {"kind": "count", "event_name": "view", "window": "7d", "op": "gte", "value": 3},
            }
        },
    ],
}

QUERIES: dict = {}
ORACLES: dict = {}


def members(rule: dict, at: dt.datetime = AT):
    """A query: tenant and profile of everyone the rule matches."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = evaluate(fixtures.profiles(spark, sf_dir), fixtures.behavior_log(spark, sf_dir), {"hit": parse(rule)}, at)
        return rows.filter("hit").select(*KEYS)

    return query


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _members(name: str, rule: dict, where: str, at: dt.datetime = AT, extra: str = "") -> None:
    _add(name, members(rule, at), with_sql(f"SELECT tenant_id, profile_id FROM prof p WHERE {where}", extra))


def leaf(field: str, op: str, value=None) -> dict:
    out = {"field": field, "op": op}
    return out if value is None else {**out, "value": value}


_COUNTRY, _ORDERS = "profile.traits.country", "profile.computed_attributes.total_orders"

_members("op_eq", leaf(_COUNTRY, "eq", "NATION_1"), "country = 'NATION_1'")
_members("op_neq", leaf(_ORDERS, "neq", "10"), "total_orders IS NOT NULL AND total_orders <> 10")
_members("op_gt", leaf("profile.traits.balance", "gt", 5000), "balance > 5000")
_members("op_gte", leaf(_ORDERS, "gte", 10), "total_orders >= 10")
_members("op_lt", leaf("profile.traits.balance", "lt", "0"), "balance < 0")
_members("op_lte", leaf(_ORDERS, "lte", 8), "total_orders <= 8")
_members("op_contains", leaf("profile.computed_attributes.tags", "contains", "gold"), "balance > 5000")
_members("op_not_contains", leaf("profile.traits.name", "not_contains", "7"), "NOT contains(name, '7')")
_members("op_in", leaf(_COUNTRY, "in", ["NATION_1", "NATION_2"]), "country IN ('NATION_1', 'NATION_2')")
_members("op_not_in", leaf(_ORDERS, "not_in", [9, "10", 11]), "total_orders IS NOT NULL AND total_orders NOT IN (9, 10, 11)")
_members("op_exists", leaf("profile.first_seen_at", "exists"), "first_seen_at IS NOT NULL")
_members("op_not_exists", leaf("profile.last_seen_at", "not_exists"), "last_seen_at IS NULL")
_members("logic_and", {"operator": "and", "conditions": [leaf(_COUNTRY, "eq", "NATION_1"), leaf(_ORDERS, "gt", 9)]}, "country = 'NATION_1' AND total_orders > 9")
_members("logic_or", {"operator": "or", "conditions": [leaf(_COUNTRY, "eq", "NATION_1"), leaf("profile.traits.segment", "eq", "BUILDING")]}, "country = 'NATION_1' OR segment = 'BUILDING'")
_members("logic_not", {"operator": "not", "conditions": [leaf(_ORDERS, "gt", 9)]}, "coalesce(NOT total_orders > 9, true)")



def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with a number of their own digits and one of 30 powers of ten."""
    own = F.substring("profile_id", 2, 20)
    power = (own.cast("long") % 30 - 9).cast("string")
    return fixtures.profiles(spark, sf_dir).withColumn("traits", F.concat(F.lit('{"x":'), own, F.lit("e"), power, F.lit("}")))


#: How such a number prints: without an exponent from 1e-4 up to a million, else as digit, point, digits and exponent.
_PRINTED = """
raw AS (SELECT tenant_id, profile_id, c_custkey::VARCHAR AS d, c_custkey % 30 - 9 AS e FROM prof),
num AS (SELECT *, rtrim(d, '0') AS m, len(d) - 1 + e AS x FROM raw),
printed AS (SELECT tenant_id, profile_id, CASE
    WHEN x >= 6 OR x < -4 THEN m[1] || CASE WHEN len(m) > 1 THEN '.' || m[2:] ELSE '' END || 'e' || CASE WHEN x < 0 THEN '-' ELSE '+' END || lpad(abs(x)::VARCHAR, 2, '0')
    WHEN x < 0 THEN '0.' || repeat('0', (-x - 1)::INT) || m
    WHEN len(m) > x + 1 THEN m[1:x + 1] || '.' || m[x + 2:]
    ELSE m || repeat('0', (x + 1 - len(m))::INT) END AS t FROM num)
"""
_SOME = [2e7, 0.01, 25, 4e-06, 1e21]


def _number_query(op: str, operator: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = parse({"operator": operator, "conditions": [leaf("profile.traits.x", op, x) for x in _SOME]})
        return evaluate(_numbered(spark, sf_dir), fixtures.behavior_log(spark, sf_dir), {"hit": rule}, AT).filter("hit").select(*KEYS)

    return query


_ANY = " OR ".join(f"contains(t, '{x}')" for x in ("2e+07", "0.01", "25", "4e-06", "1e+21"))
_add("op_contains_number", _number_query("contains", "or"), with_sql(f"SELECT tenant_id, profile_id FROM printed WHERE {_ANY}", _PRINTED))
_add("op_not_contains_number", _number_query("not_contains", "and"), with_sql(f"SELECT tenant_id, profile_id FROM printed WHERE NOT ({_ANY})", _PRINTED))

_IN = "l.tenant_id = p.tenant_id AND l.profile_id = p.profile_id"


def _count(event: str, window: str, more: str = "true", what: str = "count(*)") -> str:
    return (
        f"(SELECT {what} FROM log l WHERE {_IN} AND event_name = '{event}' "
        f"AND occurred_at BETWEEN {AT_SQL} - INTERVAL {window} AND {AT_SQL} AND {more})"
    )


def _last(event: str) -> str:
    return f"(SELECT max(occurred_at) FROM log l WHERE {_IN} AND event_name = '{event}' AND occurred_at <= {AT_SQL})"


def _b(**spec) -> dict:
    return {"behavior": spec}


_ANCHOR_CTE = f"""
anchor AS (
  SELECT tenant_id, profile_id, count(*) AS n, max(occurred_at) AS ta FROM log
  WHERE event_name = 'view' AND occurred_at BETWEEN {AT_SQL} - INTERVAL 7 DAY AND {AT_SQL} GROUP BY ALL
), gone AS (
  SELECT a.tenant_id, a.profile_id, n FROM anchor a WHERE n >= 3 AND ta + INTERVAL 24 HOUR <= {AT_SQL}
  AND NOT EXISTS (SELECT 1 FROM log q WHERE q.tenant_id = a.tenant_id AND q.profile_id = a.profile_id
                  AND q.event_name = 'purchase' AND q.occurred_at BETWEEN ta AND ta + INTERVAL 24 HOUR)
)
"""
_GONE = "EXISTS (SELECT 1 FROM gone g WHERE g.tenant_id = p.tenant_id AND g.profile_id = p.profile_id)"

_members("beh_count", _b(kind="count", event_name="view", window="7d", op="gte", value=3), f"{_count('view', '7 DAY')} >= 3")
_members("beh_count_dormant", _b(kind="count", event_name="view", window="7d", op="lte", value=0), f"{_count('view', '7 DAY')} <= 0")
_members("beh_count_where", _b(kind="count", event_name="view", window="14d", op="gte", value=2, where=leaf("event.properties.k", "gte", 50)), f"{_count('view', '14 DAY', 'k >= 50')} >= 2")
_members("beh_frequency", _b(kind="frequency", event_name="click", window="72h", op="gt", value=1), f"{_count('click', '72 HOUR')} > 1")
_members("beh_frequency_value", _b(kind="frequency", event_name="purchase", window="14d", op="gte", value=40, value_prop="revenue"), f"coalesce({_count('purchase', '14 DAY', 'true', 'sum(revenue)')}, 0) >= 40")
_members("beh_recency", _b(kind="recency", event_name="click", window="24h"), f"coalesce({_last('click')} >= {AT_SQL} - INTERVAL 24 HOUR, false)")
_members("beh_absence", _b(kind="absence", event_name="click", window="3d"), f"coalesce({_last('click')} < {AT_SQL} - INTERVAL 3 DAY, true)")
_members("beh_correlated_absence", FLAGSHIP["conditions"][1], _GONE, extra=_ANCHOR_CTE)
_members("flagship_segment", FLAGSHIP, _GONE, extra=_ANCHOR_CTE)
_members("flagship_segment_later", FLAGSHIP, _GONE, at=LATER, extra=_ANCHOR_CTE.replace(AT_SQL, LATER_SQL))


def _chain(names: list[str], hours: int) -> str:
    """Nested EXISTS over a chain of events."""
    sql = ""
    for i in reversed(range(len(names))):
        prev = f"AND s{i}.occurred_at > s{i - 1}.occurred_at AND s{i}.occurred_at <= s{i - 1}.occurred_at + INTERVAL {hours} HOUR" if i else ""
        who = "p" if i == 0 else f"s{i - 1}"
        inner = f" AND {sql}" if sql else ""
        sql = (
            f"EXISTS (SELECT 1 FROM log s{i} WHERE s{i}.tenant_id = {who}.tenant_id AND s{i}.profile_id = {who}.profile_id "
            f"AND s{i}.event_name = '{names[i]}' AND s{i}.occurred_at <= {AT_SQL} {prev}{inner})"
        )
    return sql


for _steps in (["view", "purchase"], ["view", "click", "purchase"], ["click", "click"]):
    _name = {2: "beh_sequence2", 3: "beh_sequence3"}[len(_steps)] + ("_same" if _steps[0] == _steps[1] else "")
    _members(_name, _b(kind="sequence", within="24h", steps=[{"event_name": s} for s in _steps]), _chain(_steps, 24))

_MANY = {
    "buyers": _b(kind="count", event_name="purchase", window="7d", op="gte", value=1),
    "french_buyers": {"operator": "and", "conditions": [leaf(_COUNTRY, "eq", "NATION_1"), _b(kind="count", event_name="purchase", window="7d", op="gte", value=1)]},
    "lapsed": {"operator": "and", "conditions": [leaf("profile.last_seen_at", "exists"), _b(kind="absence", event_name="view", window="3d")]},
}


def _multi_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {k: parse(r) for k, r in _MANY.items()}
    rows = evaluate(fixtures.profiles(spark, sf_dir), fixtures.behavior_log(spark, sf_dir), rules, AT)
    return behavior.matched_rules(rows, list(rules)).groupBy("tenant_id", "segment").agg(F.count(F.lit(1)).alias("members"))


_buy = f"{_count('purchase', '7 DAY')} >= 1"
_add(
    "multi_rule_counts",
    _multi_rule,
    with_sql(
        f"""SELECT tenant_id, segment, count(*) AS members FROM (
  SELECT tenant_id, 'buyers' AS segment FROM prof p WHERE {_buy}
  UNION ALL SELECT tenant_id, 'french_buyers' FROM prof p WHERE country = 'NATION_1' AND {_buy}
  UNION ALL SELECT tenant_id, 'lapsed' FROM prof p WHERE last_seen_at IS NOT NULL
    AND coalesce({_last('view')} < {AT_SQL} - INTERVAL 3 DAY, true)
) GROUP BY ALL"""
    ),
)


def _log(fn, **kw):
    return lambda spark, sf_dir: fixtures.ntz(fn(fixtures.behavior_log(spark, sf_dir), **kw))


_add(
    "beh_bucket_rollup",
    _log(behavior.hourly_buckets),
    with_sql(
        """SELECT tenant_id, profile_id, event_name, date_trunc('hour', occurred_at)::TIMESTAMP AS bucket_start, count(*) AS count,
  min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM log GROUP BY ALL"""
    ),
)
_add(
    "beh_bucket_count",
    lambda spark, sf_dir: behavior.bucket_counts(
        behavior.hourly_buckets(log := fixtures.behavior_log(spark, sf_dir)), log, "view", "90h", AT
    ),
    with_sql(
        f"""SELECT tenant_id, profile_id, count(*) AS n FROM log WHERE event_name = 'view'
  AND occurred_at BETWEEN {AT_SQL} - INTERVAL 90 HOUR AND {AT_SQL} GROUP BY ALL"""
    ),
)
_add(
    "beh_last_at",
    _log(behavior.last_at, event="purchase", at=AT),
    with_sql(f"SELECT tenant_id, profile_id, max(occurred_at) AS last_at FROM log WHERE event_name = 'purchase' AND occurred_at <= {AT_SQL} GROUP BY ALL"),
)
_NTH = f"""SELECT tenant_id, profile_id, occurred_at AS nth_at FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, profile_id ORDER BY occurred_at DESC, event_id DESC) AS rn FROM log
  WHERE event_name = '{{e}}' AND occurred_at BETWEEN {AT_SQL} - INTERVAL {{w}} AND {AT_SQL}) WHERE rn = {{n}}"""
_add("beh_nth_newest", _log(behavior.nth_newest, event="view", window="7d", n=3, at=AT), with_sql(_NTH.format(e="view", w="7 DAY", n=3)))


def _mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with every fifth k as a text, so that shapes drift."""
    log = fixtures.behavior_log(spark, sf_dir)
    k = F.get_json_object("props", "$.k")
    odd = F.substring("event_id", 2, 20).cast("long") % 5 == 0
    return log.withColumn("props", F.when(odd, F.to_json(F.struct(k.alias("k")))).otherwise(F.to_json(F.struct(k.cast("long").alias("k")))))


_DRIFT = Behavior.of({"kind": "frequency", "event_name": "view", "window": "7d", "op": "gte", "value": 1, "value_prop": "k"})
_add(
    "beh_schema_drift",
    lambda spark, sf_dir: shape_drift(_mixed_types(spark, sf_dir), _DRIFT, AT),
    with_sql(
        f"""SELECT tenant_id, profile_id, 'k' AS property, count(DISTINCT cast(substr(event_id, 2) AS BIGINT) % 5 = 0) AS kinds
  FROM log WHERE event_name = 'view' AND occurred_at BETWEEN {AT_SQL} - INTERVAL 7 DAY AND {AT_SQL}
  GROUP BY ALL HAVING kinds > 1"""
    ),
)
_add(
    "beh_sum_guarded",
    lambda spark, sf_dir: (
        _mixed_types(spark, sf_dir)
        .filter("event_name = 'view'")
        .groupBy(*KEYS)
        .agg(F.coalesce(F.sum(values.json_number(F.try_parse_json("props"), "k")), F.lit(0.0)).alias("total"))
    ),
    with_sql(
        """SELECT tenant_id, profile_id, coalesce(sum(CASE WHEN cast(substr(event_id, 2) AS BIGINT) % 5 <> 0 THEN k END), 0)::DOUBLE AS total
  FROM log WHERE event_name = 'view' GROUP BY ALL"""
    ),
)
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_add(
    "beh_shape_fingerprint",
    lambda spark, sf_dir: _shapes(spark, sf_dir),
    with_sql(
        f"""SELECT event_name, cast(greatest({_FNV} & 2147483647, 1) AS INTEGER) AS shape, count(*) AS n FROM (
  SELECT event_name, 'k:number;revenue:number;' AS t FROM log
  UNION ALL SELECT event_name, CASE WHEN cast(substr(event_id, 2) AS BIGINT) % 5 = 0 THEN 'k:string;' ELSE 'k:number;' END FROM log) GROUP BY ALL"""
    ),
)


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints themselves: per event name, the number of log rows of each shape."""
    both = fixtures.behavior_log(spark, sf_dir).unionByName(_mixed_types(spark, sf_dir))
    return both.withColumn("shape", behavior.shape_fingerprint(F.col("props"))).groupBy("event_name", "shape").agg(F.count(F.lit(1)).alias("n"))


_add(
    "beh_record",
    lambda spark, sf_dir: fixtures.ntz(behavior.record(*_incoming(spark, sf_dir)).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("recorded"), F.count_if(F.col("props").isNull()).alias("without_props"), F.max("occurred_at").alias("last_at")
    )),
    with_sql(
        """SELECT tenant_id, profile_id, count(*) AS recorded, sum((cast(substr(profile_id, 2) AS BIGINT) % 7 = 0)::INT)::BIGINT AS without_props,
  max(occurred_at) AS last_at FROM log GROUP BY ALL"""
    ),
)


def _incoming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(events with repeats and client clocks ahead of arrival, consent rows)."""
    log = fixtures.behavior_log(spark, sf_dir)
    ahead = F.when(F.substring("event_id", 2, 20).cast("long") % 4 == 0, F.expr("interval 2 hours")).otherwise(F.expr("interval 0 hours"))
    events = log.select(*KEYS, "event_id", F.lit("track").alias("type"), "event_name", (F.col("occurred_at") + ahead).alias("timestamp"), F.col("occurred_at").alias("received_at"), "props")
    events = events.unionByName(events.filter("event_name = 'view'"))
    number = F.substring("profile_id", 2, 20).cast("long")
    consent = fixtures.profiles(spark, sf_dir).select(
        *KEYS, F.lit("email").alias("channel"), F.lit("analytics").alias("purpose"), F.when(number % 7 == 0, "denied").otherwise("granted").alias("status")
    )
    return events, consent


def _due(name: str, rule: dict, sql: str, extra: str = "", at: dt.datetime = AT) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixtures.ntz(deadlines.next_due(fixtures.behavior_log(spark, sf_dir), parse(rule), at))

    _add(name, query, with_sql(f"SELECT tenant_id, profile_id, due_at FROM ({sql}) WHERE due_at > {AT_SQL}", extra))


def _due_last(event: str, window: str) -> str:
    return f"SELECT tenant_id, profile_id, max(occurred_at) + INTERVAL {window} AS due_at FROM log WHERE event_name = '{event}' AND occurred_at <= {AT_SQL} GROUP BY ALL"


def _due_nth(event: str, window: str, n: int) -> str:
    return f"SELECT tenant_id, profile_id, nth_at + INTERVAL {window} AS due_at FROM ({_NTH.format(e=event, w=window, n=n)})"


_due("due_absence", _b(kind="absence", event_name="purchase", window="5d"), _due_last("purchase", "5 DAY"))
_due("due_recency", _b(kind="recency", event_name="click", window="36h"), _due_last("click", "36 HOUR"))
_due("due_count_gte", _b(kind="count", event_name="view", window="7d", op="gte", value=3), _due_nth("view", "7 DAY", 3))
_due("due_count_gt", _b(kind="count", event_name="view", window="7d", op="gt", value=2), _due_nth("view", "7 DAY", 3))
_both = f"{_due_nth('view', '7 DAY', 2)} UNION ALL {_due_nth('view', '7 DAY', 3)}"
_due("due_count_eq", _b(kind="count", event_name="view", window="7d", op="eq", value=2), f"SELECT tenant_id, profile_id, min(due_at) AS due_at FROM ({_both}) WHERE due_at > {AT_SQL} GROUP BY ALL")
_all = f"{_due_nth('view', '7 DAY', 3)} UNION ALL {_due_last('view', '24 HOUR')}"
_due("due_composite", FLAGSHIP, f"SELECT tenant_id, profile_id, min(due_at) AS due_at FROM (SELECT * FROM ({_all}) WHERE due_at > {AT_SQL}) GROUP BY ALL")
