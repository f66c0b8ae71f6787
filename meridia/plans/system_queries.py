"""Registered queries of ingress, identity, profiles, memberships, activation, journeys, governance and operations.

Inputs that the generated tables lack (client texts, identifiers, consent,
catalogs) are derived from them by expressions that both dialects read alike.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import activation, behavior, deadlines, governance, identity, ingest, journeys, membership, metrics, ops, profiles, relay
from ..sources.storage import checkpointed, kept
from . import fixtures
from .compiler import evaluate, evaluate_rows, in_window, moment
from .fixtures import AT, AT_SQL, LATER, LATER_SQL, ntz, with_sql
from .rules import parse

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, sql: str | None = None):
    def register(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return register


# --- ingress -------------------------------------------------------------------------------------------------------

#: Client texts by event, in expressions for both dialects.
_CLIENT = {
    "event_id": "'  e' || event_id",
    "type": "CASE event_id % 11 WHEN 0 THEN 'identify' WHEN 1 THEN 'alias' WHEN 2 THEN ' bogus ' ELSE '' END",
    "event_name": "CASE WHEN event_id % 13 = 0 THEN '  ' ELSE ' ' || event_type || '  ' END",
    "user_id": "CASE WHEN event_id % 5 = 0 THEN '' ELSE ' U' || user_id || ' ' END",
    "anonymous_id": "CASE WHEN event_id % 3 = 0 THEN 'a' || user_id ELSE '' END",
    "email": "CASE WHEN event_id % 7 = 0 THEN ' User' || user_id || '@Example.COM ' ELSE '' END",
    "phone": "CASE WHEN event_id % 23 = 0 THEN '+8490' || user_id ELSE '' END",
    "external_id": "''",
    "device_id": "CASE WHEN event_id % 5 = 0 AND event_id % 2 = 0 THEN 'd' || user_id ELSE '' END",
    "previous_id": "CASE WHEN event_id % 2 = 0 THEN 'a' || (user_id + 1) ELSE '' END",
    "properties": "props",
    "context": "'{\"page\":{\"url\":\"https://x/' || (event_id % 9) || '\"}}'",
    "traits": "'{\"name\":\"N' || user_id || '\",\"country\":\"' || CASE WHEN event_id % 4 = 0 THEN 'VN' ELSE '' END || '\"}'",
}
_HOME = "'r' || (user_id % 5)"


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client events with white space, bad times, unknown types, retries and conflicting retries."""
    events = fixtures.table(spark, sf_dir, "events")
    good = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    sent = F.when(F.expr("event_id % 17 = 0"), "yesterday").when(F.expr("event_id % 4 = 0"), good).otherwise("")
    base = events.select(
        F.expr(_HOME).alias("tenant_id"),
        F.expr("'s' || (user_id % 3)").alias("source_id"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.col("event_id").alias("arrival"),
        sent.alias("timestamp"),
        *(F.expr(e).alias(c) for c, e in _CLIENT.items()),
    )
    later = {"received_at": F.col("received_at") + F.expr("interval 1 hour"), "arrival": F.col("arrival") + 1_000_000_000}
    same = base.filter("arrival % 10 = 0").withColumns(later)
    other = base.filter("arrival % 37 = 0").withColumns({**later, "event_name": F.lit("changed")})
    return base.unionByName(same).unionByName(other)


def _incoming_sql() -> str:
    """CTE ``env``: normalised envelopes with error."""
    cols = ", ".join(f"{e} AS {c}" for c, e in _CLIENT.items())
    return f"""
b AS (
  SELECT {_HOME} AS tenant_id, 's' || (e.user_id % 3) AS source_id, ts AS received_at, e.event_id AS arrival,
         CASE WHEN e.event_id % 17 = 0 THEN 'yesterday' WHEN e.event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS sent,
         * FROM events e
), c AS (
  SELECT tenant_id, source_id, received_at, arrival, sent, {cols} FROM b
), inc AS (
  SELECT * FROM c
  UNION ALL SELECT * REPLACE (received_at + INTERVAL 1 HOUR AS received_at, arrival + 1000000000 AS arrival) FROM c WHERE arrival % 10 = 0
  UNION ALL SELECT * REPLACE (received_at + INTERVAL 1 HOUR AS received_at, arrival + 1000000000 AS arrival, 'changed' AS event_name)
    FROM c WHERE arrival % 37 = 0
), t AS (
  SELECT * REPLACE (trim(event_id) AS event_id, CASE WHEN trim(type) = '' THEN 'track' ELSE trim(type) END AS type,
    trim(event_name) AS event_name, trim(user_id) AS user_id, lower(trim(email)) AS email),
    CASE WHEN sent IN ('', 'yesterday') THEN received_at ELSE strptime(sent, '%Y-%m-%dT%H:%M:%SZ') END AS ts
  FROM inc
), env AS (
  SELECT *, CASE
      WHEN sent = 'yesterday' THEN 'timestamp: must be RFC3339'
      WHEN type = 'track' AND event_name = '' THEN 'event_name: required for track events'
      WHEN type = 'track' AND user_id || anonymous_id || email || phone || external_id || device_id = ''
        THEN 'identifiers: at least one identifier is required'
      WHEN type = 'identify' AND user_id = '' AND anonymous_id = '' THEN 'identifiers: identify requires user_id or anonymous_id'
      WHEN type = 'alias' AND previous_id = '' THEN 'previous_id: required for alias events'
      WHEN type = 'alias' AND user_id = '' THEN 'user_id: required for alias events'
      WHEN type NOT IN ('track', 'identify', 'alias') THEN 'type: unknown type "' || type || '"' END AS error,
    CASE WHEN user_id <> '' THEN 'user_id:' || user_id WHEN anonymous_id <> '' THEN 'anonymous_id:' || anonymous_id
      WHEN email <> '' THEN 'email:' || sha256(email) WHEN phone <> '' THEN 'phone:' || sha256(phone)
      WHEN external_id <> '' THEN 'external_id:' || external_id ELSE 'event_id:' || event_id END AS identifier_key,
    concat_ws('~', type, event_name, user_id, anonymous_id, email, phone, device_id, previous_id,
              CASE WHEN sent IN ('', 'yesterday') THEN '' ELSE sent END, properties, context, traits) AS body
  FROM t
), verdict AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'rejected' WHEN rn = 1 THEN 'accepted' WHEN body = first_body THEN 'duplicate' ELSE 'conflict' END AS verdict
  FROM (SELECT *, row_number() OVER f AS rn, first_value(body) OVER f AS first_body FROM env
        WINDOW f AS (PARTITION BY tenant_id, event_id, error IS NULL ORDER BY received_at, arrival))
)"""


_ENV = _incoming_sql()


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.normalize(incoming(spark, sf_dir))


@_add("ingest_normalize", f"WITH {_ENV} SELECT arrival, event_id, type, event_name, user_id, email, ts AS timestamp, error FROM env")
def _normalize(spark, sf_dir):
    return ntz(_envelopes(spark, sf_dir).select("arrival", "event_id", "type", "event_name", "user_id", "email", "timestamp", "error"))


@_add(
    "ingest_identifier_key",
    f"WITH {_ENV} SELECT arrival, event_name, identifier_key, tenant_id || '|' || identifier_key AS partition_key FROM env",
)
def _identifier_key(spark, sf_dir):
    return _envelopes(spark, sf_dir).select("arrival", "event_name", "identifier_key", "partition_key")


@_add("ingest_payload_hash", f"WITH {_ENV} SELECT arrival, min(arrival) OVER (PARTITION BY tenant_id, body) AS first_arrival FROM env")
def _payload_hash(spark, sf_dir):
    """Every event with the first one of its tenant that has the same hash: equal contents and no others share one."""
    same = Window.partitionBy("tenant_id", "payload_hash")
    return _envelopes(spark, sf_dir).select("arrival", F.min("arrival").over(same).alias("first_arrival"))


@_add("ingest_verdict", f"WITH {_ENV} SELECT tenant_id, event_id, arrival, event_name, verdict FROM verdict")
def _verdict(spark, sf_dir):
    return ingest.verdicts(_envelopes(spark, sf_dir)).select("tenant_id", "event_id", "arrival", "event_name", "verdict")


@_add("ingest_reject_reasons", f"WITH {_ENV} SELECT error, count(*) AS n FROM env WHERE error IS NOT NULL GROUP BY ALL")
def _reasons(spark, sf_dir):
    return _envelopes(spark, sf_dir).filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@_add(
    "ingest_batch_counts",
    f"""WITH {_ENV} SELECT arrival % 1000000000 // 500 AS batch_id, count(*) FILTER (verdict = 'accepted') AS accepted,
  count(*) FILTER (verdict = 'duplicate') AS duplicates, count(*) FILTER (verdict IN ('rejected', 'conflict')) AS rejected
FROM verdict GROUP BY ALL""",
)
def _batches(spark, sf_dir):
    rows = ingest.verdicts(_envelopes(spark, sf_dir)).withColumn("batch_id", F.expr("arrival % 1000000000 div 500"))
    return ingest.batch_counts(rows)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bodies: JSON, broken JSON and empty ones."""
    events = fixtures.table(spark, sf_dir, "events")
    body = F.when(F.expr("event_id % 19 = 0"), F.substring("props", 1, 4)).when(F.expr("event_id % 23 = 0"), "").otherwise(F.col("props"))
    return events.select(
        F.expr(_HOME).alias("tenant_id"), F.expr("'e' || (event_id - event_id % 2)").alias("event_id"), F.col("event_id").alias("arrival"),
        F.col("ts").cast("timestamp").alias("received_at"), body.alias("raw"), F.expr("'user_id:' || user_id").alias("identifier_key"), F.col("event_type").alias("event_name"),
    )


_RAW_SQL = f"""
raw AS (
  SELECT {_HOME} AS tenant_id, 'e' || (event_id - event_id % 2) AS event_id, event_id AS arrival, ts AS received_at,
         CASE WHEN event_id % 19 = 0 THEN substr(props, 1, 4) WHEN event_id % 23 = 0 THEN '' ELSE props END AS raw,
         'user_id:' || user_id AS identifier_key, event_type AS event_name FROM events
)"""


@_add(
    "raw_store",
    f"WITH {_RAW_SQL} SELECT tenant_id, event_id, min(arrival) AS arrival, arg_min(sha256(raw), arrival) AS raw_hash FROM raw GROUP BY ALL",
)
def _raw_store(spark, sf_dir):
    return ingest.raw_store(_raw(spark, sf_dir)).select("tenant_id", "event_id", "arrival", "raw_hash")


@_add(
    "dlq_split",
    f"""WITH {_RAW_SQL} SELECT arrival, CASE WHEN raw = '' THEN 'null' ELSE cast(to_json(raw) AS VARCHAR) END AS payload, 'open' AS status
FROM raw WHERE raw = '' OR NOT json_valid(raw)""",
)
def _dlq(spark, sf_dir):
    return ingest.split_dead_letters(_raw(spark, sf_dir))[1].select("arrival", "payload", "status")


@_add(
    "raw_event_page",
    f"""WITH {_RAW_SQL} SELECT tenant_id, event_id, arrival FROM (
  SELECT * FROM raw WHERE tenant_id = 'r1' AND event_name = 'view' AND (received_at, event_id) < ({AT_SQL}, 'e5000')
  ORDER BY received_at DESC, event_id DESC LIMIT 51)""",
)
def _raw_page(spark, sf_dir):
    cursor = ops.encode_cursor(AT, "e5000")
    return ops.raw_event_page(_raw(spark, sf_dir), "r1", event_name="view", after=cursor).select("tenant_id", "event_id", "arrival")


@_add(
    "replay_identifier",
    f"WITH {_RAW_SQL} SELECT event_id, arrival, raw FROM raw WHERE tenant_id = 'r3' AND identifier_key = 'user_id:8' ORDER BY received_at DESC LIMIT 1001",
)
def _replay(spark, sf_dir):
    return ops.replay(_raw(spark, sf_dir), "r3", "user_id:8").select("event_id", "arrival", "raw")


@_add(
    "audit_page",
    f"""WITH {_RAW_SQL} SELECT audit_id, actor, action FROM (SELECT 'a' || lpad(cast(arrival AS VARCHAR), 9, '0') AS audit_id, identifier_key AS actor,
  event_name AS action, received_at FROM raw WHERE tenant_id = 'r2') ORDER BY received_at DESC, audit_id DESC LIMIT 21""",
)
def _audit(spark, sf_dir):
    audit = _raw(spark, sf_dir).select(
        "tenant_id", F.expr("'a' || lpad(arrival, 9, '0')").alias("audit_id"), F.col("identifier_key").alias("actor"),
        F.col("event_name").alias("action"), F.lit("event").alias("resource"), F.col("received_at").alias("created_at"), "raw",
    )
    return ops.audit_page(audit, "r2", 20).select("audit_id", "actor", "action")


# --- identity and profiles -----------------------------------------------------------------------------------------

#: Every fiftieth event of a user comes from a device that users of equal remainder share.
_DEVICE = "CASE WHEN event_id % 50 = 0 THEN 's' || (user_id % 20) ELSE 'd' || (user_id * 3 + event_id % 3) END"


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean envelopes with shared devices, so that clusters merge."""
    homes = fixtures._homes(spark, sf_dir).select("tenant_id", "c_custkey")
    events = fixtures.table(spark, sf_dir, "events").join(homes, F.col("user_id") == F.col("c_custkey"))
    blank = F.lit("")
    return events.select(
        "tenant_id",
        F.expr("'e' || event_id").alias("event_id"),
        F.expr("'s' || (user_id % 3)").alias("source_id"),
        F.lit("track").alias("type"),
        F.col("event_type").alias("event_name"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.expr("'u' || user_id").alias("user_id"),
        blank.alias("anonymous_id"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN 'user' || user_id || '@example.com' ELSE '' END").alias("email"),
        blank.alias("phone"),
        blank.alias("external_id"),
        F.expr(_DEVICE).alias("device_id"),
        blank.alias("previous_id"),
        F.expr(_CLIENT["properties"]).alias("properties"),
        F.expr(_CLIENT["context"]).alias("context"),
        F.expr(_CLIENT["traits"]).alias("traits"),
    )


#: CTEs ``ev`` (events with the component's key), ``comp`` (its first event).
_ID = f"""
ev AS (
  SELECT h.tenant_id, e.event_id AS n, 'e' || e.event_id AS event_id, ts, e.user_id, event_type, {_DEVICE.replace('event_id', 'e.event_id').replace('user_id', 'e.user_id')} AS device,
         CASE WHEN max((e.event_id % 50 = 0)::INT) OVER (PARTITION BY e.user_id) = 1 THEN 's' || (e.user_id % 20) ELSE 'u' || e.user_id END AS comp
  FROM events e JOIN homes h ON e.user_id = h.c_custkey
), comp AS (
  SELECT tenant_id, comp, 'c_' || arg_min(event_id, (ts, event_id)) AS cluster_id FROM ev GROUP BY ALL
), evc AS (SELECT * FROM ev JOIN comp USING (tenant_id, comp)),
nodes AS (
  SELECT tenant_id, cluster_id, 'user_id' AS namespace, 'u' || user_id AS value FROM evc
  UNION SELECT tenant_id, cluster_id, 'device_id', device FROM evc
  UNION SELECT tenant_id, cluster_id, 'email', 'user' || user_id || '@example.com' FROM evc WHERE n % 7 = 0
)"""


@_add("identity_nodes", with_sql("SELECT tenant_id, namespace, count(*) AS nodes FROM nodes GROUP BY ALL", _ID))
def _nodes(spark, sf_dir):
    found = identity.nodes(identity.extract(envelopes(spark, sf_dir)))
    return found.groupBy("tenant_id", "namespace").agg(F.count(F.lit(1)).alias("nodes"))


def _identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(identity.extract(envelopes(spark, sf_dir)).select("tenant_id", "event_id", "received_at", "node_id"))


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ids = checkpointed(identity.extract(envelopes(spark, sf_dir)))
    return ids, identity.resolve(ids)


@_add("identity_components", with_sql("SELECT tenant_id, namespace, value, cluster_id FROM nodes", _ID))
def _components(spark, sf_dir):
    ids, members = _resolved(spark, sf_dir)
    return identity.nodes(ids).join(members, ["tenant_id", "node_id"]).select("tenant_id", "namespace", "value", "cluster_id")


@_add("identity_identifier_inventory", with_sql("SELECT tenant_id, cluster_id, namespace, count(*) AS n FROM nodes GROUP BY ALL", _ID))
def _inventory(spark, sf_dir):
    ids, members = _resolved(spark, sf_dir)
    return governance.identifier_inventory(identity.nodes(ids), members)


#: Users of one remainder meet at a shared device: ``joined`` is when, ``core`` the first of them; a user whose first event
#: is that meeting begins no line of its own, unless it is the first to come.
_LINES = _ID + """, f AS (
  SELECT tenant_id, user_id, user_id % 20 AS s, min({'t': ts, 'i': event_id}) AS born, min({'t': ts, 'i': event_id}) FILTER (n % 50 = 0) AS joined FROM ev GROUP BY ALL
), j AS (
  SELECT *, min(joined) OVER (PARTITION BY tenant_id, s) AS core FROM f WHERE joined IS NOT NULL
), k AS (
  SELECT *, CASE WHEN born <> joined OR joined = core THEN born END AS line FROM j
), m AS (
  SELECT *, min(line) OVER (PARTITION BY tenant_id, s ORDER BY joined ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held,
         min(line) OVER (PARTITION BY tenant_id, s ORDER BY joined) AS holds FROM k
)"""


#: Every event with the line that its cluster was called after when it arrived.
_AT_TIME = """, w AS (
  SELECT e.tenant_id, e.event_id, CASE WHEN f.joined <= {'t': e.ts, 'i': e.event_id}
    THEN min(CASE WHEN k.joined.i = e.event_id THEN k.line END) OVER (PARTITION BY e.tenant_id, f.s, f.joined IS NULL ORDER BY e.ts, e.event_id) ELSE f.born END AS line
  FROM ev e JOIN f USING (tenant_id, user_id) LEFT JOIN k USING (tenant_id, user_id)
)"""


@_add(
    "identity_merge_history",
    with_sql(
        """SELECT tenant_id, 'c_' || CASE WHEN line < held THEN held.i ELSE line.i END AS from_cluster_id, 'c_' || least(line, held).i AS to_cluster_id,
  joined.i AS event_id, 'deterministic_match' AS reason FROM m WHERE joined <> core AND line IS NOT NULL""",
        _LINES,
    ),
)
def _history(spark, sf_dir):
    return identity.merge_history(_identifiers(spark, sf_dir))


@_add(
    "identity_resolved_feed",
    with_sql(
        """SELECT tenant_id, event_id, 'c_' || line.i AS cluster_id, 'customer_' || line.i AS canonical_user_id, merged IS NOT NULL AS merge_occurred,
  coalesce('customer_' || merged.i, '') AS merged FROM (
  SELECT w.*, CASE WHEN m.line < m.held THEN m.held ELSE m.line END AS merged
  FROM w LEFT JOIN m ON m.tenant_id = w.tenant_id AND m.joined.i = w.event_id AND m.joined <> m.core AND m.line IS NOT NULL)""",
        _LINES
        + _AT_TIME,
    ),
)
def _feed_of_identities(spark, sf_dir):
    rows = identity.resolved_feed(_identifiers(spark, sf_dir))
    merged = F.array_join("merged_canonical_user_ids", ",").alias("merged")
    return rows.select("tenant_id", "event_id", "cluster_id", "canonical_user_id", "merge_occurred", merged)


_FOLD = {"order_event": "purchase", "view_event": "view"}


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, members = _resolved(spark, sf_dir)
    return profiles.fold(profiles.observed(envelopes(spark, sf_dir), **_FOLD), identity.event_clusters(ids, members))


@_add(
    "profile_traits",
    with_sql(
        """SELECT tenant_id, cluster_id, arg_max('user' || user_id || '@example.com', (ts, event_id)) FILTER (n % 7 = 0) AS email,
  arg_max('N' || user_id, (ts, event_id)) AS name, CASE WHEN bool_or(n % 4 = 0) THEN 'VN' END AS country FROM evc GROUP BY ALL""",
        _ID,
    ),
)
def _traits(spark, sf_dir):
    rows = _folded(spark, sf_dir)
    return rows.select("tenant_id", "cluster_id", *(F.col(f"trait_{t}").alias(t) for t in ("email", "name", "country")))


@_add(
    "profile_computed",
    with_sql(
        """SELECT tenant_id, cluster_id, count(*) AS total_events, count(*) FILTER (event_type = 'purchase') AS total_orders,
  arg_max(event_type, (ts, event_id)) AS last_event_name, arg_max('s' || (user_id % 3), (ts, event_id)) AS last_source_id,
  arg_max('https://x/' || (n % 9), (ts, event_id)) AS last_page_url, max(ts) FILTER (event_type = 'purchase') AS last_order_at
FROM evc GROUP BY ALL""",
        _ID,
    ),
)
def _computed(spark, sf_dir):
    return ntz(
        _folded(spark, sf_dir).select(
            "tenant_id", "cluster_id", "total_events", "total_orders", "last_event_name", "last_source_id", "last_page_url", "last_order_at"
        )
    )


@_add("profile_seen", with_sql("SELECT tenant_id, cluster_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS version FROM evc GROUP BY ALL", _ID))
def _seen(spark, sf_dir):
    return ntz(_folded(spark, sf_dir).select("tenant_id", "cluster_id", "first_seen_at", "last_seen_at", "version"))


@_add("profile_exact_fold")
def _exact(spark, sf_dir):
    return ntz(exact_profiles(spark, sf_dir))


@_add(
    "profile_exact_activity",
    with_sql(
        """SELECT tenant_id, cluster_id, arg_max('N' || user_id, (ts, event_id)) FILTER (own) AS trait_name, arg_max(event_type, (ts, event_id)) FILTER (own) AS last_event_name,
  arg_max('s' || (user_id % 3), (ts, event_id)) FILTER (own) AS last_source_id, arg_max('https://x/' || (n % 9), (ts, event_id)) FILTER (own) AS last_page_url,
  count(*) AS total_events, count(*) FILTER (event_type = 'purchase') AS total_orders, max(ts) FILTER (event_type = 'purchase') AS last_order_at,
  min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) FILTER (own) AS version
FROM (SELECT evc.*, 'c_' || w.line.i = cluster_id AS own FROM evc JOIN w USING (tenant_id, event_id)) GROUP BY ALL""",
        _LINES + _AT_TIME,
    ),
)
def _exact_activity(spark, sf_dir):
    """The exact fold's columns that a replay isn't needed for here: these events arrive as they happen, and each sets name and activity."""
    return ntz(exact_profiles(spark, sf_dir).drop("trait_email", "trait_phone", "trait_country", "last_product_viewed"))


def exact_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.exact_fold(profiles.observed(envelopes(spark, sf_dir), **_FOLD), *identity.timeline(_identifiers(spark, sf_dir)))


@_add(
    "profile_changed_fields",
    with_sql(
        """SELECT tenant_id, event_id, cluster_id, concat_ws(',',
  CASE WHEN email IS NOT NULL AND email IS DISTINCT FROM last_value(email IGNORE NULLS) OVER w THEN 'traits.email' END,
  CASE WHEN name IS DISTINCT FROM last_value(name IGNORE NULLS) OVER w THEN 'traits.name' END,
  CASE WHEN country IS NOT NULL AND country IS DISTINCT FROM last_value(country IGNORE NULLS) OVER w THEN 'traits.country' END,
  'computed_attributes.total_events',
  CASE WHEN event_type IS DISTINCT FROM last_value(event_type) OVER w THEN 'computed_attributes.last_event_name' END,
  CASE WHEN source IS DISTINCT FROM last_value(source) OVER w THEN 'computed_attributes.last_source_id' END,
  CASE WHEN url IS DISTINCT FROM last_value(url) OVER w THEN 'computed_attributes.last_page_url' END,
  CASE WHEN event_type = 'purchase' THEN 'computed_attributes.total_orders,computed_attributes.last_order_at' END,
  CASE WHEN coalesce(ts < min(ts) OVER w, true) THEN 'first_seen_at' END,
  CASE WHEN coalesce(ts > max(ts) OVER w, true) THEN 'last_seen_at' END) AS changed
FROM (SELECT *, CASE WHEN n % 7 = 0 THEN 'user' || user_id || '@example.com' END AS email, 'N' || user_id AS name,
  CASE WHEN n % 4 = 0 THEN 'VN' END AS country, 's' || (user_id % 3) AS source, 'https://x/' || (n % 9) AS url FROM evc)
WINDOW w AS (PARTITION BY tenant_id, cluster_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        _ID,
    ),
)
def _changed(spark, sf_dir):
    ids, members = _resolved(spark, sf_dir)
    rows = profiles.changed_fields(profiles.observed(envelopes(spark, sf_dir), **_FOLD), identity.event_clusters(ids, members))
    return rows.withColumn("changed", F.array_join("changed", ","))


@_add(
    "profile_updated_feed",
    with_sql(
        """SELECT tenant_id, event_id, cluster_id, 'customer_' || substr(cluster_id, 3) AS canonical_user_id,
  row_number() OVER (PARTITION BY tenant_id, cluster_id ORDER BY ts, event_id) AS profile_version,
  CASE WHEN 'N' || user_id IS DISTINCT FROM lag('N' || user_id) OVER (PARTITION BY tenant_id, cluster_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new_name
FROM evc""",
        _ID,
    ),
)
def _updates(spark, sf_dir):
    ids, members = _resolved(spark, sf_dir)
    rows = profiles.updated_feed(profiles.observed(envelopes(spark, sf_dir), **_FOLD), identity.event_clusters(ids, members))
    new_name = F.array_contains("changed_fields", "traits.name").cast("int").alias("new_name")
    return rows.select("tenant_id", "event_id", "cluster_id", "canonical_user_id", "profile_version", new_name)


@_add(
    "profile_by_id",
    with_sql("SELECT 'id' AS found_by, tenant_id, profile_id, canonical_user_id, name FROM prof WHERE profile_id = 'p8' UNION ALL SELECT 'canonical_id', tenant_id, profile_id, canonical_user_id, name FROM prof WHERE canonical_user_id = 'customer_9'"),
)
def _by_id(spark, sf_dir):
    """Point reads of two profiles, asked of every tenant: only their own finds them."""
    people = fixtures.profiles(spark, sf_dir)
    found = [profiles.by_id(people, t, "p8").withColumn("found_by", F.lit("id")) for t in _TENANTS]
    found += [profiles.by_canonical_id(people, t, "customer_9").withColumn("found_by", F.lit("canonical_id")) for t in _TENANTS]
    rows = reduce(DataFrame.unionByName, found)
    return rows.select("found_by", "tenant_id", "profile_id", "canonical_user_id", F.get_json_object("traits", "$.name").alias("name"))


@_add(
    "profile_lookup",
    with_sql("SELECT DISTINCT tenant_id, cluster_id FROM nodes WHERE namespace = 'email' AND value = 'user8@example.com' AND tenant_id = (SELECT min(tenant_id) FROM nodes WHERE value = 'user8@example.com')", _ID),
)
def _lookup(spark, sf_dir):
    ids, members = _resolved(spark, sf_dir)
    rows = _folded(spark, sf_dir).select(
        "tenant_id", "cluster_id", F.to_json(F.struct(F.col("trait_name").alias("name"))).alias("traits"), F.col("last_seen_at").alias("updated_at")
    )
    home = ids.filter("value = 'user8@example.com'").agg(F.min("tenant_id")).first()[0]
    return profiles.lookup(rows, members, home or "r0", "email", " User8@Example.com").select("tenant_id", "cluster_id")


@_add(
    "identity_redirect",
    with_sql(
        """SELECT tenant_id, 'c' || n AS cluster_id, 'c' || top AS survivor_id FROM (
  WITH RECURSIVE up(n, top) AS (
    SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey > 0 AND c_custkey % 3 <> 0
    UNION ALL SELECT n, top // 2 FROM up WHERE top > 0 AND top % 3 <> 0)
  SELECT n, min(top) AS top FROM up GROUP BY n) x, (SELECT 't' AS tenant_id) y"""
    ),
)
def _redirect(spark, sf_dir):
    key = fixtures.table(spark, sf_dir, "customer").select("c_custkey").filter("c_custkey > 0 and c_custkey % 3 <> 0")
    merges = key.select(F.lit("t").alias("tenant_id"), F.expr("'c' || c_custkey").alias("cluster_id"), F.expr("'c' || (c_custkey div 2)").alias("survivor_id"))
    return identity.flat_redirects(merges)


# --- memberships and deadlines -------------------------------------------------------------------------------------

_VIEWERS = {"behavior": {"kind": "count", "event_name": "view", "window": "7d", "op": "gte", "value": 3}}


def _viewers(at: str) -> str:
    return f"""(SELECT tenant_id, profile_id FROM log WHERE event_name = 'view'
  AND occurred_at BETWEEN {at} - INTERVAL 7 DAY AND {at} GROUP BY ALL HAVING count(*) >= 3)"""


def verdicts_at(spark: SparkSession, sf_dir: str, at: dt.datetime, rule: dict = _VIEWERS) -> DataFrame:
    rows = evaluate(fixtures.profiles(spark, sf_dir), fixtures.behavior_log(spark, sf_dir), {"matched": parse(rule)}, at)
    return rows.select("tenant_id", F.lit("viewers").alias("segment_id"), "profile_id", "matched")


def _advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], membership.STATE)
    first = membership.state_of(membership.advance(empty, verdicts_at(spark, sf_dir, AT), AT))
    return membership.advance(first, verdicts_at(spark, sf_dir, LATER), LATER)


_BOTH = f"a AS {_viewers(AT_SQL)}, z AS {_viewers(LATER_SQL)}"


@_add(
    "membership_snapshot",
    with_sql(
        f"""SELECT tenant_id, profile_id, CASE WHEN z.profile_id IS NULL THEN 'exited' ELSE 'active' END AS status,
  CASE WHEN a.profile_id IS NULL THEN {LATER_SQL} ELSE {AT_SQL} END AS entered_at,
  CASE WHEN z.profile_id IS NULL THEN {LATER_SQL} END AS exited_at,
  cast(CASE WHEN z.profile_id IS NULL THEN 2 ELSE 1 END AS BIGINT) AS transition_seq
FROM a FULL JOIN z USING (tenant_id, profile_id)""",
        _BOTH,
    ),
)
def _snapshot(spark, sf_dir):
    return ntz(_advanced(spark, sf_dir).select("tenant_id", "profile_id", "status", "entered_at", "exited_at", "transition_seq"))


@_add(
    "membership_diff",
    with_sql(
        """SELECT tenant_id, profile_id, CASE WHEN z.profile_id IS NULL THEN 'exited' ELSE 'entered' END AS change,
  'sweep:' || CASE WHEN z.profile_id IS NULL THEN 2 ELSE 1 END AS reason
FROM a FULL JOIN z USING (tenant_id, profile_id) WHERE a.profile_id IS NULL OR z.profile_id IS NULL""",
        _BOTH,
    ),
)
def _diff(spark, sf_dir):
    return membership.changes(_advanced(spark, sf_dir)).select("tenant_id", "profile_id", "change", "reason")


@_add(
    "membership_members_page",
    with_sql(
        f"SELECT profile_id, 1::BIGINT AS transition_seq FROM (SELECT z.profile_id, a.profile_id IS NULL AS fresh FROM z LEFT JOIN a USING (tenant_id, profile_id) WHERE tenant_id = 'r1' ORDER BY fresh DESC, profile_id LIMIT 20)",
        _BOTH,
    ),
)
def _page(spark, sf_dir):
    rows = membership.state_of(_advanced(spark, sf_dir))
    return membership.members_page(rows, "r1", "viewers", 20).select("profile_id", "transition_seq")


@_add("population_page", with_sql("SELECT tenant_id, profile_id FROM prof WHERE profile_id > 'p3' ORDER BY profile_id LIMIT 100"))
def _population(spark, sf_dir):
    return membership.population_page(fixtures.profiles(spark, sf_dir), "p3", 100)


@_add(
    "edge_prefilter",
    with_sql("SELECT segment_id, count(*) AS pairs FROM (SELECT 'viewers' AS segment_id FROM log WHERE event_name = 'view' UNION ALL SELECT 'mixed' FROM log) GROUP BY ALL"),
)
def _edges(spark, sf_dir):
    rules = {
        "viewers": parse(_VIEWERS),
        "mixed": parse({"operator": "and", "conditions": [_VIEWERS, {"field": "profile.traits.name", "op": "exists"}]}),
    }
    return membership.edge_pairs(fixtures.behavior_log(spark, sf_dir), rules).groupBy("segment_id").agg(F.count(F.lit(1)).alias("pairs"))


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deadline per log row, some parked, with failed attempts."""
    n = F.substring("event_id", 2, 20).cast("long")
    return fixtures.behavior_log(spark, sf_dir).select(
        "tenant_id", F.col("event_id").alias("segment_id"), "profile_id", F.col("occurred_at").alias("due_at"),
        F.when(n % 9 == 0, F.col("occurred_at")).alias("parked_at"), (n % 12).cast("int").alias("attempts"),
    )


_PENDING = """
pend AS (SELECT tenant_id, event_id AS segment_id, profile_id, occurred_at AS due_at,
  CASE WHEN cast(substr(event_id, 2) AS BIGINT) % 9 = 0 THEN occurred_at END AS parked_at,
  cast(cast(substr(event_id, 2) AS BIGINT) % 12 AS INT) AS attempts FROM log)"""


@_add(
    "sweep_fair_claim",
    with_sql(
        f"""SELECT tenant_id, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY due_at, segment_id, profile_id) AS rn
  FROM pend WHERE due_at <= {AT_SQL} AND parked_at IS NULL) WHERE rn <= 30 ORDER BY due_at, tenant_id, segment_id, profile_id LIMIT 100""",
        _PENDING,
    ),
)
def _claim(spark, sf_dir):
    return deadlines.fair_claim(_pending(spark, sf_dir), AT, 100, 30).select("tenant_id", "segment_id")


@_add(
    "sweep_backoff_park",
    with_sql(
        f"""SELECT segment_id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 10 THEN due_at ELSE {AT_SQL} + to_seconds(least(3600, 5 * (1 << attempts))) END AS due_at, attempts + 1 >= 10 AS parked FROM pend""",
        _PENDING,
    ),
)
def _park(spark, sf_dir):
    out = deadlines.after_failure(_pending(spark, sf_dir), AT)
    return ntz(out.select("segment_id", "attempts", "due_at", F.col("parked_at").isNotNull().alias("parked")))


@_add(
    "safety_reenqueue",
    with_sql(
        f"SELECT tenant_id, 'viewers' AS segment_id, profile_id FROM a WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.tenant_id = a.tenant_id AND l.profile_id = a.profile_id AND event_name = 'error' AND occurred_at > {AT_SQL} - INTERVAL 2 DAY AND occurred_at <= {AT_SQL}) ORDER BY ALL LIMIT 50",
        _BOTH,
    ),
)
def _safety(spark, sf_dir):
    active = verdicts_at(spark, sf_dir, AT).filter("matched").select("tenant_id", "segment_id", "profile_id", F.lit("active").alias("status"))
    pending = fixtures.behavior_log(spark, sf_dir).filter(
        (F.col("event_name") == "error") & in_window(F.col("occurred_at"), "2d", AT) & (F.col("occurred_at") > moment(AT, -2 * ops.DAY))
    ).select("tenant_id", F.lit("viewers").alias("segment_id"), "profile_id").distinct()
    return deadlines.safety_page(active, pending, 50)


@_add("ops_backlog", with_sql(f"SELECT count(*) FILTER (due_at <= {AT_SQL} AND parked_at IS NULL) AS due, count(parked_at) AS parked, min(due_at) FILTER (parked_at IS NULL) AS oldest_due FROM pend", _PENDING))
def _backlog(spark, sf_dir):
    return ntz(ops.backlog(_pending(spark, sf_dir), AT))


# --- activation ----------------------------------------------------------------------------------------------------

_DESTINATIONS = [("d1", "email", "active", "{}"), ("d2", "webhook", "active", '{"channel":"sms"}'), ("d3", "email", "disabled", "{}")]
_SUBSCRIPTIONS = [("x1", "d1", "active"), ("x2", "d2", "active"), ("x3", "d3", "active"), ("x4", "d1", "disabled")]
_TENANTS = tuple(f"r{i}" for i in range(5))


def catalogs(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(subscriptions, destinations) of every tenant."""
    d = [(t, *row) for t in _TENANTS for row in _DESTINATIONS]
    s = [(t, x, dest, "viewers", status) for t in _TENANTS for x, dest, status in _SUBSCRIPTIONS]
    return (
        spark.createDataFrame(s, "tenant_id string, subscription_id string, destination_id string, segment_id string, status string"),
        spark.createDataFrame(d, "tenant_id string, destination_id string, type string, status string, config string"),
    )


def consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("profile_id", 2, 20).cast("long")
    return fixtures.profiles(spark, sf_dir).filter(n % 7 < 2).select(
        "tenant_id", "profile_id", F.when(n % 2 == 0, "email").otherwise("sms").alias("channel"), F.lit("marketing").alias("purpose"),
        F.when(n % 7 == 0, "denied").otherwise("granted").alias("status"), F.lit(AT).cast("timestamp").alias("updated_at"),
    )


_FEED = f"""
a AS {_viewers(AT_SQL)}, feed AS (SELECT tenant_id, profile_id, cast(substr(profile_id, 2) AS BIGINT) AS n FROM a),
sub(subscription_id, destination_id, channel) AS (VALUES ('x1', 'd1', 'email'), ('x2', 'd2', 'sms')),
task AS (
  SELECT tenant_id, profile_id, destination_id, subscription_id, coalesce(n % 7 = 0 AND channel = CASE WHEN n % 2 = 0 THEN 'email' ELSE 'sms' END, false) AS denied,
    sha256(concat_ws('|', tenant_id, destination_id, subscription_id, profile_id, 'sweep:1', 'entered')) AS idempotency_key FROM feed, sub
)"""


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], membership.STATE)
    feed = membership.changes(membership.advance(empty, verdicts_at(spark, sf_dir, AT), AT))
    return activation.tasks(feed, *catalogs(spark), fixtures.profiles(spark, sf_dir), consent(spark, sf_dir))


@_add(
    "activation_tasks",
    with_sql("SELECT tenant_id, profile_id, destination_id, subscription_id, CASE WHEN denied THEN 'skipped' ELSE 'pending' END AS status FROM task", _FEED),
)
def _tasks(spark, sf_dir):
    return task_rows(spark, sf_dir).select("tenant_id", "profile_id", "destination_id", "subscription_id", "status")


@_add("activation_consent_gate", with_sql("SELECT destination_id, count(*) AS skipped FROM task WHERE denied GROUP BY ALL", _FEED))
def _gate(spark, sf_dir):
    return task_rows(spark, sf_dir).filter("last_error = 'consent_denied'").groupBy("destination_id").agg(F.count(F.lit(1)).alias("skipped"))


@_add("activation_idempotency", with_sql("SELECT idempotency_key, 1::BIGINT AS n FROM task", _FEED))
def _idempotency(spark, sf_dir):
    rows = task_rows(spark, sf_dir)
    stored = membership.insert_absent(rows.filter("destination_id = 'd1'"), rows, ["tenant_id", "idempotency_key"])
    return stored.groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("n"))


def _sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows as sends with an HTTP status."""
    n = F.substring("event_id", 2, 20).cast("long")
    status = F.element_at(F.array(*(F.lit(x) for x in (200, 429, 500, 400, 404, 204, 301)), F.lit(None).cast("int")), (n % 8 + 1).cast("int"))
    return fixtures.behavior_log(spark, sf_dir).select(
        F.col("event_id").alias("task_id"), F.col("tenant_id").alias("destination_id"), n.alias("seq"), F.col("occurred_at").alias("sent_at"),
        status.alias("http_status"), (n % 6).cast("int").alias("attempt_count"),
    )


@_add(
    "activation_backoff",
    with_sql(
        f"""SELECT task_id, attempt AS attempt_count, CASE WHEN ok THEN 'succeeded' WHEN again THEN 'failed_retryable' ELSE 'failed_permanent' END AS status,
  CASE WHEN again THEN {AT_SQL} + to_seconds(least(900, 10 * (1 << (attempt - 1)))) END AS next_attempt_at FROM (
  SELECT *, retry AND attempt < 5 AS again FROM (SELECT event_id AS task_id, cast(n % 6 + 1 AS INT) AS attempt, n % 8 IN (0, 5) AS ok, n % 8 IN (1, 2, 7) AS retry
  FROM (SELECT *, cast(substr(event_id, 2) AS BIGINT) AS n FROM log)))"""
    ),
)
def _backoff(spark, sf_dir):
    return ntz(activation.after_send(_sends(spark, sf_dir), AT).select("task_id", "attempt_count", "status", "next_attempt_at"))


@_add(
    "activation_due",
    with_sql(
        f"""SELECT idempotency_key, next_attempt_at FROM (SELECT event_id AS idempotency_key,
  CASE WHEN n % 8 IN (1, 2, 7) AND n % 6 + 1 < 5 THEN {AT_SQL} + to_seconds(least(900, 10 * (1 << (n % 6)))) END AS next_attempt_at, n % 8 = 6 AS fresh
  FROM (SELECT *, cast(substr(event_id, 2) AS BIGINT) AS n FROM log)) WHERE fresh OR next_attempt_at <= {AT_SQL} + to_seconds(40)
  ORDER BY next_attempt_at NULLS FIRST, idempotency_key LIMIT 1000"""
    ),
)
def _due_tasks(spark, sf_dir):
    """Tasks some time after a round of sends: never sent ones, retries that are due, later retries and ended ones."""
    sent = activation.after_send(_sends(spark, sf_dir), AT).withColumn("idempotency_key", F.col("task_id"))
    fresh = F.col("seq") % 8 == 6
    rows = sent.withColumns({"status": F.when(fresh, "pending").otherwise(F.col("status")), "next_attempt_at": F.when(~fresh, F.col("next_attempt_at"))})
    return ntz(activation.due(rows, AT + dt.timedelta(seconds=40), 1000).select("idempotency_key", "next_attempt_at"))


@_add("activation_breaker")
def _breaker(spark, sf_dir):
    ok = activation.outcome_class(F.col("http_status")) == "success"
    # Time runs a thousand times faster here, so that a minute holds several sends.
    fast = F.timestamp_micros((F.unix_micros("sent_at") / 1000).cast("long"))
    rows = activation.breaker(_sends(spark, sf_dir).withColumns({"success": ok, "sent_at": fast}))
    return rows.groupBy("destination_id", "allowed").agg(F.count(F.lit(1)).alias("n"))


@_add(
    "activation_failure_window",
    with_sql(
        """SELECT task_id, count(*) OVER (PARTITION BY tenant_id ORDER BY occurred_at RANGE BETWEEN INTERVAL 59999999 MICROSECOND PRECEDING AND CURRENT ROW) AS recent_failures
  FROM (SELECT event_id AS task_id, * FROM log WHERE cast(substr(event_id, 2) AS BIGINT) % 8 NOT IN (0, 5))"""
    ),
)
def _failures(spark, sf_dir):
    ok = activation.outcome_class(F.col("http_status")) == "success"
    return activation.hot_destinations(_sends(spark, sf_dir).withColumn("success", ok)).select("task_id", "recent_failures")


_OUTBOX = "SELECT event_id AS id, tenant_id, profile_id, occurred_at AS created_at, cast(substr(event_id, 2) AS BIGINT) AS n FROM log"


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows as an outbox."""
    rows = fixtures.behavior_log(spark, sf_dir)
    return rows.select(
        F.col("event_id").alias("id"), "tenant_id", "profile_id", F.col("occurred_at").alias("created_at"), F.substring("event_id", 2, 20).cast("long").alias("n")
    )


@_add(
    "relay_prefix",
    with_sql(
        f"""SELECT id, CASE WHEN stop IS NULL OR {{'t': created_at, 'i': id}} < stop THEN 'published' ELSE 'pending' END AS status FROM (
  SELECT *, min(CASE WHEN n % 11 = 3 THEN {{'t': created_at, 'i': id}} END) OVER (PARTITION BY tenant_id, profile_id) AS stop FROM ({_OUTBOX}))"""
    ),
)
def _relay(spark, sf_dir):
    """Sends of which some fail: of each profile, what was sent before its first failure is published, the rest waits."""
    rows = _outbox(spark, sf_dir).withColumn("ok", F.col("n") % 11 != 3)
    return relay.committed(rows, ["tenant_id", "profile_id"]).select("id", "status")


@_add(
    "relay_claim",
    with_sql(
        f"""SELECT id, CASE WHEN stop IS NULL OR {{'t': created_at, 'i': id}} < stop THEN 'published' ELSE 'pending' END AS status FROM (
  SELECT *, min(CASE WHEN n % 53 = 7 THEN {{'t': created_at, 'i': id}} END) OVER () AS stop FROM (
    SELECT * FROM ({_OUTBOX}) WHERE n % 3 <> 0 ORDER BY created_at, id LIMIT 100))"""
    ),
)
def _relay_claim(spark, sf_dir):
    """One run over an outbox in one order: the oldest pending rows, up to the first that can't be sent."""
    status = F.when(F.col("n") % 3 != 0, relay.PENDING).otherwise(relay.PUBLISHED)
    rows = relay.claimed(_outbox(spark, sf_dir).withColumn("status", status)).drop("status")
    return relay.committed(rows.withColumn("ok", F.col("n") % 53 != 7), []).select("id", "status")


# --- journeys ------------------------------------------------------------------------------------------------------

JOURNEY = {
    "steps": [
        {"type": "wait", "duration": "1d"},
        {"type": "condition", "condition": {"behavior": {"kind": "recency", "event_name": "purchase", "window": "3d"}}, "if_true": 4, "if_false": 2},
        {"type": "split", "branches": [{"weight": 1, "next": 3}, {"weight": 3, "next": 4}]},
        {"type": "send", "destination_id": "d1", "next": 5},
        {"type": "send", "destination_id": "d2"},
    ]
}


def enrollments(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = spark.createDataFrame(
        [(t, "j1", "viewers", None, 1, 1, "active", True) for t in _TENANTS],
        "tenant_id string, journey_id string, entry_segment_id string, entry_event_name string, max_enrollments int, current_version int, status string, exit_on_segment_leave boolean",
    )
    entered = verdicts_at(spark, sf_dir, AT).filter("matched").select("tenant_id", "profile_id", "segment_id", F.lit(None).cast("string").alias("event_name"))
    n = F.substring("profile_id", 2, 20).cast("long")
    done = entered.filter(n % 5 == 0).select(
        "tenant_id", F.lit("j1").alias("journey_id"), "profile_id", F.lit(0).alias("enrollment_seq"), F.lit(1).alias("journey_version"),
        F.lit("completed").alias("status"), F.lit(5).alias("current_step_index"), F.lit(3).cast("long").alias("step_seq"), F.lit(AT).cast("timestamp").alias("due_at"),
    )
    return journeys.enroll(entered, heads, done, fixtures.profiles(spark, sf_dir), AT)


_ENROLLED = f"a AS {_viewers(AT_SQL)}, enr AS (SELECT tenant_id, profile_id FROM a WHERE cast(substr(profile_id, 2) AS BIGINT) % 5 <> 0)"


@_add("journey_enroll", with_sql(f"SELECT tenant_id, profile_id, 0 AS enrollment_seq, {AT_SQL} AS due_at FROM enr", _ENROLLED))
def _enroll(spark, sf_dir):
    return ntz(enrollments(spark, sf_dir).select("tenant_id", "profile_id", "enrollment_seq", "due_at"))


_POINT = "cast(('0x' || substr(sha256(concat_ws('|', tenant_id, 'j1', profile_id, '0', '2')), 1, 16)) AS UBIGINT)"


@_add("journey_split_target", with_sql(f"SELECT tenant_id, profile_id, CASE WHEN {_POINT} % 4 < 1 THEN 3 ELSE 4 END AS target FROM enr", _ENROLLED))
def _split(spark, sf_dir):
    rows = enrollments(spark, sf_dir).withColumn("current_step_index", F.lit(2))
    return rows.select("tenant_id", "profile_id", scalars.split_target(journeys.split_key(), [(1, 3), (3, 4)]).alias("target"))


_BOUGHT = f"""coalesce((SELECT max(occurred_at) FROM log l WHERE l.tenant_id = enr.tenant_id AND l.profile_id = enr.profile_id AND event_name = 'purchase'
  AND occurred_at <= {AT_SQL} + INTERVAL 1 DAY) >= {AT_SQL} + INTERVAL 1 DAY - INTERVAL 3 DAY, false)"""


@_add("journey_condition_route", with_sql(f"SELECT tenant_id, profile_id, {_BOUGHT} AS hit FROM enr", _ENROLLED))
def _route(spark, sf_dir):
    rows = enrollments(spark, sf_dir).withColumn("due_at", F.col("due_at") + F.expr("interval 1 day"))
    ready = rows.join(fixtures.profiles(spark, sf_dir), ["tenant_id", "profile_id"])
    rule = journeys.parse(JOURNEY)[1].condition
    return evaluate_rows(ready, fixtures.behavior_log(spark, sf_dir), rule, "due_at").select("tenant_id", "profile_id", "hit")


@_add(
    "journey_run",
    with_sql(
        f"""SELECT tenant_id, profile_id, CASE WHEN NOT bought AND {_POINT} % 4 < 1 THEN 'd1' ELSE 'd2' END AS destination_id,
  CASE WHEN NOT bought AND {_POINT} % 4 < 1 THEN 3 ELSE 4 END AS step_index, {AT_SQL} + INTERVAL 1 DAY AS sent_at
FROM (SELECT *, {_BOUGHT} AS bought FROM enr)""",
        _ENROLLED,
    ),
)
def _run(spark, sf_dir):
    _, sends = journeys.advance(
        enrollments(spark, sf_dir), journeys.parse(JOURNEY), fixtures.profiles(spark, sf_dir), fixtures.behavior_log(spark, sf_dir), LATER
    )
    return ntz(sends.select("tenant_id", "profile_id", "destination_id", "step_index", "sent_at"))


@_add(
    "journey_exit",
    with_sql("SELECT tenant_id, profile_id, CASE WHEN z.profile_id IS NULL THEN 'exited' ELSE 'active' END AS status FROM enr LEFT JOIN z USING (tenant_id, profile_id)", f"{_ENROLLED}, z AS {_viewers(LATER_SQL)}"),
)
def _exit(spark, sf_dir):
    heads = spark.createDataFrame(
        [(t, "j1", "viewers", "active", True) for t in _TENANTS],
        "tenant_id string, journey_id string, entry_segment_id string, status string, exit_on_segment_leave boolean",
    )
    left = membership.changes(_advanced(spark, sf_dir)).filter("change = 'exited'").select("tenant_id", "segment_id", "profile_id")
    return journeys.exits(left, heads, enrollments(spark, sf_dir)).select("tenant_id", "profile_id", "status")


@_add(
    "journey_payload",
    with_sql(
        f"""SELECT tenant_id, profile_id, 'journey_step' AS kind, CASE WHEN NOT bought AND {_POINT} % 4 < 1 THEN 3 ELSE 4 END AS step_index,
  canonical_user_id AS customer, name, email, total_orders FROM (SELECT *, {_BOUGHT} AS bought FROM enr) JOIN prof USING (tenant_id, profile_id)""",
        _ENROLLED,
    ),
)
def _journey_payload(spark, sf_dir):
    _, sends = journeys.advance(
        enrollments(spark, sf_dir), journeys.parse(JOURNEY), fixtures.profiles(spark, sf_dir), fixtures.behavior_log(spark, sf_dir), LATER
    )

    def at(path: str, kind: str = "string"):
        return F.get_json_object("payload", f"$.{path}").cast(kind)

    return sends.filter(at("journey_id") == "j1").select(
        at("tenant_id").alias("tenant_id"), "profile_id", at("type").alias("kind"), at("step_index", "int").alias("step_index"), at("customer.id").alias("customer"),
        at("customer.traits.name").alias("name"), at("customer.traits.email").alias("email"), at("customer.computed_attributes.total_orders", "long").alias("total_orders"),
    )


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enrolment per log row: some ended, parked or under an old or a fresh claim."""
    n = F.substring("segment_id", 2, 20).cast("long")
    claimed = F.when(n % 7 == 1, F.lit(AT - dt.timedelta(minutes=1))).when(n % 7 == 2, F.lit(AT - dt.timedelta(hours=1)))
    return _pending(spark, sf_dir).select(
        "tenant_id", F.lit("j1").alias("journey_id"), F.col("segment_id").alias("profile_id"), F.lit(0).alias("enrollment_seq"), "due_at", "parked_at", "attempts",
        F.when(n % 5 == 0, "completed").otherwise("active").alias("status"), claimed.cast("timestamp").alias("claimed_at"),
    )


_RUNS = f"""{_PENDING}, runs AS (SELECT tenant_id, segment_id AS profile_id, due_at, parked_at, attempts, n, n % 5 = 0 AS ended,
  CASE n % 7 WHEN 1 THEN {AT_SQL} - INTERVAL 1 MINUTE WHEN 2 THEN {AT_SQL} - INTERVAL 1 HOUR END AS claimed_at
  FROM (SELECT *, cast(substr(segment_id, 2) AS BIGINT) AS n FROM pend))"""


@_add(
    "journey_fair_claim",
    with_sql(
        f"""SELECT tenant_id, profile_id, {AT_SQL} AS claimed_at FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY due_at, profile_id) AS rn FROM runs
  WHERE NOT ended AND parked_at IS NULL AND due_at <= {AT_SQL} AND (claimed_at IS NULL OR claimed_at < {AT_SQL} - INTERVAL 5 MINUTE)) WHERE rn <= 25 ORDER BY due_at, tenant_id, profile_id LIMIT 80""",
        _RUNS,
    ),
)
def _journey_claim(spark, sf_dir):
    return ntz(journeys.claim(_runs(spark, sf_dir), AT, 80, 25).select("tenant_id", "profile_id", "claimed_at"))


@_add(
    "journey_failure",
    with_sql(
        f"""SELECT profile_id, CASE WHEN ended THEN attempts ELSE attempts + 1 END AS attempts,
  CASE WHEN ended OR attempts + 1 >= 10 THEN due_at ELSE {AT_SQL} + to_seconds(least(3600, 5 * (1 << attempts))) END AS due_at,
  CASE WHEN ended THEN parked_at WHEN attempts + 1 >= 10 THEN {AT_SQL} END AS parked_at FROM runs""",
        _RUNS,
    ),
)
def _journey_failure(spark, sf_dir):
    return ntz(journeys.after_failure(_runs(spark, sf_dir), AT).select("profile_id", "attempts", "due_at", "parked_at"))


@_add("journey_parked", with_sql("SELECT profile_id, attempts FROM runs WHERE tenant_id = 'r1' AND parked_at IS NOT NULL ORDER BY parked_at DESC, profile_id LIMIT 100", _RUNS))
def _journey_parked(spark, sf_dir):
    return journeys.parked(_runs(spark, sf_dir), "r1", "j1").select("profile_id", "attempts")


def _heads(spark: SparkSession, segment: str | None, event: str | None, most: int = 1) -> DataFrame:
    return spark.createDataFrame(
        [(t, "j1", segment, event, most, 3, "inactive" if t == "r0" else "active", True) for t in _TENANTS],
        "tenant_id string, journey_id string, entry_segment_id string, entry_event_name string, max_enrollments int, current_version int, status string, exit_on_segment_leave boolean",
    )


@_add(
    "journey_backfill",
    with_sql(
        f"SELECT tenant_id, profile_id, 3 AS journey_version, {AT_SQL} AS due_at FROM z WHERE tenant_id <> 'r0' AND cast(substr(profile_id, 2) AS BIGINT) % 5 <> 0",
        _BOTH,
    ),
)
def _backfill(spark, sf_dir):
    """Members at the later instant, of whom a fifth has an enrolment already."""
    state = membership.state_of(_advanced(spark, sf_dir))
    done = state.filter(F.substring("profile_id", 2, 20).cast("long") % 5 == 0).select("tenant_id", F.lit("j1").alias("journey_id"), "profile_id")
    return ntz(journeys.backfill(state, _heads(spark, "viewers", None), done, AT).select("tenant_id", "profile_id", "journey_version", "due_at"))


@_add(
    "journey_enroll_event",
    with_sql(
        """SELECT DISTINCT tenant_id, profile_id, CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS enrollment_seq FROM (
  SELECT *, cast(substr(profile_id, 2) AS BIGINT) AS n FROM log WHERE event_name = 'signup') WHERE tenant_id <> 'r0' AND n % 3 <> 0"""
    ),
)
def _enroll_event(spark, sf_dir):
    """Everyone who signed up enters, at most twice; a third has an active run, a fifth an ended one."""
    log = fixtures.behavior_log(spark, sf_dir).filter("event_name = 'signup'")
    n = F.substring("profile_id", 2, 20).cast("long")
    entries = log.select("tenant_id", "profile_id", F.lit(None).cast("string").alias("segment_id"), "event_name")
    running = F.when(n % 3 == 0, "active").when(n % 5 == 0, "completed")
    runs = fixtures.profiles(spark, sf_dir).filter(running.isNotNull()).select(
        "tenant_id", F.lit("j1").alias("journey_id"), "profile_id", F.lit(0).alias("enrollment_seq"), running.alias("status")
    )
    out = journeys.enroll(entries, _heads(spark, None, "signup", 2), runs, fixtures.profiles(spark, sf_dir), AT)
    return out.select("tenant_id", "profile_id", "enrollment_seq")


# --- governance and operations -------------------------------------------------------------------------------------


@_add(
    "mask_traits",
    with_sql(
        """SELECT tenant_id, profile_id, substr(email, 1, 1) || '***@example.com' AS email, substr(name, 1, 1) || '***' AS name, country FROM prof WHERE tenant_id = 'r1'"""
    ),
)
def _mask(spark, sf_dir):
    viewer = governance.Principal("VIEWER", "r1")
    rows = governance.visible_profiles(fixtures.profiles(spark, sf_dir), viewer)
    return rows.select("tenant_id", "profile_id", *(F.get_json_object("traits", f"$.{k}").alias(k) for k in ("email", "name", "country")))


@_add(
    "mask_identifiers",
    with_sql("SELECT DISTINCT tenant_id, namespace, CASE WHEN namespace = 'email' THEN 'u***@example.com' ELSE substr(value, 1, 1) || '***' END AS value FROM nodes", _ID),
)
def _mask_ids(spark, sf_dir):
    key = F.lit("0123456789abcdef")
    found = identity.nodes(identity.extract(envelopes(spark, sf_dir))).withColumn("value_encrypted", scalars.sealed(F.col("value"), key))
    return governance.inventory_values(found, key, permitted=False).select("tenant_id", "namespace", "value").distinct()


#: The number of permissions of each role, and whether it may read personal data.
_MATRIX = "('SUPER_ADMIN', 19, true), ('TENANT_ADMIN', 19, true), ('MARKETER', 13, false), ('ANALYST', 9, false), ('OPERATOR', 11, false), ('VIEWER', 9, false)"


@_add(
    "rbac_matrix",
    f"""SELECT role, permissions::BIGINT AS permissions, pii, count(c_custkey) AS users, count(c_custkey) * permissions::BIGINT AS grants
FROM (VALUES {_MATRIX}) t(role, permissions, pii) LEFT JOIN customer
  ON role = CASE c_custkey % 7 WHEN 0 THEN 'SUPER_ADMIN' WHEN 1 THEN 'TENANT_ADMIN' WHEN 2 THEN 'MARKETER' WHEN 3 THEN 'ANALYST' WHEN 4 THEN 'OPERATOR' ELSE 'VIEWER' END
GROUP BY role, permissions, pii""",
)
def _rbac(spark, sf_dir):
    """Customers as users with a role by their key: how many hold each role, and what they are granted together."""
    role = F.expr("CASE c_custkey % 7 WHEN 0 THEN 'SUPER_ADMIN' WHEN 1 THEN 'TENANT_ADMIN' WHEN 2 THEN 'MARKETER' WHEN 3 THEN 'ANALYST' WHEN 4 THEN 'OPERATOR' ELSE 'VIEWER' END")
    users = fixtures.table(spark, sf_dir, "customer").groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("users"))
    matrix = governance.role_matrix(spark).groupBy("role").agg(F.count(F.lit(1)).alias("permissions"), F.max(F.col("permission") == "pii:read").alias("pii"))
    users = F.broadcast(users)  # one row per role
    found = matrix.join(users, "role", "left").withColumn("users", F.coalesce("users", F.lit(0)))
    return found.withColumn("grants", F.col("users") * F.col("permissions"))


@_add(
    "consent_merge_denied_wins",
    with_sql(
        """SELECT tenant_id, 'p' || (n - n % 2) AS profile_id, channel, CASE WHEN bool_or(n % 7 = 0) THEN 'denied' ELSE 'granted' END AS status FROM (
  SELECT tenant_id, cast(substr(profile_id, 2) AS BIGINT) AS n, CASE WHEN cast(substr(profile_id, 2) AS BIGINT) % 2 = 0 THEN 'email' ELSE 'sms' END AS channel FROM prof)
  WHERE n % 7 < 2 GROUP BY ALL"""
    ),
)
def _merge_consent(spark, sf_dir):
    rows = consent(spark, sf_dir)
    n = F.substring("profile_id", 2, 20).cast("long")
    survivors = fixtures.profiles(spark, sf_dir).filter(n % 2 == 1).select("tenant_id", "profile_id", F.concat(F.lit("p"), n - 1).alias("survivor_id"))
    return governance.merge_consent(rows, survivors).select("tenant_id", "profile_id", "channel", "status")


@_add("consent_status", with_sql("SELECT tenant_id, profile_id, CASE WHEN n % 7 < 2 AND n % 2 = 0 THEN CASE WHEN n % 7 = 0 THEN 'denied' ELSE 'granted' END ELSE 'unknown' END AS consent FROM (SELECT *, cast(substr(profile_id, 2) AS BIGINT) AS n FROM prof)"))
def _consent_status(spark, sf_dir):
    people = fixtures.profiles(spark, sf_dir).select("tenant_id", "profile_id")
    return activation.consent_status(people, consent(spark, sf_dir), F.lit("email"), F.lit("marketing"))


_ERASED = "cast(substr(profile_id, 2) AS BIGINT) % 10 = 3"


@_add(
    "erase_anti",
    with_sql(
        f"""SELECT 'log' AS part, tenant_id, count(*) AS kept FROM log WHERE NOT {_ERASED} GROUP BY ALL
  UNION ALL SELECT 'profiles', tenant_id, count(*) FROM prof WHERE NOT {_ERASED} GROUP BY ALL
  UNION ALL SELECT 'memberships', tenant_id, count(*) FROM a WHERE NOT {_ERASED} GROUP BY ALL
  UNION ALL SELECT 'consent', tenant_id, count(*) FROM prof WHERE cast(substr(profile_id, 2) AS BIGINT) % 7 < 2 AND NOT {_ERASED} GROUP BY ALL""",
        _BOTH,
    ),
)
def _erase(spark, sf_dir):
    log = fixtures.behavior_log(spark, sf_dir)
    erased = fixtures.profiles(spark, sf_dir).filter(F.expr("cast(substr(profile_id, 2) as bigint) % 10 = 3")).select("tenant_id", "profile_id")
    members = verdicts_at(spark, sf_dir, AT).filter("matched")
    tables = {"log": log, "profiles": fixtures.profiles(spark, sf_dir), "memberships": members, "consent": consent(spark, sf_dir)}
    kept, _ = governance.erase(tables, erased)
    parts = [df.select(F.lit(name).alias("part"), "tenant_id") for name, df in kept.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("part", "tenant_id").agg(F.count(F.lit(1)).alias("kept"))


@_add(
    "erase_counts",
    with_sql(f"SELECT 'log' AS \"table\", count(*) AS erased FROM log WHERE {_ERASED} UNION ALL SELECT 'profiles', count(*) FROM prof WHERE {_ERASED}"),
)
def _erase_counts(spark, sf_dir):
    people = fixtures.profiles(spark, sf_dir)
    erased = people.filter(F.expr("cast(substr(profile_id, 2) as bigint) % 10 = 3")).select("tenant_id", "profile_id")
    return governance.erase({"log": fixtures.behavior_log(spark, sf_dir), "profiles": people}, erased)[1]


@_add(
    "export_bundle",
    with_sql(
        """SELECT p.tenant_id, p.profile_id, canonical_user_id, coalesce(events, '') AS identifiers, coalesce(m.status, '') AS memberships, coalesce(c.given, '') AS consent FROM prof p
  LEFT JOIN (SELECT tenant_id, profile_id, string_agg(event_id, ',' ORDER BY event_id) AS events FROM log GROUP BY ALL) l USING (tenant_id, profile_id)
  LEFT JOIN (SELECT tenant_id, profile_id, 'viewers:' || CASE WHEN z.profile_id IS NULL THEN 'exited' ELSE 'active' END AS status FROM a FULL JOIN z USING (tenant_id, profile_id)) m USING (tenant_id, profile_id)
  LEFT JOIN (SELECT profile_id, CASE WHEN n % 2 = 0 THEN 'email' ELSE 'sms' END || ':marketing:' || CASE WHEN n % 7 = 0 THEN 'denied' ELSE 'granted' END AS given
             FROM (SELECT profile_id, cast(substr(profile_id, 2) AS BIGINT) AS n FROM prof) WHERE n % 7 < 2) c USING (profile_id)""",
        _BOTH,
    ),
)
def _export(spark, sf_dir):
    people = fixtures.profiles(spark, sf_dir)
    log = fixtures.behavior_log(spark, sf_dir)
    ids = log.select("tenant_id", "profile_id", F.lit("event").alias("namespace"), F.col("event_id").alias("value"))
    member = membership.state_of(_advanced(spark, sf_dir))
    out = governance.export_bundle(people, ids, member, consent(spark, sf_dir), people.select("tenant_id", "profile_id"))

    def texts(c: str, *fields: str):
        return F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", *(x[f] for f in fields))), ","), F.lit("")).alias(c)

    return out.select(
        "tenant_id", "profile_id", "canonical_user_id", texts("identifiers", "value"), texts("memberships", "segment_id", "status"),
        texts("consent", "channel", "purpose", "status"),
    )


@_add(
    "stats_counts",
    with_sql("SELECT tenant_id, (SELECT count(*) FROM prof p WHERE p.tenant_id = t.tenant_id) AS profiles, (SELECT count(*) FROM log l WHERE l.tenant_id = t.tenant_id) AS events FROM (SELECT DISTINCT tenant_id FROM prof) t"),
)
def _stats(spark, sf_dir):
    return ops.tenant_counts({"profiles": fixtures.profiles(spark, sf_dir), "events": fixtures.behavior_log(spark, sf_dir)})


@_add(
    "stats_tenant",
    with_sql(
        f"""SELECT tenant_id, (SELECT count(*) FROM log l WHERE l.tenant_id = t.tenant_id AND cast(substr(event_id, 2) AS BIGINT) % 5 = 1) AS dlq_open,
  (SELECT count(*) FROM supplier s JOIN nation ON s_nationkey = n_nationkey WHERE 'r' || n_regionkey = t.tenant_id) AS sources,
  -1::BIGINT AS destinations, (SELECT count(*) FROM prof p WHERE p.tenant_id = t.tenant_id) AS profiles,
  (SELECT count(*) FROM nation WHERE 'r' || n_regionkey = t.tenant_id) AS segments FROM (SELECT 'r' || r_regionkey AS tenant_id FROM region) t"""
    ),
)
def _tenant_stats(spark, sf_dir):
    """The five counts of every tenant: dead letters of which some are open, suppliers as sources, no table of destinations, nations as segments."""
    tenants = fixtures.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("tenant_id"))
    n = F.substring("event_id", 2, 20).cast("long")
    dead = fixtures.behavior_log(spark, sf_dir).filter(n % 5 < 2).withColumn("status", F.when(n % 5 == 1, "open").otherwise("resolved"))
    nation = fixtures.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("tenant_id"))
    sources = fixtures.table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    return ops.tenant_stats(tenants, dead, sources=sources, destinations=None, profiles=fixtures.profiles(spark, sf_dir), segments=nation)


_CATALOG = """
seg AS (SELECT 'r' || n_regionkey AS tenant_id, 's' || n_nationkey AS segment_id, n_nationkey AS n, CASE WHEN n_nationkey % 4 = 0 THEN 'inactive' ELSE 'active' END AS status,
  n_nationkey % 3 + 1 AS current_version, TIMESTAMP '2024-01-01' + to_hours(n_nationkey) AS updated_at FROM nation),
ver AS (SELECT tenant_id, segment_id, n, unnest(range(1, current_version + 1 + n % 2)) AS version FROM seg)"""


def _segment_catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A segment per nation with one to four versions; every other one has a version beyond its current one."""
    n = F.col("n_nationkey")
    segments = fixtures.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("r"), "n_regionkey").alias("tenant_id"), F.concat(F.lit("s"), n).alias("segment_id"), n.alias("n"),
        F.when(n % 4 == 0, "inactive").otherwise("active").alias("status"), (n % 3 + 1).alias("current_version"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp") + F.make_dt_interval(hours=n)).alias("updated_at"),
    )
    numbers = F.explode(F.sequence(F.lit(1), F.col("current_version") + F.col("n") % 2)).alias("version")
    versions = segments.select("tenant_id", "segment_id", "n", numbers)
    rule = F.concat(F.lit('{"v":'), "version", F.lit(',"n":'), "n", F.lit("}"))
    return segments, versions.withColumn("rule_json", rule)


@_add(
    "retention_horizon",
    f"""WITH {_CATALOG} SELECT greatest(40, ceil(max(s) / 86400.0)::BIGINT + 8) AS days FROM (
  SELECT n * 86400 + 1 AS s FROM seg WHERE status = 'active'
  UNION ALL SELECT s_suppkey * 43200 FROM supplier WHERE s_suppkey % 3 = 0 OR (s_suppkey % 3 = 1 AND s_suppkey % 5 = 0))""",
)
def _horizon(spark, sf_dir):
    """Segments of nations; journeys of suppliers, a third of them active and some of the others with an active run."""
    segments = _segment_catalog(spark, sf_dir)[0].withColumn("max_window_seconds", F.col("n").cast("long") * 86400 + 1)
    key = F.col("s_suppkey")
    suppliers = fixtures.table(spark, sf_dir, "supplier")
    status = F.when(key % 3 == 0, "active").otherwise("inactive").alias("status")
    versions = suppliers.select(key.cast("string").alias("journey_id"), F.lit(1).alias("version"), status, (key * 43200).cast("long").alias("max_window_seconds"))
    state = F.when((key % 3 == 1) & (key % 5 == 0), "active").otherwise("completed").alias("status")
    runs = suppliers.select(key.cast("string").alias("journey_id"), F.lit(1).alias("journey_version"), state)
    return ops.horizon_days(segments, versions, runs)


@_add("retention_prune", with_sql(f"SELECT tenant_id, strftime(date_trunc('week', occurred_at), '%Y-%m-%d') AS week, count(*) AS n FROM log WHERE occurred_at >= {LATER_SQL} - INTERVAL 10 DAY GROUP BY ALL"))
def _prune(spark, sf_dir):
    log = ops.retained(ops.with_week(fixtures.behavior_log(spark, sf_dir)), LATER, 10)
    return log.groupBy("tenant_id", F.col("week").cast("string").alias("week")).agg(F.count(F.lit(1)).alias("n"))


@_add(
    "ops_metrics",
    f"""WITH {_ENV} SELECT 'events_accepted' AS metric, count(*) FILTER (verdict = 'accepted') AS value FROM verdict
UNION ALL SELECT 'events_rejected', count(*) FILTER (verdict IN ('rejected', 'conflict')) FROM verdict""",
)
def _metrics(spark, sf_dir):
    rows = ingest.verdicts(_envelopes(spark, sf_dir))
    return metrics.counters({"events_accepted": (rows, "verdict = 'accepted'"), "events_rejected": (rows, "verdict in ('rejected', 'conflict')")})


@_add(
    "ops_lag_histogram",
    f"""WITH {_ENV}, d AS (SELECT epoch_us(received_at) - epoch_us(ts) AS us FROM env)
SELECT b AS upper_bound, (SELECT count(*) FROM d WHERE us / 1e6 <= b) AS count
FROM (SELECT unnest([0.05, 0.15000000000000002, 0.45, 1.35, 'Infinity'::DOUBLE]) AS b)""",
)
def _lag(spark, sf_dir):
    return metrics.lag_histogram(_envelopes(spark, sf_dir), "timestamp", "received_at", 0.05, 3, 4)


@_add("rate_limit")
def _rate(spark, sf_dir):
    rows = _raw(spark, sf_dir).select(F.col("tenant_id").alias("source_id"), F.col("arrival").alias("seq"), "received_at")
    out = metrics.rate_limited(rows, rate=1 / 1800, burst=3)
    return out.groupBy("source_id", "allowed").agg(F.count(F.lit(1)).alias("n"))


@_add(
    "dlq_list",
    f"""WITH {_RAW_SQL} SELECT dlq_id, status FROM (SELECT 'q' || lpad(cast(arrival AS VARCHAR), 9, '0') AS dlq_id, received_at,
  CASE WHEN arrival IN (19, 38) THEN 'discarded' ELSE 'open' END AS status FROM raw
  WHERE tenant_id = 'r1' AND (raw = '' OR NOT json_valid(raw))) WHERE status = 'open' ORDER BY received_at DESC, dlq_id DESC LIMIT 100""",
)
def _dlq_list(spark, sf_dir):
    dead = ingest.split_dead_letters(_raw(spark, sf_dir))[1].withColumns(
        {"dlq_id": F.expr("'q' || lpad(arrival, 9, '0')"), "failed_at": F.col("received_at")}
    )
    marked = ops.dlq_mark(dead, ["q000000019", "q000000038"], "discarded")
    return ops.dlq_list(marked, "r1", "open").select("dlq_id", "status")


@_add("parked_list", with_sql("SELECT segment_id, attempts FROM pend WHERE tenant_id = 'r2' AND parked_at IS NOT NULL ORDER BY parked_at DESC, segment_id, profile_id LIMIT 100", _PENDING))
def _parked(spark, sf_dir):
    return ops.parked_list(_pending(spark, sf_dir), "r2").select("segment_id", "attempts")


@_add(
    "delivery_list",
    with_sql(
        """SELECT idempotency_key, status, attempt_count FROM (SELECT event_id AS idempotency_key, occurred_at, cast(n % 6 + 1 AS INT) AS attempt_count,
  CASE WHEN n % 8 IN (0, 5) THEN 'success' ELSE 'failed' END AS status FROM (SELECT *, cast(substr(event_id, 2) AS BIGINT) AS n FROM log) WHERE tenant_id = 'r1')
  ORDER BY occurred_at DESC, idempotency_key LIMIT 200"""
    ),
)
def _deliveries(spark, sf_dir):
    rows = _sends(spark, sf_dir).select("*", F.col("destination_id").alias("tenant_id"), F.lit("p").alias("profile_id"), F.lit("s").alias("source_event_id"), F.col("task_id").alias("idempotency_key"))
    return activation.deliveries(activation.delivery_log(rows), "r1").select("idempotency_key", "status", "attempt_count")


@_add(
    "subscription_view",
    """SELECT 'r' || n_regionkey AS tenant_id, 'x' || s_suppkey AS subscription_id, CASE WHEN n_nationkey % 3 = 0 THEN 'disabled' ELSE 'active' END AS destination_status
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _subscriptions(spark, sf_dir):
    """A destination per nation, a subscription per supplier."""
    nation = fixtures.table(spark, sf_dir, "nation")
    tenant, home = F.concat(F.lit("r"), "n_regionkey").alias("tenant_id"), F.concat(F.lit("d"), "n_nationkey").alias("destination_id")
    status = F.when(F.col("n_nationkey") % 3 == 0, "disabled").otherwise("active").alias("status")
    dests = nation.select(tenant, home, F.lit("webhook").alias("type"), status, F.lit("{}").alias("config"), F.col("n_name").alias("name"))
    rows = fixtures.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    subs = rows.select(tenant, F.concat(F.lit("x"), "s_suppkey").alias("subscription_id"), home, F.lit("viewers").alias("segment_id"), F.lit("active").alias("status"))
    return activation.subscription_view(subs, dests).select("tenant_id", "subscription_id", "destination_status")


@_add(
    "segment_current_versions",
    f"""WITH {_CATALOG} SELECT tenant_id, segment_id, current_version, '{{"v":' || current_version || ',"n":' || n || '}}' AS rule_json FROM seg WHERE status = 'active'""",
)
def _current(spark, sf_dir):
    segments, versions = _segment_catalog(spark, sf_dir)
    return membership.current_versions(segments, versions.drop("n")).select("tenant_id", "segment_id", "current_version", "rule_json")


@_add("segment_next_version", f"WITH {_CATALOG} SELECT tenant_id, segment_id, (max(version) + 1)::INTEGER AS version FROM ver GROUP BY ALL")
def _next(spark, sf_dir):
    return membership.next_version(_segment_catalog(spark, sf_dir)[1])


@_add("segment_epoch", f"WITH {_CATALOG} SELECT count(*) AS segments, max(updated_at) AS updated_at, sum(current_version)::BIGINT AS versions FROM seg WHERE status = 'active'")
def _epoch(spark, sf_dir):
    return ntz(membership.rules_epoch(_segment_catalog(spark, sf_dir)[0]))


@_add(
    "consent_upsert",
    with_sql(
        """SELECT tenant_id, profile_id, CASE WHEN n % 4 = 0 THEN 'withdrawn' WHEN n % 7 = 0 THEN 'denied' ELSE 'granted' END AS status
  FROM (SELECT *, cast(substr(profile_id, 2) AS BIGINT) AS n FROM prof) WHERE n % 7 < 2"""
    ),
)
def _upsert(spark, sf_dir):
    old = consent(spark, sf_dir)
    n = F.substring("profile_id", 2, 20).cast("long")
    new = old.filter(n % 4 == 0).withColumn("status", F.lit("withdrawn"))
    late = old.filter(n % 4 == 1).withColumns({"status": F.lit("late"), "updated_at": F.col("updated_at") - F.expr("interval 1 day")})
    return governance.set_consent(old, new.unionByName(late)).select("tenant_id", "profile_id", "status")


@_add(
    "ingest_payload",
    f"WITH {_ENV} SELECT arrival, event_name, nullif(user_id, '') AS user_id, 'https://x/' || (arrival % 1000000000 % 9) AS url FROM env WHERE error IS NULL",
)
def _payload(spark, sf_dir):
    rows = _envelopes(spark, sf_dir).filter("error is null").withColumn("p", ingest.payload())

    def at(path: str, name: str):
        return F.get_json_object("p", path).alias(name)

    return rows.select("arrival", at("$.event_name", "event_name"), at("$.identifiers.user_id", "user_id"), at("$.context.page.url", "url"))


def _survivors(spark, sf_dir):
    n = F.substring("profile_id", 2, 20).cast("long")
    people = fixtures.profiles(spark, sf_dir).filter(n % 2 == 1)
    return people.select("tenant_id", "profile_id", F.concat(F.lit("p"), n - 1).alias("survivor_id"))


@_add(
    "reparent_memberships",
    with_sql(
        """SELECT tenant_id, profile_id, arg_min(n, n) AS owner FROM (SELECT tenant_id, n, 'p' || (n - n % 2) AS profile_id FROM (
  SELECT tenant_id, cast(substr(profile_id, 2) AS BIGINT) AS n FROM a)) GROUP BY ALL""",
        f"a AS {_viewers(AT_SQL)}",
    ),
)
def _reparent(spark, sf_dir):
    rows = verdicts_at(spark, sf_dir, AT).filter("matched").withColumn("owner", F.substring("profile_id", 2, 20).cast("long"))
    return membership.rekeyed(rows, _survivors(spark, sf_dir), membership.KEYS).select("tenant_id", "profile_id", "owner")


@_add(
    "reparent_events",
    with_sql("SELECT tenant_id, 'p' || (n - n % 2) AS profile_id, event_id FROM (SELECT *, cast(substr(profile_id, 2) AS BIGINT) AS n FROM log)"),
)
def _reparent_events(spark, sf_dir):
    log = fixtures.behavior_log(spark, sf_dir)
    moved = membership.reparented({"events": (log, ["tenant_id", "profile_id", "event_id"])}, _survivors(spark, sf_dir))
    return moved["events"].select("tenant_id", "profile_id", "event_id")


@_add(
    "reparent_buckets",
    with_sql(
        """SELECT tenant_id, 'p' || (n - n % 2) AS profile_id, event_name, date_trunc('hour', occurred_at)::TIMESTAMP AS bucket_start, count(*) AS count,
  min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM (SELECT *, cast(substr(profile_id, 2) AS BIGINT) AS n FROM log) GROUP BY ALL"""
    ),
)
def _reparent_buckets(spark, sf_dir):
    buckets = behavior.hourly_buckets(fixtures.behavior_log(spark, sf_dir))
    return ntz(behavior.reparented_buckets(buckets, _survivors(spark, sf_dir)))


@_add(
    "reparent_enrollments",
    with_sql(
        """SELECT tenant_id, journey_id, profile_id, arg_min(n, (n % 2, n)) AS owner FROM (
  SELECT tenant_id, 'j' || (n // 2 % 3) AS journey_id, 'p' || (n - n % 2) AS profile_id, n FROM (SELECT *, cast(substr(profile_id, 2) AS BIGINT) AS n FROM prof)) GROUP BY ALL"""
    ),
)
def _reparent_enrollments(spark, sf_dir):
    """An enrolment per profile; where survivor and loser are in one journey, the survivor's own stays."""
    n = F.substring("profile_id", 2, 20).cast("long")
    rows = fixtures.profiles(spark, sf_dir).select("tenant_id", "profile_id", F.concat(F.lit("j"), F.floor(n / 2) % 3).alias("journey_id"), n.alias("owner"))
    keys = ["tenant_id", "journey_id", "profile_id"]
    return membership.reparented({"enrollments": (rows, keys)}, _survivors(spark, sf_dir))["enrollments"].select(*keys, "owner")


@_add("segment_deactivate", with_sql("SELECT tenant_id, count(*) AS pending FROM pend WHERE tenant_id <> 'r0' GROUP BY ALL", _PENDING))
def _deactivate(spark, sf_dir):
    pending = _pending(spark, sf_dir).withColumn("segment_id", F.lit("s1"))
    segments = spark.createDataFrame([(t, "s1", "inactive" if t == "r0" else "active") for t in _TENANTS], "tenant_id string, segment_id string, status string")
    return membership.deactivated(pending, segments).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("pending"))


@_add("due_earliest", with_sql("SELECT tenant_id, profile_id, min(due_at) AS due_at FROM pend GROUP BY ALL", _PENDING))
def _earliest(spark, sf_dir):
    rows = _pending(spark, sf_dir).withColumn("segment_id", F.lit("s1"))
    odd = F.col("attempts") % 2 == 1
    return ntz(deadlines.earliest(rows.filter(odd), rows.filter(~odd)).select("tenant_id", "profile_id", "due_at"))


@_add("sweep_eligible", with_sql("SELECT tenant_id, count(*) AS n FROM pend WHERE tenant_id <> 'r0' AND attempts % 3 = 0 AND cast(substr(profile_id, 2) AS BIGINT) % 2 = 0 GROUP BY ALL", _PENDING))
def _eligible(spark, sf_dir):
    rules = {"s0": parse(_VIEWERS), "s1": parse({"field": "event.type", "op": "exists"})}
    name = F.when(F.col("attempts") % 3 == 0, "s0").when(F.col("attempts") % 3 == 1, "s1").otherwise("s2")
    segments = spark.createDataFrame([(t, s, "inactive" if t == "r0" else "active") for t in _TENANTS for s in rules], "tenant_id string, segment_id string, status string")
    people = fixtures.profiles(spark, sf_dir).filter(F.substring("profile_id", 2, 20).cast("long") % 2 == 0)
    out = deadlines.sweepable(_pending(spark, sf_dir).withColumn("segment_id", name), segments, rules, people)
    return out.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


@_add("due_coalesced", with_sql("SELECT segment_id, CASE WHEN parked_at IS NULL AND attempts % 2 = 0 THEN due_at ELSE due_at + to_seconds(CASE WHEN attempts % 2 = 0 THEN 50 ELSE 70 END) END AS due_at FROM pend", _PENDING))
def _coalesced(spark, sf_dir):
    stored = _pending(spark, sf_dir)
    planned = stored.withColumn("due_at", F.timestamp_micros(F.unix_micros("due_at") + F.when(F.col("attempts") % 2 == 0, 50_000_000).otherwise(70_000_000)))
    return ntz(deadlines.coalesced(stored, planned).select("segment_id", "due_at"))


@_add(
    "consent_list",
    with_sql(
        """SELECT CASE WHEN n % 2 = 0 THEN 'email' ELSE 'sms' END AS channel, 'marketing' AS purpose, CASE WHEN n % 7 = 0 THEN 'denied' ELSE 'granted' END AS status
  FROM (SELECT cast(substr(profile_id, 2) AS BIGINT) AS n FROM prof WHERE profile_id = 'p14') WHERE n % 7 < 2"""
    ),
)
def _consent_list(spark, sf_dir):
    rows = consent(spark, sf_dir)
    home = fixtures.profiles(spark, sf_dir).filter("profile_id = 'p14'").first().tenant_id
    return governance.consent_list(rows, home, "p14")
