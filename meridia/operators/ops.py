"""Operations: pages, replay, dead letters, counts, audit and retention."""

from __future__ import annotations

import base64
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import micros, moment

DAY = 86_400_000_000
#: Page sizes, replay cap and retention.
PAGE_LIMIT, PAGE_MAX = 50, 500
REPLAY_MAX = 1000
RETENTION_DAYS, RETENTION_MARGIN_DAYS = 40, 8


def encode_cursor(at: dt.datetime, row_id: str) -> str:
    text = f"{micros(at) * 1000}|{row_id}"
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[int, str]:
    """(microseconds, id)."""
    try:
        text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
        nanos, _, row_id = text.partition("|")
        return int(nanos) // 1000, row_id
    except ValueError as error:
        raise ValueError(f"invalid cursor {cursor!r}") from error


def keyset_page(rows: DataFrame, time: str, row_id: str, limit: int = PAGE_LIMIT, after: str | None = None) -> DataFrame:
    """The newest rows after a cursor, with one extra row that tells whether there is a next page."""
    limit = min(max(1, limit), PAGE_MAX)
    if after:
        us, last = decode_cursor(after)
        t = F.unix_micros(time)
        rows = rows.filter((t < us) | ((t == us) & (F.col(row_id) < last)))
    return rows.orderBy(F.col(time).desc(), F.col(row_id).desc()).limit(limit + 1)


def raw_event_page(raw: DataFrame, tenant: str, identifier_key: str | None = None, event_name: str | None = None, limit: int = PAGE_LIMIT, after: str | None = None) -> DataFrame:
    rows = raw.filter(F.col("tenant_id") == tenant)
    if identifier_key:
        rows = rows.filter(F.col("identifier_key") == identifier_key)
    if event_name:
        rows = rows.filter(F.col("event_name") == event_name)
    return keyset_page(rows, "received_at", "event_id", limit, after)


def raw_event(raw: DataFrame, tenant: str, event_id: str) -> DataFrame:
    return raw.filter((F.col("tenant_id") == tenant) & (F.col("event_id") == event_id))


def replay(raw: DataFrame, tenant: str, identifier_key: str) -> DataFrame:
    """Stored payloads to feed in again, newest first; one row over the cap tells that more were left out."""
    mine = raw.filter((F.col("tenant_id") == tenant) & (F.col("identifier_key") == identifier_key))
    return mine.orderBy(F.col("received_at").desc(), F.col("event_id").desc()).limit(REPLAY_MAX + 1)


def audit_page(audit: DataFrame, tenant: str, limit: int = PAGE_LIMIT, after: str | None = None) -> DataFrame:
    """Who did what when; bodies stay unread."""
    rows = audit.filter(F.col("tenant_id") == tenant).select("audit_id", "actor", "action", "resource", "created_at")
    return keyset_page(rows, "created_at", "audit_id", limit, after)


def dlq_list(dlq: DataFrame, tenant: str, status: str | None = None, limit: int = 100) -> DataFrame:
    rows = dlq.filter(F.col("tenant_id") == tenant)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.col("failed_at").desc(), F.col("dlq_id").desc()).limit(min(limit, PAGE_MAX))


def dlq_mark(dlq: DataFrame, ids: list[str], status: str) -> DataFrame:
    return dlq.withColumn("status", F.when(F.col("dlq_id").isin(ids), status).otherwise(F.col("status")))


def tenant_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts per tenant, one column per table, from one grouped union."""
    parts = None
    for name, df in tables.items():
        rows = df.select("tenant_id", F.lit(name).alias("_table"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("tenant_id").agg(*(F.count_if(F.col("_table") == n).alias(n) for n in tables))


def tenant_stats(tenants: DataFrame, dead_letters: DataFrame, **tables: DataFrame | None) -> DataFrame:
    """Per tenant dlq_open and a count per table (sources, destinations, profiles, segments, ...), 0 without rows and -1 for a table that is not there."""
    there = {"dlq_open": dead_letters.filter("status = 'open'")} | {n: df for n, df in tables.items() if df is not None}
    counts = tenants.select("tenant_id").join(tenant_counts(there), "tenant_id", "left")
    columns = {n: F.coalesce(n, F.lit(0)) if n in there else F.lit(-1).cast("long") for n in ("dlq_open", *tables)}
    return counts.select("tenant_id", *(c.alias(n) for n, c in columns.items()))


def backlog(pending: DataFrame, at: dt.datetime) -> DataFrame:
    due = F.col("due_at") <= moment(at)
    return pending.agg(
        F.count_if(due & F.col("parked_at").isNull()).alias("due"),
        F.count_if(F.col("parked_at").isNotNull()).alias("parked"),
        F.min(F.when(F.col("parked_at").isNull(), F.col("due_at"))).alias("oldest_due"),
    )


def horizon_days(segment_versions: DataFrame, journey_versions: DataFrame, enrollments: DataFrame) -> DataFrame:
    """How many days of log are needed: the default, or the longest live window and a margin.

    Live are active segments' versions, and versions of journeys that are active
    or that an active enrolment is pinned to.
    """
    live = segment_versions.filter("status = 'active'").select("max_window_seconds")
    pinned = enrollments.filter("status = 'active'").select("journey_id", F.col("journey_version").alias("version")).distinct()
    used = journey_versions.filter("status = 'active'").select("journey_id", "version", "max_window_seconds")
    used = used.unionByName(
        journey_versions.filter("status <> 'active'").join(pinned, ["journey_id", "version"], "left_semi").select("journey_id", "version", "max_window_seconds")
    )
    longest = live.unionByName(used.select("max_window_seconds")).agg(F.coalesce(F.max("max_window_seconds"), F.lit(0)).alias("s"))
    days = F.ceil(F.col("s") / 86_400).cast("long")
    needed = F.when(F.col("s") > 0, days + RETENTION_MARGIN_DAYS).otherwise(0)
    return longest.select(F.greatest(F.lit(RETENTION_DAYS).cast("long"), needed).alias("days"))


def retained(log: DataFrame, at: dt.datetime, days: int) -> DataFrame:
    """The log rows to keep; with a ``week`` partition column, whole weeks before the cutoff are pruned unread."""
    cutoff = moment(at, -days * DAY)
    if "week" in log.columns:
        log = log.filter(F.col("week") >= F.date_trunc("week", cutoff).cast("date"))
    return log.filter(F.col("occurred_at") >= cutoff)


def with_week(log: DataFrame) -> DataFrame:
    """The Monday of each row's week, to partition the stored log by."""
    return log.withColumn("week", F.date_trunc("week", "occurred_at").cast("date"))


def audit_rows(requests: DataFrame) -> DataFrame:
    """Audit rows of (tenant_id, actor, action, resource, created_at, body); ids follow from the content."""
    key = F.sha2(F.concat_ws("|", "tenant_id", "actor", "action", "resource", F.col("created_at").cast("string")), 256)
    return requests.select("tenant_id", F.substring(key, 1, 32).alias("audit_id"), "actor", "action", "resource", "created_at", "body")


def parked_list(pending: DataFrame, tenant: str, limit: int = 100) -> DataFrame:
    """Parked work of a tenant, latest first."""
    rows = pending.filter((F.col("tenant_id") == tenant) & F.col("parked_at").isNotNull())
    return rows.orderBy(F.col("parked_at").desc(), "segment_id", "profile_id").limit(limit)


def newest(rows: DataFrame, tenant: str, order: str, row_id: str, limit: int) -> DataFrame:
    """A tenant's newest rows: the shape of all catalog lists."""
    return rows.filter(F.col("tenant_id") == tenant).orderBy(F.col(order).desc(), F.col(row_id)).limit(limit)


def dlq_retry(dlq: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(payloads of open dead letters to feed in again, the dead letters with those marked as retried)."""
    again = dlq.filter(F.col("dlq_id").isin(ids) & (F.col("status") == "open"))
    status = F.when(F.col("dlq_id").isin(ids) & (F.col("status") == "open"), "retried").otherwise(F.col("status"))
    return again, dlq.withColumn("status", status)
