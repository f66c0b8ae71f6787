"""The behavioural log: recording, hourly rollup and direct queries on it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, values
from ..plans.compiler import KEYS, in_window, micros, moment
from ..plans.rules import parse_window


def record(events: DataFrame, consent: DataFrame) -> DataFrame:
    """Log rows of named track events, one per (tenant, profile, event_id).

    An event happened when its client says, but not after it arrived.  Properties
    are dropped where the profile denies analytics on any channel; the event
    still counts.
    """
    denied = (
        consent.filter("purpose = 'analytics' and status = 'denied'").select(*KEYS).distinct().withColumn("_denied", F.lit(True))
    )
    rows = (
        events.filter("type = 'track' and coalesce(event_name, '') <> ''")
        .withColumn("occurred_at", F.least("timestamp", "received_at"))
        .dropDuplicates([*KEYS, "event_id"])
    )
    rows = rows.join(denied, list(KEYS), "left")
    return rows.select(
        *KEYS,
        "event_id",
        "event_name",
        "occurred_at",
        F.when(F.col("_denied"), None).otherwise(F.col("props")).alias("props"),
        shape_fingerprint(F.col("props")).alias("schema_version"),
    )


def shape_fingerprint(props: Column) -> Column:
    """A hash of the sorted keys and JSON types of an object; 1 for anything else."""
    keys = F.array_sort(F.json_object_keys(props))
    kinds = F.try_variant_get(F.try_parse_json(props), "$", "map<string,variant>")

    def text(row: Column) -> Column:
        shapes = row["kinds"]
        parts = F.transform(
            row["keys"], lambda k: F.concat(k, F.lit(":"), values.json_kind(F.try_element_at(shapes, k)), F.lit(";"))
        )
        return F.array_join(parts, "")

    made = scalars.fnv1a_31(scalars.let(F.struct(keys.alias("keys"), kinds.alias("kinds")), text))
    return F.when(F.coalesce(F.size(keys), F.lit(0)) < 1, 1).otherwise(F.greatest(made, F.lit(1))).cast("int")


def hourly_buckets(log: DataFrame) -> DataFrame:
    """Count, first and last per profile, event name and hour; partial aggregates before the one shuffle."""
    return log.groupBy(*KEYS, "event_name", F.date_trunc("hour", "occurred_at").alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("count"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")
    )


def merge_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add a batch's buckets to stored ones."""
    return (
        old.unionByName(new)
        .groupBy(*KEYS, "event_name", "bucket_start")
        .agg(F.sum("count").alias("count"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    )


def reparented_buckets(buckets: DataFrame, survivors: DataFrame) -> DataFrame:
    """The buckets of merged profiles added to their survivors'; ``survivors`` has tenant_id, profile_id, survivor_id."""
    moved = buckets.join(survivors, ["tenant_id", "profile_id"], "left")
    moved = moved.withColumn("profile_id", F.coalesce("survivor_id", "profile_id")).drop("survivor_id")
    return merge_buckets(moved.limit(0), moved)


def bucket_counts(buckets: DataFrame, log: DataFrame, event: str, window: str, at: dt.datetime) -> DataFrame:
    """The exact windowed count from whole hours of the rollup and the two boundary hours of the log."""
    hour = 3_600_000_000
    end, start = micros(at), micros(at) - parse_window(window)
    first_whole, last_whole = -(-start // hour) * hour, end // hour * hour
    named = F.col("event_name") == event
    ts = F.col("occurred_at")

    def us(x: int) -> Column:
        return F.timestamp_micros(F.lit(x))

    if first_whole >= last_whole:  # no whole hour
        rest = log.filter(named & ts.between(us(start), us(end)))
        return rest.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    inner = buckets.filter(named & (F.col("bucket_start") >= us(first_whole)) & (F.col("bucket_start") < us(last_whole)))
    head = named & (ts >= us(start)) & (ts < us(first_whole))
    tail = named & (ts >= us(last_whole)) & (ts <= us(end))
    parts = inner.select(*KEYS, F.col("count").alias("n")).unionByName(log.filter(head | tail).select(*KEYS, F.lit(1).cast("long").alias("n")))
    return parts.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def last_at(log: DataFrame, event: str, at: dt.datetime) -> DataFrame:
    rows = log.filter((F.col("event_name") == event) & (F.col("occurred_at") <= moment(at)))
    return rows.groupBy(*KEYS).agg(F.max("occurred_at").alias("last_at"))


def nth_newest(log: DataFrame, event: str, window: str, n: int, at: dt.datetime) -> DataFrame:
    """The n-th newest occurrence in the window.  The rank limit is pushed below the shuffle."""
    newest = Window.partitionBy(*KEYS).orderBy(F.col("occurred_at").desc(), F.col("event_id").desc())
    rows = log.filter((F.col("event_name") == event) & in_window(F.col("occurred_at"), window, at))
    ranked = rows.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n)
    return ranked.filter(F.col("_rn") == n).select(*KEYS, F.col("occurred_at").alias("nth_at"))


def matched_rules(verdicts: DataFrame, names: list[str]) -> DataFrame:
    """(tenant, profile, segment) for every true verdict column."""
    hits = F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return verdicts.select(*KEYS, F.explode(hits).alias("segment"))
