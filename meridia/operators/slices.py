"""Hourly slices of the behavioural log: mergeable counts with the exact times of an hour.

A slice holds how often an event occurred on a profile in an hour, when first and last,
and the sorted times.  Slices of any parts of a log merge, so a stream keeps them as
state; a window is its whole slices plus the exact times of the slices across its bounds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import KEYS, leaves, moment, sliceable
from ..plans.rules import Rule, parse_window
from . import deadlines

SLICES = (
    "tenant_id string, profile_id string, event_name string, hour timestamp, count long, first_at timestamp, "
    "last_at timestamp, times array<timestamp>"
)
_GROUP = (*KEYS, "event_name", "hour")


def needs(rules: list[Rule]) -> tuple[set[str], int]:
    """(event names, longest window in microseconds) that slices must cover to serve the rules and their deadlines."""
    names, span, _ = deadlines.depth(rules)
    mine = [b for b in leaves(rules) if sliceable(b)]
    return names | {b.event_name for b in mine}, max([span, *(parse_window(b.window) for b in mine if b.window)])


def sliced(log: DataFrame, names: set[str]) -> DataFrame:
    """The slices of a log's events of these names."""
    rows = log.filter(F.col("event_name").isin(sorted(names)))
    return rows.groupBy(*KEYS, "event_name", F.date_trunc("hour", "occurred_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
        F.sort_array(F.collect_list("occurred_at")).alias("times"),
    )


def merged(slices: DataFrame) -> DataFrame:
    """One slice per profile, event name and hour from several."""
    return slices.groupBy(*_GROUP).agg(
        F.sum("count").alias("count"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.sort_array(F.flatten(F.collect_list("times"))).alias("times"),
    )


def newest(slices: DataFrame, at: dt.datetime, rank: int) -> DataFrame:
    """Log rows (without event_id and props) that hold the ``rank`` newest occurrences of every slice up to ``at``."""
    past = F.filter("times", lambda t: t <= moment(at))
    rows = slices.filter(F.col("first_at") <= moment(at)).withColumn("occurred_at", F.explode(F.slice(F.reverse(past), 1, rank)))
    return rows.select(*KEYS, F.lit(None).cast("string").alias("event_id"), "event_name", "occurred_at")
