"""Segment memberships: versions, enter and exit changes, and the edge prefilter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compiler import moment
from ..plans.rules import Rule, analyze

KEYS = ["tenant_id", "segment_id", "profile_id"]
STATE = (
    "tenant_id string, segment_id string, profile_id string, status string, entered_at timestamp, exited_at timestamp, "
    "last_evaluated_at timestamp, transition_seq long"
)


def advance(old: DataFrame, verdicts: DataFrame, at: dt.datetime) -> DataFrame:
    """The next state with ``change`` (entered, exited or null) per evaluated row.

    ``verdicts`` has the keys and ``matched``.  Rows that aren't evaluated stay as
    they are; a row that never matched has no state.
    """
    was = old.select(*KEYS, *(F.col(c).alias(f"_{c}") for c in ("status", "entered_at", "exited_at", "last_evaluated_at", "transition_seq")))
    both = was.join(verdicts.select(*KEYS, "matched"), KEYS, "full_outer")
    active = F.coalesce(F.col("_status") == "active", F.lit(False))
    change = (
        F.when(F.col("matched") & ~active, "entered").when((F.col("matched") == F.lit(False)) & active, "exited")
    )
    now = moment(at)
    flipped = F.col("_change").isNotNull()
    return (
        both.withColumn("_change", change)
        .filter(F.col("_status").isNotNull() | F.col("matched"))
        .select(
            *KEYS,
            F.when(F.col("_change") == "entered", "active").when(F.col("_change") == "exited", "exited").otherwise(F.col("_status")).alias("status"),
            F.when(F.col("_change") == "entered", now).otherwise(F.col("_entered_at")).alias("entered_at"),
            F.when(F.col("_change") == "exited", now).when(F.col("_change") == "entered", None).otherwise(F.col("_exited_at")).alias("exited_at"),
            F.when(F.col("matched").isNotNull(), now).otherwise(F.col("_last_evaluated_at")).alias("last_evaluated_at"),
            (F.coalesce("_transition_seq", F.lit(0)) + flipped.cast("long")).alias("transition_seq"),
            F.col("_change").alias("change"),
        )
    )


def changes(advanced: DataFrame, token: Column | None = None) -> DataFrame:
    """The change feed, with a token that makes a change unique: "<event or sweep>:<seq>"."""
    reason = F.concat(token if token is not None else F.lit("sweep"), F.lit(":"), F.col("transition_seq").cast("string"))
    return advanced.filter("change is not null").select(
        *KEYS, "change", "transition_seq", F.col("last_evaluated_at").alias("changed_at"), reason.alias("reason")
    )


def state_of(advanced: DataFrame) -> DataFrame:
    return advanced.drop("change")


def edge_pairs(events: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(event row, segment_id) pairs that need evaluation: a purely behavioural rule only for the events it names."""
    tests = []
    for name, rule in sorted(rules.items()):
        a = analyze(rule)
        skip = a.stateful and not a.stateless
        tests.append(F.when(F.col("event_name").isin(list(a.event_names)) if skip else F.lit(True), F.lit(name)))
    picked = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return events.withColumn("segment_id", F.explode(picked))


def current_versions(segments: DataFrame, versions: DataFrame) -> DataFrame:
    """Active segments with their current version's rule."""
    active = segments.filter("status = 'active'")
    same = ["tenant_id", "segment_id"]
    picked = active.join(versions.withColumnRenamed("version", "_v"), same).filter("current_version = _v")
    return picked.drop("_v")


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("tenant_id", "segment_id").agg((F.max("version") + 1).alias("version"))


def rules_epoch(segments: DataFrame) -> DataFrame:
    """A fingerprint of the active catalog; parsed rules may be kept while it is the same."""
    return segments.filter("status = 'active'").agg(
        F.count(F.lit(1)).alias("segments"), F.max("updated_at").alias("updated_at"), F.sum("current_version").alias("versions")
    )


def members_page(memberships: DataFrame, tenant: str, segment: str, limit: int = 500) -> DataFrame:
    """Active members, latest entries first."""
    mine = memberships.filter((F.col("tenant_id") == tenant) & (F.col("segment_id") == segment) & (F.col("status") == "active"))
    return mine.select("profile_id", "entered_at", "transition_seq").orderBy(F.col("entered_at").desc(), "profile_id").limit(limit)


def population_page(profiles: DataFrame, after: str | None, limit: int = 1000) -> DataFrame:
    rows = profiles if after is None else profiles.filter(F.col("profile_id") > after)
    return rows.select("tenant_id", "profile_id").orderBy("profile_id").limit(limit)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union where the row with the greatest ``order`` of each key wins; of equals, the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "_new")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks; of repeated new keys one row goes in."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def rekeyed(rows: DataFrame, survivors: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of merged profiles under their survivor, which keeps its own row where both have one.

    ``survivors`` has tenant_id, profile_id, survivor_id; ``keys`` identify a row (profile_id among them).
    """
    moved = rows.join(survivors, ["tenant_id", "profile_id"], "left").withColumns(
        {"_own": F.col("survivor_id").isNull(), "_from": F.col("profile_id"), "profile_id": F.coalesce("survivor_id", "profile_id")}
    )
    first = Window.partitionBy(*keys).orderBy(F.col("_own").desc(), "_from")
    kept = moved.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    return kept.select(*rows.columns)


def reparented(tables: dict[str, tuple[DataFrame, list[str]]], survivors: DataFrame) -> dict[str, DataFrame]:
    """Every table of a profile's children (its rows, what identifies a row) under the survivors: memberships, enrolments, history, events.

    Buckets and consent merge in their own ways: ``behavior.merge_buckets``, ``governance.merge_consent``.
    """
    return {name: rekeyed(rows, survivors, keys) for name, (rows, keys) in tables.items()}


def deactivated(pending: DataFrame, segments: DataFrame) -> DataFrame:
    """Deadlines of active segments only; memberships of the others stay as they are, frozen."""
    live = segments.filter("status = 'active'").select("tenant_id", "segment_id")
    return pending.join(live, ["tenant_id", "segment_id"], "left_semi")
