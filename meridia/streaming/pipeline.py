"""The event pipeline as a stream of micro-batches.

A batch of landed requests is normalised, judged against what was seen before, resolved
to clusters, and appended; then the memberships of the profiles it touched are
evaluated.  All of that goes through the operators of the set-wise queries, so a
drained stream followed by a sweep agrees with one batch evaluation.

What grows with the events is append-only, in one folder per batch that a repeated
run of the batch overwrites, parted by week.  What is kept per key lies in buckets of the
key: profiles, hourly slices of the behavioural log, memberships and deadlines are in
buckets of the profile, and a batch reads and rewrites the buckets of the profiles it
touches.  A repeated run of a batch starts from the state before it.

* Event ids: a stream remembers every id with the hash of its content, at any age, in the
  state store (``state.remembered``), so a batch reads no stored events to find reused ids.
  ``absorb`` on its own, without a stream, compares with the ids of all stored events.
* Rules: counts, recency and absence are read from slices, whole ones and the exact times
  at a window's bounds; only leaves with a filter, a sum, a sequence or an anchor read
  events, of the weeks that their windows reach back to.
* Identity: a batch covers its own identifiers and the clusters they belong to, not the
  whole graph; rows written under a cluster that later merged are redirected when they
  are read.

Requests that can't be read, and events whose id was used before with other content,
become dead letters with their body.  A batch that fails on its data is tried again
``retries`` times, then the rows that fail by themselves are looked for
(``isolate.failing``), become dead letters too, and the rest goes through.  Any other
failure, and more than ``most_failing`` such rows, fails the query, which runs the batch
again when it is started again.
"""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activation, behavior, deadlines, identity, ingest, membership, profiles, slices
from ..operators.graph import connected_components
from ..plans.compiler import KEYS, evaluate, leaves, micros, moment, scan_bound, sliceable
from ..plans.rules import Rule
from ..sources import readers
from ..sources.storage import Batches, Buckets, Snapshot, checkpointed
from . import isolate, state

CHANGES = "tenant_id string, segment_id string, profile_id string, change string, transition_seq long, changed_at timestamp, reason string"
ENVELOPE = (
    "tenant_id string, source_id string, event_id string, type string, event_name string, "
    + ", ".join(f"{c} string" for c in ingest.IDENTIFIERS)
    + ", previous_id string, timestamp timestamp, received_at timestamp, arrival long, context string, properties string, "
    "traits string, payload_hash string, identifier_key string, cluster_id string"
)
_ENVELOPE = [x.split()[0] for x in ENVELOPE.split(", ")]
DEAD = "tenant_id string, source_id string, received_at timestamp, arrival long, raw string, error string"
NODES = "tenant_id string, node_id string, namespace string, value string, cluster_id string, created_at timestamp"
TASKS = (
    "tenant_id string, destination_id string, subscription_id string, profile_id string, source_event_id string, "
    "idempotency_key string, status string, last_error string, attempt_count int, next_attempt_at timestamp, payload string"
)
CONSENT = "tenant_id string, profile_id string, channel string, purpose string, status string"
LOG = "tenant_id string, profile_id string, event_id string, event_name string, occurred_at timestamp, props string, schema_version int"
PENDING = "tenant_id string, segment_id string, profile_id string, due_at timestamp"
#: Slices are kept so long beyond the longest window; an evaluation that is further behind the newest one reads events.
SLACK = 86_400_000_000
MERGED = "tenant_id string, cluster_id string, survivor_id string"


@dataclass
class Pipeline:
    spark: SparkSession
    root: str
    rules: dict[str, Rule]
    #: Activation catalogs; without them no tasks are made.
    subscriptions: DataFrame | None = None
    destinations: DataFrame | None = None
    consent: DataFrame | None = None
    #: Buckets of the keyed state; fixed once the state is there.
    buckets: int = 64
    #: How often a batch that fails on its data runs again, each time after a tenth of a second more.
    retries: int = 2
    #: Rows of a batch that may become dead letters because the work fails on them.
    most_failing: int = 64

    def __post_init__(self) -> None:
        s, r = self.spark, self.root
        self.events = Batches(s, f"{r}/events", ENVELOPE, week="received_at")
        self.dead = Batches(s, f"{r}/dead", DEAD)
        self.nodes = Batches(s, f"{r}/nodes", NODES, keys=["tenant_id", "node_id"], count=self.buckets)
        self.feed = Batches(s, f"{r}/changes", CHANGES)
        self.tasks = Batches(s, f"{r}/tasks", TASKS)
        if self.consent is None:
            self.consent = s.createDataFrame([], CONSENT)
        self.merged = Snapshot(s, f"{r}/merged", MERGED)
        self.state = Buckets(s, f"{r}/membership", membership.STATE, list(KEYS), self.buckets)
        self.profiles = Buckets(s, f"{r}/profiles", profiles.PARTIAL, ["tenant_id", "cluster_id"], self.buckets)
        self.slices = Buckets(s, f"{r}/slices", slices.SLICES, list(KEYS), self.buckets)
        self.pending = Buckets(s, f"{r}/pending", PENDING, list(KEYS), self.buckets)
        rules = list(self.rules.values())
        self.sliced_names, self.sliced_span = slices.needs(rules)
        #: What needs the events themselves.
        self.deep = [b for b in leaves(rules) if not sliceable(b)]

    def redirected(self, rows: DataFrame) -> DataFrame:
        """Rows with the surviving cluster in ``cluster_id``."""
        return self._led(rows, self.merged.read())

    def _led(self, rows: DataFrame, merged: DataFrame) -> DataFrame:
        out = rows.join(merged, ["tenant_id", "cluster_id"], "left")
        return out.withColumn("cluster_id", F.coalesce("survivor_id", "cluster_id")).drop("survivor_id")

    def _resolve(self, fresh: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """(events of the batch with clusters, clusters that merged into others); stores new nodes and merges."""
        ids = checkpointed(identity.extract(fresh))
        order = F.struct("received_at", "event_id")
        touched = ids.select("tenant_id", "node_id").distinct()
        stored = self.nodes.read(but=batch, buckets=self.nodes.numbers(touched))
        known = self._led(stored.join(touched, ["tenant_id", "node_id"], "left_semi"), self.merged.read(but=batch))
        known = checkpointed(known.select("tenant_id", "node_id", "cluster_id", "created_at"))
        per_event = ids.groupBy("tenant_id", "event_id").agg(F.min("node_id").alias("a"), F.collect_set("node_id").alias("all"))
        star = per_event.select("a", F.explode("all").alias("b"))
        # Cluster ids carry their tenant here; node ids are hashes that hold it already.
        home = F.concat_ws("|", "tenant_id", "cluster_id")
        edges = star.unionByName(known.select(F.col("node_id").alias("a"), home.alias("b"))).filter("a <> b")
        roots = connected_components(edges)
        first = ids.groupBy("tenant_id", "node_id").agg(F.min(order).alias("first"))
        rooted = first.join(roots.withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("root", F.coalesce("root", "node_id"))
        old = known.join(rooted.select("node_id", "root"), "node_id")
        found = rooted.select("root", F.struct(F.lit(1).alias("late"), F.col("first.received_at").alias("at"), F.concat(F.lit("c_"), "first.event_id").alias("c")).alias("head"))
        found = found.unionByName(old.select("root", F.struct(F.lit(0).alias("late"), F.col("created_at").alias("at"), F.col("cluster_id").alias("c")).alias("head")))
        heads = checkpointed(found.groupBy("root").agg(F.min("head").alias("head")))
        owner = rooted.join(heads, "root").select("tenant_id", "node_id", "root", F.col("head.c").alias("cluster_id"), F.col("head.at").alias("created_at"))
        owner = checkpointed(owner)
        losers = old.join(heads, "root").filter(F.col("cluster_id") != F.col("head.c")).select("tenant_id", "cluster_id", F.col("head.c").alias("survivor_id")).distinct()
        losers = checkpointed(losers)
        if not losers.isEmpty():
            again = losers.select("tenant_id", F.col("cluster_id").alias("survivor_id"), F.col("survivor_id").alias("_new"))
            kept = self.merged.read(but=batch).join(again, ["tenant_id", "survivor_id"], "left").select(
                "tenant_id", "cluster_id", F.coalesce("_new", "survivor_id").alias("survivor_id")
            )
            self.merged.replace(kept.unionByName(losers).dropDuplicates(["tenant_id", "cluster_id"]), batch=batch)
        new = identity.nodes(ids).join(known.select("tenant_id", "node_id").distinct(), ["tenant_id", "node_id"], "left_anti")
        self.nodes.write(batch, new.join(owner.drop("root"), ["tenant_id", "node_id"]))
        mine = per_event.select("tenant_id", "event_id", F.col("a").alias("node_id")).join(owner, ["tenant_id", "node_id"])
        return fresh.join(mine.select("tenant_id", "event_id", "cluster_id"), ["tenant_id", "event_id"], "left"), losers

    def _since(self, at: dt.datetime) -> Column | None:
        """The time that the windows of ``deep`` leaves reach back to at ``at``; None where one sees everything."""
        bound = scan_bound(self.deep, at)
        return None if bound is None else F.timestamp_micros(F.lit(bound))

    def people(self, touched: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The profiles, all or only of touched (tenant_id, cluster_id) in these buckets."""
        states = self.redirected(self.profiles.read(buckets))
        if touched is not None:
            states = states.join(touched, ["tenant_id", "cluster_id"], "left_semi")
        return self._people(profiles.merged(states))

    @staticmethod
    def _people(states: DataFrame) -> DataFrame:
        folded = profiles.folded(states)
        traits = F.struct(*(F.col(f"trait_{t}").alias(t) for t in profiles.TRAITS))
        computed = F.struct("total_events", "total_orders", *profiles.LAST)
        return folded.select(
            "tenant_id",
            F.col("cluster_id").alias("profile_id"),
            F.concat(F.lit("customer_"), F.substring("cluster_id", 3, 1_000)).alias("canonical_user_id"),
            F.to_json(traits).alias("traits"),
            F.to_json(computed).alias("computed_attributes"),
            "first_seen_at",
            "last_seen_at",
        )

    def log(self, since: Column | None, touched: DataFrame | None = None) -> DataFrame:
        """The behavioural log of the events that arrived since then, of all or only of touched profiles."""
        # What occurred in a window arrived no earlier than it begins.
        events = self.redirected(self.events.read(since=since).filter("cluster_id is not null"))
        if touched is not None:
            events = events.join(touched, ["tenant_id", "cluster_id"], "left_semi")
        rows = events.withColumns({"profile_id": F.col("cluster_id"), "props": F.col("properties")})
        return behavior.record(rows, self.consent)

    def _slice(self, mine: DataFrame, at: dt.datetime, batch: int, buckets: list[int]) -> None:
        """Merge the slices of a batch's events into the state; build it from the stored events where it doesn't cover the rules."""
        note = self.slices.note(but=batch)
        newest = max(micros(at), note.get("at", micros(at)))
        oldest = newest - self.sliced_span - SLACK
        whole = not (self.sliced_names <= set(note.get("names", ())) and self.sliced_span <= note.get("span", -1))
        if whole:
            made = slices.sliced(self.log(F.timestamp_micros(F.lit(oldest))), self.sliced_names)
        else:
            rows = mine.withColumns({"profile_id": F.col("cluster_id"), "props": F.col("properties")})
            fresh = slices.sliced(behavior.record(rows, self.consent), self.sliced_names)
            held = self.slices.read(buckets, but=batch).unionByName(fresh).withColumnRenamed("profile_id", "cluster_id")
            made = slices.merged(self.redirected(held).withColumnRenamed("cluster_id", "profile_id"))
        kept = made.filter(F.col("last_at") >= F.timestamp_micros(F.lit(oldest)))
        note = {"names": sorted(self.sliced_names), "span": self.sliced_span, "at": newest}
        self.slices.update(kept, None if whole else buckets, batch=batch, note=note)

    def _slices(self, at: dt.datetime, touched: DataFrame | None, buckets: list[int] | None) -> DataFrame:
        """The slices that the rules need at ``at``: stored ones, or made from events for an instant long before the newest."""
        note = self.slices.note()
        covered = self.sliced_names <= set(note.get("names", ())) and self.sliced_span <= note.get("span", -1)
        if covered and micros(at) >= note["at"] - SLACK:
            rows = self.slices.read(buckets)
            if touched is not None:
                rows = rows.join(touched.withColumnRenamed("cluster_id", "profile_id"), list(KEYS), "left_semi")
            return rows
        since = F.timestamp_micros(F.lit(micros(at) - self.sliced_span))
        return slices.sliced(self.log(since, touched), self.sliced_names)

    def _judged(self, made: DataFrame, batch: int) -> DataFrame:
        """The events of a batch with the hash that their id was stored with before, from all stored events."""
        stored = self.events.read(but=batch).select("tenant_id", "event_id", F.col("payload_hash").alias("stored_hash"))
        return made.join(stored, ["tenant_id", "event_id"], "left")

    def absorb(self, requests: DataFrame, batch: int, at: dt.datetime | None = None) -> None:
        """One micro-batch of requests.  ``at`` is the evaluation instant; by default the latest arrival."""
        self._take(checkpointed(self._judged(checkpointed(state.envelopes(requests)), batch)), batch, at)

    def _deliver(self, made: DataFrame, batch: int) -> None:
        """A batch of the stream, without the rows that fail after all retries."""
        made = checkpointed(isolate.numbered(made))
        for attempt in range(self.retries + 1):
            try:
                return self._take(made, batch)
            except Exception as e:
                if isolate.row_error(e) is None:
                    raise
                failure = e
                time.sleep(0.1 * attempt)
        bad = isolate.failing(made, self._alone, self.most_failing)
        if not bad:
            raise failure
        wrong = F.create_map(*(F.lit(x) for number, text in bad.items() for x in (number, f"processing: {text}")))
        self._take(made.withColumn("error", F.coalesce("error", F.try_element_at(wrong, F.col(isolate.ROW)))), batch)

    def _alone(self, made: DataFrame) -> None:
        """What a batch computes of its events, with each as a profile of its own; writes nothing."""
        events = made.filter("error is null").withColumn("cluster_id", F.concat(F.lit("c_"), "event_id"))
        at = events.agg(F.max("received_at")).first()[0]
        if at is None:  # no events
            return
        seen = profiles.observed(events).join(events.select("tenant_id", "event_id", "cluster_id"), ["tenant_id", "event_id"])
        log = behavior.record(events.withColumns({"profile_id": F.col("cluster_id"), "props": F.col("properties")}), self.consent)
        verdicts = evaluate(self._people(profiles.partial(seen)), log, self.rules, at)
        for out in (ingest.verdicts(events), identity.nodes(identity.extract(events)), log, verdicts):
            out.write.format("noop").mode("overwrite").save()

    def _take(self, made: DataFrame, batch: int, at: dt.datetime | None = None) -> None:
        """The events of a batch, each with ``stored_hash``."""
        same = F.col("payload_hash") == F.col("stored_hash")
        verdict = F.when(F.col("stored_hash").isNull(), F.col("verdict")).when(same, "duplicate").otherwise("conflict")
        judged = checkpointed(ingest.verdicts(made.filter("error is null")).withColumn("verdict", verdict))
        letters = [x.split()[0] for x in DEAD.split(", ")]
        reused = judged.filter("verdict = 'conflict'").withColumn("error", F.lit("event_id: used before with other content"))
        self.dead.write(batch, made.filter("error is not null").select(*letters).unionByName(reused.select(*letters)))
        fresh = checkpointed(judged.filter("verdict = 'accepted'").select(*_ENVELOPE[:-1]))
        if fresh.isEmpty():
            return
        at = at or fresh.agg(F.max("received_at")).first()[0]
        resolved, losers = self._resolve(fresh, batch)
        resolved = checkpointed(resolved.select(*_ENVELOPE))
        self.events.write(batch, resolved)
        mine = resolved.filter("cluster_id is not null")
        touched = checkpointed(self.redirected(mine.select("tenant_id", "cluster_id")).distinct())
        buckets = self.profiles.numbers(touched.unionByName(losers.select("tenant_id", "cluster_id")))
        seen = profiles.observed(mine).join(mine.select("tenant_id", "event_id", "cluster_id"), ["tenant_id", "event_id"])
        states = self.profiles.read(buckets, but=batch).unionByName(profiles.partial(seen))
        self.profiles.update(profiles.merged(self.redirected(states)), buckets, batch=batch)
        self._slice(mine, at, batch, buckets)
        self.evaluate(at, batch, touched, buckets)

    def evaluate(self, at: dt.datetime, batch: int, touched: DataFrame | None = None, buckets: list[int] | None = None) -> None:
        """Evaluate every rule at ``at`` for the touched profiles, or all; append what changed to the feed, store new deadlines.

        ``buckets`` are those of the touched profiles and of the ones that merged into them.
        """
        if touched is not None and buckets is None:
            buckets = self.profiles.numbers(touched)
        people = checkpointed(self.people(touched, buckets))
        parts = checkpointed(self._slices(at, touched, buckets))
        empty = self.spark.createDataFrame([], LOG)
        log = checkpointed(self.log(self._since(at), touched)) if self.deep else empty
        verdicts = evaluate(people, log, self.rules, at, slices=parts)
        flat = F.array(*(F.struct(F.lit(n).alias("segment_id"), F.col(n).alias("matched")) for n in self.rules))
        rows = verdicts.select(*KEYS, F.inline(flat))
        # A profile that merged into another leaves its segments.
        merged = self.merged.read().select("tenant_id", F.col("cluster_id").alias("profile_id"))
        before = self.state.read(buckets, but=batch)
        gone = before.join(merged, list(KEYS), "left_semi").select(*membership.KEYS, F.lit(False).alias("matched"))
        ahead = checkpointed(membership.advance(before, rows.unionByName(gone), at))
        feed = membership.changes(ahead)
        self.feed.write(batch, feed)
        if self.subscriptions is not None and self.destinations is not None:
            made = activation.tasks(feed, self.subscriptions, self.destinations, people, self.consent)
            self.tasks.write(batch, made.select(*(x.split()[0] for x in TASKS.split(", "))))
        self.state.update(membership.state_of(ahead), buckets, batch=batch)
        self._arm(people, parts, merged, at, batch, buckets)

    def _arm(self, people: DataFrame, parts: DataFrame, merged: DataFrame, at: dt.datetime, batch: int, buckets: list[int] | None) -> None:
        """Replace the deadlines of the evaluated profiles, and drop those of merged ones."""
        stored = self.pending.read(buckets, but=batch)
        planned = None
        recent = slices.newest(parts, at, deadlines.depth(list(self.rules.values()))[2])
        for name, rule in self.rules.items():
            rows = deadlines.next_due(recent, rule, at).withColumn("segment_id", F.lit(name))
            planned = rows if planned is None else planned.unionByName(rows)
        kept = stored.join(people.select(*KEYS), list(KEYS), "left_anti").join(merged, list(KEYS), "left_anti")
        columns = [x.split()[0] for x in PENDING.split(", ")]
        if planned is not None:
            # A deadline that moved by less than the slack stays, if it is still to come.
            ahead = stored.filter(F.col("due_at") > moment(at)).withColumn("parked_at", F.lit(None).cast("timestamp"))
            kept = kept.select(*columns).unionByName(deadlines.coalesced(ahead, planned).select(*columns))
        self.pending.update(kept.select(*columns), buckets, batch=batch)

    def sweep(self, at: dt.datetime, everyone: bool = False) -> None:
        """Evaluate without events what only time changes: the profiles with a deadline before ``at``, or all.

        Sums have no deadline; rules with one need ``everyone``.
        """
        due = self.pending.read().filter(F.col("due_at") < moment(at))
        touched = None if everyone else checkpointed(due.select("tenant_id", F.col("profile_id").alias("cluster_id")).distinct())
        if touched is None or not touched.isEmpty():
            self.evaluate(at, -int(at.replace(tzinfo=dt.timezone.utc).timestamp()), touched)

    def due(self) -> DataFrame:
        """(tenant, segment, profile, due_at): when each rule can flip next without an event, as of the last evaluation."""
        return self.pending.read()

    def start(self, landing: str, checkpoint: str, files_per_trigger: int = 100):
        """Drain what has landed, in bounded batches, and stop; run again for more.

        The session needs the RocksDB state store.  The ids of events that were stored
        before the stream's first batch are its initial state; batches absorbed without
        the stream have other numbers than its own, from 0 on.
        """
        stream = readers.landed_stream(self.spark, landing, files_per_trigger)
        # A repeated first batch must not remember what its first run stored.
        known = self.events.read(but=0).select("tenant_id", "event_id", "payload_hash")
        judged = state.remembered(state.envelopes(stream), known)
        return (
            judged.writeStream.foreachBatch(self._deliver)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def bucket_stream(log: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Hourly counts of a log stream: one row per closed hour, after the watermark passed it."""
    return (
        log.withWatermark("occurred_at", lateness)
        .dropDuplicatesWithinWatermark(["tenant_id", "profile_id", "event_id"])
        .groupBy(*KEYS, "event_name", F.window("occurred_at", "1 hour"))
        .agg(F.count(F.lit(1)).alias("count"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
        .select(*KEYS, "event_name", F.col("window.start").alias("bucket_start"), "count", "first_at", "last_at")
    )


def retraction_free_counts(log: DataFrame) -> DataFrame:
    """Running counts per profile and event name, for update mode."""
    return log.groupBy(*KEYS, "event_name").agg(F.count(F.lit(1)).alias("count"), F.max("occurred_at").alias("last_at"))
