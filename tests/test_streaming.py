import datetime as dt
import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from meridia.operators import behavior, deadlines, identity, ingest, profiles
from meridia.plans.compiler import evaluate
from meridia.plans.rules import parse
from meridia.sources import readers
from meridia.streaming import isolate, pipeline

AT = dt.datetime(2026, 6, 10, 12)
RULES = {
    "viewers": parse({"behavior": {"kind": "count", "event_name": "view", "window": "2d", "op": "gte", "value": 2}}),
    "named": parse({"field": "profile.traits.name", "op": "exists"}),
}


def _requests(rng, n):
    rows = []
    for i in range(n):
        u = rng.randrange(12)
        body = {"event_id": f"e{i}", "event_name": rng.choice(["view", "order_completed"]), "device_id": f"d{u}"}
        if rng.random() < 0.3:
            body["user_id"] = f"u{u // 3}"
        if rng.random() < 0.4:
            body["traits"] = {"name": f"n{u}"}
        if rng.random() < 0.05:
            body = {"event_id": f"e{i}", "type": "track"}
        rows.append({"tenant_id": f"t{u % 2}", "source_id": "s", "endpoint": "track", "received_at": (AT + dt.timedelta(hours=i)).isoformat() + "Z", "arrival": i, "body": json.dumps(body)})
        if rng.random() < 0.1:
            rows.append({**rows[-1], "arrival": 10_000 + i})
    return rows


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = _requests(rng, 90)
    landing = tmp_path / "in"
    landing.mkdir()
    for k in range(3):
        part = landing / f"part{k}.json"
        part.write_text("\n".join(json.dumps(r) for r in rows[k * 33 : (k + 1) * 33]))
        os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))  # the source takes older files first
    tenants = ("t0", "t1")
    subs = spark.createDataFrame([(t, "x", "d", "viewers", "active") for t in tenants], "tenant_id string, subscription_id string, destination_id string, segment_id string, status string")
    dests = spark.createDataFrame([(t, "d", "webhook", "active", "{}") for t in tenants], "tenant_id string, destination_id string, type string, status string, config string")
    work = pipeline.Pipeline(spark, f"file://{tmp_path}/state", RULES, subs, dests, buckets=4)
    work.start(f"file://{landing}", f"file://{tmp_path}/ckpt", files_per_trigger=1).awaitTermination()
    end = AT + dt.timedelta(hours=100)
    work.sweep(end)

    made = readers.single_events(readers.landed(spark, f"file://{landing}"))
    events = ingest.accepted(made.filter("arrival < 99 * 500"))
    ids = identity.extract(events)
    members = identity.resolve(ids)
    clusters = identity.event_clusters(ids, members)
    stored = {(r.tenant_id, r.event_id): r.cluster_id for r in work.redirected(work.events.read()).collect()}
    assert stored == {(r.tenant_id, r.event_id): r.cluster_id for r in clusters.collect()}
    assert work.dead.read().count() == made.filter("error is not null and arrival < 20000 * 500").count()
    folded = profiles.fold(profiles.observed(events), clusters)
    people = folded.select(
        "tenant_id", F.col("cluster_id").alias("profile_id"), F.lit("c").alias("canonical_user_id"),
        F.to_json(F.struct(F.col("trait_name").alias("name"))).alias("traits"), F.lit("{}").alias("computed_attributes"), "first_seen_at", "last_seen_at",
    )
    rows = events.join(clusters, ["tenant_id", "event_id"]).withColumns({"profile_id": F.col("cluster_id"), "props": F.col("properties")})
    consent = spark.createDataFrame([], "tenant_id string, profile_id string, channel string, purpose string, status string")
    verdicts = evaluate(people, behavior.record(rows, consent), RULES, end).collect()
    want = {(r.tenant_id, n, r.profile_id) for r in verdicts for n in RULES if r[n]}
    state = work.state.read().collect()
    assert {(r.tenant_id, r.segment_id, r.profile_id) for r in state if r.status == "active"} == want and want
    feed = work.feed.read().collect()
    assert len({(r.tenant_id, r.segment_id, r.profile_id, r.transition_seq) for r in feed}) == len(feed)
    last = {}
    for r in sorted(feed, key=lambda r: r.transition_seq):
        last[r.tenant_id, r.segment_id, r.profile_id] = r.change
    assert {k for k, v in last.items() if v == "entered"} == want
    made = work.tasks.read().collect()
    assert len({r.idempotency_key for r in made}) == len(made) and all(r.status == "pending" for r in made)
    on = {(r.tenant_id, r.profile_id, r.reason) for r in feed if r.segment_id == "viewers"}
    assert {(r.tenant_id, r.profile_id, r.source_event_id) for r in made} <= on and made
    before = len(feed)
    work.absorb(readers.landed(spark, f"file://{landing}"), 99)
    assert work.feed.read().count() == before
    # Every deadline that is still to come is the one that a fresh look at the whole log finds.
    whole = behavior.record(work.redirected(work.events.read()).withColumns({"profile_id": F.col("cluster_id"), "props": F.col("properties")}), consent)
    planned = {(r.tenant_id, r.profile_id): r.due_at for r in deadlines.next_due(whole, RULES["viewers"], end).collect()}
    assert {(r.tenant_id, r.profile_id): r.due_at for r in work.due().collect() if r.due_at > end} == planned


def test_bucket_stream_matches_batch(spark, tmp_path):
    rows = [("t", "p", f"e{i % 40}", "view", AT + dt.timedelta(minutes=13 * (i % 40)), "{}") for i in range(50)]
    log = spark.createDataFrame(rows, "tenant_id string, profile_id string, event_id string, event_name string, occurred_at timestamp, props string")
    path = f"file://{tmp_path}/log"
    log.coalesce(1).write.parquet(path)
    stream = pipeline.bucket_stream(spark.readStream.schema(log.schema).parquet(path), "1 hour")
    query = stream.writeStream.format("memory").queryName("buckets").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(r.bucket_start, r["count"]) for r in behavior.hourly_buckets(log.dropDuplicates(["event_id"])).collect()}
    got = {(r.bucket_start, r["count"]) for r in spark.table("buckets").collect()}
    assert got <= want and len(want) - len(got) <= 2


def _land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def _track(i, event_id, **body):
    made = {"event_id": event_id, "event_name": "view", "user_id": f"u{i % 5}", **body}
    return {"tenant_id": "t", "source_id": "s", "endpoint": "track", "received_at": (AT + dt.timedelta(minutes=i)).isoformat() + "Z", "arrival": i, "body": json.dumps(made)}


def test_a_failed_batch_runs_again_without_loss(spark, tmp_path):
    rows = [_track(i, f"e{i}") for i in range(20)]
    _land(tmp_path / "in", "a.json", rows)
    work = pipeline.Pipeline(spark, f"file://{tmp_path}/state", RULES, buckets=4)
    whole = work._arm
    work._arm = lambda *_: 1 / 0  # after events, profiles, feed and memberships are stored
    with pytest.raises(StreamingQueryException):
        work.start(f"file://{tmp_path}/in", f"file://{tmp_path}/ckpt").awaitTermination()
    work._arm = whole
    work.start(f"file://{tmp_path}/in", f"file://{tmp_path}/ckpt").awaitTermination()
    assert work.dead.read().isEmpty() and work.events.read().count() == 20
    assert profiles.folded(work.profiles.read()).agg(F.sum("total_events")).first()[0] == 20
    assert work.feed.read().filter("change = 'entered'").count() == 5 == work.state.read().filter("status = 'active'").count()
    assert work.due().count() == 5


def test_dead_letters_keep_their_body(spark, tmp_path):
    many = json.dumps({"events": [{"event_id": "x"}] * 501})
    rows = [_track(1, "a"), {**_track(2, "a"), "body": _track(1, "a")["body"]}, _track(3, "a", event_name="other"), {**_track(4, ""), "body": "{broken"}]
    rows += [{**_track(5 + k, ""), "endpoint": "batch", "body": body} for k, body in enumerate((many, "[no", json.dumps({"events": [{"event_id": "b", "event_name": "view", "user_id": "u"}, 7]})))]
    _land(tmp_path / "in", "a.json", rows)
    work = pipeline.Pipeline(spark, f"file://{tmp_path}/state", RULES, buckets=4)
    work.absorb(readers.landed(spark, f"file://{tmp_path}/in"), 0)
    dead = {r.raw: r.error for r in work.dead.read().collect()}
    assert dead[many] == "too many events" and dead["[no"] == "batch requires events" and "{broken" in dead and len(dead) == 5
    assert dead[rows[2]["body"]].startswith("event_id:")
    work.absorb(spark.createDataFrame([("t", "s", "track", AT + dt.timedelta(hours=1), 99, rows[2]["body"])], readers.LANDED), 1)
    assert work.dead.read(only=1).count() == 1 and work.events.read().count() == 2


def _poisoned(monkeypatch):
    """Recording an event called poison fails, as a value that an expression can't take does."""
    record = behavior.record

    def failing(rows, consent):
        bad = F.when(F.col("event_name") == "poison", F.element_at(F.array(F.lit("x")), F.length("event_id") + 1))
        return record(rows, consent).withColumn("event_name", F.coalesce(bad, "event_name"))

    monkeypatch.setattr(pipeline.behavior, "record", failing)


def test_rows_that_fail_become_dead_letters_after_the_retries(spark, tmp_path, monkeypatch):
    _poisoned(monkeypatch)
    rows = [_track(i, f"e{i}", event_name="poison" if i in (3, 17) else "view") for i in range(30)] + [{**_track(40, ""), "body": "{broken"}]
    _land(tmp_path / "in", "a.json", rows)
    work = pipeline.Pipeline(spark, f"file://{tmp_path}/state", RULES, buckets=4, retries=1)
    tries = []
    take = work._take
    work._take = lambda made, batch, at=None: (tries.append(batch), take(made, batch, at))[1]
    work.start(f"file://{tmp_path}/in", f"file://{tmp_path}/ckpt").awaitTermination()
    dead = {r.raw: r.error for r in work.dead.read().collect()}
    assert len(dead) == 3 and all(dead[rows[i]["body"]].startswith("processing: INVALID_ARRAY_INDEX") for i in (3, 17))
    assert work.events.read().count() == 28 and tries == [0, 0, 0]
    assert profiles.folded(work.profiles.read()).agg(F.sum("total_events")).first()[0] == 28
    assert work.state.read().filter("status = 'active'").count() == 5


def test_too_many_failing_rows_fail_the_query(spark, tmp_path, monkeypatch):
    _poisoned(monkeypatch)
    _land(tmp_path / "in", "a.json", [_track(i, f"e{i}", event_name="poison") for i in range(20)])
    work = pipeline.Pipeline(spark, f"file://{tmp_path}/state", RULES, buckets=4, retries=0, most_failing=4)
    with pytest.raises(StreamingQueryException, match="over 4 rows fail"):
        work.start(f"file://{tmp_path}/in", f"file://{tmp_path}/ckpt").awaitTermination()
    assert work.dead.read().isEmpty()


def test_what_is_a_rows_fault():
    assert isolate.row_error(RuntimeError("x [CAST_INVALID_INPUT] The value 'a'\n is bad. SQLSTATE: 22018 y")) == "CAST_INVALID_INPUT: The value 'a' is bad."
    assert isolate.row_error(RuntimeError("[USER_RAISED_EXCEPTION] no SQLSTATE: P0001")) is not None
    assert isolate.row_error(RuntimeError("[UNRESOLVED_COLUMN] no SQLSTATE: 42703")) is None and isolate.row_error(OSError("disk full")) is None


FILTERED = {"filtered": parse({"behavior": {"kind": "count", "event_name": "view", "window": "2d", "op": "gte", "value": 2, "where": {"field": "event.properties.x", "op": "exists"}}})}


def test_a_batch_reads_only_the_weeks_of_its_windows(spark, tmp_path):
    work = pipeline.Pipeline(spark, f"file://{tmp_path}/state", FILTERED, buckets=4)
    for week in range(4):
        shift = dt.timedelta(weeks=week)
        rows = [("t", "s", "track", AT + shift, week * 10 + i, json.dumps({"event_id": f"w{week}e{i}", "event_name": "view", "user_id": f"u{i}"})) for i in range(6)]
        work.absorb(spark.createDataFrame(rows, readers.LANDED), week)
        assert work.log(work._since(AT + shift)).count() == 6 and work.people().count() == 6
        plan = work.events.read(since=work._since(AT + shift))._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(week" in plan and "(week#" in plan
    assert profiles.folded(work.profiles.read()).agg(F.sum("total_events")).first()[0] == 24


SLICED = {
    "often": parse({"behavior": {"kind": "count", "event_name": "view", "window": "5h", "op": "gte", "value": 3}}),
    "once": parse({"behavior": {"kind": "count", "event_name": "buy", "window": "90m", "op": "eq", "value": 1}}),
    "recent": parse({"behavior": {"kind": "recency", "event_name": "view", "window": "100m"}}),
    "away": parse({"behavior": {"kind": "absence", "event_name": "buy", "window": "4h"}}),
}


def test_batches_neither_read_old_events_nor_rewrite_untouched_profiles(spark, tmp_path):
    """Random logs with merging clusters: slices give what all events give, and a batch's work doesn't grow."""
    rng = random.Random(11)
    work = pipeline.Pipeline(spark, f"file://{tmp_path}/state", SLICED, buckets=8)
    everyone, n, sizes, reads = 40, 0, [], []
    read = work.events.read

    def counted(*args, **kwargs):
        reads.append((args, kwargs))
        return read(*args, **kwargs)

    for batch in range(4):
        rows = []
        people = range(everyone) if batch == 0 else rng.sample(range(everyone), 3)
        for u in people:
            for _ in range(3):
                ids = {"device_id": f"d{u}"} | ({"user_id": f"u{u // 2}"} if batch > 1 and rng.random() < 0.5 else {})
                body = {"event_id": f"e{n}", "event_name": rng.choice(["view", "view", "buy", "other"]), **ids}
                rows.append(("t", "s", "track", AT + dt.timedelta(minutes=37 * batch + n % 30), n, json.dumps(body)))
                n += 1
        work.events.read = counted
        reads.clear()
        made = pipeline.state.envelopes(spark.createDataFrame(rows, readers.LANDED)).withColumn("stored_hash", F.lit(None).cast("string"))
        before = {f for f in tmp_path.rglob("*.parquet")}
        work._take(pipeline.checkpointed(made), batch)
        work.events.read = read
        assert not reads or batch == 0  # the first batch builds the slices
        sizes.append(sum(f.stat().st_size for name in ("profiles", "slices", "membership", "pending") for f in (tmp_path / "state" / name).rglob("*.parquet") if f not in before))
        at = max(r[3] for r in rows)
        clusters = {r.cluster_id for r in work.profiles.read().collect()}
        touched = {c for (c,) in work.redirected(work.events.read(only=batch)).select("cluster_id").distinct().collect()}
        state = {(r.segment_id, r.profile_id): r.status for r in work.state.read().collect()}
        want = evaluate(work.people(), work.log(None), SLICED, at).collect()
        assert {r.profile_id for r in want} == clusters
        for r in want:
            if r.profile_id in touched:
                assert all((state.get((k, r.profile_id)) == "active") == r[k] for k in SLICED)
        assert not any(s == "active" and p not in clusters for (_, p), s in state.items())
        log = work.log(None)
        due = {(r.segment_id, r.profile_id): r.due_at for r in work.due().collect()}
        for k, rule in SLICED.items():
            planned = {r.profile_id: r.due_at for r in deadlines.next_due(log, rule, at).collect() if r.profile_id in touched}
            mine = {p: d for (s, p), d in due.items() if s == k and p in touched and d > at}
            # A deadline that moves by a minute or less stays.
            assert mine.keys() == planned.keys() and all(abs(mine[p] - planned[p]) <= dt.timedelta(seconds=60) for p in planned)
    assert max(sizes[1:]) < 0.6 * sizes[0]
    work.rules = work.rules | {"wide": parse({"behavior": {"kind": "count", "event_name": "other", "window": "3d", "op": "gte", "value": 1}})}
    work.__post_init__()
    late = AT + dt.timedelta(hours=9)
    work.sweep(late, everyone=True)  # slices don't cover the new rule: it is read from the events
    got = {(r.segment_id, r.profile_id) for r in work.state.read().filter("status = 'active'").collect()}
    want = evaluate(work.people(), work.log(None), work.rules, late).collect()
    assert got == {(k, r.profile_id) for r in want for k in work.rules if r[k]}


def test_a_stream_remembers_ids_at_any_age(spark, tmp_path):
    work = pipeline.Pipeline(spark, f"file://{tmp_path}/state", RULES, buckets=4)
    early = _track(1, "early")
    work.absorb(spark.createDataFrame([("t", "s", "track", AT, 1, early["body"])], readers.LANDED), 1000)
    later = (AT + dt.timedelta(days=400)).isoformat() + "Z"
    files = [
        [early, _track(2, "a"), _track(3, "a", event_name="other"), {**_track(4, "x"), "body": "{broken"}],
        [{**_track(5, "a"), "received_at": later}, {**_track(6, "a"), "received_at": later, "body": _track(2, "a")["body"]}, {**_track(2, "b"), "received_at": later}],
        [{**_track(7, "a", event_name="third"), "received_at": later}],
    ]
    for k, rows in enumerate(files):
        _land(tmp_path / "in", f"{k}.json", rows)
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    reads = []
    read = work.events.read
    work.events.read = lambda *a, **k: reads.append(k) or read(*a, **k)
    work.start(f"file://{tmp_path}/in", f"file://{tmp_path}/ckpt", files_per_trigger=1).awaitTermination()
    assert all(k.get("since") is not None or k.get("but") == 0 for k in reads)
    assert sorted(r.event_id for r in read().collect()) == ["a", "b", "early"]
    dead = sorted((r.error.split(":")[0], json.loads(r.raw)["event_name"] if "{broken" not in r.raw else "") for r in work.dead.read().collect())
    assert [e for e, _ in dead].count("event_id") == 3 and len(dead) == 4


def test_bucketed_state_keeps_versions_and_other_buckets(spark, tmp_path):
    from meridia.sources.storage import Buckets

    table = Buckets(spark, f"file://{tmp_path}/b", "k string, v long", ["k"], 5)
    assert table.read().count() == 0 and table.note() == {}
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v long")
    table.update(rows, None, batch=0, note={"x": 1})
    mine = table.numbers(spark.createDataFrame([("k1",), ("k2",)], "k string"))
    part = table.read(mine)
    names = {r.k for r in part.collect()}
    assert {"k1", "k2"} <= names and len(names) < 50
    for run in range(3):  # a batch that is repeated starts from the state before it
        table.update(table.read(mine, but=1).withColumn("v", F.col("v") + 100), mine, batch=1)
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {f"k{i}": i + 100 * (f"k{i}" in names) for i in range(50)}
    assert {r.k: r.v for r in table.read(but=1).collect()} == {f"k{i}": i for i in range(50)} and table.note(but=1) == {"x": 1}
    with pytest.raises(ValueError):
        table.update(rows, mine[:1], batch=2)
    table.update(spark.createDataFrame([], "k string, v long"), mine, batch=3)
    assert {r.k for r in table.read().collect()} == set(got) - names
    table.update(table.read(), None, batch=4)
    table.update(table.read(), None, batch=5)
    assert len(list((tmp_path / "b" / "_versions").glob("[0-9]*"))) == 2
