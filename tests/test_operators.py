import datetime as dt
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from meridia.functions import scalars
from meridia.operators import activation, behavior, deadlines, governance, graph, identity, ingest, journeys, membership, metrics, ops, profiles
from meridia.plans.rules import RuleError, parse
from meridia.sources import catalog, readers, sinks
from meridia.sources.storage import Snapshot

AT = dt.datetime(2026, 6, 10, 12)
HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)
LOG = "tenant_id string, profile_id string, event_id string, event_name string, occurred_at timestamp, props string"


def log(spark, times, name="view"):
    return spark.createDataFrame([("t", "p", f"e{i}", name, AT + d, "{}") for i, d in enumerate(times)], LOG)


@pytest.mark.parametrize("window", ["40m", "90m", "3h", "4h", "10h"])
def test_bucket_counts_equal_exact_counts(spark, window):
    at = AT + HOUR / 2
    hours = [-4.5, -3.6, -3.5, -2.5, -1.5, -0.6, -0.1, 0.5, 0.4, 2]
    frame = log(spark, [h * HOUR for h in hours])
    got = behavior.bucket_counts(behavior.hourly_buckets(frame), frame, "view", window, at).collect()
    from meridia.plans.rules import parse_window

    span = dt.timedelta(microseconds=parse_window(window))
    assert got[0].n == sum(at - span <= AT + h * HOUR <= at for h in hours)


def test_shape_fingerprints(spark):
    shapes = [
        ('{"qty":3,"sku":"k9","gift":false}', "gift:bool;qty:number;sku:string;"),
        ('{"gift":true,"sku":"","qty":-0.5}', "gift:bool;qty:number;sku:string;"),
        ('{"lines":[1],"to":{"zip":1},"note":null}', "lines:array;note:null;to:object;"),
        ('{"Ü":1e3}', "Ü:number;"),
        (" {} ", None),
        ("[{}]", None),
        ("7", None),
        ("{broken", None),
        (None, None),
    ]
    rows = [x for x, _ in shapes]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, p string").orderBy("i").select(behavior.shape_fingerprint(F.col("p"))).collect()]

    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h & 0x7FFFFFFF

    assert got == [fnv(text) if text else 1 for _, text in shapes]


@pytest.mark.parametrize("seed", range(6))
def test_next_due_is_the_next_flip(spark, seed):
    """The first instant at which the verdict differs, found by trying every end of every window."""
    rng = random.Random(seed)
    hours = sorted(rng.sample(range(-90, 0), 9))
    for kind, op in [("recency", None), ("absence", None), *(("count", o) for o in ("gte", "gt", "lt", "lte", "eq"))]:
        span, k = rng.randrange(20, 110), rng.randrange(1, 6)
        spec = {"kind": kind, "event_name": "view", "window": f"{span}h"} | ({"op": op, "value": k} if op else {})

        def verdict(at):
            n = sum(at - span <= h for h in hours)
            return {"recency": n > 0, "absence": n == 0, "gte": n >= k, "gt": n > k, "lt": n < k, "lte": n <= k, "eq": n == k}[op or kind]

        ends = [h + span for h in hours if h + span > 0]
        flip = next((e for e in ends if verdict(e + 0.01) != verdict(e)), None)
        got = [r.due_at for r in deadlines.next_due(log(spark, [h * HOUR for h in hours]), parse({"behavior": spec}), AT).collect()]
        if kind == "count":
            # An early look is harmless, a late one is not.
            assert flip is None or (got and got[0] <= AT + flip * HOUR)
            assert not got or (got[0] - AT) / HOUR in ends
        else:
            assert got == ([AT + flip * HOUR] if flip is not None else [])


def test_sums_have_no_deadline(spark):
    spec = {"kind": "frequency", "event_name": "view", "window": "5d", "op": "lt", "value": 1}
    assert deadlines.next_due(log(spark, [-2 * HOUR]), parse({"behavior": spec}), AT).isEmpty()


def test_fair_claim_and_parking(spark):
    rows = [("a", f"s{i}", "p", AT - HOUR, None, 0) for i in range(100)] + [("b", "s", "p", AT, None, 9), ("b", "x", "p", AT + HOUR, None, 0)]
    frame = spark.createDataFrame(rows, "tenant_id string, segment_id string, profile_id string, due_at timestamp, parked_at timestamp, attempts int")
    got = [r.tenant_id for r in deadlines.fair_claim(frame, AT, 20, 5).collect()]
    assert sorted(got) == ["a"] * 5 + ["b"]
    claimed = frame.withColumn("claimed_at", F.when(F.col("segment_id") == "s1", F.lit(AT)).when(F.col("segment_id") == "s2", F.lit(AT - HOUR)).cast("timestamp"))
    got = {r.segment_id for r in deadlines.fair_claim(claimed, AT, 200, 200).collect()}
    assert "s1" not in got and "s2" in got and len(got) == 100
    after = {r.segment_id: r for r in deadlines.after_failure(frame.filter("tenant_id = 'b'"), AT).collect()}
    assert after["s"].parked_at == AT and after["s"].attempts == 10 and after["s"].due_at == AT
    assert after["x"].parked_at is None and after["x"].due_at == AT + dt.timedelta(seconds=5)


def test_connected_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(200, 300)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    used = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in used}


ENV = ["tenant_id", "event_id", "source_id", "type", "event_name", "received_at", "timestamp", *ingest.IDENTIFIERS, "previous_id", "properties", "context", "traits"]


def envelopes(spark, rows):
    made = []
    for i, r in enumerate(rows):
        base = dict.fromkeys(ENV, "") | {"tenant_id": "t", "event_id": f"e{i}", "source_id": "s", "type": "track", "event_name": "x"}
        base |= {"received_at": AT + i * HOUR, "timestamp": AT + i * HOUR} | r
        for c in ("properties", "context", "traits"):
            base[c] = json.dumps(base[c]) if base[c] else None
        made.append(tuple(base[c] for c in ENV))
    times = {"received_at", "timestamp"}
    return spark.createDataFrame(made, ", ".join(f"{c} {'timestamp' if c in times else 'string'}" for c in ENV))


def unified(spark, rows, exact):
    events = envelopes(spark, rows)
    ids = identity.extract(events)
    members = identity.resolve(ids)
    seen = profiles.observed(events)
    if not exact:
        return profiles.fold(seen, identity.event_clusters(ids, members)).collect(), ids, members
    return profiles.exact_fold(seen, *identity.timeline(ids, members)).collect(), ids, members


THREE = [
    {"anonymous_id": "a1", "traits": {"name": "Ines"}},
    {"user_id": "u1", "phone": "123456789", "event_name": "order_completed"},
    {"email": "e@x.com", "traits": {"country": "CL", "name": "Late"}},
    {"anonymous_id": "a1", "user_id": "u1", "email": "e@x.com"},
    {"tenant_id": "other", "user_id": "u1"},
]


def test_three_clusters_merge_into_the_first(spark):
    got, ids, members = unified(spark, THREE, exact=True)
    mine = next(r for r in got if r.tenant_id == "t")
    assert len(got) == 2 and mine.cluster_id == "c_e0" and mine.total_events == 4 and mine.total_orders == 1
    assert (mine.trait_name, mine.trait_phone, mine.trait_country, mine.trait_email) == ("Ines", "123456789", "CL", "e@x.com")
    assert mine.first_seen_at == AT and mine.last_order_at == AT + HOUR
    history = {(r.from_cluster_id, r.to_cluster_id, r.event_id) for r in identity.merge_history(ids, members).collect()}
    assert history == {("c_e1", "c_e0", "e3"), ("c_e2", "c_e0", "e3")}


def test_alias_links_and_no_identifier_drops(spark):
    rows = [{"anonymous_id": "a"}, {"type": "alias", "user_id": "u", "previous_id": "a"}, {"user_id": "u"}, {}]
    _, ids, members = unified(spark, rows, exact=False)
    clusters = {r.event_id: r.cluster_id for r in identity.event_clusters(ids, members).collect()}
    assert clusters == {"e0": "c_e0", "e1": "c_e0", "e2": "c_e0"}


def test_declarative_fold_is_exact_without_merges(spark):
    rng = random.Random(5)
    rows = [
        {"user_id": f"u{rng.randrange(5)}", "event_name": rng.choice(["order_completed", "product_viewed", "x"]),
         "traits": rng.choice([{}, {"name": f"n{rng.randrange(9)}", "country": ""}, {"name": 5}]), "properties": {"product_id": f"p{i}"},
         "timestamp": AT + rng.randrange(-50, 50) * HOUR}
        for i in range(60)
    ]
    a, b = (sorted(tuple(r) for r in unified(spark, rows, exact)[0]) for exact in (False, True))
    assert a == b and len(a) == 5


def test_changed_fields(spark):
    events = envelopes(spark, [{"user_id": "u", "traits": {"name": "A"}}, {"user_id": "u", "traits": {"name": "A"}, "timestamp": AT}])
    ids = identity.extract(events)
    got = {r.event_id: set(r.changed) for r in profiles.changed_fields(profiles.observed(events), identity.event_clusters(ids, identity.resolve(ids))).collect()}
    assert "traits.name" in got["e0"] and got["e1"] == {"computed_attributes.total_events"}


def requests(spark, rows):
    made = [("t", "s", e, AT + i * HOUR, i, b if isinstance(b, str) else json.dumps(b)) for i, (e, b) in enumerate(rows)]
    return spark.createDataFrame(made, readers.LANDED)


def test_single_and_batch_requests(spark):
    ev = {"event_name": "x", "user_id": "u"}
    frame = requests(
        spark,
        [("track", {**ev, "event_id": "1"}), ("track", {**ev, "event_id": "1"}), ("track", {**ev, "event_id": "1", "event_name": "y"}),
         ("identify", {"email": "a@b"}), ("alias", {"user_id": "u", "previous_id": "a"}), ("track", "{broken"), ("track", '"text"'),
         ("track", {**ev, "properties": {"x": "z" * 70_000}}), ("track", {**ev, "timestamp": "2024-01-01"}), ("track", {**ev, "timestamp": "2024-01-01T00:00:00+02:00"}),
         ("batch", {"events": [{**ev, "event_id": "b1"}, {"type": "nope"}]}), ("batch", {"events": []}), ("batch", {"events": [ev] * 501})],
    )
    single = {r.arrival // ingest.MAX_BATCH_EVENTS: r for r in ingest.verdicts(readers.single_events(frame)).collect()}
    assert [single[i].verdict for i in range(5)] == ["accepted", "duplicate", "conflict", "rejected", "accepted"]
    assert single[5].error == single[6].error == "invalid JSON" and single[7].error == "payload too large"
    assert single[8].error == "timestamp: must be RFC3339" and single[9].timestamp == dt.datetime(2023, 12, 31, 22)
    assert single[3].error.startswith("identifiers: identify") and single[4].type == "alias"
    batch = readers.batch_events(frame).select("batch_id", "position", "error", "event_id").collect()
    assert {(r.batch_id, r.position): r.error for r in batch} == {
        (10, 0): None, (10, 1): 'type: unknown type "nope"', (11, None): "batch requires events", (12, None): "too many events",
    }


def test_dead_letters(spark):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(['{"a":1}', "{a", "", None, 'q"\\'])], "i int, raw string")
    good, dead = ingest.split_dead_letters(frame)
    assert [r.i for r in good.collect()] == [0]
    payloads = {r.i: r.payload for r in dead.collect()}
    assert json.loads(payloads[1]) == "{a" and payloads[2] == payloads[3] == "null" and json.loads(payloads[4]) == 'q"\\'


def test_membership_flips(spark):
    def verdict(*rows):
        return spark.createDataFrame([("t", "s", p, m) for p, m in rows], "tenant_id string, segment_id string, profile_id string, matched boolean")

    state = spark.createDataFrame([], membership.STATE)
    feed = []
    for i, rows in enumerate([[("a", True), ("b", False)], [("a", True), ("b", True)], [("a", False)], [("a", True)]]):
        ahead = membership.advance(state, verdict(*rows), AT + i * HOUR)
        feed.append(sorted((r.profile_id, r.change, r.reason) for r in membership.changes(ahead).collect()))
        state = spark.createDataFrame(membership.state_of(ahead).collect(), membership.STATE)
    assert feed == [[("a", "entered", "sweep:1")], [("b", "entered", "sweep:1")], [("a", "exited", "sweep:2")], [("a", "entered", "sweep:3")]]
    rows = {r.profile_id: r for r in state.collect()}
    assert rows["a"].exited_at is None and rows["b"].last_evaluated_at == AT + HOUR


def test_masks_and_crypto(spark):
    rows = [("email", "user@example.com", "u***@example.com"), ("email", "@x", "@***"), ("email", "", ""), ("phone", "+84901234567", "+8490****567"), ("phone", "12345678", "****"), ("phone", "", ""), ("name", "Nguyen", "N***"), ("name", "", "")]
    frame = spark.createDataFrame(rows, "ns string, v string, want string")
    assert all(r[0] == r[1] for r in frame.select(scalars.mask_identifier(F.col("ns"), F.col("v")), "want").collect())
    traits = spark.createDataFrame([('{"email":"a@b","phone":"+84901234567","name":5,"x":1}',), (None,)], "t string").select(governance.masked_traits(F.col("t"))).collect()
    assert json.loads(traits[0][0]) == {"email": "a***@b", "phone": "+8490****567", "name": 5, "x": 1} and traits[1][0] is None
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    box = frame.select(scalars.sealed(F.col("v"), key).alias("b"), "v")
    assert all(r[0] == r[2] and r[1] is None for r in box.select(scalars.unsealed(F.col("b"), key), scalars.unsealed(F.col("b"), other), "v").collect())


def test_roles_and_scope(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, x int")
    assert governance.Principal("VIEWER", "a").scope(frame, "profile:read").count() == 1
    with pytest.raises(PermissionError):
        governance.Principal("VIEWER", "a").scope(frame, "profile:read", "b")
    with pytest.raises(PermissionError):
        governance.Principal("VIEWER", "a").scope(frame, "profile:delete")
    assert governance.Principal("SUPER_ADMIN").scope(frame, "pii:read", "b").first().x == 2


def test_retries(spark):
    rows = [(0, 200), (0, 429), (0, None), (4, 500), (0, 404), (3, 503)]
    frame = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate(rows)], "i int, attempt_count int, http_status int")
    got = {r.i: r for r in activation.after_send(frame, AT).collect()}
    assert [got[i].status for i in range(6)] == ["succeeded", "failed_retryable", "failed_retryable", "failed_permanent", "failed_permanent", "failed_retryable"]
    assert got[1].next_attempt_at == AT + dt.timedelta(seconds=10) and got[5].next_attempt_at == AT + dt.timedelta(seconds=80)
    delays = spark.range(1, 12).select(scalars.retry_delay_seconds(F.col("id"))).collect()
    assert [r[0] for r in delays] == [10, 20, 40, 80, 160, 320, 640, 900, 900, 900, 900]


def test_breaker(spark):
    seconds = [0, 1, 2, 3, 4, 5, 20, 34, 35, 64, 70]
    ok = [False] * 5 + [True, True, False, True, True, True]
    frame = spark.createDataFrame([("d", i, AT + dt.timedelta(seconds=s), o) for i, (s, o) in enumerate(zip(seconds, ok))], "destination_id string, seq long, sent_at timestamp, success boolean")
    got = {r.seq: r.allowed for r in activation.breaker(frame).collect()}
    assert [got[i] for i in range(11)] == [True] * 5 + [False, False, True, False, True, True]


def test_split_is_weighted(spark):
    frame = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"))
    counts = {w: frame.select(scalars.split_target(F.col("k"), [(w, 1), (1, 2)]).alias("x")).groupBy("x").count().collect() for w in (1, 99)}
    even, heavy = ({r.x: r["count"] for r in counts[w]} for w in (1, 99))
    assert set(even) == {1, 2} and heavy[1] >= 900
    n = int.from_bytes(hashlib.sha256(b"k7").digest()[:8], "big") % 2
    assert frame.filter("k = 'k7'").select(scalars.split_target(F.col("k"), [(1, 1), (1, 2)])).first()[0] == (1 if n < 1 else 2)


SEND = {"type": "send", "destination_id": "d"}


@pytest.mark.parametrize(
    "steps",
    [
        [],
        [{"type": "wait", "duration": "1d"}],
        [{"type": "nope"}, SEND],
        [{"type": "wait", "duration": "1x"}, SEND],
        [{"type": "send"}],
        [{**SEND, "next": 0, "duration": "1d"}],
        [{"type": "wait", "duration": "1d", "next": 3}, SEND],
        [{"type": "split", "branches": [{"weight": 1, "next": 1}]}, SEND],
        [{"type": "split", "branches": [{"weight": 0, "next": 1}, {"weight": 1, "next": 1}]}, SEND],
        [{"type": "condition", "condition": {"field": "event.type", "op": "exists"}, "if_true": 1, "if_false": 1}, SEND],
        [{"type": "condition", "condition": {"field": "a", "op": "exists"}, "if_true": 0, "if_false": 1}, SEND],
        [{"type": "condition", "if_true": 1, "if_false": 1}, SEND],
    ],
)
def test_bad_journeys(steps):
    with pytest.raises(RuleError):
        journeys.parse({"steps": steps})


def test_journey_waits_and_erased_profiles(spark):
    steps = journeys.parse({"steps": [{"type": "wait", "duration": "1h"}, SEND, {"type": "wait", "duration": "1d"}, SEND]})
    state = spark.createDataFrame([("t", "j", p, 0, 1, "active", 0, 0, AT) for p in ("a", "gone")], journeys.STATE)
    people = spark.createDataFrame(
        [("t", "a", "c", "{}", "{}", AT, AT)],
        "tenant_id string, profile_id string, canonical_user_id string, traits string, computed_attributes string, first_seen_at timestamp, last_seen_at timestamp",
    )
    after, sends = journeys.advance(state, steps, people, log(spark, []), AT + 2 * HOUR)
    got = {r.profile_id: r for r in after.collect()}
    assert got["gone"].status == "exited" and got["a"].current_step_index == 3 and got["a"].due_at == AT + 25 * HOUR
    assert [(r.profile_id, r.step_index, r.sent_at) for r in sends.collect()] == [("a", 1, AT + HOUR)]
    done, sends = journeys.advance(after, steps, people, log(spark, []), AT + 2 * DAY)
    assert {r.profile_id: r.status for r in done.collect()} == {"a": "completed", "gone": "exited"} and sends.count() == 1
    assert journeys.prune(done, AT + 200 * DAY).count() == 0


def test_cursor_and_pages(spark):
    frame = spark.createDataFrame([(f"{i:02d}", AT + (i // 3) * HOUR) for i in range(10)], "id string, ts timestamp")
    first = ops.keyset_page(frame, "ts", "id", 4).collect()
    assert [r.id for r in first] == ["09", "08", "07", "06", "05"]
    cursor = ops.encode_cursor(first[3].ts, first[3].id)
    assert [r.id for r in ops.keyset_page(frame, "ts", "id", 4, cursor).collect()] == ["05", "04", "03", "02", "01"]
    with pytest.raises(ValueError):
        ops.decode_cursor("%%%")


def test_retention(spark):
    frame = ops.with_week(log(spark, [-60 * DAY, -10 * DAY]))
    assert ops.retained(frame, AT, 40).count() == 1 and ops.retained(frame, AT, 98).count() == 2


def test_signed_delivery(spark):
    rows = [("k1", '{"a":1}', '{"url":"u"}'), ("k2", None, None)]
    frame = spark.createDataFrame(rows, "idempotency_key string, payload string, config string")
    signed = {r.idempotency_key: r.signature for r in sinks.sign(frame, "s").collect()}
    assert signed["k1"] == hmac.new(b"s", b'{"a":1}', hashlib.sha256).hexdigest() and signed["k2"] is None
    sent = {r.idempotency_key: r.http_status for r in sinks.deliver(frame, lambda c, k, p: 200 if c else None).collect()}
    assert sent == {"k1": 200, "k2": None}


def test_catalogs():
    segments = catalog.Segments()
    rule = {"field": "profile.traits.a", "op": "exists"}
    segments.put("t", "s1", "vip", rule, AT)
    first = segments.epoch()
    assert segments.put("t", "s1", "vip", rule, AT).number == 2 and segments.epoch() != first
    with pytest.raises(RuleError):
        segments.put("t", "s2", "vip", rule, AT)
    segments.deactivate("t", "s1", AT)
    assert segments.active("t") == {} and segments.version("t", "s1", 1).body == rule
    keys = catalog.Keys("src")
    old = keys.issue("a")
    new = keys.rotate("a")
    assert keys.owner(old) is None and keys.owner(new) == "a" and keys.owner("x") is None


def test_snapshots(spark, tmp_path):
    table = Snapshot(spark, f"file://{tmp_path}/t", "x int")
    assert table.read().count() == 0
    for i in range(4):
        table.replace(table.read().unionByName(spark.createDataFrame([(i,)], "x int")))
    assert sorted(r.x for r in table.read().collect()) == [0, 1, 2, 3]
    assert len([p for p in tmp_path.joinpath("t").iterdir() if p.name != "_versions"]) <= 3


def test_consent_merge_and_upsert(spark):
    schema = "tenant_id string, profile_id string, channel string, purpose string, status string, updated_at timestamp"
    old = spark.createDataFrame([("t", "a", "email", "m", "granted", AT), ("t", "b", "email", "m", "denied", AT - DAY)], schema)
    new = spark.createDataFrame([("t", "a", "email", "m", "unknown", AT)], schema)
    assert {r.profile_id: r.status for r in governance.set_consent(old, new).collect()} == {"a": "unknown", "b": "denied"}
    merged = spark.createDataFrame([("t", "b", "a")], "tenant_id string, profile_id string, survivor_id string")
    assert [(r.profile_id, r.status) for r in governance.merge_consent(old, merged).collect()] == [("a", "denied")]


def test_rate_limit(spark):
    rows = [("s", i, AT + dt.timedelta(milliseconds=5 * i)) for i in range(400)] + [("o", 0, AT)]
    frame = spark.createDataFrame(rows, "source_id string, seq long, received_at timestamp")
    got = {(r.source_id, r.seq): r.allowed for r in metrics.rate_limited(frame).collect()}
    bucket = metrics.Bucket()
    assert [got["s", i] for i in range(400)] == [bucket.allow(5000 * i) for i in range(400)] and got["o", 0]
    assert 190 <= sum(got["s", i] for i in range(400)) <= 201


def test_observed_counts(spark):
    rows = spark.createDataFrame([("accepted",), ("accepted",), ("duplicate",), ("conflict",)], "verdict string")
    watched, seen = metrics.observed_verdicts(rows)
    watched.collect()
    assert seen.get == {"events_received": 4, "events_accepted": 2, "events_duplicate": 1, "events_rejected": 1}


def test_destinations():
    assert activation.destination_error("webhook", {}) and activation.destination_error("ftp", {})
    assert activation.destination_error("kafka", {"topic": "x"}) is None
    assert activation.with_consent_target({"url": "u"}, "sms") == {"url": "u", "channel": "sms"}


def test_audit_ids_follow_content(spark):
    frame = spark.createDataFrame([("t", "a", "read", "r", AT, "b"), ("t", "a", "read", "r", AT, "c"), ("t", "a", "write", "r", AT, "c")], "tenant_id string, actor string, action string, resource string, created_at timestamp, body string")
    assert ops.audit_rows(frame).select("audit_id").distinct().count() == 2
