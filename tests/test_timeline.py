import datetime as dt
import random
from collections import defaultdict
from pathlib import Path

import pytest

from meridia.operators import identity, profiles
from meridia.sources.storage import shared_folder

from replay import replayed
from test_operators import AT, HOUR, envelopes


def _events(seed, n, devices, users):
    """Events whose identifiers meet sooner or later; times run ahead and back."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ids = {"device_id": f"d{rng.randrange(devices)}"}
        if rng.random() < 0.45:
            ids["user_id"] = f"u{rng.randrange(users)}"
        if rng.random() < 0.15:
            ids["email"] = f"m{rng.randrange(users)}@x.org"
        rows.append(
            ids
            | {"tenant_id": rng.choice("xy"), "event_name": rng.choice(["order_completed", "product_viewed", "seen"]), "source_id": f"s{i % 5}"}
            | {"traits": rng.choice([{}, {"name": f"n{i}"}, {"country": f"c{i}"}]), "context": rng.choice([{}, {"page": {"url": f"u{i}"}}])}
            | {"properties": {"product_id": f"p{i}"}, "timestamp": AT + rng.randrange(-40, 40) * HOUR, "received_at": AT + (i // 2) * HOUR}
        )
    return rows + [{"tenant_id": "x"}]


@pytest.mark.parametrize("seed, n, devices, users", [(1, 120, 30, 12), (2, 150, 40, 20)])
def test_merges_and_profiles_are_those_of_a_replay(spark, seed, n, devices, users):
    events = envelopes(spark, _events(seed, n, devices, users)).cache()
    ids = identity.extract(events)
    members = identity.resolve(ids)
    seen = profiles.observed(events)
    nodes = defaultdict(set)
    for r in ids.collect():
        nodes[r.tenant_id, r.event_id].add(r.node_id)
    rows = [type("Row", (), r.asDict() | {"nodes": nodes[r.tenant_id, r.event_id]}) for r in seen.orderBy("received_at", "event_id").collect()]
    want, merges, homes = replayed(rows)
    history = identity.merge_history(ids, members).collect()
    assert {tuple(r)[:4] for r in history} == merges and len(history) == len(merges) > 5
    feed = {(r.tenant_id, r.event_id): (r.cluster_id, tuple(r.merged_canonical_user_ids)) for r in identity.resolved_feed(ids, members).collect()}
    assert feed == homes
    got = profiles.exact_fold(seen, *identity.timeline(ids, members)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_long_chain_of_merges(spark):
    """Every event merges one more cluster, each older than the last survivor: a line dies each time."""
    n = 9
    rows = [{"device_id": f"d{i}", "traits": {"name": f"n{i}"}} for i in range(n)]
    rows += [{"device_id": f"d{i}", "user_id": "u", "event_name": "seen"} for i in reversed(range(n))]
    events = envelopes(spark, rows)
    ids = identity.extract(events)
    history = {(r.from_cluster_id, r.to_cluster_id, r.event_id) for r in identity.merge_history(ids, identity.resolve(ids)).collect()}
    assert history == {(f"c_e{i + 1}", f"c_e{i}", f"e{n + n - 1 - i}") for i in range(n - 1)}


def test_no_events(spark):
    events = envelopes(spark, [{"user_id": "u"}]).limit(0)
    ids = identity.extract(events)
    members = identity.resolve(ids)
    assert identity.resolved_feed(ids, members).count() == 0 == identity.merge_history(ids, members).count()
    assert profiles.exact_fold(profiles.observed(events), *identity.timeline(ids, members)).count() == 0


def test_updates_count_versions(spark):
    events = envelopes(spark, [{"user_id": "u", "traits": {"name": x}, "timestamp": AT - dt.timedelta(days=i)} for i, x in enumerate("aab")])
    ids = identity.extract(events)
    rows = profiles.updated_feed(profiles.observed(events), identity.event_clusters(ids, identity.resolve(ids))).orderBy("profile_version").collect()
    assert [r.profile_version for r in rows] == [1, 2, 3] and {r.canonical_user_id for r in rows} == {"customer_e0"}
    assert ["traits.name" in r.changed_fields for r in rows] == [True, False, True]


def test_a_hub_takes_few_jobs(spark, monkeypatch):
    """However many clusters meet at one device, the driver plans as many steps; each used to add to a round's."""
    made, real = [], type(spark.range(0)).checkpoint
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda self, *a, **b: made.append(1) or real(self, *a, **b))
    n = 40
    rows = [{"user_id": f"u{i}"} for i in range(n)] + [{"user_id": f"u{i * 7 % n}", "device_id": "d"} for i in range(n)]
    history = identity.merge_history(identity.extract(envelopes(spark, rows)), None).collect()
    assert len(history) == n - 1 and {r.to_cluster_id for r in history} == {"c_e0"}
    assert len(made) < 25


def _hub(spark, n):
    rows = [{"user_id": f"u{i}", "traits": {"name": f"n{i}"}} for i in range(n)]
    rows += [{"user_id": f"u{i * 7 % n}", "device_id": "d", "event_name": "order_completed"} for i in range(n)]
    return envelopes(spark, rows).cache()


def test_exact_profiles_of_a_hub_take_few_steps(spark, monkeypatch):
    made, real = [], type(spark.range(0)).checkpoint
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda self, *a, **b: made.append(1) or real(self, *a, **b))
    events = _hub(spark, 40)
    got = profiles.exact_fold(profiles.observed(events), *identity.timeline(identity.extract(events))).collect()
    assert [(r.cluster_id, r.trait_name, r.last_event_name, r.total_events, r.total_orders) for r in got] == [("c_e0", "n0", "order_completed", 80, 40)]
    assert len(made) < 50


def test_exact_fold_leaves_no_event_rows(spark):
    """The events with all their values are dropped once they are folded; only the timeline, which the caller may read again, stays."""
    events = _hub(spark, 4)
    past = set(map(str, Path(shared_folder(spark).removeprefix("file:")).glob("kept-*")))
    out = profiles.exact_fold(profiles.observed(events), *identity.timeline(identity.extract(events)))
    assert out.count() == 1
    left = [p for p in Path(shared_folder(spark).removeprefix("file:")).glob("kept-*") if str(p) not in past]
    assert len(left) == 1


def test_feed_of_a_hub_takes_few_steps(spark, monkeypatch):
    made, real = [], type(spark.range(0)).checkpoint
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda self, *a, **b: made.append(1) or real(self, *a, **b))
    rows = identity.resolved_feed(identity.extract(_hub(spark, 40))).collect()
    assert len(rows) == 80 and sum(r.merge_occurred for r in rows) == 39
    assert {r.cluster_id for r in rows if int(r.event_id[1:]) >= 40} == {"c_e0"}
    assert len(made) < 30
