import random

from meridia.operators import relay

SCHEMA = "id string, created_at long, status string, partition_key string, payload string"


def _rows(n):
    rng = random.Random(5)
    return [(f"r{i}", rng.randrange(50), rng.choice(["pending"] * 4 + ["published"]), rng.choice("aab"), str(rng.random() < 0.8)) for i in range(n)]


def test_the_longest_sent_prefix_of_a_key_is_committed(spark, tmp_path):
    rows = _rows(120)
    picked = relay.claimed(spark.createDataFrame(rows, SCHEMA), 60)
    oldest = sorted((r for r in rows if r[2] == "pending"), key=lambda r: (r[1], r[0]))[:60]
    assert [r.id for r in picked.collect()] == [r[0] for r in oldest]
    folder = str(tmp_path)

    def send(key, value):
        with open(f"{folder}/{key}", "a") as f:
            f.write("x")
        if value == "False":
            raise OSError(key)
        return True

    sent = relay.checkpointed(relay.sent(picked.drop("status"), send))
    got = {r.id: r.status for r in relay.committed(sent, ["partition_key"]).collect()}
    for key in "ab":
        mine = [r for r in oldest if r[3] == key]
        stop = next((i for i, r in enumerate(mine) if r[4] == "False"), len(mine))
        assert [got[r[0]] for r in mine] == ["published"] * stop + ["pending"] * (len(mine) - stop)
        assert len((tmp_path / key).read_text()) == min(stop + 1, len(mine))  # nothing is sent behind a failure


def test_one_order_without_keys(spark):
    rows = spark.createDataFrame([("a", 1, True), ("b", 1, None), ("c", 0, True), ("d", 2, True)], "id string, created_at long, ok boolean")
    assert {r.id: r.status for r in relay.committed(rows, []).collect()} == {"c": "published", "a": "published", "b": "pending", "d": "pending"}
    assert relay.committed(rows.limit(0), []).count() == 0
