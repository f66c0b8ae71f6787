import random

from meridia.operators import prefix


def test_two_level_running_sums(spark):
    rng = random.Random(1)
    rows = [(k, at, rng.randrange(9)) for k in "ab" for at in rng.sample(range(-500, 500), 300)]
    got = prefix.ahead(spark.createDataFrame(rows, "k string, at long, n long"), ["k"], "at", "n", "out", 16).collect()
    assert all(r.out == sum(n for k, at, n in rows if k == r.k and at < r["at"]) for r in got) and len(got) == 600


def test_values_before_a_row(spark):
    rng = random.Random(3)
    keys = ["hot"] * 8 + ["a", "b"]
    rows = [(rng.choice(keys), rng.randrange(200), i, rng.choice([None, rng.randrange(9)])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at long, i long, v long")
    v = prefix.F.col("v")
    got = prefix.before(df, ["k"], ["at", "i"], {"l": ("last", v), "lo": ("min", v), "hi": ("max", v), "s": ("sum", v)}).collect()
    assert len(got) == len(rows)
    for r in got:
        past = [x for k, at, i, x in sorted(rows, key=lambda r: r[1:3]) if k == r.k and (at, i) < (r["at"], r.i) and x is not None]
        want = (past[-1], min(past), max(past), sum(past)) if past else (None,) * 4
        assert (r.l, r.lo, r.hi, r.s) == want
    assert prefix.before(df.limit(0), ["k"], ["at"], {"l": ("last", v)}).count() == 0


def test_trailing_windows_in_slices(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xxxy"), rng.randrange(-3000, 3000)) for _ in range(700)] + [("x", 100 * i) for i in range(-30, 30)]
    df = spark.createDataFrame(rows, "k string, at long")
    for widths in (1, 3, 10):
        got = prefix.recent(df, ["k"], "at", 100, "n", widths).collect()
        assert sorted((r.k, r["at"], r.n) for r in got) == sorted((k, at, sum(1 for x, t in rows if x == k and at - 100 < t <= at)) for k, at in rows)


def test_one_hot_key_spreads_over_tasks(spark):
    df = spark.range(4000).selectExpr("if(id % 10 = 0, 'x', 'hot') k", "id at", "id % 7 v")
    out = prefix.before(df, ["k"], ["at"], {"s": ("sum", prefix.F.col("v"))}).filter("k = 'hot'")
    assert out.select(prefix.F.spark_partition_id().alias("p")).distinct().count() > 1
    plan = prefix.recent(df, ["k"], "at", 10, "n")._jdf.queryExecution().executedPlan().toString()
    assert "_slice#" in plan.split("hashpartitioning(k#")[1][:60]
