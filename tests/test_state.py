import datetime as dt

from meridia.streaming import state

AT = dt.datetime(2026, 6, 10, 12)
LOG = "tenant_id string, profile_id string, event_id string, event_name string, occurred_at timestamp, props string"


def test_profiles_expire_after_their_last_event(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hour = dt.timedelta(hours=1)
    batches = [
        [("a", 0), ("b", 0), ("a", 1)],
        [("b", 3), ("late", 2)],
        [("other", 40)],
        [("other", 80)],
    ]
    path = tmp_path / "log"
    path.mkdir()
    query = state.expiring(spark.readStream.schema(LOG).parquet(f"file://{path}"), "view", "6h")
    work = query.writeStream.format("memory").queryName("expired").outputMode("append").start()
    try:
        for i, rows in enumerate(batches):
            made = [("t", p, f"e{i}", "view", AT + h * hour, "{}") for p, h in rows]
            spark.createDataFrame(made, LOG).coalesce(1).write.mode("append").parquet(f"file://{path}")
            work.processAllAvailable()
    finally:
        work.stop()
    got = {(r.profile_id, r.last_at, r.due_at) for r in spark.table("expired").collect()}
    want = {(p, AT + h * hour, AT + (h + 6) * hour) for p, h in (("a", 1), ("b", 3), ("late", 2))}
    assert want <= got and {p for p, *_ in got - want} <= {"other"}
