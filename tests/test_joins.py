import pytest
from pyspark.sql import functions as F

from meridia.operators import joins
from meridia.operators.graph import connected_components
from meridia.sources import storage


@pytest.mark.parametrize("rows", [100, 3, 0])
@pytest.mark.parametrize("how", ["left", "inner", "anti"])
def test_attach_equals_a_plain_join(spark, monkeypatch, rows, how):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", max(rows, 1))
    keys = ["hot"] * 60 + [f"k{i % 11}" for i in range(50)] + ["none", None]
    left = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    right = left.filter("key <> 'none'").groupBy("key").agg(F.count("id").alias("n"), F.max("id").alias("top"))
    if rows == 0:
        right = right.limit(0)
    got = joins.attach(left, storage.checkpointed(right), ["key"], "n", F.col("id"), how)
    plain = left.join(right.drop("n"), "key", {"anti": "left_anti"}.get(how, how)).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_small_enough_counts_rows_and_texts(spark):
    df = spark.createDataFrame([("x" * 100,)] * 10, "t string")
    assert joins.small_enough(df, 1640, "t") and not joins.small_enough(df, 1639, "t") and joins.small_enough(df.limit(0), 0)


def test_rounds_of_components_leave_one_checkpoint(spark, tmp_path):
    old = spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    try:
        assert {r.root for r in connected_components(edges).collect()} == {0}
        assert len(list(tmp_path.glob("*/rdd-*"))) == 1
    finally:
        if old.isDefined():
            spark.sparkContext.setCheckpointDir(old.get())
