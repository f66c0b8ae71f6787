import json

import pytest
from pyspark.sql import functions as F

from meridia.sources import bus


def _rows(spark, n, parts=4):
    rows = spark.range(n).select((F.col("id") % 7).cast("string").alias("k"), "id", F.concat(F.lit("v"), "id").alias("v"))
    return rows.repartition(parts)


def _read(spark, path):
    return bus.read_topic(spark, path, "t").orderBy("batch", "partition", "file", "nth").collect()


def test_keys_stay_in_one_partition_and_in_order(spark, tmp_path):
    path = f"file://{tmp_path}/bus"
    bus.create_topic(path, "t", 3)
    bus.create_topic(path, "t", 99)  # is there already
    assert bus.read_topic(spark, path, "t").count() == 0
    bus.publish(_rows(spark, 100), path, "t", "k", "v", ["id"])
    got = _read(spark, path)
    assert sorted(int(r.value[1:]) for r in got) == list(range(100)) and {r.partition for r in got} <= {0, 1, 2}
    for k in map(str, range(7)):
        mine = [r for r in got if r.key == k]
        assert len({(r.partition, r.file) for r in mine}) == 1
        assert [int(r.value[1:]) for r in mine] == sorted(int(r.value[1:]) for r in mine)


def test_a_failed_task_leaves_nothing_published(spark, tmp_path):
    path = f"file://{tmp_path}/bus"
    bus.create_topic(path, "t")
    broken = _rows(spark, 50).withColumn("v", F.when(F.col("id") == 33, F.raise_error("boom")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="boom"):
        bus.publish(broken, path, "t", "k", "v", ["id"])
    assert bus.read_topic(spark, path, "t").count() == 0
    bus.publish(_rows(spark, 50), path, "t", "k", "v", ["id"])
    assert bus.read_topic(spark, path, "t").count() == 50


def test_a_missing_topic_fails_for_good(spark, tmp_path):
    with pytest.raises(bus.MissingTopic):
        bus.publish(_rows(spark, 5), f"file://{tmp_path}/bus", "none", "k", "v", ["id"])
    spark.dataSource.register(bus.Topics)
    with pytest.raises(Exception, match="topic none does not exist"):
        _rows(spark, 5).selectExpr("k key", "v value").write.format("topics").mode("append").option("path", f"file://{tmp_path}/bus").option("topic", "none").save()


def test_a_stream_publishes_each_batch_once(spark, tmp_path):
    path = f"file://{tmp_path}/bus"
    bus.create_topic(path, "t", 2)
    spark.dataSource.register(bus.Topics)
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        sink = stream.writeStream.format("topics").option("path", path).option("topic", "t").option("checkpointLocation", f"file://{tmp_path}/ck")
        sink.trigger(availableNow=True).start().awaitTermination()

    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"key": f"k{i}", "value": f"{k}-{i}"}) for i in range(5)))
    run()
    want = sorted(f"{k}-{i}" for k in range(2) for i in range(5))
    assert sorted(r.value for r in _read(spark, path)) == want
    # The last batch runs again: its commit is lost to the stream, not to the topic.
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert sorted(r.value for r in _read(spark, path)) == want
