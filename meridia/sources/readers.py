"""Readers of client events: HTTP bodies landed as files, batch envelopes, and raw JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest

#: What the edge writes per request: who sent it, when it arrived, and the exact body.
LANDED = "tenant_id string, source_id string, endpoint string, received_at timestamp, arrival long, body string"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Requests landed as JSON lines."""
    return spark.read.schema(LANDED).json(path)


def landed_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream; a trigger takes a bounded number of files."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_trigger).json(path)


def single_events(requests: DataFrame) -> DataFrame:
    """Track, identify and alias requests: the endpoint decides the type.

    ``arrival`` is on the scale of batches, so that both kinds stand in one order.
    """
    rows = requests.filter(F.col("endpoint").isin("track", "identify", "alias"))
    rows = rows.withColumn("arrival", F.col("arrival") * ingest.MAX_BATCH_EVENTS)
    parsed = ingest.parse_bodies(rows)
    out = ingest.normalize(parsed.withColumn("type", F.col("endpoint")).drop("endpoint"))
    return out.withColumn("error", F.coalesce("_bad", "error")).drop("_bad")


def batch_events(requests: DataFrame) -> DataFrame:
    """Batch requests, one row per event with ``batch_id`` and ``position``.

    A batch over its limits is rejected as a whole, with its body, one bad event on its own.
    """
    rows = requests.filter("endpoint = 'batch'").withColumn("batch_id", F.col("arrival"))
    events = F.try_variant_get(F.try_parse_json("body"), "$.events", "array<variant>")
    n = F.size(events)
    bad = (
        F.when(F.octet_length("body") > ingest.MAX_BATCH_BYTES, "batch too large")
        .when(events.isNull() | (n == 0), "batch requires events")
        .when(n > ingest.MAX_BATCH_EVENTS, "too many events")
    )
    rows = rows.withColumns({"_batch_bad": bad, "_events": F.when(bad.isNull(), events)})
    flat = rows.select(
        "tenant_id", "source_id", "received_at", "batch_id", "_batch_bad", F.when(F.col("_batch_bad").isNotNull(), F.col("body")).alias("_whole"),
        F.posexplode_outer("_events").alias("position", "_event"),
    ).withColumn("body", F.coalesce(F.to_json("_event"), "_whole", F.lit("{}"))).drop("_whole")
    flat = flat.withColumn("arrival", F.col("batch_id") * ingest.MAX_BATCH_EVENTS + F.coalesce("position", F.lit(0))).drop("_event")
    out = ingest.normalize(ingest.parse_bodies(flat))
    return out.withColumn("error", F.coalesce("_batch_bad", "_bad", "error")).drop("_bad", "_batch_bad")
