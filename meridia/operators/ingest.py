"""Event ingress: parsing, normalisation, validation, keys, hashes and duplicate verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rfc3339, rfc3339_text, sha256_of, trimmed

#: Ingress limits, and identifiers by priority.
MAX_EVENT_BYTES = 64 * 1024
MAX_BATCH_EVENTS = 500
MAX_BATCH_BYTES = 5 * 1024 * 1024
IDENTIFIERS = ("user_id", "anonymous_id", "email", "phone", "external_id", "device_id")
_TEXTS = ("event_id", "type", "event_name", "previous_id", "timestamp", *IDENTIFIERS)
INCOMING = ", ".join(f"{c} string" for c in (*_TEXTS, "context", "properties", "traits"))


def parse_bodies(raw: DataFrame, column: str = "body") -> DataFrame:
    """JSON bodies as incoming events; ``_bad`` marks what is too large or no object."""
    parsed = F.from_json(F.col(column), INCOMING, {"mode": "PERMISSIVE"})
    shape = F.schema_of_variant(F.try_parse_json(F.col(column)))
    bad = (
        F.when(F.octet_length(column) > MAX_EVENT_BYTES, "payload too large")
        .when(~F.coalesce(F.startswith(shape, F.lit("OBJECT")), F.lit(False)), "invalid JSON")
    )
    rest = [c for c in raw.columns if c != column]
    return raw.select(*rest, F.col(column).alias("raw"), parsed.alias("_in"), bad.alias("_bad")).select(*rest, "raw", "_bad", "_in.*")


def normalize(incoming: DataFrame, forced_type: str | None = None) -> DataFrame:
    """Canonical envelopes.  ``incoming`` has tenant_id, source_id, received_at and the texts of an event.

    A missing event_id is derived from tenant, content and arrival, so a rerun
    gives the same one.  ``error`` holds the first complaint, or null.
    """
    clean = {c: trimmed(F.col(c)) for c in _TEXTS}
    df = incoming.withColumns(clean).withColumn("email", F.lower("email"))
    kind = F.lit(forced_type) if forced_type else F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("track"))
    given = F.col("timestamp") != ""
    client = rfc3339(F.col("timestamp"))
    df = df.withColumns(
        {
            "type": kind,
            "ts_provided": given,
            "_client": client,
            "_bad_time": given & client.isNull(),
        }
    )
    df = df.withColumns(
        {
            "payload_hash": payload_hash(),
            "timestamp": F.coalesce("_client", "received_at"),
        }
    )
    made = F.concat(F.lit("evt_"), F.substring(sha256_of(F.col("tenant_id"), F.col("payload_hash"), F.col("received_at").cast("string")), 1, 32))
    df = df.withColumn("event_id", F.when(F.col("event_id") == "", made).otherwise(F.col("event_id")))
    df = df.withColumn("identifier_key", identifier_key()).withColumn("partition_key", F.concat_ws("|", "tenant_id", "identifier_key"))
    error = F.when(F.col("_bad_time"), "timestamp: must be RFC3339").otherwise(complaint())
    return df.withColumn("error", error).drop("_client", "_bad_time")


def identifier_key() -> Column:
    """The first identifier by priority, hashed where it is personal; device ids don't count."""

    def has(c: str) -> Column:
        return F.col(c) != ""

    return (
        F.when(has("user_id"), F.concat(F.lit("user_id:"), "user_id"))
        .when(has("anonymous_id"), F.concat(F.lit("anonymous_id:"), "anonymous_id"))
        .when(has("email"), F.concat(F.lit("email:"), F.sha2("email", 256)))
        .when(has("phone"), F.concat(F.lit("phone:"), F.sha2("phone", 256)))
        .when(has("external_id"), F.concat(F.lit("external_id:"), "external_id"))
        .otherwise(F.concat(F.lit("event_id:"), "event_id"))
    )


def payload_hash() -> Column:
    """A hash of what the client sent: not of arrival, source or event_id, and of the time only if it was given."""
    ids = F.struct(*(F.col(c) for c in IDENTIFIERS))
    parts = F.struct(
        "type", "event_name", ids.alias("identifiers"), "previous_id", rfc3339_text(F.col("_client")).alias("timestamp"), "context", "properties", "traits"
    )
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def complaint() -> Column:
    """The first rule that an envelope breaks, or null."""
    any_id = F.greatest(*(F.col(c) != "" for c in IDENTIFIERS))
    kind = F.col("type")
    return (
        F.when((kind == "track") & (F.col("event_name") == ""), "event_name: required for track events")
        .when((kind == "track") & ~any_id, "identifiers: at least one identifier is required")
        .when(
            (kind == "identify") & (F.col("user_id") == "") & (F.col("anonymous_id") == ""),
            "identifiers: identify requires user_id or anonymous_id",
        )
        .when((kind == "alias") & (F.col("previous_id") == ""), "previous_id: required for alias events")
        .when((kind == "alias") & (F.col("user_id") == ""), "user_id: required for alias events")
        .when(~kind.isin("track", "identify", "alias"), F.concat(F.lit('type: unknown type "'), kind, F.lit('"')))
    )


def verdicts(envelopes: DataFrame) -> DataFrame:
    """accepted, duplicate, conflict or rejected for every envelope.

    Of one (tenant, event_id) the first by arrival is accepted; later ones are
    duplicates if their payload hash is the same.  Rejected rows don't take part.
    """
    first = Window.partitionBy("tenant_id", "event_id", "_ok").orderBy("received_at", "arrival")
    df = envelopes.withColumn("_ok", F.col("error").isNull())
    df = df.withColumns({"_rn": F.row_number().over(first), "_first": F.first("payload_hash").over(first)})
    verdict = (
        F.when(~F.col("_ok"), "rejected")
        .when(F.col("_rn") == 1, "accepted")
        .when(F.col("payload_hash") == F.col("_first"), "duplicate")
        .otherwise("conflict")
    )
    return df.withColumn("verdict", verdict).drop("_ok", "_rn", "_first")


def accepted(envelopes: DataFrame) -> DataFrame:
    return verdicts(envelopes).filter("verdict = 'accepted'").drop("verdict", "error")


def batch_counts(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per ingested batch: how many events were accepted, duplicates and rejected."""
    v = F.col("verdict")
    return rows.groupBy(batch).agg(
        F.count_if(v == "accepted").alias("accepted"),
        F.count_if(v == "duplicate").alias("duplicates"),
        F.count_if(v.isin("rejected", "conflict")).alias("rejected"),
    )


def batch_errors(rows: DataFrame, batch: str = "batch_id", size: str = "raw") -> DataFrame:
    """Batches that break a limit: empty, too many events, or too many bytes."""
    per = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("events"), F.sum(F.octet_length(size)).alias("bytes"))
    return per.filter((F.col("events") > MAX_BATCH_EVENTS) | (F.col("bytes") > MAX_BATCH_BYTES))


def raw_store(events: DataFrame) -> DataFrame:
    """One raw row per (tenant, event_id): the first that arrived, with a hash of its exact bytes."""
    first = Window.partitionBy("tenant_id", "event_id").orderBy("received_at", "arrival")
    rows = events.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    return rows.withColumn("raw_hash", F.sha2(F.col("raw").cast("binary"), 256))


def split_dead_letters(raw: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(rows with a JSON body, dead letters).  A dead body is kept as a JSON string, an empty one as null."""
    ok = F.try_parse_json(F.col(column)).isNotNull()
    body = F.when(F.coalesce(F.col(column), F.lit("")) == "", "null").otherwise(F.to_json(F.array(F.col(column))))
    body = F.when(body == "null", body).otherwise(F.substring(body, 2, F.char_length(body) - 2))
    good = raw.filter(F.coalesce(ok, F.lit(False)))
    dead = raw.filter(~F.coalesce(ok, F.lit(False)))
    return good, dead.withColumns({"payload": body, "status": F.lit("open"), "error": F.lit("invalid JSON")})


def payload() -> Column:
    """An envelope as the JSON that is stored and published."""
    ids = F.struct(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in IDENTIFIERS))
    return F.to_json(
        F.struct(
            "event_id", "tenant_id", "source_id", "type", "event_name", ids.alias("identifiers"),
            F.nullif(F.col("previous_id"), F.lit("")).alias("previous_id"), rfc3339_text(F.col("timestamp")).alias("timestamp"),
            rfc3339_text(F.col("received_at")).alias("received_at"), F.try_parse_json("context").alias("context"),
            F.try_parse_json("properties").alias("properties"), F.try_parse_json("traits").alias("traits"),
        )
    )
