"""Keyed state of streams.

``remembered`` knows every event id that was accepted, with the hash of its content, at
any age.  ``expiring`` emits a profile's verdict that expires without an event when it
does: its state is one number per (tenant, profile), and one timer.  Expiry follows the
watermark, so a replayed stream emits the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ingest
from ..plans.rules import parse_window
from ..sources import readers

#: What a stream carries of an event: the envelope without its cluster, and the exact body or what is wrong with it.
EVENT = (
    "tenant_id string, source_id string, event_id string, type string, event_name string, "
    + ", ".join(f"{c} string" for c in ingest.IDENTIFIERS)
    + ", previous_id string, timestamp timestamp, received_at timestamp, arrival long, context string, properties string, "
    "traits string, payload_hash string, identifier_key string, raw string, error string"
)
_EVENT = [x.split()[0] for x in EVENT.split(", ")]
#: Groups that event ids are dealt out to; a batch calls a task's Python once for each that it touches.
ID_GROUPS = 1 << 12


def envelopes(requests: DataFrame) -> DataFrame:
    """The events of landed requests, a batch or a stream, good ones and bad ones."""
    made = readers.single_events(requests).unionByName(readers.batch_events(requests), allowMissingColumns=True)
    return made.select(*_EVENT)


class Remembered(StatefulProcessor):
    """Adds the hash that an event's id was stored with before the batch, and stores the hashes of new ids.

    Of a new id that repeats in the batch, the first by arrival counts.  Memory holds the
    ids of a group in one batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getMapState("hashes", "tenant_id string, event_id string", "payload_hash string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for tenant, event, made in initialState[["tenant_id", "event_id", "payload_hash"]].itertuples(index=False):
            self.hashes.updateValue((tenant, event), (made,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: dict[tuple, str | None] = {}
        first: dict[tuple, tuple] = {}
        for pdf in rows:
            stored = []
            for tenant, event, error, at, arrival, made in pdf[["tenant_id", "event_id", "error", "received_at", "arrival", "payload_hash"]].itertuples(index=False):
                if isinstance(error, str):  # a null is None or NaN
                    stored.append(None)
                    continue
                name = (tenant, event)
                if name not in held:
                    found = self.hashes.getValue(name)
                    held[name] = found[0] if found is not None else None
                if held[name] is None and (name not in first or (at, arrival) < first[name][:2]):
                    first[name] = (at, arrival, made)
                stored.append(held[name])
            yield pdf[_EVENT].assign(stored_hash=pd.Series(stored, index=pdf.index, dtype=object))
        for name, (*_, made) in first.items():
            self.hashes.updateValue(name, (made,))

    def close(self) -> None:
        pass


def remembered(events: DataFrame, known: DataFrame, groups: int = ID_GROUPS) -> DataFrame:
    """A stream of ``envelopes`` with ``stored_hash``, null for an id that was never accepted before the batch.

    ``known`` (tenant_id, event_id, payload_hash) is what was accepted before the stream began.
    The session needs the RocksDB state store.
    """
    group = F.pmod(F.xxhash64("tenant_id", "event_id"), F.lit(groups)).cast("int")
    # What can't be read has no id, and is spread by what was sent.
    spread = F.pmod(F.xxhash64("tenant_id", "raw", "arrival"), F.lit(groups)).cast("int")
    rows = events.withColumn("id_group", F.when(F.col("error").isNull(), group).otherwise(spread))
    return rows.groupBy("id_group").transformWithStateInPandas(
        statefulProcessor=Remembered(),
        outputStructType=f"{EVENT}, stored_hash string",
        outputMode="Append",
        timeMode="None",
        initialState=known.withColumn("id_group", group).groupBy("id_group"),
    )

EXPIRED = "tenant_id string, profile_id string, last_at timestamp, due_at timestamp"


class Expiry(StatefulProcessor):
    """Emits a profile when ``span`` microseconds have passed since its last event."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def _millis(self, us: int) -> int:
        # A window is closed: it is over strictly after the due time.
        return (us + self.span) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pdf["us"].max()) for pdf in rows)
        held = self.last.get()[0] if self.last.exists() else None
        if held is None or newest > held:
            if held is not None:
                self.handle.deleteTimer(self._millis(held))
            self.last.update((newest,))
            self.handle.registerTimer(self._millis(newest))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame(
            {
                "tenant_id": [key[0]],
                "profile_id": [key[1]],
                "last_at": [pd.Timestamp(us, unit="us")],
                "due_at": [pd.Timestamp(us + self.span, unit="us")],
            }
        )

    def close(self) -> None:
        pass


def expiring(log: DataFrame, event: str, window: str, lateness: str = "1 hour") -> DataFrame:
    """(tenant, profile, last_at, due_at) whenever a profile has had no ``event`` for ``window``.

    ``log`` is a stream; the session needs the RocksDB state store.
    """
    rows = log.filter(F.col("event_name") == event).withWatermark("occurred_at", lateness)
    rows = rows.select("tenant_id", "profile_id", "occurred_at", F.unix_micros("occurred_at").alias("us"))
    return rows.groupBy("tenant_id", "profile_id").transformWithStateInPandas(
        statefulProcessor=Expiry(parse_window(window)), outputStructType=EXPIRED, outputMode="Append", timeMode="EventTime"
    )
