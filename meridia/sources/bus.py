"""Topics of keyed messages in a shared store, written and read through a Spark data source.

A topic is a folder with a description that fixes its partitions.  A task stages its
messages; when all tasks have succeeded, one commit file names the staged files, and only
named files are read.  So a failed task leaves nothing published, and a streaming batch
that runs again replaces nothing: its commit is there already.  The messages of a key go
to one partition; a commit's files keep each writer task's order, so ``publish`` first
brings a key's rows together and in order.

    spark.dataSource.register(bus.Topics)
    bus.create_topic("file:///shared/bus", "events")
    rows.writeStream.format("topics").option("path", ...).option("topic", "events")...

A missing topic fails for good (``MissingTopic``), before anything is written.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

PARTITIONS = 6
MESSAGES = "topic string, partition int, batch string, file string, nth long, key string, value string"


class MissingTopic(ValueError):
    """The topic doesn't exist: no retry helps."""


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(path)
    return fs, root.rstrip("/")


def _description(path: str, topic: str) -> dict:
    fs, root = _open(path)
    place = f"{root}/{topic}/topic.json"
    if fs.get_file_info(place).type != pafs.FileType.File:
        raise MissingTopic(f"topic {topic} does not exist")
    with fs.open_input_stream(place) as f:
        return json.loads(f.read())


def create_topic(path: str, topic: str, partitions: int = PARTITIONS) -> None:
    """Create a topic unless it is there; its partitions stay as they were."""
    fs, root = _open(path)
    fs.create_dir(f"{root}/{topic}", recursive=True)
    place = f"{root}/{topic}/topic.json"
    if fs.get_file_info(place).type != pafs.FileType.File:
        _put(fs, place, json.dumps({"partitions": partitions}))


def _put(fs: pafs.FileSystem, place: str, text: str) -> None:
    """Write a file that readers see whole or not at all."""
    draft = f"{place}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(text.encode())
    fs.move(draft, place)


@dataclass
class Staged(WriterCommitMessage):
    """(partition, file, messages) that a task has staged."""

    files: list[tuple[int, str, int]]


class _Writer:
    def __init__(self, options: dict[str, str], batch: str):
        self.path, self.topic, self.run = options["path"], options["topic"], batch
        self.partitions = _description(self.path, self.topic)["partitions"]

    def _stage(self, batches: Iterator) -> Staged:
        fs, root = _open(self.path)
        context = TaskContext.get()
        name = f"{self.run}-{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/{self.topic}/files", recursive=True)
        open_, counts = {}, {}
        try:
            for batch in batches:
                for key, value in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist()):
                    p = zlib.crc32((key or "").encode()) % self.partitions
                    if p not in open_:
                        open_[p] = fs.open_output_stream(f"{root}/{self.topic}/files/{name}-{p}.json")
                    open_[p].write((json.dumps({"nth": counts.get(p, 0), "key": key, "value": value}) + "\n").encode())
                    counts[p] = counts.get(p, 0) + 1
        finally:
            for f in open_.values():
                f.close()
        return Staged([(p, f"{name}-{p}.json", n) for p, n in sorted(counts.items())])

    def _commit(self, messages: list, batch: str) -> None:
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/{self.topic}/commits", recursive=True)
        place = f"{root}/{self.topic}/commits/{batch}.json"
        if fs.get_file_info(place).type == pafs.FileType.File:  # the batch was published by its first run
            return self._abort(messages)
        files = [f for m in messages if m is not None for f in m.files]
        _put(fs, place, "\n".join(json.dumps({"partition": p, "file": f, "messages": n}) for p, f, n in files))

    def _abort(self, messages: list) -> None:
        fs, root = _open(self.path)
        for _, file, _ in (f for m in messages if m is not None for f in m.files):
            place = f"{root}/{self.topic}/files/{file}"
            if fs.get_file_info(place).type == pafs.FileType.File:
                fs.delete_file(place)


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def write(self, iterator: Iterator) -> Staged:
        return self._stage(iterator)

    def commit(self, messages: list) -> None:
        self._commit(messages, self.run)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def write(self, iterator: Iterator) -> Staged:
        return self._stage(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"{self.run}-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._abort(messages)


class Topics(DataSource):
    """Sink ``topics`` with the options path, topic and, for streams, writer: a name that tells their commits apart."""

    @classmethod
    def name(cls) -> str:
        return "topics"

    def schema(self) -> str:
        return "key string, value string"

    def writer(self, schema, overwrite: bool) -> _BatchWriter:
        return _BatchWriter(dict(self.options), f"batch-{uuid.uuid4().hex}")

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(dict(self.options), self.options.get("writer", "stream"))


def publish(rows: DataFrame, path: str, topic: str, key: str, value: str, order: list[str]) -> None:
    """Publish rows as one commit, each key's rows in order."""
    rows.sparkSession.dataSource.register(Topics)
    many = _description(path, topic)["partitions"]
    made = rows.select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"), F.struct(*order).alias("_order"))
    dealt = made.repartition(many, "key").sortWithinPartitions("key", "_order").select("key", "value")
    dealt.write.format("topics").mode("append").option("path", path).option("topic", topic).save()


def read_topic(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """The published messages of a topic: MESSAGES."""
    _description(path, topic)
    place = f"{path.rstrip('/')}/{topic}"
    fs, root = _open(place)
    if fs.get_file_info(f"{root}/commits").type != pafs.FileType.Directory:
        return spark.createDataFrame([], MESSAGES)
    commits = spark.read.schema("partition int, file string, messages long").json(f"{place}/commits/*.json")
    commits = commits.select("partition", "file", F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.json$", 1).alias("batch"))
    rows = spark.read.schema("nth long, key string, value string").json(f"{place}/files")
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    return rows.join(commits, "file").select(F.lit(topic).alias("topic"), "partition", "batch", "file", "nth", "key", "value")
