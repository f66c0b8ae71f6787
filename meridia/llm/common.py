"""Shared helpers: shared-folder checkpoints, Arrow mapping and table reading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = r"[\x20\x09-\x0D]"


#: Rows whose texts are Python objects at a time.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` in slices of batches, whose bytes Spark bounds (spark.sql.execution.arrow.maxBytesPerBatch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield fn(batch.slice(at, SLICE_ROWS))

    return df.mapInArrow(run, schema)


def ascii_lower(text):
    """Lower-case A-Z only; other letters stay as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, taken by exact name, so that extra columns can't clash."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows: those with the smallest hash of ``key``.

    A count first gives a hash threshold that about 1.3 times as many rows pass, so
    what the tasks sort and send stays at the bound for any size of the table.
    """
    n = df.count()
    h = F.xxhash64(F.col(key).cast("string"))
    if n > rows:
        df = df.filter(F.pmod(h, F.lit(1 << 31)) < int(min(1.0, (1.3 * rows + 100) / n) * (1 << 31)))
    place = F.pmod(h, F.lit(1 << 31))
    return df.orderBy(place, *(F.col(f"`{c}`") for c in df.columns)).limit(rows)
