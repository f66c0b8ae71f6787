"""Shards of equal counts that each hold the sources in their proportions.

The rows of every source are shuffled by a seeded hash and ranked.  The row of rank r
among a source's n rows gets the fractional rank (r + u) / n, with an offset u between 0
and 1 that is drawn per source.  All rows sorted by fractional rank interleave the sources
in proportion, and cut into equal counts they give the shards: counts differ by one at
most, and a source's count in a shard differs by less than two from its share of the
fractional ranks that the shard covers.

Ranks are exact and found without gathering a source: a shuffled source falls into ranges
of its hash, and the sorted table into ranges of the fractional rank, each with a bounded
number of rows; running sums over the ranges' counts, in two levels, give the rows ahead
of a range, and a window within the range does the rest.  How many ranges there are
changes no result.

Defined results
    null or empty text   size 1, CRC 0
    null source          a source of its own
    null doc_id          a row like any other, shuffled by its text's CRC
    very long text       one row; its text is only read for its size and hashes
    ties                 by doc_id (null last), size, CRC, a hash of the text
    repeated rows        numbered, and each placed by itself
    empty table          an empty result
    extra columns        ignored by the report, kept by ``sharded`` (its columns get a prefix where they clash)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..operators.prefix import ahead, groups_of, interleaved
from ..sources.storage import checkpointed
from .common import table

SHARDS = 16
SEED = 29
LAW = "rows"
#: Copies of one row that are numbered at a time.
_CHUNK = 1 << 14
_KEY = ["source", "no_source", "doc_id", "no_id", "size", "crc", "k1"]


def _key(row: str = "") -> list[Column]:
    """What tells rows apart, without nulls."""

    def col(name: str) -> Column:
        return F.col(row).getField(name) if row else F.col(f"`{name}`")

    text = F.coalesce(col("text").cast("string"), F.lit(""))
    source, doc_id = col("source").cast("string"), col("doc_id").cast("long")
    return [
        F.coalesce(source, F.lit("")).alias("source"),
        source.isNull().alias("no_source"),
        F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id"),
        doc_id.isNull().alias("no_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("k1"),
    ]


def _drawn(*parts: Column) -> Column:
    """60 bits drawn from a text."""
    made = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(made, 1, 15), 16, 10).cast("long")


def placed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row: its key, the number of its copy and of all copies, shard and slot."""
    session = docs.sparkSession
    partitions = int(session.conf.get("spark.sql.shuffle.partitions"))
    groups = docs.select(*_key()).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"))
    chunks = groups.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_CHUNK).cast("long"))))
    # The chunks of a row that repeats often are dealt out before they are numbered.
    several = chunks.filter("copies > 1").repartition(partitions, *_KEY, "from")
    last = F.least(F.col("copies"), F.col("from") + _CHUNK) - 1
    several = several.withColumn("copy", F.explode(F.sequence("from", last))).drop("from")
    rows = chunks.filter("copies = 1").withColumnRenamed("from", "copy").unionByName(several)
    name = F.when(F.col("no_id"), F.lit("")).otherwise(F.col("doc_id").cast("string"))
    rows = checkpointed(rows.withColumn("at", _drawn(F.lit(seed), name, F.col("crc"), F.col("copy"))))
    total = rows.count()
    room = groups_of(total, partitions)

    of_source = ["source", "no_source"]
    sizes = rows.groupBy(*of_source).agg(F.count(F.lit(1)).alias("n"))
    offset = _drawn(F.lit(seed), F.col("source")) / F.lit(float(1 << 60))
    sizes = checkpointed(sizes.select(*of_source, "n", F.col("n").alias("of"), offset.alias("offset"), F.ceil(F.col("n") / room).alias("ranges")))
    rows = attach(rows, sizes, of_source, "n", F.col("at"))
    rows = checkpointed(rows.withColumn("range", interleaved(F.col("at"), F.col("ranges"))))
    order = ["at", "no_id", "doc_id", "size", "crc", "k1", "copy"]
    rows = _numbered(rows, [*of_source, "range"], of_source, "range", order, "rank")

    place = (F.col("rank") + F.col("offset")) / F.col("of")
    many = max(1, -(-total // room))
    rows = rows.withColumn("place", place)
    rows = checkpointed(rows.withColumn("range", F.least(F.floor(F.col("place") * many), F.lit(many - 1)).cast("long")))
    rows = _numbered(rows, ["range"], [], "range", ["place", "no_source", "source", "rank"], "number")
    shard = F.expr(f"(number * {shards}) div {max(total, 1)}")
    # A shard begins at the first number that falls into it.
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    rows = rows.withColumn("shard", shard).withColumn("slot", F.col("number") - start)
    return rows.select(*_KEY, "copy", "copies", F.col("shard").cast("int").alias("shard"), "slot")


def _numbered(rows: DataFrame, group: list[str], keys: list[str], at: str, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the rows of the key before this one, by group, then by ``order`` within it."""
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(ahead(counts, keys, at, "n", "before"))
    joined = attach(rows, counts, group, "n", F.col("at"))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return joined.withColumn(out, F.col("before") + nth).drop("before", at)


def shard_report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return placed(docs, shards, seed).select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows with all columns, and their shard and slot (shard_..., slot_... where the names are taken)."""
    names = docs.columns
    spots = checkpointed(placed(docs, shards, seed))
    whole = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    rows = docs.select(whole, F.spark_partition_id().alias("part")).select("row", "part", *_key("row"))
    single = rows.join(spots.filter("copies = 1").select(*_KEY, "shard", "slot"), _KEY).select("row", "shard", "slot")
    again = checkpointed(spots.filter("copies > 1").groupBy(*_KEY).agg(F.max("copies").alias("n")))
    if not again.isEmpty():
        # Rows that share a key are numbered within each part of the input, then over the parts.
        mine = checkpointed(attach(rows, again, _KEY, "n", F.xxhash64("part", "doc_id"), "inner"))
        parts = mine.groupBy(*_KEY, "part").agg(F.count(F.lit(1)).alias("m"))
        parts = checkpointed(ahead(parts, _KEY, "part", "m", "before"))
        order = [F.col("row").getField(c).cast("string") for c in names]
        nth = F.row_number().over(Window.partitionBy(*_KEY, "part").orderBy(*order)) - 1
        mine = attach(mine, parts, [*_KEY, "part"], "m", F.col("part")).withColumn("copy", F.col("before") + nth)
        found = mine.join(spots.filter("copies > 1").select(*_KEY, "copy", "shard", "slot"), [*_KEY, "copy"])
        single = single.unionByName(found.select("row", "shard", "slot"))
    taken = set(names)
    shard, slot = (next(x for x in (c, *(f"{c}_{i}" for i in range(len(taken) + 1))) if x not in taken) for c in ("shard", "slot"))
    return single.select(*(F.col("row").getField(c).alias(c) for c in names), F.col("shard").alias(shard), F.col("slot").alias(slot))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, file_rows: int = 1_000_000) -> None:
    """Write one folder per shard, in files of ``file_rows`` rows in the order of their slots."""
    rows = sharded(docs, shards, seed)
    shard, slot = rows.columns[-2:]
    part = F.floor(F.col(slot) / file_rows)
    rows.repartition(shard, part).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH bits AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS step
  FROM range(256) r(i)
), d AS (
  SELECT doc_id, source, text, hex(encode(coalesce(text, ''))) AS digits FROM documents
), c AS (
  SELECT doc_id, source, text, len(digits) // 2 + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(digits, '..'), lambda x: ('0x' || x)::BIGINT),
                         lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM d, bits
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, text) - 1 AS copy FROM c
), h AS (
  SELECT *, ('0x' || substr(md5('29:' || coalesce(doc_id::VARCHAR, '') || ':' || crc || ':' || copy), 1, 15))::BIGINT AS drawn,
         ('0x' || substr(md5('29:' || coalesce(source, '')), 1, 15))::BIGINT::DOUBLE / 1152921504606846976::DOUBLE AS shift
  FROM n
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY drawn, doc_id NULLS LAST, size, crc, text, copy) - 1 AS rank,
         count(*) OVER (PARTITION BY source) AS n
  FROM h
), f AS (
  SELECT *, row_number() OVER (ORDER BY (rank + shift) / n, source NULLS LAST, rank) - 1 AS number, count(*) OVER () AS total FROM r
), s AS (
  SELECT *, (number * 16) // total AS shard FROM f
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, cast(shard AS INTEGER) AS shard,
       number - (shard * total + 15) // 16 AS slot, cast(NULL AS INTEGER) AS grown_shard
FROM s
"""

QUERIES = {"op12_sharding": op12_sharding}
ORACLES = {"op12_sharding": ORACLE}
