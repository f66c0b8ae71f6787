"""Mixing sources to target weights by systematic sampling.

Every source gets a target of words: the sources, in code-point order with null
last, weigh 3, 1, 2, repeating, and share ``share`` times the words of all
documents; a target stops at ``ceiling`` times its source's words and the excess
goes to the others by weight (water filling, in closed form).

Within a source every document has the same expected copies, target / size.  The
documents stand in a fixed order; the prefix sum of the expected copies plus one
offset per source, drawn from the seed over the whole unit, crosses some integers at
a document, and each crossing emits it once.  The order is a hill: by size, the
largest document in the middle and the others by turns left and right of it, so
that sizes change little from one document to the next and are small at both ends.
The words taken then hardly depend on the offset, but for the few largest documents.
Prefix sums are exact integers in units of 2^-20 copies, so reruns and any
partitioning agree.

Rows that share doc_id, source, size and text are one group with a number of rows.
The place in the order is found in three levels so that no source is gathered in
one task: counts by (source, size), by block of doc_ids within a size, and a running
sum within a block.

Defined results
    null or empty text   size 0, taken 0
    null source          a source of its own, last in order
    null doc_id          after the others of its size, by a hash of the text
    ties                 rows of one size and doc_id stand by a hash of the text
    repeated rows        sampled one by one; ``mixture`` emits exactly the copies of the
                         report, spread evenly over the rows of a group
    source without words target 0
    empty table          an empty result
    extra columns        ignored by the report, kept by ``mixture``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..sources.storage import checkpointed
from .common import ASCII_SPACE, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2
SEED = 17
UNIT = 1 << 20
#: doc_ids per block: 2^12.
_BLOCK_BITS = 12


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than ASCII white space."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{ASCII_SPACE}+")
    # Only the first and the last part can be empty.
    empty = (F.element_at(parts, 1) == "").cast("long") + (F.element_at(parts, -1) == "").cast("long")
    n = F.size(parts).cast("long")
    return F.when((n == 1) & (empty == 2), F.lit(0)).otherwise(n - empty).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """source, source_size, documents, target, rate (in UNIT copies a document) and offset.

    ``sizes`` has source, size and rows.  One row per source: its windows span the
    table of sources, not of documents.
    """
    per = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("documents")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    per = (
        per.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(ceiling))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.col("total") * F.lit(share) - F.col("capped")) / F.col("open_weight")
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("level", level)
        # The water level is that of the first source, by ratio, which its own cap doesn't bind.
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything))
    )
    full = F.col("water").isNull() | (F.col("level") > F.col("ratio"))
    target = F.when(full, F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("water")["level"] * F.col("weight"))
    )
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(UNIT))).otherwise(F.lit(0))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("place")).cast("binary")), 1, 5), 16, 10)
    return (
        per.withColumn("target", target)
        .withColumn("rate", rate.cast("long"))
        .withColumn("offset", drawn.cast("long"))
        .select("source", "source_size", "documents", "target", "rate", "offset")
    )


_GROUP = ["source", "size", "doc_id", "k1", "k2"]


def _row_keys(row: str = "") -> list[Column]:
    def col(name: str) -> Column:
        return F.col(row).getField(name) if row else F.col(f"`{name}`")

    text = F.coalesce(col("text").cast("string"), F.lit(""))
    return [
        col("source").cast("string").alias("source"),
        word_count(text).alias("size"),
        col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("k1"),
        F.hash(text).alias("k2"),
    ]


def _ranked(groups: DataFrame) -> DataFrame:
    """Adds ``rank``: the rows of the source ahead of the group, by size descending, then doc_id, then text hash."""
    by_id = F.shiftright(F.col("doc_id"), _BLOCK_BITS)
    rows = groups.withColumn("block", F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce(by_id, F.shiftright("k1", 52)).alias("at")))
    blocks = rows.groupBy("source", "size", "block").agg(F.sum("rows").alias("n"))
    before = (Window.unboundedPreceding, -1)
    in_size = Window.partitionBy("source", "size").orderBy("block").rowsBetween(*before)
    in_source = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(*before)
    blocks = blocks.withColumn("ahead_block", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    by_size = (
        blocks.groupBy("source", "size")
        .agg(F.sum("n").alias("n"))
        .withColumn("ahead_size", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
        .select(F.col("source").alias("s1"), F.col("size").alias("z1"), "ahead_size")
    )
    places = blocks.join(by_size, F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1"))).select(
        F.col("source").alias("s2"),
        F.col("size").alias("z2"),
        F.col("block").alias("b2"),
        (F.col("ahead_size") + F.col("ahead_block")).alias("ahead"),
    )
    in_block = Window.partitionBy("source", "size", "block").orderBy("doc_id", "k1", "k2").rowsBetween(*before)
    rows = rows.withColumn("nth", F.coalesce(F.sum("rows").over(in_block), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("block") == F.col("b2"))
    return rows.join(places, same).withColumn("rank", F.col("ahead") + F.col("nth")).drop("block", "nth", "s2", "z2", "b2", "ahead")


def _copies(rank: Column) -> Column:
    """Copies of the row at ``rank`` by size: it stands on the hill at the middle and by turns right and left of it."""
    half = F.expr("documents div 2")
    odd = F.pmod(rank, F.lit(2)) == 1
    place = F.when(odd, half - F.shiftright(rank + 1, 1)).otherwise(half + F.shiftright(rank, 1))

    def crossed(at: Column) -> Column:
        return F.shiftright(at * F.col("rate") + F.col("offset"), UNIT.bit_length() - 1)

    return crossed(place + 1) - crossed(place)


def _sampled(docs: DataFrame, share: float, ceiling: int, seed: int) -> DataFrame:
    """Per row: the columns of _GROUP, rows (of its group), source_size, target, copies."""
    groups = checkpointed(docs.select(*_row_keys()).groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("rows")))
    targets = source_targets(groups, share, ceiling, seed).withColumnRenamed("source", "s0")
    ranked = _ranked(groups).join(targets, F.col("source").eqNullSafe(F.col("s0"))).drop("s0")
    # In two steps, so that no array holds more than 2^16 numbers for a row that repeats often.
    chunk = 1 << 16
    starts = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(chunk).cast("long"))
    chunks = ranked.withColumn("start", F.explode_outer(starts))
    last = F.least(F.col("rows"), F.col("start") + chunk) - 1
    rows = chunks.withColumn("nth", F.explode_outer(F.sequence("start", last)))
    copies = _copies(F.col("rank") + F.col("nth"))
    return rows.select(*_GROUP, "rows", "source_size", "target", copies.alias("copies"))


def mix_report(docs: DataFrame, share: float = SHARE, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies, taken."""
    return _sampled(docs, share, ceiling, seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixture(docs: DataFrame, share: float = SHARE, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row once per copy, with all columns and the number of the copy (from 1)."""
    names = docs.columns
    sampled = _sampled(docs, share, ceiling, seed)
    # Null-safe keys that any join can use.
    key = F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("ns"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("i"), F.col("doc_id").isNull().alias("ni"), "k1", "k2").alias("key")
    groups = sampled.groupBy(key).agg(F.first("rows").alias("rows"), F.sum("copies").alias("copies"))
    taken = checkpointed(groups.filter("copies > 0").withColumn("several", F.col("rows")))
    whole = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    rows = docs.select(whole).select("row", *_row_keys("row")).select("row", key)
    # About as many keys as rows, so only those of the most rows are broadcast.
    kept = attach(rows, taken, ["key"], "rows", F.col("key"), "inner", 1000)
    single = kept.filter("several = 1").select("row", "copies")
    if not taken.filter("several > 1").isEmpty():
        # Rows of one group: equal ones are combined, then the copies are dealt out in their order.
        equal = kept.filter("several > 1").groupBy("key", "row", "several", "copies").agg(F.count(F.lit(1)).alias("m"))
        order = Window.partitionBy("key").orderBy(*(F.col("row").getField(c).cast("string") for c in names))
        end = F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0))
        ends = equal.withColumn("end", end)
        share_of = F.expr("(end * copies) div several - ((end - m) * copies) div several")
        single = single.unionByName(ends.select("row", share_of.alias("copies")).filter("copies > 0"))
    copies = F.explode_outer(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
    extra = "copy_no"
    while extra in names:
        extra = f"mix_{extra}"
    return single.select("row", copies).select(*(F.col("row").getField(c).alias(c) for c in names), F.col("_copy").alias(extra))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: Per-row sizes are to be in ``d`` (doc_id, source, size); the result is in ``mixed``.
MIX_SQL = r"""
per AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size, count(*) AS documents,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM per
), r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, (cast(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE
             - cast(coalesce(sum(cap) OVER b, 0) AS BIGINT))
            / cast(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS level
  FROM r WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT level AS water FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1
), t AS (
  SELECT source, source_size, documents, place,
         CASE WHEN level > ratio OR (SELECT count(*) FROM water) = 0 THEN cap::DOUBLE
              ELSE least(cap::DOUBLE, (SELECT water FROM water) * weight) END AS target
  FROM l
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size * 1048576) AS BIGINT) ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || place), 1, 5))::BIGINT AS off
  FROM t
), n AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id ASC NULLS LAST) - 1 AS rank FROM d
), h AS (
  SELECT n.*, q.source_size, q.target, q.rate, q.off,
         documents // 2 + CASE WHEN rank % 2 = 1 THEN -((rank + 1) // 2) ELSE rank // 2 END AS spot
  FROM n JOIN q ON n.source IS NOT DISTINCT FROM q.source
), mixed AS (
  SELECT *, (((spot + 1) * rate + off) >> 20) - ((spot * rate + off) >> 20) AS copies FROM h
)
"""

ORACLE = (
    r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), """
    + MIX_SQL
    + """
SELECT doc_id, size, source_size, target, cast(copies * size AS BIGINT) AS taken FROM mixed
"""
)

QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLES = {"op2_mix_sources": ORACLE}
