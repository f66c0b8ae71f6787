"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows are equal when their texts are identical after deleting ASCII white space.
Copies are combined in three steps, each of which compares the full normalised
text and not only its digest:

1. the partial aggregate in each map task keeps one row per content (local);
2. the local winners of a content meet in one of SALTS groups by digest and salt;
3. the winners of the salts meet by digest.

A content that makes up a third of all rows therefore reaches a reducer as at
most one row per map task.  Rows learn the winner by their digest, which step 3
has shown to stand for one content; digests of many rows are broadcast, as only few
can be, and a row whose digest is its own needs no join partner.  Should two contents
ever share a digest, those rows are joined by their full content.

Defined results
    null text      counts as the empty text
    null doc_id    ranks after every other id; a group without any id has keep_id null
    ties           most code points first, then the smallest doc_id
    repeated rows  rows that also share the doc_id and the length are the same
                   document: the report marks all of them, ``survivors`` returns the
                   one whose text is smallest
    empty table    an empty result
    extra columns  ignored by the report, kept by ``survivors``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..sources.storage import checkpointed
from .common import ASCII_SPACE, table

SALTS = 16
#: Contents with several rows whose keys ``survivors`` broadcasts.
BROADCAST_KEYS = 1_000_000
#: One more than the largest id; a null id takes the place after all others.
_ID_END = "cast(9223372036854775808 as decimal(20,0))"
_RANK_BASE = "cast(100000000000000000000 as decimal(21,0))"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{ASCII_SPACE}+", "")


def _rank() -> Column:
    """One number that orders (code points descending, doc_id ascending); fits a mutable aggregation buffer."""
    return F.expr(f"cast(n_cp * {_RANK_BASE} + coalesce({_ID_END} - doc_id, 0) as decimal(38,0))")


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(
        F.col("`doc_id`").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col("`text`"), F.lit(""))).cast("long").alias("n_cp"),
        normalised(F.col("`text`")).alias("norm"),
    )
    return rows.withColumn("digest", F.sha2(F.col("norm").cast("binary"), 256))


def content_groups(docs: DataFrame) -> DataFrame:
    """One row per content: digest, norm, rank of its winner, size."""
    salted = (
        _keyed(docs)
        .select("digest", "norm", _rank().alias("rank"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    )
    return (
        salted.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
    )


def digest_winners(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one small row per digest, the groups with their contents)."""
    groups = content_groups(docs)
    per_digest = groups.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("rank").alias("rank"), F.max("n").alias("n")
    )
    return checkpointed(per_digest), groups


def _members(docs: DataFrame) -> DataFrame:
    """Every row with its group's winner: doc_id, n_cp, digest, rank (own), win, n."""
    winners, groups = digest_winners(docs)
    several = winners.filter("n > 1 or contents > 1").select("digest", "n", "contents", F.col("rank").alias("win"), F.col("n").alias("size"))
    rows = _keyed(docs).withColumn("rank", _rank())
    out = attach(rows, several, ["digest"], "n", F.col("rank"))
    members = out.filter("coalesce(contents, 1) = 1").select(
        "doc_id", "n_cp", "digest", "rank", F.coalesce("win", "rank").alias("win"), F.coalesce("size", F.lit(1).cast("long")).alias("n")
    )
    shared = winners.filter("contents > 1").select("digest")
    if not shared.isEmpty():
        by_content = groups.join(shared, "digest", "left_semi").select("digest", "norm", F.col("rank").alias("win"), "n")
        clash = rows.join(shared, "digest", "left_semi").join(by_content, ["digest", "norm"])
        members = members.unionByName(clash.select(members.columns))
    return members


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    id_part = F.expr(f"win % {_RANK_BASE}")
    keep = F.when(id_part > 0, (F.expr(_ID_END) - id_part).cast("long"))
    return _members(docs).select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rank") == F.col("win")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows whose content is theirs alone stay without a partner; the keys of the other
    contents are broadcast up to BROADCAST_KEYS, beyond which only those of the most
    rows are and the rest meets in a shuffle.
    """
    names = docs.columns
    winners, groups = digest_winners(docs)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"),
        F.col("`doc_id`").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col("`text`").cast("string"), F.lit(""))).cast("long").alias("n_cp"),
        F.sha2(normalised(F.col("`text`").cast("string")).cast("binary"), 256).alias("digest"),
    ).withColumn("rank", _rank())
    several = winners.filter("n > 1 or contents > 1").select("digest", "n", "contents", F.col("rank").alias("win"))
    marked = attach(rows, several, ["digest"], "n", F.col("rank"), rows=BROADCAST_KEYS)
    shared = winners.filter("contents > 1").select("digest")
    clash = not shared.isEmpty()
    if not clash and docs.groupBy(F.col("`doc_id`")).count().filter("count > 1").isEmpty():
        kept = marked.filter("win is null or rank = win")
    else:
        # Rows that repeat a winner's id and length differ in white space only: the smallest text stays.
        chosen = marked.filter("contents = 1 and rank = win").select("row", "digest", "rank")
        if clash:  # contents that share a digest: every one of them keeps its own winner
            each = groups.join(shared, "digest", "left_semi").select("digest", "rank")
            chosen = chosen.unionByName(rows.join(each, ["digest", "rank"], "left_semi").select("row", "digest", "rank"))
        text = F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))
        once = chosen.groupBy("digest", "rank").agg(F.min_by("row", text).alias("row"))
        kept = marked.filter("win is null").select("row").unionByName(once.select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in names))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, n_cp, norm,
         first_value(doc_id) OVER g AS keep_id,
         first_value(n_cp) OVER g AS keep_cp,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW g AS (PARTITION BY norm ORDER BY n_cp DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size,
       (doc_id IS NOT DISTINCT FROM keep_id AND n_cp = keep_cp) AS kept,
       sha256(norm) AS text_sha256
FROM w
"""

QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {"op10_exact_dedup": ORACLE}
