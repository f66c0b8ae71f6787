"""Scans over ordered rows in two levels, and sliding windows in slices, so that no task reads a whole key.

``ahead`` sums what lies before a group, ``before`` finds the last, least, greatest or
summed value before a row, and ``recent`` counts the rows of a trailing window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed

#: Groups per block.
BLOCK = 1024


def ahead(counts: DataFrame, keys: list[str], at: str, n: str, out: str, block: int = BLOCK) -> DataFrame:
    """``counts`` (keys, at, n), with one row per key and number ``at``, and in ``out`` the sum of ``n`` before ``at`` of its key.

    The numbers are cut in blocks: a sum over the blocks of a key, and one within each block.
    """
    rows = counts.withColumn("_block", F.floor(F.col(at) / block).cast("long"))
    blocks = rows.groupBy(*keys, "_block").agg(F.sum(n).alias("_n"))
    before = (Window.unboundedPreceding, -1)
    of_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*before)
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_n").over(of_blocks), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(*before)
    rows = rows.withColumn("_within", F.coalesce(F.sum(n).over(within), F.lit(0)))
    joined = rows.join(blocks, [*keys, "_block"])
    return joined.withColumn(out, F.col("_ahead") + F.col("_within")).drop("_block", "_ahead", "_within")


def groups_of(rows: int, partitions: int, most: int = 50_000, least: int = 64) -> int:
    """How many rows a group should hold: at most ``most``, fewer where that would leave partitions idle.

    It decides how work is dealt out, and never a result.
    """
    return max(least, min(most, rows // (4 * partitions)))


def interleaved(hash60: Column, groups: Column) -> Column:
    """The group of ``groups`` equal ranges that a 60-bit number lies in."""
    return F.shiftright(F.shiftright(hash60, 30) * groups, 30)


def before(rows: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with, per name of ``wanted``, the last non-null value (last), or min, max or sum, of the rows of the key before this one.

    The rows are range-partitioned by key and order, so a key that holds a large share of
    them spreads over parts.  A part scans its own rows; what the parts before it leave of
    the one key that crosses into it is joined, at most one row per part.  Nulls in
    ``order`` come first; a key is not null.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = rows.withColumns({f"_{n}": c for n, (_, c) in wanted.items()})
    # Range bounds are sampled: the parts are kept, so that a repeated task can't see others.
    made = checkpointed(made.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    past = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole, scan, carry, total = [], {}, {}, {}
    for name, (how, _) in wanted.items():
        v, c = F.col(f"_{name}"), F.col(f"_carry_{name}")
        if how == "last":
            whole.append(F.max(F.when(v.isNotNull(), F.struct(*order, v.alias("v"))))["v"].alias(f"_{name}"))
            scan[f"_own_{name}"], carry[f"_carry_{name}"] = F.last(v, ignorenulls=True).over(own), F.last(v, ignorenulls=True).over(past)
            total[name] = F.coalesce(f"_own_{name}", c)
        else:
            one = {"min": F.min, "max": F.max, "sum": F.sum}[how]
            whole.append(one(v).alias(f"_{name}"))
            scan[f"_own_{name}"], carry[f"_carry_{name}"] = one(v).over(own), one(v).over(past)
            o = F.col(f"_own_{name}")
            total[name] = {"min": F.least, "max": F.greatest}[how](o, c) if how != "sum" else F.when(
                o.isNotNull() | c.isNotNull(), F.coalesce(o, F.lit(0)) + F.coalesce(c, F.lit(0))
            )
    sums = made.groupBy(*keys, "_part").agg(*whole)
    first = F.min("_part").over(Window.partitionBy(*keys))
    crossing = sums.withColumns({**carry, "_first": first}).filter("_part > _first").select(*keys, "_part", *carry)
    out = made.withColumns(scan).join(F.broadcast(crossing), [*keys, "_part"], "left").withColumns(total)
    return out.select(*rows.columns, *wanted)


def recent(rows: DataFrame, keys: list[str], at: str, span: int, out: str, widths: int = 10) -> DataFrame:
    """``rows`` with the number of rows of the key in the ``span`` up to and with this one's ``at`` (a long), more than ``span`` ago not counted.

    Time is cut into slices of ``widths`` spans, and a slice counts apart: it sees its own
    rows and those of the last span before it.
    """
    wide = span * widths
    rest = F.pmod(F.col(at), F.lit(wide))
    slice_no = ((F.col(at) - rest) / wide).cast("long")
    late = rest > wide - span
    copies = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = rows.withColumn("_slice", slice_no).withColumn("_copy", F.explode(copies)).withColumn("_slice", F.col("_slice") + F.col("_copy"))
    window = Window.partitionBy(*keys, "_slice").orderBy(at).rangeBetween(-(span - 1), 0)
    return spread.withColumn(out, F.count(F.lit(1)).over(window)).filter("_copy = 0").drop("_slice", "_copy")
