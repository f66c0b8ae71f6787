"""SimHash near-duplicate classes through a segment-popcount embedding.

Fingerprints: texts are lower-cased (A-Z), split on ASCII white space, and every
three-word shingle is hashed with XXH64 (seed 42); a bit of the fingerprint is
set where over half of the hashes have it.

Linking (at most two differing bits): a 64-bit fingerprint is cut into 32
segments of two bits, and mapped to the vector of the segments' bit counts.  The
Manhattan distance of two vectors is a lower bound of the Hamming distance.  The
range join on the grid of vectors meets in the middle: two points at distance
two or less have a grid point at distance one or less from both, so each
fingerprint goes to its own cell and to the adjacent ones (at most 65), and only
cells that several fingerprints visit go on.

In a cell that it shares, a fingerprint is represented by the numbers at most one
bit away from it whose vector is the cell (at most two).  Two fingerprints differ in
at most two bits if and only if they have such a number in common, in a cell that
both visit: that is the exact verification.  All that meet at a number (65 at most)
are linked with each other, so a star to the smallest holds the links, and no cell,
however crowded, emits its pairs.

Classes are the connected components, found with alternating large-star and
small-star rounds over distinct fingerprints, each round checkpointed.

Defined results
    null or empty text   fingerprint zero, linked like any other
    null doc_id          linked, but never a class id (null if the class has no id);
                         ``survivors`` keeps one row of a class without ids
    repeated rows        one output row each; ``survivors`` keeps one row of a class,
                         also where a doc_id repeats with the same or another text
    very long text       hashed in blocks, so memory follows one block
    empty table          an empty result
    extra columns        ignored by the report, kept by ``survivors``
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.joins import attach
from ..sources.storage import checkpointed
from .common import map_batches, table

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
#: Bytes of exploded cells (24 each) per partition.
_PART_BYTES = 64 << 20
#: Rows that ``survivors`` drops by a broadcast of their keys.
BROADCAST_KEYS = 1_000_000
_BLOCK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hash_of, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _BLOCK):
        pairs = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
        hashes = np.array([hash_of(flat[a:b], HASH_SEED) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits(2 * total > len(starts), bitorder="little")
    return int(over.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a 96-bit key of the text (k1, k2) and the signed 64-bit fp of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        kept = ["doc_id", "k1", "k2"]
        return pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(made.view(np.int64))], [*kept, "fp"])

    text = F.col("`text`").cast("string")
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), *_text_key(text), text.alias("text"))
    return map_batches(rows, run, "doc_id long, k1 long, k2 int, fp long")


def _text_key(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def popcount_vector(fp: Column) -> Column:
    """The 32 bit counts of two-bit segments, packed in two bits each."""
    low = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(fp, 1)
    both = fp.bitwiseAND(shifted).bitwiseAND(low)
    one = fp.bitwiseXOR(shifted).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(one)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _cells(vector: Column) -> Column:
    """The cell itself and those whose vector differs by one in one count."""
    # A count is 00, 01 or 10: flipping the low bit leads 0 <-> 1, flipping both leads 1 <-> 2.
    flips = []
    for i in range(32):
        one, two = _signed(1 << 2 * i), _signed(2 << 2 * i)
        both = _signed(3 << 2 * i)
        flips.append(F.when(vector.bitwiseAND(F.lit(two)) == 0, vector.bitwiseXOR(F.lit(one))))
        flips.append(F.when(vector.bitwiseAND(F.lit(both)) != 0, vector.bitwiseXOR(F.lit(both))))
    return F.array(vector, *flips)


def _middles(fp: Column, cell: Column) -> Column:
    """The numbers at most one bit from ``fp`` whose vector is ``cell``, one of its cells."""
    low = F.lit(0x5555555555555555)
    apart = popcount_vector(fp).bitwiseXOR(cell)
    first = apart.bitwiseOR(F.shiftrightunsigned(apart, 1)).bitwiseAND(low)  # the first bit of the segment that differs
    flipped = F.array(fp.bitwiseXOR(first), fp.bitwiseXOR(F.shiftleft(first, 1)))
    return F.when(apart == 0, F.array(fp)).otherwise(F.filter(flipped, lambda m: popcount_vector(m) == cell))


def _spread(prints: DataFrame, visits: int) -> DataFrame:
    """The fingerprints in so many partitions that each holds _PART_BYTES after an explosion to ``visits`` rows."""
    size = prints.count() * visits * 24
    return prints.repartition(max(prints.sparkSession.sparkContext.defaultParallelism, size // _PART_BYTES), "fp")


def _links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints whose components hold all links of at most MAX_BITS bits."""
    visits = (
        _spread(distinct, 65)
        .withColumn("vector", popcount_vector(F.col("fp")))
        .select("fp", F.explode(_cells(F.col("vector"))).alias("cell"))
        .filter("cell is not null")
    )
    shared = checkpointed(visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = attach(visits, shared, ["cell"], "n", F.col("fp"), "inner")
    middles = met.select("fp", F.explode(_middles(F.col("fp"), F.col("cell"))).alias("middle"))
    stars = middles.withColumn("a", F.min("fp").over(Window.partitionBy("middle")))  # 65 rows at most
    return stars.filter("a < fp").select("a", F.col("fp").alias("b")).distinct()


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every row's doc_id, k1, k2, fp; per fp of a class with several rows: fp, n, head).

    The head is the class's first row by doc_id (null last) and text key.
    """
    prints = checkpointed(fingerprints(docs))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    distinct = checkpointed(prints.groupBy("fp").agg(F.min(row).alias("head"), F.count(F.lit(1)).alias("n")))
    linked = connected_components(_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = checkpointed(distinct.join(linked, "fp"))
    heads = checkpointed(rooted.groupBy("root").agg(F.min("head").alias("first"), F.count(F.lit(1)).alias("w")))
    joined = attach(rooted.select("fp", "n", "root"), heads, ["root"], "w", F.col("fp")).select("fp", "n", F.col("first").alias("head"))
    alone = distinct.filter("n > 1").join(linked, "fp", "left_anti").select("fp", "n", "head")
    return prints, checkpointed(joined.unionByName(alone))


def near_dup_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint, component_id."""
    prints, classes = _classes(docs)
    out = attach(prints, classes, ["fp"], "n", F.col("k1"))
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head")["doc_id"]).alias("component_id"),
    )


def survivors(docs: DataFrame) -> DataFrame:
    """One row of every class, its head, with all columns."""
    names = docs.columns
    prints, classes = _classes(docs)
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "k1", "k2"]
    on = ["no_id", "id", "k1", "k2"]
    several = attach(prints, classes, ["fp"], "n", F.col("k1"), "inner")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    marked = checkpointed(
        several.select(*key, (~own.eqNullSafe(F.col("head"))).alias("gone")).groupBy(*on, "gone").agg(F.count(F.lit(1)).alias("n"))
    )
    whole = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    doc_id = F.col("`doc_id`").cast("long")
    rows = docs.select(
        doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), *_text_key(F.col("`text`").cast("string")), whole
    )
    gone = marked.filter("gone").select(*on, "n")
    kept = attach(rows, gone, on, "n", F.col("k1"), "anti", BROADCAST_KEYS)
    again = marked.filter("not gone and n > 1").select(*on, "n")
    if not again.isEmpty():  # heads that repeat as whole rows
        once = attach(kept, again, on, "n", F.col("k1"), "anti", BROADCAST_KEYS)
        kept = once.unionByName(kept.join(again, on, "left_semi").groupBy(*on).agg(F.first("row").alias("row")).select(rows.columns))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in names))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_report(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLES: dict[str, str] = {}
