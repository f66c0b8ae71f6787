"""Ranked lexical search: windows of postings are scored bucket by bucket.

The index is made where the documents are read, without a shuffle: a task cuts its
documents into windows (bounded in documents and in bytes of text), numbers the documents
of a window by doc_id, and writes one row per window with its terms and their postings
(document numbers and occurrences).  The index holds every document and every term, and
serves any number of searches.

A search takes its queries in blocks of bounded bytes.  For a block, one pass over the
index's term lists counts the documents of the block's terms.  A second pass scores:
in every window, a query adds its terms' integer impacts into an array of one place per
document of the window, which stays in the cache, and joins the terms' occupancy bitsets;
the occupied places are then harvested into a heap of the query's best.  A task sends at
most k rows per query, and the best k of all tasks are the result.

Scores are exact integers: a term weighs floor(1000 * ln((2N + 2) / (2df + 1))), and a
document gives it (1000000000 * tf) div (1000 * tf + 12 * m), with
m = 75 + (25 * n * N) div L for its n terms, N documents with terms and L terms in all.

Defined results
    null or empty text   no terms; in no result.  An item without terms has no result rows
    null doc_id          ranked after the ids of its score
    null item_id         an item like any other
    very long text       indexed whole, in blocks; memory follows its terms
    ties                 equal scores by ascending doc_id
    repeated rows        documents: each is ranked by itself.  Items: rows of one id and text give
                         one result, another text of the same id is an item of its own
    empty tables         an empty result
    extra columns        ignored
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.storage import checkpointed, remove, shared_folder
from .common import table

TOP = 20
#: Documents and bytes of text of a window; a longer text is a window of its own.  A window is a row of the index, of which
#: readers hold some at a time in every task, so it is small.
WINDOW_ROWS = 4096
WINDOW_BYTES = 2 << 20
#: A row group of the index, which holds a few windows.
ROW_GROUP_BYTES = 4 << 20
#: Bytes of query texts that a pass over the index serves.
BLOCK_BYTES = 4 << 20
_TEXT_BYTES = 4 << 20
_KEPT = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum())
#: Bytes of terms, A-Z in lower case, and a blank for all others.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b in _KEPT else 32 for b in range(256))
INDEX = "filled int, total long, doc_id array<long>, n array<long>, term array<binary>, df array<int>, place array<short>, tf array<int>"


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in blocks, in order, with repeats."""
    at = 0
    while at < len(raw):
        to = min(len(raw), at + _TEXT_BYTES)
        while to < len(raw) and _FOLD[raw[to]] != 32:
            to += 1
        yield raw[at:to].translate(_FOLD).split()
        at = to


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class _Window:
    """Documents while their window is being made."""

    def __init__(self) -> None:
        self.number, self.size = _Numbers(), 0
        self.doc_id: list[int | None] = []
        self.ids: list[np.ndarray] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        blocks = [np.fromiter(map(self.number.__getitem__, b), np.int32, len(b)) for b in terms(raw)]
        self.ids.append(np.concatenate(blocks) if blocks else np.zeros(0, np.int32))
        self.doc_id.append(doc_id)
        self.size += len(raw)

    def full(self, more: int) -> bool:
        return len(self.doc_id) >= WINDOW_ROWS or bool(self.doc_id) and self.size + more > WINDOW_BYTES

    def row(self) -> pa.RecordBatch:
        rows, vocabulary = len(self.doc_id), len(self.number)
        order = sorted(range(rows), key=lambda k: (self.doc_id[k] is None, self.doc_id[k] or 0))
        ids = [self.ids[k] for k in order]
        n = np.fromiter(map(len, ids), np.int64, rows)
        flat = np.concatenate(ids).astype(np.int64) if rows else np.zeros(0, np.int64)
        pairs, tf = np.unique(flat * rows + np.repeat(np.arange(rows), n), return_counts=True)
        df = np.bincount(pairs // rows, minlength=vocabulary) if len(pairs) else np.zeros(vocabulary, np.int64)

        def cell(values) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        made = {
            "filled": pa.array([int((n > 0).sum())], pa.int32()),
            "total": pa.array([int(n.sum())], pa.int64()),
            "doc_id": cell(pa.array([self.doc_id[k] for k in order], pa.int64())),
            "n": cell(pa.array(n)),
            "term": cell(pa.array(list(self.number), pa.binary())),
            "df": cell(pa.array(df.astype(np.int32))),
            "place": cell(pa.array((pairs % rows).astype(np.int16))),
            "tf": cell(pa.array(tf.astype(np.int32))),
        }
        return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the index of ``docs`` (doc_id, text) to ``path``, one row per window, and return it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = _Window()
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id"), batch.column("raw")):
                raw = raw.as_py() or b""
                if window.full(len(raw)):
                    yield window.row()
                    window = _Window()
                window.add(doc_id.as_py(), raw)
        if window.doc_id:
            yield window.row()

    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").cast("binary").alias("raw"))
    # Small row groups, as a reader takes the long rows of a group at once; without the second option only 100 rows end a group.
    writer = rows.mapInArrow(run, INDEX).write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size.row.check.min", 1)
    writer.option("parquet.page.size.row.check.max", 1).parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def _weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _norms(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """12 * m of documents with ``n`` terms."""
    values, back = np.unique(n, return_inverse=True)
    return np.array([12 * (75 + 25 * int(x) * documents // total) for x in values], np.int64)[back]


def _window_scores(row: dict, wanted: pa.Array, queries: list, documents: int, total: int, heaps: list, k: int) -> None:
    """Score one window and harvest it into the queries' heaps.

    ``queries`` holds per query the numbers of its terms in ``wanted`` and their weights.
    """
    rows = len(row["n"])
    number = pc.index_in(row["term"], value_set=wanted)
    mine = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
    if not len(mine):
        return
    slot = np.full(len(wanted), -1, np.int64)
    slot[number.drop_null().to_numpy()] = np.arange(len(mine))
    df = row["df"].to_numpy()
    past = np.cumsum(df, dtype=np.int64)
    places, tf = row["place"].to_numpy(), row["tf"].to_numpy()
    norm = _norms(row["n"].to_numpy(), documents, total)
    at, impact, bits = [], [], []
    for t in mine.tolist():
        own = slice(int(past[t] - df[t]), int(past[t]))
        where, f = places[own], tf[own].astype(np.int64)
        held = np.zeros(rows, bool)
        held[where] = True
        at.append(where)
        impact.append(1_000_000_000 * f // (1000 * f + norm[where]))
        bits.append(np.packbits(held))
    bucket = np.zeros(rows, np.int64)
    doc_id = row["doc_id"]
    for q, (numbers, weights) in enumerate(queries):
        found = slot[numbers]
        here = found >= 0
        if not here.any():
            continue
        occupied = np.zeros(len(bits[0]), np.uint8)
        for s, w in zip(found[here].tolist(), weights[here].tolist()):
            bucket[at[s]] += w * impact[s]
            occupied |= bits[s]
        spots = np.flatnonzero(np.unpackbits(occupied, count=rows))
        scores = bucket[spots]
        bucket[spots] = 0
        heap = heaps[q]
        floor = max(1, heap[0][0]) if len(heap) == k else 1
        good = scores >= floor
        spots, scores = spots[good], scores[good]
        if len(spots) > k:  # places follow doc_id, so the first of equal scores are the right ones
            best = np.argsort(-scores, kind="stable")[:k]
            spots, scores = spots[best], scores[best]
        for spot, score in zip(spots.tolist(), scores.tolist()):
            x = doc_id[spot].as_py()
            entry = (score, x is not None, -(x or 0))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _blocks(items: DataFrame) -> Iterator[list]:
    """Distinct (id, text) rows in blocks of at most BLOCK_BYTES of text."""
    block, size = [], 0
    for row in items.toLocalIterator():
        more = len(row.raw or b"") + 64
        if block and size + more > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(row)
        size += more
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Per item of ``items`` (item_id, text) its ``k`` best documents: item_id, rank, doc_id, score."""
    spark = index.sparkSession
    kind = items.schema["item_id"].dataType
    documents, total = index.agg(F.sum("filled"), F.sum("total")).first()
    schema = StructType([StructField("q", IntegerType()), StructField("item_id", kind)])
    out = None
    asked = items.select(F.col("`item_id`").alias("item_id"), F.col("`text`").cast("string").cast("binary").alias("raw")).distinct()
    for block in _blocks(asked) if documents else ():
        found = _search_block(index, [row.raw or b"" for row in block], documents, total, k)
        names = spark.createDataFrame([(q, row.item_id) for q, row in enumerate(block)], schema)
        best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        ranked = checkpointed(ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return spark.createDataFrame([], StructType([schema["item_id"]])).selectExpr("item_id", "0 rank", "0L doc_id", "0L score")
    return out


def _search_block(index: DataFrame, texts: list[bytes], documents: int, total: int, k: int) -> DataFrame:
    """(q, score, doc_id): the best of every task for each text of a block."""
    counted = [Counter(t for part in terms(raw) for t in part) for raw in texts]
    wanted = sorted(set().union(*counted))
    number = {t: i for i, t in enumerate(wanted)}
    vocabulary = index.sparkSession.createDataFrame([(bytearray(t),) for t in wanted], "term binary")
    counts = index.select(F.inline(F.arrays_zip("term", "df"))).join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = {bytes(r.term): _weight(documents, r.df) for r in counts.collect()}  # at most the terms of the block
    queries = []
    for own in counted:
        numbers = [number[t] for t in own if t in weight]
        weights = [times * weight[t] for t, times in own.items() if t in weight]
        queries.append((np.array(numbers, np.int64), np.array(weights, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(wanted, pa.binary())
        heaps: list[list] = [[] for _ in queries]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].values for c in ("doc_id", "n", "term", "df", "place", "tf")}
                _window_scores(row, value_set, queries, documents, total, heaps, k)
        rows = [(q, e[0], -e[2] if e[1] else None) for q, heap in enumerate(heaps) for e in heap]
        for at in range(0, len(rows), 10_000):
            q, score, doc_id = zip(*rows[at : at + 10_000])
            columns = [pa.array(q, pa.int32()), pa.array(score, pa.int64()), pa.array(doc_id, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["q", "score", "doc_id"])

    return index.select("doc_id", "n", "term", "df", "place", "tf").mapInArrow(run, "q int, score long, doc_id long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/search-index-{uuid.uuid4().hex}"
    found = search(build_index(table(spark, sf_dir, "documents"), path), table(spark, sf_dir, "benchmark"))
    remove(spark, path)  # the result is a checkpoint
    return found


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), stats AS (
  SELECT count(*) FILTER (len(terms) > 0) AS docs, cast(sum(len(terms)) AS BIGINT) AS total FROM t
), p AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM t) GROUP BY ALL
), w AS (
  SELECT term, cast(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, stats GROUP BY term, docs
), m AS (
  SELECT row, doc_id, 75 + (25 * len(terms)::BIGINT * docs) // total AS m FROM t, stats WHERE len(terms) > 0
), i AS (
  SELECT DISTINCT item_id, text FROM benchmark
), q AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM i
  ) GROUP BY ALL
), s AS (
  SELECT item, item_id, row, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (row)
  GROUP BY ALL
)
SELECT item_id, cast(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""

QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {"op11_ranked_search": ORACLE}
