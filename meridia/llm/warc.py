"""WARC archives of pages and their globally ordered capture index.

Writing: every page becomes one WARC/1.1 record whose block is an HTTP response
with the html in UTF-8.  Of equal payloads (at least ``min_bytes`` long) the
smallest page_id is the response; the others are revisit records that keep the
HTTP header and refer to it.  Records end in two line breaks, so Spark's text
writer with that line separator writes proper archives (one gzip stream each)
through its own file system layer and commit protocol; a lost executor leaves no
partial archive behind.

Reading: the text reader cuts the archives at "record end, WARC/1.1"; Content-Length
joins the pieces again where a payload holds that sequence.  Memory follows one
record, not one archive.  Payload digests are recomputed and compared.

Index: each reader task sorts its captures by URL key, timestamp and page_id in
runs of at most RUN_ROWS and writes them.  The runs are cut into blocks of BLOCK_ROWS
captures at the bounds of key ranges.  A range's task receives the blocks of all runs in
the order of their first captures, so a block arrives when the merge reaches it and
not before: a loser tree merges the runs with one block of each run in memory.  The
concatenated partitions are the capture histories in global order.

Defined results
    null html      an empty payload
    null url       no target URI in the record; URL key ""
    null page_id   refers to the smallest id of its payload; a response if there is none
    repeated rows  one record each; rows that repeat the winner's page_id are responses too
    control characters and spaces in a url   each becomes %20
    empty table    an empty result
    extra columns  ignored
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..sources.storage import checkpointed, remove, shared_folder
from .common import table

MIN_REVISIT_BYTES = 0
RUN_ROWS = 50_000
BLOCK_ROWS = 500
#: Captures of a key range, and the most ranges.
MERGE_ROWS = 100_000
MAX_RANGES = 4096
#: Sampled captures per range, from which its bounds are taken.
_SAMPLE = 20
#: Uncompressed bytes of an archive, on average; one task reads one archive.
FILE_BYTES = 256 << 20
FIRST_DATE = 1704067200  # 2024-01-01T00:00:00Z
_DATES = 315_360_000
_END = "\r\n\r\n"
_MAGIC = "WARC/1.1\r\n"
_CUT = _END + _MAGIC
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: eight groups of five hex digits give four letters each."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _winners(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(same, first_id, n) of payloads that occur more than once."""
    return (
        rows.filter(F.octet_length("html") >= min_bytes)
        .groupBy("same")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_id is not null")
    )


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One column ``value``: the text of each page's record without its end."""
    rows = pages.select(
        F.col("`page_id`").cast("long").alias("page_id"),
        F.regexp_replace(F.col("`url`").cast("string"), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.col("`html`").cast("string"), F.lit("")).alias("html"),
    ).withColumn("same", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    winners = checkpointed(_winners(rows, min_bytes))
    joined = attach(rows, winners, ["same"], "n", F.struct("page_id", "url"))
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    size = F.octet_length("html")
    date = F.date_format(
        F.timestamp_seconds(F.lit(FIRST_DATE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(_DATES))),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )

    def urn(page: Column) -> Column:
        h = F.sha2(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), F.hex("same")), 256)
        parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(_END)
    )
    block_size = F.octet_length(http) + F.when(revisit, 0).otherwise(size)

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    header = F.concat(
        F.lit(_MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html").cast("binary")))),
        line("WARC-Profile", F.when(revisit, _PROFILE)),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("first_id")))),
        line("Page-Id", F.col("page_id").cast("string")),
        line("Refers-To-Page-Id", F.when(revisit, F.col("first_id").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", block_size.cast("string")),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(header, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    mean = pages.agg(F.avg(F.octet_length(F.col("`html`").cast("string")))).first()[0] or 0
    (
        records(pages, min_bytes)
        .write.option("lineSep", _END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", int(FILE_BYTES // (mean + 500)) + 1)
        .text(path)
    )


def url_key(url: str | None) -> str:
    """Sort-friendly form: reversed host labels, then port, path and query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.lower()
    labels = host.split(".")
    if labels and labels[0] == "www":
        labels = labels[1:]
    place = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(labels)) + place + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _fields(head: str) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")) if k}


def parse_pieces(pieces: Iterator[tuple[str, str]]) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(file, offset, fields, block) of the records in pieces (file, text) in reading order."""
    current, offset, ahead = None, 0, None
    while ahead or (ahead := next(pieces, None)):
        (file, piece), ahead = ahead, None
        if file != current:
            current, offset = file, 0
            piece = piece.removeprefix(_MAGIC)
        head, _, body = piece.partition(_END)
        found = _fields(head)
        parts = [body.encode("utf-8")]
        have, want = len(parts[0]), int(found["content-length"])
        while have < want:
            parts.append((_CUT + next(pieces)[1]).encode("utf-8"))
            have += len(parts[-1])
        block = b"".join(parts)
        size = len(_MAGIC) + len(head.encode("utf-8")) + len(_END) + want + len(_END)
        yield file, offset, found, block[:want]
        offset += size
        # A payload that ends in the separator's beginning draws the next record in: it is read from there.
        if block.startswith(_CUT.encode(), want):
            ahead = file, block[want + len(_CUT) :].decode("utf-8")


_ENTRY = (
    "url_key string, timestamp string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, file string, offset long"
)
_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]


def _entry(file: str, offset: int, found: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = found["warc-payload-digest"].removeprefix("sha1:")
    if found["warc-type"] == "response":
        size = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload digest differs in {file} at {offset}")
    else:
        size = int(_fields(http.decode("utf-8"))["content-length"])
    url, page, refers = found.get("warc-target-uri"), found.get("page-id"), found.get("refers-to-page-id")
    return (
        url_key(url), found["warc-date"], int(page) if page else None, url, found["warc-type"],
        int(refers) if refers else None, size, digest, file, offset,
    )


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is None, entry[2] or 0, entry[8], entry[9]


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_TYPES = {"string": pa.string(), "long": pa.int64()}
_SCHEMA = pa.schema([(n, _TYPES[x.split()[1]]) for n, x in zip(_NAMES, _ENTRY.split(", "))])
_RUN_SCHEMA = pa.schema([*_SCHEMA, ("run", pa.string())])


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives in ``path``, in locally sorted runs (column ``run``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f, v) for b in batches for f, v in zip(b.column("file").to_pylist(), b.column("value").to_pylist()))
        waiting: list[tuple] = []

        def flush() -> pa.RecordBatch:
            waiting.sort(key=_order)
            name = f"{waiting[0][8]}@{min(e[9] for e in waiting)}"
            batch = _as_batch([(*e, name) for e in waiting], _RUN_SCHEMA)
            waiting.clear()
            return batch

        for record in parse_pieces(pieces):
            waiting.append(_entry(*record))
            if len(waiting) >= RUN_ROWS:
                yield flush()
        if waiting:
            yield flush()

    lines = spark.read.option("lineSep", _CUT).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(run, f"{_ENTRY}, run string")


class LoserTree:
    """Merges sorted runs that arrive in blocks: inner nodes hold the loser of their match, the root the winner.

    The leaves double in number when they run out, so all are set up anew a logarithmic
    number of times; every entry and every block costs one path to the root.
    """

    def __init__(self, key: Callable):
        self.key = key
        self.places: dict[str, int] = {}
        self.queues: list[deque] = []
        self.heads: list[tuple | None] = []
        self.tree: list[int] = [-1]

    def _next(self, i: int) -> None:
        entry = self.queues[i].popleft() if self.queues[i] else None
        self.heads[i] = None if entry is None else (self.key(entry), i, entry)

    def _beats(self, a: int, b: int) -> bool:
        if b == -1 or a == -1:
            return a == -1  # an empty place wins until every run has entered
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _replay(self, i: int) -> None:
        """The winner's run has another head."""
        winner, at = i, (i + len(self.heads)) // 2
        while at > 0:
            if self._beats(self.tree[at], winner):
                winner, self.tree[at] = self.tree[at], winner
            at //= 2
        self.tree[0] = winner

    def _enter(self, i: int) -> None:
        """A run that had no head has the least of all: it wins every match on its path.

        Where it stood as a loser, and wherever the side that it comes from lost, the winner
        of the other side has gone up; it is found further up and comes back.
        """
        if self.tree[0] == i:
            return
        leaves, side = len(self.heads), i + len(self.heads)
        empty, at = 0, side // 2
        while at > 0:
            loser = self.tree[at]
            if loser == i:
                empty = at
            elif empty:
                above = loser + leaves
                while above > side:
                    above //= 2
                if above == side:
                    self.tree[empty], empty = loser, at
            side, at = at, at // 2
        self.tree[empty] = self.tree[0]
        self.tree[0] = i

    def feed(self, run: str, entries: Iterable) -> None:
        """The next block of a run; it begins at or after what ``until`` has passed, and not after what it has left."""
        i = self.places.setdefault(run, len(self.places))
        if i == len(self.heads):
            more = max(1, len(self.heads))
            self.queues += [deque() for _ in range(more)]
            self.heads += [None] * more
            self.tree = [-1] * len(self.heads)
            for k in range(len(self.heads)):
                self._replay(k)
        self.queues[i].extend(entries)
        if self.heads[i] is None:
            self._next(i)
            self._enter(i)

    def until(self, bound=None) -> Iterator:
        """The entries in order, up to the first whose key isn't below ``bound``."""
        while self.heads and (head := self.heads[self.tree[0]]) is not None and (bound is None or head[0] < bound):
            yield head[2]
            self._next(head[1])
            self._replay(head[1])


def merge_blocks(blocks: Iterable[tuple[str, list]], key: Callable) -> Iterator:
    """Entries in order, from (run, block) in the order of the blocks' first entries; holds one block of each run."""
    tree = LoserTree(key)
    for run, entries in blocks:
        yield from tree.until(key(entries[0]))
        tree.feed(run, entries)
    yield from tree.until()


def _bounds(runs: DataFrame) -> list[tuple]:
    """Keys that part the captures in ranges of about MERGE_ROWS; at most MAX_RANGES of them."""
    n = runs.count()
    parts = min(MAX_RANGES, -(-n // MERGE_ROWS))
    if parts < 2:
        return []
    unit = 1 << 31
    below = min(unit, int(parts * _SAMPLE / n * unit) + 1)
    place = F.pmod(F.xxhash64("url_key", "timestamp", "page_id", "file", "offset"), F.lit(unit))
    sample = sorted(_order(tuple(r)) for r in runs.filter(place < below).select(*_NAMES).collect())
    return [sample[k * len(sample) // parts] for k in range(1, parts)] if len(sample) >= parts else []


_BLOCKS = f"part int, first_key string, first_time string, no_page boolean, first_page long, run string, nth long, entries array<struct<{_ENTRY.replace(' ', ':').replace(',:', ',')}>>"
_BLOCK_TYPES = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct(list(_SCHEMA)))]
_BLOCK_NAMES = [x.split()[0] for x in _BLOCKS.split(", ")[:7]] + ["entries"]


def _cut_runs(rows: Iterable[tuple], bounds: list[tuple]) -> Iterator[tuple]:
    """Blocks (in the order of _BLOCK_NAMES) of (entry, run) rows; where a reader breaks a run's order, another begins."""
    entries: list[tuple] = []
    state: list = [None, None, 0, 0]  # run, last order, part, number of the block

    def block(number: int) -> tuple:
        first = entries[0]
        return (state[2], first[0], first[1], first[2] is None, first[2] or 0, f"{state[0]}#{number}", state[3], list(entries))

    number = 0
    for *entry, run in rows:
        order = _order(tuple(entry))
        part = bisect_right(bounds, order)
        broken = run != state[0] or (state[1] is not None and order < state[1])
        if entries and (broken or part != state[2] or len(entries) >= BLOCK_ROWS):
            yield block(number)
            entries.clear()
            state[3] += 1
        if broken:
            number += 1
        state[:3] = run, order, part
        entries.append(tuple(entry))
    if entries:
        yield block(number)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The capture histories in global order of URL key, timestamp and page_id."""
    bounds = runs.sparkSession.sparkContext.broadcast(_bounds(runs))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _cut_runs(rows_of(batches), bounds.value)
        while some := list(islice(found, 20)):
            columns = list(zip(*some))
            columns[7] = [[dict(zip(_NAMES, e)) for e in block] for block in columns[7]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK_TYPES)], _BLOCK_NAMES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = ((f"{row[0]}#{row[5]}", [tuple(e[n] for n in _NAMES) for e in row[7]]) for row in rows_of(batches))
        merged = merge_blocks(blocks, _order)
        while some := list(islice(merged, 10_000)):
            yield _as_batch(some, _SCHEMA)

    order = ["part", "first_key", "first_time", "no_page", "first_page", "run", "nth"]
    blocks = runs.select(*_NAMES, "run").mapInArrow(cut, _BLOCKS)
    dealt = blocks.repartitionByRange(len(bounds.value) + 1, "part").sortWithinPartitions(*order)
    return dealt.mapInArrow(merge, _ENTRY)


def archive_and_index(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write archives and runs below ``folder``; the merged capture index of what was read back.

    The index is read from ``folder``/runs, so the folder stays until it has been used.
    """
    spark = pages.sparkSession
    write_archives(pages, f"{folder}/archives", min_bytes)
    capture_runs(spark, f"{folder}/archives").write.parquet(f"{folder}/runs")
    runs = spark.read.parquet(f"{folder}/runs")
    written, found = pages.count(), runs.count()
    if written != found:
        raise ValueError(f"{written} pages were written and {found} captures read")
    return merge_runs(runs)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = archive_and_index(table(spark, sf_dir, "pages"), folder)
    remove(spark, f"{folder}/archives")  # the index holds what the query returns
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
w AS (
  SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS head FROM p
), d AS (
  SELECT *, head IS NOT NULL AND page_id IS DISTINCT FROM head AS again,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31) + 1)::INTEGER, 1) for i in range(32)], '') AS digest
  FROM w
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN head END AS refers_to
FROM d
"""

QUERIES = {"op7_warc": op7_warc}
ORACLES = {"op7_warc": ORACLE}
