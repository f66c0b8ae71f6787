"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts are lower-cased (A-Z) and split into words of letters, digits and
characters beyond ASCII.  A window is WINDOW consecutive words of a benchmark
item; an item of fewer words is one window.  Every word of a document inside an
occurrence of a window is hit.

Winnowing: of the hashes of GRAM consecutive words, the smallest in each run of
WINDOW - GRAM + 1 neighbours is kept (the leftmost of equal ones).  Two texts that
share WINDOW words share all hashes in that run, hence also its smallest, so every
occurrence of a window holds a kept fingerprint of the item.  A hash and its place
are packed in one number, 32 bits each; what a shorter hash lets through by chance
the comparison of words drops.  Windows of short items have fewer words than
winnowing guarantees; each of their lengths is looked up by a hash of its own.

The kept fingerprints of the documents are exploded and joined with those of the
benchmark.  Hits gather by content of the document (a 96-bit key, so that copies
share one answer and a lost task gives the same rows again).  Texts with hits are
extended: the windows around each hit are compared word for word with the windows
of the benchmark.  Items are joined only to the windows that were really found.
Each small side is measured first and broadcast or shuffled accordingly.

Defined results
    null text      no words, not contaminated
    null item      an item without words, never hit
    null item_id   its windows mark words, but it is not listed or counted
    repeated rows  one output row each; an item_id that repeats counts once
    empty table    an empty result, or no hits
    extra columns  ignored by the report, kept by ``clean``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import attach, small_enough
from ..sources.storage import checkpointed
from .common import ascii_lower, table

WINDOW = 10
GRAM = 6
RUN = WINDOW - GRAM + 1
#: Largest side in bytes that a join broadcasts, and keys of contaminated texts that ``clean`` does.
BROADCAST_BYTES = 32 << 20
BROADCAST_KEYS = 1_000_000

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


_KEY = ["k1", "k2"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), lambda w: w != "")


def _key(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def _packed(hashes: Column, size: int) -> Column:
    """All runs of ``size`` words, given the words' hashes: 32 bits of the run's hash over 32 bits of its place."""
    n = F.size(hashes) - size + 1

    def at(i: Column) -> Column:
        salt = [] if size == GRAM else [F.lit(size)]
        h = F.xxhash64(*salt, *(F.get(hashes, i + k) for k in range(size)))
        return h.bitwiseAND(F.lit(-1 << 32)).bitwiseOR(i.cast("long"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<bigint>"))


def _kept(grams: str) -> Column:
    """The smallest of each run of RUN neighbours in column ``grams``, each place once."""
    n = F.size(grams) - RUN + 1
    least = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(*(F.get(grams, i + k) for k in range(RUN))))
    return F.array_distinct(F.when(n > 0, least).otherwise(F.array().cast("array<bigint>")))


def _prints(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """Replaces column ``text`` by ``prints``: kept fingerprints, and all runs of the ``lengths`` of short items."""
    rest = [c for c in texts.columns if c != "text"]
    hashed = texts.select(*rest, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    grams = hashed.select(*rest, "h", _packed(F.col("h"), GRAM).alias("g"))
    short = [_packed(F.col("h"), size) for size in lengths]
    return grams.select(*rest, F.concat(_kept("g"), *short).alias("prints"))


def _windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, len, window text) of all items."""
    items = benchmark.select(F.col("`item_id`").alias("item_id"), words_of(F.col("`text`")).alias("words"))
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - WINDOW + 1))
    return (
        items.filter(n > 0)
        .select("item_id", F.least(n, F.lit(WINDOW)).alias("len"), "words", F.explode(starts).alias("at"))
        .select("item_id", "len", F.array_join(F.slice("words", F.col("at"), WINDOW), " ").alias("window"))
        .distinct()
    )


def _short_lengths(benchmark: DataFrame) -> list[int]:
    """The numbers of words of the items that have fewer than WINDOW, at most WINDOW - 1 numbers."""
    sizes = benchmark.select(F.size(words_of(F.col("`text`"))).alias("n")).filter(F.col("n").between(1, WINDOW - 1))
    return sorted(r.n for r in sizes.distinct().collect())


def _benchmark_prints(benchmark: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per fingerprint of the items: f, and the lengths of the windows that may hold it."""
    items = benchmark.select(F.col("`text`").alias("text"), F.size(words_of(F.col("`text`"))).alias("n"))
    parts = [_prints(items.filter(F.col("n") >= WINDOW).select("text"), []).select(F.lit(WINDOW).alias("len"), F.explode_outer("prints").alias("v"))]
    for size in lengths:
        hashes = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
        run = items.filter(F.col("n") == size).select(hashes.alias("h")).select(F.get(_packed(F.col("h"), size), F.lit(0)).alias("v"))
        parts.append(run.select(F.lit(size).alias("len"), "v"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.filter("v is not null").groupBy(F.shiftright("v", 32).alias("f")).agg(F.collect_set("len").alias("lens"))


def _sized(df: DataFrame, text: str | None = None) -> DataFrame:
    return F.broadcast(df) if small_enough(df, BROADCAST_BYTES, text) else df


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per content with a fingerprint of the benchmark: k1, k2, spots (place, len) and its number of rows."""
    lengths = _short_lengths(benchmark)
    mine = checkpointed(_benchmark_prints(benchmark, lengths))
    text = F.col("`text`")
    prints = _prints(docs.select(*_key(text), text.alias("text")), lengths)
    # An inner explode would infer a filter that computes the fingerprints anew for every word.
    exploded = prints.select(*_KEY, F.explode_outer("prints").alias("v")).withColumn("f", F.shiftright("v", 32))
    hits = exploded.filter("v is not null").join(_sized(mine), "f")
    place = F.col("v").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at")
    return (
        hits.select(*_KEY, place, F.explode("lens").alias("len"))
        .groupBy(*_KEY, "at", "len")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy(*_KEY)
        .agg(F.collect_list(F.struct("at", "len")).alias("spots"), F.max("copies").alias("copies"))
    )


def _extended(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(k1, k2, at, len, window): the windows around every hit."""
    spots = hits.agg(F.sum(F.size("spots") * 16 + 64)).first()[0] or 0
    texts = docs.select(*_key(F.col("`text`")), F.col("`text`").alias("text"))
    found = texts.join(F.broadcast(hits) if spots <= BROADCAST_BYTES else hits, _KEY)
    words = found.select(*_KEY, "spots", words_of(F.col("text")).alias("words"))

    def around(s: Column) -> Column:
        first = F.when(s["len"] == WINDOW, F.greatest(F.lit(0), s["at"] - (WINDOW - GRAM))).otherwise(s["at"])
        last = F.when(s["len"] == WINDOW, F.least(s["at"], F.col("n") - WINDOW)).otherwise(s["at"])
        return F.transform(
            F.sequence(first, F.greatest(first, last)), lambda i: F.struct(i.alias("at"), s["len"].alias("len"))
        )

    starts = F.array_distinct(F.flatten(F.transform("spots", around)))
    placed = words.withColumn("n", F.size("words")).select(*_KEY, "words", "n", starts.alias("starts"))
    texts = F.transform(
        "starts",
        lambda c: F.struct(
            c["at"].alias("at"), c["len"].alias("len"), F.array_join(F.slice("words", c["at"] + 1, c["len"]), " ").alias("window")
        ),
    )
    listed = placed.select(*_KEY, F.explode_outer(texts).alias("c"))
    return listed.select(*_KEY, "c.at", "c.len", "c.window")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per content with a window of the benchmark: k1, k2, copies, n_hit, n_items, items_sha256."""
    hits = checkpointed(_hits(docs, benchmark))
    windows = _windows(benchmark)
    marks = [F.xxhash64("window").alias("w1"), F.hash("window").alias("w2")]
    distinct = checkpointed(windows.select("len", "window").distinct())
    found = checkpointed(
        _extended(docs, hits).join(_sized(distinct, "window"), ["len", "window"]).select(*_KEY, "at", "len", *marks).distinct()
    )
    # Union of the spans, in order of their starts: (words covered, end so far).
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(
        F.sort_array(F.col("spans")),
        zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["at"] + s["len"] - F.greatest(acc["end"], s["at"].cast("long")))).cast("long").alias("n"),
            F.greatest(acc["end"], (s["at"] + s["len"]).cast("long")).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    spans = found.groupBy(*_KEY).agg(F.collect_list(F.struct("at", "len")).alias("spans")).select(*_KEY, covered.alias("n_hit"))
    held = checkpointed(windows.filter("item_id is not null").select("item_id", "len", *marks))
    items = (
        found.select(*_KEY, "len", "w1", "w2")
        .distinct()
        .join(_sized(held), ["len", "w1", "w2"])
        .select(*_KEY, "item_id")
        .distinct()
        .groupBy(*_KEY)
        .agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    )
    named = F.coalesce("items", F.array().cast("array<string>"))
    return spans.join(items, _KEY, "left").join(hits.select(*_KEY, "copies"), _KEY).select(
        *_KEY,
        "copies",
        "n_hit",
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = checkpointed(leaks(docs, benchmark))
    text = F.col("`text`")
    parts = docs.select(
        F.col("`doc_id`").alias("doc_id"), *_key(text), F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK).alias("parts")
    )
    # Only the first and the last part can be empty.
    empty = (F.element_at("parts", 1) == "").cast("long") + (F.element_at("parts", -1) == "").cast("long")
    n_words = F.when((F.size("parts") == 1) & (empty == 2), 0).otherwise(F.size("parts") - empty).cast("long")
    rows = parts.select("doc_id", *_KEY, n_words.alias("n_words"))
    zero = F.lit(0).cast("long")
    return attach(rows, found, _KEY, "copies", F.col("doc_id")).select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any hit, with all columns."""
    names = docs.columns
    bad = checkpointed(leaks(docs, benchmark).select(*_KEY, "copies"))
    rows = docs.select(*_key(F.col("`text`")), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    kept = attach(rows, bad, _KEY, "copies", F.col("row")["doc_id"], "anti", BROADCAST_KEYS)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in names))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), bw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(list_slice(words, pos, pos + 9), ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(2, len(words) - 8))) AS pos FROM bw WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT size FROM win),
occ AS (
  SELECT rid, pos, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS w
  FROM (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS pos
        FROM dw, sizes WHERE len(words) >= size)
), hits AS (
  SELECT o.rid, o.pos, o.size, item_id FROM occ o JOIN win USING (size, w)
), hit_words AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT rid, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY rid
), hit_items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS items
  FROM hits GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""

QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES = {"op9_decontaminate": ORACLE}
