import glob
import math
import random
import re
import uuid
from collections import Counter

import pytest
from pyarrow.parquet import ParquetFile

pytest.importorskip("meridia.llm")

from meridia.llm import search  # noqa: E402

DOCS = "doc_id long, text string, item_id string, score string"
ITEMS = "item_id long, text string, doc_id string, rank string"


def _terms(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _brute(docs, items, k):
    bags = [(i, Counter(_terms(t)), len(_terms(t))) for i, t in docs]
    n, total = sum(1 for *_, size in bags if size), sum(size for *_, size in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, bag, size in bags:
            if size:
                m = 100 - 25 + (25 * size * n) // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in _terms(text) if bag[t])
                if s > 0:
                    scored.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if no else i, -s) for rank, (s, no, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def _search(spark, tmp_path, docs, items, k=20, parts=3):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS).repartition(parts)
    i = spark.createDataFrame([(*r, "x", "y") for r in items], ITEMS)
    index = search.build_index(d, f"file://{tmp_path}/{uuid.uuid4().hex}")
    return sorted((tuple(r) for r in search.search(index, i, k).collect()), key=str)


def _rows(rng, n):
    words = [f"w{i}" for i in range(30)] + ["Ünï", "日本", "A1", "éa"]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("window", [3, 4096])
def test_ranks_agree_with_scoring_every_document(spark, tmp_path, monkeypatch, window):
    monkeypatch.setattr(search, "WINDOW_ROWS", window)
    monkeypatch.setattr(search, "_TEXT_BYTES", 7)
    rng = random.Random(window)
    docs = _rows(rng, 60)
    docs += [(i + 100, docs[0][1]) for i in range(30)]  # ties of many copies
    docs += [(None, docs[0][1]), (None, "w1"), (7, "w1 w1"), (7, "w1 w1"), (500, None), (501, ""), (502, " .,!\n"), (-3, docs[0][1].upper())]
    items = [(1, docs[0][1]), (2, "w1 w1 w2"), (2, "w1 w1 w2"), (2, "w3"), (3, None), (4, "..."), (5, "nowhere"), (None, "W1; ünï-A1"), (6, docs[3][1])]
    assert _search(spark, tmp_path, docs, items, 5) == _brute(docs, items, 5)
    monkeypatch.setattr(search, "BLOCK_BYTES", 80)
    assert _search(spark, tmp_path, docs, items, 20) == _brute(docs, items, 20)


def test_long_text_and_windows_in_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "WINDOW_BYTES", 1000)
    rng = random.Random(3)
    docs = [*_rows(rng, 20), (50, "w1 " * 400_000 + "rare"), (51, "x" * 3_000_000)]
    items = [(1, "rare w1"), (2, "x" * 3_000_000)]
    assert _search(spark, tmp_path, docs, items) == _brute(docs, items, 20)


def test_readers_take_few_windows_at_once(spark, tmp_path):
    """A reader takes a row group whole: none holds many windows, even of a task that wrote fewer than a hundred."""
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(25_000))) for i in range(80)]
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    search.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), f"file://{path}")
    groups = [f.metadata.row_group(g) for f in map(ParquetFile, glob.glob(f"{path}/*.parquet")) for g in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 4 and max(g.total_byte_size for g in groups) < 8 << 20


def test_empty_tables(spark, tmp_path):
    assert _search(spark, tmp_path, [], [(1, "a")]) == []
    assert _search(spark, tmp_path, [(1, "a")], []) == []
    assert _search(spark, tmp_path, [(1, None), (2, "")], [(1, "a")]) == []
    index = search.build_index(spark.createDataFrame([(1, "a")], "doc_id long, text string"), f"file://{tmp_path}/x")
    empty = search.search(index, spark.createDataFrame([], ITEMS))
    assert empty.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_large_counts_stay_exact():
    assert search._norms(search.np.array([10**7]), 10**11, 10**14)[0] == 12 * (75 + 25 * 10**18 // 10**14)
