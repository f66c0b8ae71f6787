import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("meridia.llm")

from meridia.llm import sharding  # noqa: E402

SCHEMA = "doc_id long, text string, source string, shard string, slot string"


def _rows(n=900):
    rng = random.Random(4)
    sources = ["big"] * 6 + ["mid"] * 3 + ["small", None]
    rows = [(i, f"t{rng.randrange(200)} é", rng.choice(sources), "a", "b") for i in range(n)]
    rows += [(5, "same", "big", "a", "b")] * 300 + [(5, "same", "big", "other", "b")] * 20
    rows += [(None, None, None, None, None), (None, None, "mid", None, None), (None, "x" * 200_000, "lone", None, None), (7, "", "lone2", None, None)]
    return rows


def test_shards_are_equal_and_hold_the_mixture(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [r.asDict() for r in sharding.shard_report(df).collect()]
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    whole = sharding.sharded(df)
    assert whole.columns == ["doc_id", "text", "source", "shard", "slot", "shard_0", "slot_0"]
    placed = whole.collect()
    assert Counter(tuple(r[:5]) for r in placed) == Counter(rows)
    assert Counter((r.shard_0, r.slot_0) for r in placed) == Counter((r["shard"], r["slot"]) for r in got)
    per = defaultdict(Counter)
    for r in placed:
        per[r.source][r.shard_0] += 1
    for source, n in Counter(r[2] for r in rows).items():
        assert all(abs(per[source][s] - n / 16) < 3 for s in range(16)), source


@pytest.mark.parametrize("least", [1, 7, 10_000])
def test_ranges_change_no_result(spark, monkeypatch, least):
    df = spark.createDataFrame(_rows(300), SCHEMA)
    want = sorted(map(tuple, sharding.shard_report(df, 7).collect()), key=str)
    monkeypatch.setattr(sharding, "groups_of", lambda *_: least)
    monkeypatch.setattr(sharding, "_CHUNK", 13)
    assert sorted(map(tuple, sharding.shard_report(df.repartition(3), 7).collect()), key=str) == want


def test_plain_ranking_gives_the_same_shards(spark):
    """Rank within the source, sort everything by fractional rank, cut."""
    import hashlib

    rows = [r for r in _rows(400) if r[0] is not None][:400]

    def drawn(*parts):
        return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)

    groups = defaultdict(list)
    for i, t, s, *_ in rows:
        crc = zlib.crc32(t.encode())
        groups[s].append((drawn(29, i, crc, 0), i, len(t.encode()) + 1, crc))
    flat = []
    for s, mine in groups.items():
        shift = float(drawn(29, s or "")) / float(1 << 60)
        flat += [((r + shift) / len(mine), s is None, s or "", r, row[1]) for r, row in enumerate(sorted(mine))]
    want = {row[-1]: k * 16 // len(flat) for k, row in enumerate(sorted(flat))}
    got = sharding.shard_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.shard for r in got} == want


def test_empty_table_and_fewer_rows_than_shards(spark):
    assert sharding.shard_report(spark.createDataFrame([], SCHEMA)).count() == 0
    got = sharding.shard_report(spark.createDataFrame([(1, "a", "s", "", ""), (2, "b", None, "", "")], SCHEMA)).collect()
    assert len({r.shard for r in got}) == 2 and {r.slot for r in got} == {0}


def test_files_hold_their_slots_in_order(spark, tmp_path):
    df = spark.createDataFrame(_rows(200)[:200], SCHEMA).select("doc_id", "text", "source")
    sharding.write_shards(df, f"file://{tmp_path}/out", shards=4, file_rows=20)
    files = list((tmp_path / "out").glob("shard=*/*.parquet"))
    assert len(files) >= 4
    for f in files:
        slots = [r.slot for r in spark.read.parquet(f"file://{f}").coalesce(1).collect()]
        assert slots == sorted(slots)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 200
