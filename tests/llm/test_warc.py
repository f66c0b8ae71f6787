import base64
import hashlib
import random
import uuid

import pytest

pytest.importorskip("meridia.llm")

from meridia.llm import warc  # noqa: E402

ENDS = ["x\r\n\r\nWARC/1.1", "x\r\n\r\nWARC/1.1\r\n", "\r\n", "\r\n\r\n", "x\r\n\r\nWARC/1.1" * 2, "\r\n\r\n\r"]
CUT = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n"


def _pages(spark):
    rows = [(i, "https://www.Example.com:8080/%d?q=1" % (9 - i % 5), "<p>é %d</p>" % (i % 7)) for i in range(40)]
    rows += [(50, None, None), (51, "x y\r\n", ""), (52, "http://[bad", CUT), (53, "http://h/", CUT * 3 + "\r\n"), (54, "u", "z" * 300_000)]
    rows += [(3, "again", "<p>é 3</p>"), (None, "n", "<p>é 3</p>"), (None, "n", "only nulls"), (None, "n", "only nulls")]
    rows += [(60 + i, "https://e.example/", x) for i, x in enumerate(ENDS)]
    return rows, spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, same string")


def test_round_trip_and_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 7)
    monkeypatch.setattr(warc, "MERGE_ROWS", 11)
    monkeypatch.setattr(warc, "BLOCK_ROWS", 2)
    monkeypatch.setattr(warc, "FILE_BYTES", 90_000)
    rows, frame = _pages(spark)
    got = warc.archive_and_index(frame.repartition(3), f"file://{tmp_path}/{uuid.uuid4().hex}").collect()
    keys = [warc._order(tuple(r)) for r in got]
    assert len(list(tmp_path.glob("*/archives/*.gz"))) > 3
    assert keys == sorted(keys) and len(got) == len(rows)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        head = first.get(html or "")
        again = head is not None and i != head
        want.append((i, len(raw), digest, "revisit" if again else "response", head if again else None))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark, tmp_path):
    _, frame = _pages(spark)
    got = warc.archive_and_index(frame, f"file://{tmp_path}/{uuid.uuid4().hex}", min_bytes=1).collect()
    assert {r.record_type for r in got if r.payload_bytes == 0} == {"response"}


def test_empty_table(spark, tmp_path):
    _, frame = _pages(spark)
    assert warc.archive_and_index(frame.limit(0), f"file://{tmp_path}/{uuid.uuid4().hex}").count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
@pytest.mark.parametrize("size", [1, 3, 100])
def test_blocks_merge_with_one_block_of_a_run_in_memory(k, size):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(90) for _ in range(rng.randrange(40))) for _ in range(k)]
    blocks = [(run[a : a + size], f"r{i}", a) for i, run in enumerate(runs) for a in range(0, len(run), size)]
    blocks.sort(key=lambda b: (b[0][0], b[1], b[2]))
    assert list(warc.merge_blocks(((r, b) for b, r, _ in blocks), lambda x: x)) == sorted(x for r in runs for x in r)
    tree = warc.LoserTree(lambda x: x)
    for b, r, _ in blocks:
        list(tree.until(b[0]))
        tree.feed(r, b)
        # A block that shares its first entry with the end of the one before it may wait beside it.
        assert all(len(q) < 2 * size or q[0] == q[-1] or q[size - 1] == b[0] for q in tree.queues)


def _blocks_of(k, size, n):
    rng = random.Random(k)
    runs = [sorted(rng.random() for _ in range(n)) for _ in range(k)]
    return sorted(((run[a : a + size], f"r{i}") for i, run in enumerate(runs) for a in range(0, n, size)), key=lambda b: b[0][0])


@pytest.mark.parametrize("k", [1, 2, 3, 7, 33, 100])
def test_every_node_holds_the_winner_of_its_weaker_side(k):
    tree = warc.LoserTree(lambda x: x)
    got = []
    for b, r in _blocks_of(k, 3, 20):
        got += tree.until(b[0])
        tree.feed(r, b)
        leaves = len(tree.heads)
        assert sorted(tree.tree) == list(range(leaves))
        best = [None] * leaves + list(range(leaves))
        for at in range(leaves - 1, 0, -1):
            pair = sorted(best[2 * at : 2 * at + 2], key=lambda x: (tree.heads[x] is None, tree.heads[x] or ()))
            best[at] = pair[0]
            assert tree.heads[tree.tree[at]] == tree.heads[pair[1]]
    assert got + list(tree.until()) == sorted(x for b, _ in _blocks_of(k, 3, 20) for x in b)


def test_time_of_an_entry_follows_the_logarithm_of_the_runs():
    import time

    def took(k):
        blocks = [(r, b) for b, r in _blocks_of(k, 12, 24)]
        began = time.process_time()
        assert sum(1 for _ in warc.merge_blocks(blocks, lambda x: x)) == 24 * k
        return (time.process_time() - began) / k

    took(250)
    assert min(took(4000) for _ in range(2)) < 2 * max(took(250) for _ in range(3))


def test_runs_are_cut_at_bounds_and_where_their_order_breaks(monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ROWS", 2)
    entry = lambda k: (k, "t", 1, None, "response", None, 0, "", "f", 0)
    rows = [(*entry(k), run) for run, keys in (("r", "abcxy"), ("s", "mnab")) for k in keys]
    blocks = list(warc._cut_runs(rows, [warc._order(entry("m"))]))
    assert [("".join(e[0] for e in b[7]), b[0]) for b in blocks] == [("ab", 0), ("c", 0), ("xy", 1), ("mn", 1), ("ab", 0)]
    assert len({b[5] for b in blocks}) == 3


def test_url_keys():
    assert warc.url_key("http://www.a.example.org/x?y=1") == "org,example,a)/x?y=1"
    assert warc.url_key("https://b.org:8443") == "org,b:8443)/"
    assert warc.url_key(None) == ""
