import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("meridia.llm")

from meridia.llm import runs  # noqa: E402


def _brute(w, least_periods=4, least_words=6):
    """Every stretch of words that equal the ones q before, at its smallest period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least_words, least_periods * q):
                part = w[start : start + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((start, length, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def _sequences(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        if rng.random() < 0.5:
            letters = rng.choice([1, 2, 3, 5])
            yield [rng.randrange(letters) for _ in range(rng.randrange(0, 60))]
        else:
            w = []
            while len(w) < rng.randrange(1, 90):
                w += [rng.randrange(4) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 8)
            yield w


@pytest.mark.parametrize("direct", [1, 2, 12])
def test_runs_agree_with_brute_force(monkeypatch, direct):
    monkeypatch.setattr(runs, "_DIRECT", direct)
    for w in _sequences(direct, 700):
        assert runs.word_runs(w) == _brute(w), w
        assert runs.word_runs(w, 2, 2) == _brute(w, 2, 2), w
        assert runs.document_runs(np.array(w, np.int32)) == _brute(w), w


def test_colliding_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(runs, "_PRIME", 3)
    monkeypatch.setattr(runs, "_DIRECT", 1)
    for w in _sequences(9, 300):
        assert runs.word_runs(w, 2, 2) == _brute(w, 2, 2), w


def test_time_follows_the_length():
    import time

    def took(n):
        began = time.process_time()
        for w in ([1] * n, [i % 997 for i in range(n)], [i % 3 for i in range(n // 2)] + [i % 7 for i in range(n // 2)]):
            assert runs.word_runs(w)
        return time.process_time() - began

    took(5000)
    assert took(80_000) < 20 * took(10_000)


SCHEMA = "doc_id long, text string, runs string, start string"


def _want(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = _brute(w)
    gone = {x for s, length, q in found for x in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_report_agrees_with_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(runs, "_BLOCK_BYTES", 11)
    monkeypatch.setattr(runs, "_VOCABULARY", 20)
    rng = random.Random(2)
    rows = [(i, rng.choice([" ", "\t\n", "\v"]).join(f"w{x}é" for x in w)) for i, w in enumerate(_sequences(6, 150))]
    rows += [(1000, None), (1001, ""), (1002, " \t "), (None, "a b " * 9), (None, None), (5, "a " * 7), (5, "a " * 7), (1003, " x " * 8), (1004, "x\x1cy\x85 " * 6)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = runs.run_report(runs.periodic_runs(df, runs.planted)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((_want(*r) for r in rows), key=str)
    assert sum(r.n_runs > 0 for r in got) > 40


def test_long_text_and_operator_columns(spark):
    rng = random.Random(8)
    parts = [" ".join(str(rng.randrange(10**6)) for _ in range(40_000)), "so on " * 50_000, " ".join(str(i % 700) for i in range(7000))]
    df = spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string")
    (got,) = runs.periodic_runs(df).collect()
    assert [tuple(r) for r in got.runs] == [(40_000, 100_000, 2), (140_000, 7000, 700)]
    assert got.collapsed == " ".join([parts[0], "so on", *map(str, range(700))])


def test_empty_table(spark):
    assert runs.run_report(runs.periodic_runs(spark.createDataFrame([], SCHEMA), runs.planted)).count() == 0


def test_planted_documents_of_the_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text or "") < 20_000}
    got = {r.doc_id: tuple(r) for r in runs.op13_periodic_runs(spark, folder).collect()}
    assert len(got) == docs.count() and all(got[i] == _want(i, t) for i, t in texts.items())
