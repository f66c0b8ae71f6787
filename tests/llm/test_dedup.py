import random

import pytest

pytest.importorskip("meridia.llm")

from meridia.llm import exact_dedup, simhash  # noqa: E402
from meridia.operators import joins  # noqa: E402
from meridia.operators.graph import connected_components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, digest string, near_dup_gone_id long, `a.b` string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "x", i, "d") for i, t in rows], SCHEMA)


def test_exact_dedup_edges(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t"), (None, "ab"), (7, "x" * 200_000), (8, "a b")]
    got = {r.doc_id: r for r in exact_dedup.dedup_report(_docs(spark, rows)).collect()}
    assert {i: got[i].keep_id for i in got} == {1: 3, 2: 3, 3: 3, None: 3, 4: 6, 5: 6, 6: 6, 7: 7, 8: 8}
    assert got[1].group_size == 4 and got[3].kept and not got[1].kept
    left = exact_dedup.survivors(_docs(spark, rows + [(3, "a  b")]))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "rank", "digest", "near_dup_gone_id", "a.b"]
    assert sorted(r.doc_id for r in left.collect()) == [3, 6, 7, 8]


@pytest.mark.parametrize("rows", [100_000, 2])
def test_exact_dedup_against_counting_by_hand(spark, monkeypatch, rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
    rng = random.Random(5)
    texts = ["hot  text"] * 60 + [" ".join("abc"[: rng.randrange(4)]) * rng.randrange(3) for _ in range(60)] + [None, "x y z" * 30_000]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    groups = {}
    for i, t in docs:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i))
    got = {r.doc_id: r for r in exact_dedup.dedup_report(_docs(spark, docs)).collect()}
    for members in groups.values():
        keep = min(members)[1]
        for _, i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(members), i == keep)
    assert sorted(r.doc_id for r in exact_dedup.survivors(_docs(spark, docs)).collect()) == sorted(min(m)[1] for m in groups.values())


def test_survivors_of_rows_that_differ_in_space_only(spark):
    rows = [(1, "a b"), (1, "a\tb"), (1, None), (1, None), (2, "c")]
    left = exact_dedup.survivors(_docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, "a\tb"), (1, None), (2, "c")], key=str)


def test_exact_dedup_only_null_ids(spark):
    rows = [(None, "a"), (None, "a b"), (None, "ab")]
    got = exact_dedup.dedup_report(_docs(spark, rows)).collect()
    assert all(r.keep_id is None for r in got) and sorted(r.group_size for r in got) == [1, 2, 2]


def test_dedup_empty_tables(spark):
    assert exact_dedup.dedup_report(_docs(spark, [])).count() == 0
    assert exact_dedup.survivors(_docs(spark, [])).count() == 0
    assert simhash.near_dup_report(_docs(spark, [])).count() == 0


def _brute(prints):
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin(a ^ b).count("1") <= simhash.MAX_BITS:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in prints}


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(50)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 40, 200]))]
        for _ in range(rng.choice([1, 3])):
            copy = list(base)
            if copy and rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "zz%d" % rng.randrange(9)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (None, rows[5][1]), (5, rows[5][1])]
    want_fp = [(i, simhash.fingerprint(t)) for i, t in rows]
    roots = _brute({f for _, f in want_fp})
    heads = {}
    for i, f in want_fp:
        if i is not None:
            heads[roots[f]] = min(i, heads.get(roots[f], i))
    want = sorted(((i, "%016x" % f, heads[roots[f]]) for i, f in want_fp), key=str)
    got = sorted((tuple(r) for r in simhash.near_dup_report(_docs(spark, rows)).collect()), key=str)
    assert got == want
    left = sorted(r.doc_id for r in simhash.survivors(_docs(spark, rows)).collect())
    assert left == sorted(set(heads.values()))


def test_fingerprint_definition():
    import xxhash

    words = "The Cat sat ON the mat É the cat sat".split()
    low = [w.replace("T", "t").replace("C", "c").replace("ON", "on") for w in words]
    hashes = [xxhash.xxh64_intdigest(" ".join(low[i : i + 3]).encode(), 42) for i in range(len(low) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(" ".join(words)) == want
    assert simhash.fingerprint("x") == xxhash.xxh64_intdigest(b"x", 42)


def test_survivors_of_repeated_and_null_ids(spark):
    a, b, c = "one two three four five", "quite another text is this here", "and a third one of its own words"
    rows = [(2, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, "no id has this text at all"), (None, "no id has this text at all")]
    left = simhash.survivors(_docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted([(2, a), (5, b), (7, c), (None, rows[-1][1])], key=str)


@pytest.mark.parametrize("rows", [100_000, 4])
def test_crowded_cells_keep_every_link(spark, monkeypatch, rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(20)}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in connected_components(simhash._links(frame)).collect()}
    groups = {}
    for f in signed:
        groups.setdefault(got.get(f, f), set()).add(f)
    brute = {}
    for f, r in _brute(prints).items():
        brute.setdefault(r, set()).add(f - (1 << 64) if f >> 63 else f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_middles_are_the_numbers_one_bit_away_in_the_cell(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(40)] + [0, -1, 1, -(1 << 63)]

    def vector(x):
        return sum(bin(x >> 2 * i & 3).count("1") << 2 * i for i in range(32))

    rows = spark.createDataFrame([(x,) for x in prints], "fp long")
    cells = rows.withColumn("cell", F.explode(simhash._cells(simhash.popcount_vector(F.col("fp"))))).filter("cell is not null")
    got = cells.select("fp", "cell", simhash._middles(F.col("fp"), F.col("cell")).alias("m")).collect()
    for fp in prints:
        mine = [m % 2**64 for r in got if r.fp == fp for m in r.m]
        assert sorted(mine) == sorted([fp % 2**64] + [fp % 2**64 ^ 1 << i for i in range(64)])
    assert all(vector(m % 2**64) == r.cell % 2**64 for r in got for m in r.m)
