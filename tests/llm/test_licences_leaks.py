import hashlib
import random
import re
from collections import defaultdict

import pytest

pytest.importorskip("meridia.llm")

from meridia.llm import decontaminate, licences  # noqa: E402
from meridia.operators import joins  # noqa: E402


def _dice(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_licences_against_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "one", "Released under the MIT License.", "x\nlicensed under the apache license version 2 0\ny z"]
    texts += ["Released under the MIT License. " * 400]
    for name, template in licences.TEMPLATES:
        words = template.split()
        for drop in (0, 1, 4):
            some = [w for w in words if drop == 0 or rng.randrange(len(words)) >= drop]
            texts.append("noise before\n\n" + "\n".join([" ".join(some[:6]), " ".join(some[6:])]) + "\n\nnoise after that")
    rows = list(enumerate(texts)) + [(None, texts[3])]
    frame = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, norm string")
    got = {r.doc_id: r for r in licences.licence_report(frame).collect()}
    templates = [(n, licences.template_bigrams(t)) for n, t in licences.TEMPLATES]
    wholes = [(n, licences.template_bigrams(t)) for n, t in licences.WHOLES]
    for i, text in rows:
        found, nearly = [], False
        norm = re.sub(r"[^a-z0-9\n]+", " ", (text or "").lower())
        units = norm.split("\n") + [p for p in re.split(r"\n ?\n[ \n]*", norm) if "\n" in p]
        for unit in units:
            w = unit.split()
            grams = [f"{a} {b}" for a, b in zip(w, w[1:])]
            if grams:
                best = max((_dice(grams, g), n) for n, g in templates)
                nearly |= 0.6 < best[0] < 0.8  # a window of it may match
                if best[0] >= 0.8:
                    found.append(best)
        w = norm.split()
        if len(w) > 1:
            best = max((_dice([f"{a} {b}" for a, b in zip(w, w[1:])], g), n) for n, g in wholes)
            if best[0] >= 0.8:
                found.append(best)
        best = max(found, default=(None, None))
        names = ",".join(sorted({n.split("/")[0] for _, n in found}))
        if nearly and got[i].n_matches > len(found):
            continue
        assert (got[i].n_matches, got[i].licences, got[i].best_template) == (len(found), names, best[1])
    assert licences.licence_report(frame.limit(0)).count() == 0


def test_notices_inside_longer_lines(spark):
    by = dict(licences.TEMPLATES)
    mit = " ".join(by["MIT/" + x] for x in ("grant", "condition", "warranty"))
    rows = [
        ("This project is released under the MIT License.", "MIT", 1),
        ("Released under the MIT License. All rights reserved.", "MIT", 1),
        ("Some prose before it ends here. Licensed under the Apache License, Version 2.0.", "Apache-2.0", 1),
        (mit, "MIT", 4),
        ("Copyright some one " + mit + " " + by["GPL-2.0/grant"], "GPL-2.0,MIT", 5),
        ("words of a text that is released\nunder the MIT License. And more words\nfollow here", "MIT", 1),
        ("a b c Released under the MIT License. d e f Licensed under CC BY 4.0. g h", "CC-BY-4.0,MIT", 2),
        ("a b\nReleased under the MIT License.\nc d and it was released under the MIT License. e", "MIT", 2),
        ("nothing under the sun, the license of the poet is in the text " * 50, "", 0),
        ("", "", 0),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id int, text string")
    got = {r.doc_id: (r.licences, r.n_matches) for r in licences.licence_report(frame).collect()}
    assert got == {i: (names, n) for i, (_, names, n) in enumerate(rows)}


def test_whole_licences(spark):
    rng = random.Random(3)
    rows = [(n.split("/")[0], t) for n, t in licences.WHOLES]
    rows += [(n, "Copyright 2020 some one else\n" + " ".join(w for w in t.split() if rng.random() < 0.97)) for n, t in rows]
    rows += [("", rows[-1][1][:800] + " other words that no licence has" * 400)]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id int, text string")
    got = {r.doc_id: (r.licences.split(","), r.best_dice) for r in licences.licence_report(frame).collect()}
    for i, (name, _) in enumerate(rows):
        assert name in got[i][0], (i, name, got[i])
    with pytest.raises(ValueError):
        licences.licence_report(frame, [("it's", "a b c")])


def _brute(docs, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[a : a + 10])].add(i)
    out = []
    for i, t in docs:
        words = split(t)
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for a in range(len(words) - size + 1):
                items_here = windows.get(tuple(words[a : a + size]))
                if items_here:
                    hit |= set(range(a, a + size))
                    found |= items_here
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def _shuffled(monkeypatch):
    """Nothing is small enough to be broadcast, but for the keys with the most rows."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", 2)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        _shuffled(monkeypatch)
    rng = random.Random(6)
    vocabulary = ["w%d" % i for i in range(30)] + ["É", "ü9"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, make(n)) for i, n in enumerate([40, 10, 11, 9, 3, 1, 25, 0])]
    items[5] = (5, ["solo"])
    docs = []
    for i in range(40):
        words = make(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            _, item = rng.choice(items)
            a = rng.randrange(max(1, len(item) - 12))
            at = rng.randrange(len(words) + 1)
            words[at:at] = item[a : a + rng.randrange(5, 20)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words).upper() if i % 3 else " ".join(words)))
    docs += [(100, None), (101, ""), (None, " ".join(items[1][1])), (7, docs[7][1])]
    items = [(i, " ".join(w)) for i, w in items] + [(None, "lost words"), (8, None), (1, " ".join(items[1][1]))]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, row int, at int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contamination(frame, bench).collect()), key=str)
    want = _brute(docs, items)
    assert got == want
    clean = decontaminate.clean(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in want if not r[5])
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    assert decontaminate.contamination(frame, bench.limit(0)).filter("contaminated or n_items > 0").count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_large_benchmark_against_brute_force(spark, monkeypatch, broadcast):
    """Tens of thousands of fingerprints, a passage in a third of the documents, and copies of one text."""
    if not broadcast:
        _shuffled(monkeypatch)
    rng = random.Random(2)
    make = lambda n: " ".join("%x" % rng.randrange(5000) for _ in range(n))
    items = [(i, make(rng.randrange(10, 60))) for i in range(6000)]
    docs = [(i, make(rng.randrange(0, 80))) for i in range(200)]
    docs += [(200 + i, f"{make(9)} {rng.choice(items)[1]} {make(5)}") for i in range(100)]
    docs += [(300 + i, f"{make(9)} {items[7][1]} {make(5)}") for i in range(150)]
    docs += [(450 + i, docs[450 - 1][1]) for i in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate._benchmark_prints(bench, []).count() > 50_000
    want = _brute(docs, items)
    assert sorted((tuple(r) for r in decontaminate.contamination(frame, bench).collect()), key=str) == want
    assert {r.doc_id for r in decontaminate.clean(frame, bench).collect()} == {r[0] for r in want if not r[5]}
