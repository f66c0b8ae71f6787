import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("meridia.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from meridia.llm import langid, mixing, simhash  # noqa: E402

EN = "the of and thing thre erond hathe with thand ster oner".split()
FR = "le la éaux eau dans mentre ouèque étreille pour queoi".split()


def _texts(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(2)
    items = [(i, _texts(rng, EN, 30)) for i in range(5)]
    rows = []
    for i in range(240):
        lang, words = [("en", EN), ("fr", FR)][i % 2]
        rows.append((i, _texts(rng, words, rng.randrange(30, 90)), lang, "s%d" % (i % 3), 0))
    rows += [(300, rows[3][1], "fr", "s0", 0), (301, rows[3][1] + " ", "fr", "s0", 0), (302, None, "en", "s1", 0), (303, "123 456", "en", None, 0)]
    rows += [(310, rows[10][1] + " " + items[0][1], "en", "s1", 0), (None, _texts(rng, EN, 50), None, None, 0), (311, rows[20][1].upper(), "en", "s2", 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_pipeline(spark, corpus):
    folder, rows, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy_no"]
    got = Counter(r.doc_id for r in out.collect())
    for gone in (3, 300, 302, 303, 310, 311):
        assert gone not in got
    # 301 has more code points than its copies 3 and 300
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in stages["exact_dedup"](spark, docs, folder).collect()}
    assert 301 in kept and not kept & {3, 300}
    near = {r.doc_id for r in stages["simhash_near_dedup"](spark, docs, folder).collect()}
    roots = {}
    prints = [(i, simhash.fingerprint(t)) for i, t, *_ in rows]
    for i, f in prints:
        if i is not None:
            others = [j for j, g in prints if j is not None and bin(f ^ g).count("1") <= 2]
            roots[i] = min(others)
    assert {i for i in near if i is not None} == {i for i in roots if roots[i] == i}
    left = {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, folder).collect()}
    assert {i for i, *_ in rows} - left == {310}


def test_language_held_out_accuracy(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = langid.lang_report(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[302].lang_pred == by[303].lang_pred == "und" and by[302].score == 0
    truth = {i: lang for i, _, lang, *_ in rows if i is not None and i < 300}
    held = [i for i in truth if by[i].held_out]
    assert held and sum(by[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.lang_report(docs.limit(0)).count() == 0
    assert langid.accepted(docs).columns == docs.columns


def test_training_sample_with_null_and_repeated_ids(spark):
    low = min((i for i in range(400) if zlib.crc32(b"%d" % i) % 4 != 2), key=lambda i: zlib.crc32(b"%d" % i))
    rows = [(None, "null %d" % i, "de") for i in range(300)]
    for name in range(400):
        rows.append((name, "own %d" % name, ["de", "en"][name % 2]))
    rows += [(low, "again %d" % i, ["de", "en", "fr"][i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows, langs = langid.training_sample(docs, 60)
    assert len(windows) == 60 and not any(w.startswith(b"null") for w in windows)
    assert Counter(langs) == {"de": 20, "en": 20, "fr": 20}
    assert {w.split()[0] for w in windows} == {b"own", b"again"}


def test_every_window_trains(monkeypatch):
    """With fewer windows an epoch than there are, the epochs take them in turn."""
    monkeypatch.setattr(langid, "EPOCH_WINDOWS", 64)
    seen = Counter()
    real = langid.Network.pooled

    def pooled(self, codes):
        seen.update(bytes(c[:3].astype("uint8")) for c in codes)
        return real(self, codes)

    monkeypatch.setattr(langid.Network, "pooled", pooled)
    langid.train([b"%03d" % i for i in range(150)], ["a", "b"] * 75, epochs=5)
    assert len(seen) == 150 and set(seen.values()) == {2, 3} and sum(seen.values()) == 5 * 64


def test_training_sample_holds_rare_languages_and_whole_texts(spark):
    rows = [(4 * i, "en words %d " % i * 60, "en") for i in range(500)] + [(5001, "seul texte " * 90, "fr"), (5003, "?!", "xx")]
    docs = spark.createDataFrame([(i, t, lang, 1) for i, t, lang in rows], "doc_id long, text string, lang string, key int")
    windows, langs = langid.training_sample(docs, 30)
    taken = [t for i, t, _ in rows if zlib.crc32(b"%d" % i) % 4 != 2]
    assert set(langs) <= {"en", "fr"} and ("fr" in langs) == (zlib.crc32(b"5001") % 4 != 2)
    cut = {t: [t.encode()[a : a + langid.WINDOW] for a in range(0, len(t), langid.WINDOW)] for t in taken}
    some = {t for t in taken if cut[t][0] in windows}
    assert sorted(windows) == sorted(w for t in some for w in cut[t]) and len(some) <= 30
    assert len(langid.training_sample(docs, 30, 7)[0]) == 7
    assert langid.training_sample(docs.limit(0)) == ([], [])


def test_scores_against_a_plain_network(spark):
    """The unfolded, batched network gives what a loop over windows, filters and places gives."""
    texts = ["the cat sat", "é" * 300 + " und so weiter", "x" * 700]
    net = langid.train([t.encode()[: langid.WINDOW] for t in texts] * 20, ["a", "b", "c"] * 20, epochs=2)

    def window_probabilities(window):
        codes = list(window) + [256] * (langid.WINDOW - len(window))
        hidden = []
        for f in range(net.kernel.shape[1]):
            best = -np.inf
            for at in range(langid.WINDOW - langid.WIDEST + 1):
                unfolded = np.concatenate([net.embed[c] for c in codes[at : at + langid.WIDEST]])
                best = max(best, float(unfolded @ net.kernel[:, f]))
            hidden.append(max(best + net.bias[f], 0))
        logits = np.array(hidden) @ net.out + net.out_bias
        e = np.exp(logits - logits.max())
        return e / e.sum()

    langs, scores = langid._classify(net, texts)
    for text, lang, score in zip(texts, langs, scores):
        raw = text.encode()
        windows = [raw[a : a + langid.WINDOW] for a in range(0, len(raw), langid.WINDOW)]
        weights = [sum(chr(b).isascii() and chr(b).isalpha() or b >= 128 for b in w) + 1e-6 for w in windows]
        mean = sum(p * w for p, w in zip(map(window_probabilities, windows), weights)) / sum(weights)
        assert lang == net.labels[int(mean.argmax())] and abs(score - mean.max()) < 1e-4


def test_language_of_repeated_rows_and_clashing_columns(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.unionByName(docs.filter("doc_id in (1, 2)")).selectExpr("*", "1 as score", "'zz' as lang_pred", "2 as `key`", "3 as mark")
    got = langid.lang_report(odd).collect()
    assert len(got) == len(rows) + 2 and {len({(r.lang_pred, r.score) for r in got if r.doc_id == i}) for i in (1, 2)} == {1}
    assert langid.accepted(odd).columns == odd.columns


def test_long_text_uses_every_window(spark):
    windows = [_texts(random.Random(i), [EN, FR][i % 2], 40).encode()[: langid.WINDOW] for i in range(200)]
    net = langid.train(windows, ["en", "fr"] * 100)
    rng = random.Random(9)
    text = _texts(rng, EN, 20) + " " + _texts(rng, FR, 40_000)
    assert langid._classify(net, [text, None, "", "?!"])[0] == ["fr", "und", "und", "und"]


def test_mixture_emits_reported_copies(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    report = mixing.mix_report(docs).collect()
    want = Counter({r.doc_id: r.copies for r in report if r.copies})
    assert Counter(r.doc_id for r in mixing.mixture(docs).collect()) == want
    again = {r.doc_id: r.taken for r in mixing.mix_report(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in report}
    total = sum(r.size for r in report)
    targets = {r.source: (r.target, r.source_size) for r in report}
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6 * total
    for s, (target, size) in targets.items():
        taken = sum(r.taken for r in report if r.source == s)
        assert abs(taken - target) <= max([r.size for r in report if r.source == s]) and target <= 2 * size
    assert all(0 <= r.taken <= 2 * r.size for r in report)
    assert mixing.mix_report(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (None, None, "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_report(nulls).collect()] == [0, 0]


def _by_hand(rows, seed):
    """Copies of every row, by laying the hill out and adding up shares one by one."""
    sizes = {}
    for i, size, source in rows:
        sizes.setdefault(source, []).append((-size, i))
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    total = {s: -sum(z for z, _ in sizes[s]) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * total[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    out = {}
    for k, s in enumerate(names):
        hill: list = []
        for n, (_, i) in enumerate(sorted(sizes[s])):
            hill.insert(0, i) if n % 2 else hill.append(i)
        rate = int(target[s] / total[s] * 2**20) if total[s] else 0
        place = int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:5], 16)
        for i in hill:
            out[i] = (place + rate) // 2**20 - place // 2**20
            place += rate
    return out


def test_sampling_against_one_by_one(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([0, 1, 3, 3, 17, 40, 200]), rng.choice(["a", "b", "b", "b", "ö", None])) for i in range(300)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
    for seed in (17, 3):
        got = {r.doc_id: r.copies for r in mixing.mix_report(docs, seed=seed).collect()}
        assert got == _by_hand(rows, seed)


def test_every_document_has_its_expected_copies():
    """Over many seeds: the mean of the copies is the rate, for every place of the order and also for the largest document."""
    rows = [(i, 10 + i * i, "ab"[i % 8 == 0]) for i in range(64)]
    seeds = 2000
    sums = Counter()
    for seed in range(seeds):
        sums.update(_by_hand(rows, seed))
    for source in "ab":
        means = [sums[i] / seeds for i, _, s in rows if s == source]
        assert max(means) - min(means) < 0.1 and means


def test_repeated_rows_share_the_copies_of_their_group(spark):
    rows = [(7, "one two three", "a", k % 2) for k in range(10)] + [(i, "x " * 50, "b", 0) for i in range(20)]
    rows += [(None, "no id " * 4, "b", k) for k in range(30)] + [(8, "same size", "a", 0), (8, "size same", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no int").withColumn("mix_copy_no", F.lit(1))
    want = Counter()
    for r in mixing.mix_report(docs).collect():
        want[(r.doc_id, r.size)] += r.copies
    out = mixing.mixture(docs)
    assert out.columns[-1] == "mix_mix_copy_no" and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert Counter((r.doc_id, len((r.text or "").split())) for r in got) == +want
    again = Counter((r.copy_no) for r in got if r.doc_id == 7)
    assert abs(again[0] - again[1]) <= 1


@pytest.mark.parametrize("with_rows", [True, False])
def test_pipeline_of_odd_tables(spark, tmp_path, with_rows):
    """Nulls in every column, repeated ids and rows, clashing names, a very long text; and an empty table."""
    rng = random.Random(4)
    clean = [_texts(rng, EN, 60) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 2}", None, 7) for i, t in enumerate(clean)]
    rows += [(3, _texts(rng, EN, 55), "en", "s1", 5, 8), (3, clean[3], "en", "s0", 5, 7), (None, _texts(rng, EN, 50), None, None, None, None)]
    rows += [(None, None, None, None, None, None)] * 3 + [(50, "", "en", "s1", 0, 0), (51, _texts(rng, EN, 60_000), "en", "s1", 0, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy_no int, row string, rank string, h string"
    made = [(*r, "x", "y", "z") for r in rows] if with_rows else []
    spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, _texts(rng, FR, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*(x.split()[0] for x in schema.split(", ")), "mix_copy_no"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == out.columns[:-1], name
    kept = Counter((r.doc_id, r.text) for r in docs.collect())
    if with_rows:
        # Each text once; the empty ones have no language.
        assert kept == Counter({(r[0], r[1]): 1 for r in rows if r[1]})
    else:
        assert not kept and out.count() == 0
