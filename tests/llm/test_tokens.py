import json
import random
import time

import pytest

pytest.importorskip("meridia.llm")
P = pytest.importorskip("public_tokenizers")

from meridia.llm import tokens  # noqa: E402

PATH = str(P.path(tokens.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def _texts():
    rng = random.Random(5)
    alphabet = "abcdefghij ABC .,!\n\t'0123é日本😀́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    return texts + [None, "", " ", "a", "aaaaaaaaa", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "a" * 5000, "ab" * 3000 + "c", "the " * 20000]


def test_counts_agree_with_the_library(library, monkeypatch):
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in _texts()]
    assert tokens.Counter(PATH).count(_texts()) == want
    monkeypatch.setattr(tokens, "CACHE", 10)
    monkeypatch.setattr(tokens, "_BLOCK_TOKENS", 7)
    assert tokens.Counter(PATH).count(_texts()) == want
    monkeypatch.setattr(tokens, "_BLOCK_BYTES", 40)
    monkeypatch.setattr(tokens, "BAND", 2)
    assert tokens.Counter(PATH).count(_texts()) == want


@pytest.mark.parametrize("band", [1, 3, 50, 4096])
def test_long_pre_tokens_agree_with_the_library(library, monkeypatch, band):
    monkeypatch.setattr(tokens, "BAND", band)
    rng = random.Random(band)
    long = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [long("etaoinshr", 3000), "a" * 5001, "ab" * 4000, long("日本é😀", 2000), long("!?#", 3000)]
    texts.append(" ".join(long("etaoinshrdlu", rng.randrange(1, 300)) for _ in range(60)))
    assert tokens.Counter(PATH).count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_megabyte_without_a_break_takes_seconds(library):
    rng = random.Random(1)
    start = time.process_time()
    text = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(1_000_000))
    assert tokens.Counter(PATH).count([text]) == [len(library.encode(text).ids)]
    assert time.process_time() - start < 30


def test_unknown_options_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            tokens.Counter(str(tmp_path / "v.json"))


def test_report(spark, library):
    rows = [(1, "a b", 9), (None, None, 8), (3, "é " * 600, 7), (3, "é " * 600, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((tuple(r) for r in tokens.token_counts(frame, PATH).collect()), key=str)
    n = len(library.encode("é " * 600).ids)
    assert got == sorted([(1, 3, 2, False), (None, 0, 0, False), (3, 1800, n, n > 512), (3, 1800, n, n > 512)], key=str)
    assert tokens.token_counts(frame.limit(0), PATH).count() == 0
