import random

import pytest
from pyspark.sql import functions as F

from crystalspark.llm import merge_counts
from crystalspark.llm.registry import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return merge_counts.Counter(*merge_counts.merge_table(f.read()))


PIECES = ["a", "the", " ", "  ", "\n", "\r\n", "\t", "'s", "'re", "'l", "1", "²", "é", "½", "ß", "×", "中", "文字", "\x1c", "\x85", "\xa0", "՘", "Ᲊ", "😀", "‍", "!", "_", "<|endoftext|>", "<|endof"]


@pytest.mark.parametrize("kind", ["latin", "any", "characters"])
def test_against_the_library(library, counter, kind):
    rng = random.Random(kind)
    latin = [x for x in PIECES if all(ord(c) < 256 for c in x)]
    for _ in range(3000):
        if kind == "characters":
            text = "".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(0, 30)))
        else:
            text = "".join(rng.choice(latin if kind == "latin" else PIECES) for _ in range(rng.randint(0, 30)))
        assert counter(text) == library(text), repr(text)


def test_one_long_word_and_segments(library, counter, monkeypatch):
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    assert counter(word) == library(word)
    monkeypatch.setattr(merge_counts, "SEGMENT", 50)
    text = " ".join("".join(rng.choice("abcé'1. \n") for _ in range(rng.randint(1, 9))) for _ in range(4000))
    assert len(list(merge_counts.segments(text))) > 100 and "".join(merge_counts.segments(text)) == text
    assert counter(text) == library(text)


def test_merges_against_repeated_scans():
    rng = random.Random(2)
    pairs, made = [], [b"a", b"b", b"c"]
    while len(pairs) < 12:
        pair = rng.choice(made), rng.choice(made)
        if pair not in pairs:
            pairs.append(pair)
            made.append(pair[0] + pair[1])
    ranks, merges = {p: r for r, p in enumerate(pairs)}, merge_counts.Merges(pairs)
    for _ in range(2000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 100)))
        symbols = [word[i : i + 1] for i in range(len(word))]
        while True:
            found = min(((ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks), default=None)
            if found is None:
                break
            i = found[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        assert merges.count(word) == len(symbols)


def test_cache_halves_change_nothing(library, monkeypatch):
    monkeypatch.setattr(merge_counts, "CACHE", 5)
    with open(PATH, encoding="utf-8") as f:
        counter = merge_counts.Counter(*merge_counts.merge_table(f.read()))
    for text in ["one two three four five six seven", "eight nine one two", "one", "ten two three"] * 3:
        assert counter(text) == library(text)


def test_documents(spark, docs, no_docs, clashing, rows, library):
    found = merge_counts.count_tokens(clashing, PATH)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens"]
    expected = sorted(((r[0], len((r[1] or "").encode()), library(r[1] or "")) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found.collect()), key=str) == expected
    assert merge_counts.count_tokens(no_docs, PATH).count() == 0
    assert merge_counts.count_tokens(docs.where(F.col("text").isNull()), PATH).collect()[0].n_tokens == 0


def test_other_tokenizers_raise():
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        merge_counts.merge_table(f.read())
