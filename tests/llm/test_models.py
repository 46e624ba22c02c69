"""Bounds of the language model's sample and of the encoder's cache; long words by rounds."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemolake.llm import bpe, language_id

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe.Tokenizer(Path(PATH).read_text(encoding="utf-8"))


def test_a_language_of_long_texts_only(spark):
    """No label is lost to the sample's bound, whatever the length of its texts."""
    rng = random.Random(1)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(2, 8)))
    text = lambda s, n: " ".join(word(s) for _ in range(n))
    rows = [(i, text("aeiourstlm", 5000), "la") for i in range(5)] + [(10 + i, text("bcdfghkqx", 40), "en") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(r[1]) for r in rows[:5]) > 1 << 14
    for options in ({}, {"cells": 16}, {"texts_per_language": 1}):
        model = language_id.fit(df, **options)
        assert model.languages == ["en", "la"]
        assert [r["lang_pred"] for r in language_id.identify(df, model).orderBy("doc_id").collect()] == [r[2] for r in rows]


def test_a_column_that_is_no_language(spark):
    """Of many labels the most frequent are learned; of one huge text, as much as its share."""
    rows = [(i, "some words here", f"l{i:03}") for i in range(60)] + [(100 + i, "vox populi", "la") for i in range(3)] + [(200, "drei Worte noch " * 9000, "de"), (201, "drei Worte", "de")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=5, cells=25 * 64)
    assert model.languages == ["de", "l000", "l001", "l002", "la"]
    one = language_id.fit(spark.createDataFrame([r for r in rows if r[0] == 200], "doc_id long, text string, lang string"), cells=500)
    assert one.languages == ["de"]


def test_extra_columns_of_any_type(spark):
    """Nested fields with odd names come through; names that are added are refused."""
    df = spark.createDataFrame([(1, "some words", "en", ({"x y": 1},), (2,))], "doc_id long, text string, lang string, `a b` struct<`c d`: map<string, int>>, score struct<`e-f`: int>")
    model = language_id.fit(df)
    got = language_id.identify(df, model, "doc_id", "text", "`a b`").first()
    assert got["a b"]["c d"] == {"x y": 1} and got["lang_pred"] == "en"
    assert bpe.encode_decode(df, PATH, "doc_id", "text", False, "`a b`").first()["a b"]["c d"] == {"x y": 1}
    with pytest.raises(ValueError, match="score"):
        language_id.identify(df, model, "doc_id", "text", "score")
    with pytest.raises(ValueError, match="n_tokens"):
        bpe.encode_decode(df.withColumn("N_tokens", df["lang"]), PATH, "doc_id", "text", False, "N_tokens")


def test_long_texts_go_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    samples = {"a": [bytes(rng.integers(97, 105, 3000, np.uint8))], "b": [bytes(rng.integers(101, 112, 3000, np.uint8))]}
    model = language_id.train(samples)
    raw = rng.integers(97, 112, 5000, np.uint8)
    whole = language_id.code_lengths(model, np.array([0, 4000, 5000]), raw)
    monkeypatch.setattr(language_id, "PIECE", 1 << 10)
    assert (language_id.code_lengths(model, np.array([0, 4000, 5000]), raw) == whole).all()


def test_long_words_by_rounds(coder):
    ref = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    words = ["a" * 5001, "ab" * 700, "é" * 900, "日本語" * 400, "".join(rng.choice("etaoinshr") for _ in range(6000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000)), "=" * 1111, "x" * 511, "y" * 513]
    for w in words:
        assert coder.ids(w) == ref.encode(w, add_special_tokens=False).ids
    flat, count = coder.merge_long([w.encode() for w in words])
    short, same = coder.merge_words([w.encode() for w in words])
    assert flat.tolist() == short.tolist() and count.tolist() == same.tolist()


def test_long_words_where_merges_share_tokens(coder):
    """Without a token for each merge, one pair of a word merges at a time."""
    words = [b"abcabcabcd" * 60, b"aaaa" * 200]
    coder.at_once = False
    try:
        one, two = coder.merge_long(words), coder.merge_words(words)
    finally:
        coder.at_once = True
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()


def test_the_cache_is_bounded_in_bytes(coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 1 << 20)
    ref = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(5000)) + " ".join(str(rng.random()) for _ in range(500))
        assert coder.ids(text) == ref.encode(text, add_special_tokens=False).ids
        held = sum(bpe.ENTRY + 4 * len(k) + len(v) for c in (coder.cache, coder.old) for k, v in c.items())
        assert held < 3 << 20  # two generations and what one text asks
