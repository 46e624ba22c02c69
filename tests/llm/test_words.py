"""Words, windows and repeats where hashes of a weak form would collide or runs would hide."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from mnemolake.llm import flat_words, quality_rules, substring_dedup


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def tokens(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def expected(rows: list[str | None]) -> list[tuple[int, int, int, str]]:
    seen = Counter(" ".join(w[i : i + 35]) for t in rows for w in [tokens(t)] for i in range(len(w) - 34))
    out = []
    for k, t in enumerate(rows):
        w = tokens(t)
        gone = {i + j for i in range(len(w) - 34) if seen[" ".join(w[i : i + 35])] > 1 for j in range(35)}
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def removed(spark, rows: list[str | None]) -> list[tuple]:
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return sorted(map(tuple, substring_dedup.substring_dedup(df).collect()))


def test_words_are_told_apart():
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    raw = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
    first, last, _ = flat_words.words(np.array([0, len(raw)]), raw)
    assert flat_words.hashes(raw, first, last).tolist()[0] == flat_words.hashes(raw, first, last).tolist()[2] != flat_words.hashes(raw, first, last).tolist()[1]


def test_colliding_words_repeat_nothing(spark):
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    shared = [f"w{i}" for i in range(34)]
    rows = [" ".join([x, *shared]), " ".join([y, *shared]), " ".join(thue_morse(64, "a ", "b ").split()), " ".join(thue_morse(64, "b ", "a ").split())]
    assert removed(spark, rows) == expected(rows)
    df = spark.createDataFrame([(0, f"{x}\n{y}", "s")], "doc_id long, text string, source string")
    assert [r["n_dup_lines"] for r in quality_rules.host_rules(df).collect()] == [0]


@pytest.mark.parametrize("seed", range(3))
def test_passages_that_begin_and_end_in_repeated_phrases(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        phrase = [f"p{k}{j}" for j in range(rng.randint(1, 3))] * rng.randint(3, 4)
        core = [f"c{k}_{j}" for j in range(rng.randint(30, 50))]
        passage = rng.choice([core + phrase, phrase + core, phrase + core + phrase])
        for _ in range(2):
            rows.append(" ".join([*[f"l{rng.randint(0, 9)}" for _ in range(rng.randint(0, 6))], *passage, *[f"l{rng.randint(0, 9)}" for _ in range(rng.randint(0, 6))]]))
    assert removed(spark, rows) == expected(rows)


@pytest.mark.parametrize(("letters", "size"), [(2, 220), (3, 400), (1, 120)])
def test_small_alphabets(spark, letters, size):
    rng = random.Random(letters)
    part = [rng.choice("abc"[:letters]) for _ in range(50)]
    rows: list[str | None] = [None, ""]
    for _ in range(30):
        t = [rng.choice("abc"[:letters]) for _ in range(rng.randint(0, size))]
        at = rng.randint(0, len(t))
        rows.append(" ".join(t[:at] + part[rng.randint(0, 8) :] + t[at:]))
    assert removed(spark, rows) == expected(rows)


def test_windows_beyond_packed_codes():
    """Codes too large to pack are renumbered; groups stay exact."""
    code = np.array([1 << 30, 5, 1 << 30, 1 << 30, 5, 1 << 30, 7], np.int64)
    at, group = flat_words.window_groups(code, np.array([0, 0, 0, 1, 1, 1, 1]), 3)
    assert at.tolist() == [0, 3, 4] and len(set(group.tolist())) == 3
    at, group = flat_words.window_groups(code[:6], np.zeros(6, np.int64), 3)
    assert group[0] == group[3] and len(set(group.tolist())) == 3


def test_long_words_and_null_ids(spark):
    """A word of over a quarter MiB; rows that share a null doc_id."""
    long = "é" * (1 << 18)
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(None, f"{long} {body}"), (None, f"{body} {long}"), (None, "short"), (7, body), (7, body)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(df, full=True).collect())
    assert got == sorted([(True, 41, 40), (True, 41, 40), (True, 1, 0), (False, 40, 40), (False, 40, 40)])
