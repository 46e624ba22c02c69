"""The near_dedup stage against brute force: every pair of Jaccard 0.8 is linked, no other."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from mnemolake.llm import simhash_similar


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def texts() -> list[str]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))

    def edited(text: str, n: int) -> str:
        w = text.split()
        for i in rng.sample(range(len(w)), n):
            w[i] = word()
        return " ".join(w)

    out = []
    for k in range(40):  # one to eight edits of 200 words: 0.95 down to 0.65
        base = " ".join(word() for _ in range(200))
        out += [base, edited(base, 1 + k % 8)]
    base = " ".join(word() for _ in range(150))
    out += [edited(base, 2) for _ in range(60)]  # a bucket of many: 0.75 to 0.95 of each other
    chain = [" ".join(word() for _ in range(120))]
    for _ in range(30):
        chain.append(" ".join([*chain[-1].split()[6:], *(word() for _ in range(6))]))  # ends linked by the middle only
    return out + chain + ["one two three", "One  two three", "one two", "", "  "]


@pytest.mark.parametrize(("tree", "asks"), [(4096, 512), (3, 5)])
def test_near_dedup_finds_every_pair(spark, monkeypatch, tree, asks):
    """With small trees too, and few texts to a copy of one."""
    monkeypatch.setattr(simhash_similar, "TREE", tree)
    monkeypatch.setattr(simhash_similar, "ASKS", asks)
    rows = list(enumerate(texts()))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert kept == [i for i in range(len(rows)) if top(i) == i]
