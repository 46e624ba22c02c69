"""Levenshtein automata over trie shards against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mnemolake.llm import spelling as sp

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, slip_every=31):
    n: Counter[str] = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(SMALL)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip_every and h % slip_every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 7:
                n[w] += 1
    n = Counter({w: c for w, c in n.items() if c > 1})
    form = {}
    for w in n:
        best = min(((-n[v], v) for v in n if near(w, v)), default=None)
        if best and -best[0] >= 10 * n[w]:
            form[w] = best[1]

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), c, sum(near(w, v) for v in n), n.get(form.get(w))) for w, c in n.items())


def got(spark, rows, slip_every=31):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, near int")
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in sp.spelling_variants(df, slip_every=slip_every).collect())


@pytest.mark.parametrize("seed", range(3))
def test_automata(seed):
    """Few letters, so that one pair has many ways to be apart; shards of all words and of one."""
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abé"[: rng.randint(1, 3)]) for _ in range(rng.randint(0 if seed else 1, 8))).encode("latin-1") for _ in range(250)})
    want = sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a.decode("latin-1"), b.decode("latin-1")))
    trie = sp.Trie.unpacked(sp.Trie(words, np.arange(len(words))).packed())
    q, v = sp.neighbours(trie, words)
    assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == want
    alone = [sp.neighbours(sp.Trie([w], np.ones(1)), words)[0].tolist() for w in words]
    assert sorted((i, j) for j, found in enumerate(alone) for i in found) == want


def test_words_of_all_kinds(spark, monkeypatch):
    """Slips, chains of forms, ties, repeats, a hot word, long words; in blocks, shards and waves of a few words."""
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdeàü") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    stems += [s[:k] + rng.choice("abcé") + s[k + 1 :] for s in stems for k in (0, 3, len(s) - 1)]
    rows = [(i, " ".join(rng.choice(stems[: rng.choice((3, 30, 240))]).upper() + rng.choice((" ", "-", "9", "_")) for _ in range(300))) for i in range(40)]
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    rows += [(100, None), (101, ""), (None, "straßen straßen"), (None, "straßen Straßen"), (102, f"{long} {long}x {long} {long}x"), (103, "ÀÉÎÕÜÑÇ àéîõüñç ÀÉÎÕÜÑÇ àéîõüñç ×÷×÷×÷× ×÷×÷×÷×")]
    rows += [(105 + k, w) for k, (w, c) in enumerate((("chained", 300), ("chainee", 25), ("chaiiee", 2), ("tiedone", 20), ("tiedtwo", 20), ("tiedtoe", 2))) for _ in range(c)]
    for name, value in (("SHARD", 64), ("WAVE", 4096), ("BLOCK", 500), ("WORDS", 50), ("HELD", 40), ("PIECE", 100)):
        monkeypatch.setattr(sp, name, value)  # on the driver; workers keep theirs
    want = brute([r for r in rows if r[0] != 102])
    found = got(spark, rows)
    assert [r for r in found if len(r[0]) < 1000] == want
    assert ("chaiiee", "chainee", "chained") in {r[:3] for r in want} and any(r[4] > 2 for r in want)
    assert [r[1:] for r in found if len(r[0]) > 1000] in ([(None, long, 2, 1, None), (None, long + "x", 2, 1, None)], [(None, w, 2, 1, None) for w in sorted((long, long + "x"))])
    assert [r for r in got(spark, rows, None) if len(r[0]) < 1000] == brute([r for r in rows if r[0] != 102], None)


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "short words only")]) == []


def test_bounds_in_a_task(monkeypatch):
    """Counts handed on in parts and states in small blocks give the same."""
    import pyarrow as pa

    text = "counting counting sortable sortable countings " * 30
    batch = pa.RecordBatch.from_pydict({"id": ["1", "2"], "text": [text, "COUNTING"]})
    whole = sp._counts(7, None)([batch])
    total = Counter()
    for b in whole:
        total.update(dict(zip(*b.to_pydict().values(), strict=True)))
    monkeypatch.setattr(sp, "HELD", 1)
    monkeypatch.setattr(sp, "PIECE", 10)
    parts = Counter()
    for b in sp._counts(7, None)([batch]):
        for w, n in zip(*b.to_pydict().values(), strict=True):
            parts[w] += n
    assert parts == total == Counter({"counting": 61, "sortable": 60, "countings": 30})
    words = sorted({f"w{i:03}".encode() for i in range(300)})
    every = sorted(zip(*(x.tolist() for x in sp.neighbours(sp.Trie(words, np.ones(300)), words)), strict=True))
    monkeypatch.setattr(sp, "BLOCK", 17)
    assert sorted(zip(*(x.tolist() for x in sp.neighbours(sp.Trie(words, np.ones(300)), words)), strict=True)) == every and len(every) > 5000
