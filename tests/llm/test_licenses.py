"""The licence scan against reading every place of every text."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mnemolake.llm import license_scan as ls
from mnemolake.llm.license_notices import NOTICES, PHRASES


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def base(t):
    w = tokens(t)
    return sorted((k, label) for text, label in PHRASES for p in [text.split()] for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p)


def noticed(rows):
    """Labels of notices in each text, and the largest share, by the definition."""
    held = [set(tokens(t)) for _, t in rows]
    idf = {w: max(math.log1p(len(rows) / (1 + sum(w in h for h in held))), 1e-9) for x in (*(p for p, _ in PHRASES), *(n for _, n, _ in NOTICES)) for w in x.split()}
    number = {w: i for i, w in enumerate(idf)}
    out = []
    for (_, text), has in zip(rows, held, strict=True):
        w, labels, best = tokens(text), set(), 0.0
        for label, notice, keys in NOTICES:
            t = notice.split()
            asked = [x for x in sorted(set(t), key=lambda x: (-idf[x], number[x])) if x in has][: ls.RARE]
            for s in {p - q for p, x in enumerate(w) if x in asked for q, y in enumerate(t) if y == x}:
                at = lambda q, k: 0 <= s + q + k < len(w) and w[s + q + k] == t[q]  # noqa: B023, E731
                shifts = range(-ls.SLACK, ls.SLACK + 1)
                met = [any(at(q, k) for k in shifts) for q in range(len(t))]
                agree = {t[q] for q in range(len(t)) if met[q]} & set(asked)
                spans = [(i, len(key.split())) for key in keys for i in [next(i for i in range(len(t)) if t[i : i + len(key.split())] == key.split())]]
                stand = all(any(all(at(q, k) for q in range(i, i + n)) for k in shifts) for i, n in spans)
                share = sum(idf[x] for x, m in zip(t, met, strict=True) if m) / sum(idf[x] for x in t)
                if len(agree) >= min(ls.AGREE, len(asked)) and stand and share >= ls.SHARE:
                    labels.add(label)
                    best = max(best, share)
        out.append((labels, best))
    return out


def corpus():
    rng = random.Random(3)
    plain = "the of to and in is license this under by all rights general public file 2 0 software".split()
    rows = [(None, None), (None, ""), (1, "  \n\t "), (2, "CC BY cc-by; Cc\nBy CC, BY"), (2, "cc byé cc by9 ccby c c by"), (3, "All Rights Reserved. ALL rights reserved all rights"), (3, "ÀLL rights reserved"), (4, "general public license general public license"), (4, "general public license general public license")]
    for label, notice, _ in NOTICES:
        w = notice.split()
        altered = w[:3] + ["really"] + w[3:]
        cut = [x for x in w if x != rng.choice(w)]
        for body in (w, altered, cut, w[: len(w) // 2], rng.sample(w, len(w))):
            head, foot = ([rng.choice(plain) for _ in range(rng.randint(0, 30))] for _ in range(2))
            rows.append((len(rows), " ".join([*head, *body, *foot]).title() if label < "c" else ", ".join([*head, *body, *foot])))
    rows += [(len(rows) + k, " ".join(rng.choice(plain) for _ in range(200))) for k in range(20)]
    return rows


def test_against_reading_all_places(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, matches string, n_words string")
    got = ls.digest(ls.scan_licenses(df)).collect()
    want = []
    for (i, t), (labels, share) in zip(rows, noticed(rows), strict=True):
        b = base(t)
        names = {x for _, x in b}
        want.append((i, len(tokens(t)), len(b), b[0][0] if b else None, b[-1][0] if b else None, ",".join(sorted(names)), ",".join(sorted(names | labels)), round(1.0 if b else share, 9)))
    assert sorted((*r[:7], round(r["score"], 9)) for r in got if r[0] is not None) == sorted(x for x in want if x[0] is not None)
    assert [tuple(r) for r in got if r[0] is None] == [(None, 0, 0, None, None, "", "", 0.0)] * 2
    found = {label for _, _, _, _, _, _, labels, _ in want for label in labels.split(",")}
    assert {n[0] for n in NOTICES} <= found


def test_notices_as_written(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        (2, "prose. This work is licensed under the GNU General Public License, version 3. more prose", "gpl,gpl-3.0"),
        (3, "Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        (4, "/* Released under the\n * MIT License. */", "mit"),
        (5, "Er kam mit License und ging; the apache tribe held a license of version 2", ""),
        (6, "redistribution of income and use of source material in binary stars", ""),
    ]
    got = ls.digest(ls.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))).collect()
    assert sorted((r["doc_id"], r["labels"]) for r in got) == [(r[0], r[2]) for r in rows]
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)


def test_empty(spark):
    assert ls.digest(ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_long_texts_in_parts(monkeypatch, piece):
    """Parts end between words, so starts and counts stay."""
    texts = [t or "" for _, t in corpus()] + ["cc by " * 500 + "é" * 300 + " all rights reserved"]
    index = ls.Index(PHRASES, NOTICES)
    whole = ls.licence_words(pa.array(texts), index)
    monkeypatch.setattr(ls, "PIECE", piece)
    for a, b in zip(whole, ls.licence_words(pa.array(texts), index), strict=True):
        assert np.array_equal(a, b)
    monkeypatch.setattr(ls, "PLACES", 3)
    idf = np.ones(len(index.names))
    doc, t, start, _ = ls.matches(*whole, index, idf)
    of = (doc == len(texts) - 1) & np.array([index.templates[x].exact for x in t])
    assert start[of].tolist() == [*range(0, 1000, 2), 1001]


def test_key_phrases_must_be_in_the_notice():
    with pytest.raises(ValueError, match="key phrase"):
        ls.Index((), [("x", "some notice", ("other words",))])
