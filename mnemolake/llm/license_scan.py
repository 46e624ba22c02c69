"""Licence scan by a positional index of rare licence words.

The index lists, for each word of the licence texts (templates), where it stands in them.
One pass over the corpus counts in how many files each such word occurs. In a second
pass each file looks up, for each template, the RARE words of it that the file holds and
that are rarest in the corpus (highest IDF), every occurrence of them: an occurrence at p of
a word that stands at q in the template proposes the place p - q. Places on which the
looked-up words agree are read word by word; the template's key phrases must stand there,
and the IDF weight of the words in place must reach a share of the whole.

A phrase is a template that is all key phrase: its places are exact, and all are found,
since a file with the phrase holds all its words. Notices may have up to SLACK words more
or fewer before any of their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.common import tune, utf8
from mnemolake.llm.flat_words import words
from mnemolake.llm.license_notices import NOTICES, PHRASES

#: Words of a template that a file looks up, of those it holds; so many must agree on a notice's place.
RARE, AGREE = 3, 2
#: Words by which a notice's words may be shifted, and the share of its weight that must be in place.
SLACK, SHARE = 3, 0.6
#: Bytes of texts that are cut into words together; longer texts are cut in parts.
PIECE = 1 << 22
#: Places that are read together.
PLACES = 1 << 14

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Template:
    def __init__(self, label: str, text: str, phrases: Sequence[str], exact: bool, number: dict[str, int]) -> None:
        tokens = text.split()
        self.label, self.exact = label, exact
        self.words = np.array([number.setdefault(w, len(number)) for w in tokens], np.int64)
        self.keys = []
        for p in phrases:
            want = p.split()
            at = next((i for i in range(len(tokens)) if tokens[i : i + len(want)] == want), None)
            if at is None:
                raise ValueError(f"the notice does not hold its key phrase: {p}")
            self.keys.append(np.arange(at, at + len(want)))
        self.must = np.unique(self.words[np.concatenate(self.keys)])


class Index:
    """Templates, and the words of all of them by number."""

    def __init__(self, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str, Sequence[str]]]) -> None:
        number: dict[str, int] = {}
        self.templates = [Template(label, text, [text], True, number) for text, label in phrases] + [Template(label, text, keys, False, number) for label, text, keys in notices]
        self.names = list(number)
        coded = [w.encode() for w in self.names]
        self.longest = max(map(len, coded), default=1)
        self.width = -(-self.longest // 8) * 8
        packed = np.frombuffer(b"".join(w.ljust(self.width, b"\0") for w in coded), f"V{self.width}")
        self.order = np.argsort(packed, kind="stable") if len(packed) else np.zeros(0, np.int64)
        self.packed = packed[self.order]
        #: by length, first and last byte: may this be a word of ours?
        self.maybe = np.zeros((self.longest + 1, 256, 256), bool)
        for w in coded:
            self.maybe[len(w), w[0], w[-1]] = True

    def numbers(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words are ours, their numbers)."""
        size = last - first
        which = np.nonzero(size <= self.longest)[0]
        which = which[self.maybe[size[which], raw[first[which]], raw[last[which] - 1]]]
        if not len(which):
            return which, which
        reach = np.arange(self.width)
        take = np.minimum(first[which][:, None] + reach, len(raw) - 1)
        rows = np.where(reach < size[which][:, None], raw[take], 0).astype(np.uint8)
        packed = np.ascontiguousarray(rows).view(f"V{self.width}").ravel()
        # void values have no order in searchsorted, bytes do
        at = np.minimum(np.searchsorted(self.packed.view(f"S{self.width}"), packed.view(f"S{self.width}")), len(self.packed) - 1)
        ours = self.packed[at] == packed
        return which[ours], self.order[at[ours]]


def _parts(at: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, offsets, bytes) of pieces; a long text comes in parts that end between words."""
    a, n = 0, len(at) - 1
    while a < n:
        b = a + 1
        while b < n and at[b + 1] - at[a] <= PIECE:
            b += 1
        if at[b] - at[a] <= PIECE:
            yield a, at[a : b + 1] - at[a], raw[at[a] : at[b]]
        else:
            low, end = int(at[a]), int(at[a + 1])
            while low < end:
                high = min(low + PIECE, end)
                while high < end and not _BETWEEN[raw[high]]:
                    gap = np.nonzero(_BETWEEN[raw[high : high + PIECE]])[0]
                    high = min(high + (int(gap[0]) if len(gap) else PIECE), end)
                yield a, np.array([0, high - low]), raw[low:high]
                low = high
        a = b


def licence_words(column: pa.Array, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; text, place and number of each licence word, in order)."""
    at, raw = utf8(column)
    total = np.zeros(len(at) - 1, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, bounds, piece in _parts(at, raw):
        piece = _LOWER[piece]
        first, last, text = words(bounds, piece, _BETWEEN)
        each = np.bincount(text, minlength=len(bounds) - 1)
        place = np.arange(len(first)) - (np.cumsum(each) - each)[text]
        which, number = index.numbers(piece, first, last)
        found.append((text[which] + a, place[which] + total[text[which] + a], number))
        total[a : a + len(each)] += each
    if not found:
        none = np.zeros(0, np.int64)
        return total, none, none, none
    return total, *(np.concatenate(x) for x in zip(*found, strict=True))


def _frequencies(index: Index) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(number, files that hold the word); all files count under -1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, files, w = np.zeros(len(index.names), np.int64), 0, len(index.names)
        for batch in batches:
            _, text, _, number = licence_words(batch.column("text"), index)
            counts += np.bincount(np.unique(text * w + number) % w, minlength=w) if len(text) else 0
            files += len(batch)
        yield pa.RecordBatch.from_pydict({"number": pa.array([-1, *range(w)], pa.int32()), "n": pa.array([files, *counts.tolist()], pa.int64())})

    return run


def matches(total: np.ndarray, text: np.ndarray, place: np.ndarray, number: np.ndarray, index: Index, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, template, first word, share of the weight in place) of all that is found."""
    n, found = len(total), []
    held = np.zeros((n, len(index.names)), bool)
    held[text, number] = True
    step = int(total.max(initial=0)) + 1 + 2 * max((len(t.words) for t in index.templates), default=0) + 2 * SLACK
    pad = step - 1 - int(total.max(initial=0))
    keys = text * step + place  # ascending
    for t, template in enumerate(index.templates):
        able = held[:, template.must].all(axis=1)
        if not able.any():
            continue
        own = np.unique(template.words)
        own = own[np.lexsort((own, -idf[own]))]  # rarest first
        column = np.full(len(index.names), -1)
        column[own] = np.arange(len(own))
        has = held[:, own]
        asked = has & (np.cumsum(has, axis=1) <= RARE)
        hit = np.nonzero(able[text] & (column[number] >= 0))[0]
        hit = hit[asked[text[hit], column[number[hit]]]]
        # every pair of an occurrence and a posting proposes a place
        occurs, stands = np.nonzero(number[hit][:, None] == template.words[None, :])
        start = place[hit][occurs] - stands
        proposed = np.unique(text[hit][occurs] * step + start + pad // 2)
        doc, start = proposed // step, proposed % step - pad // 2
        slack = 0 if template.exact else SLACK
        weight = idf[template.words] / idf[template.words].sum()
        for a in range(0, len(doc), PLACES):
            d, s = doc[a : a + PLACES], start[a : a + PLACES]
            there = np.zeros((2 * slack + 1, len(d), len(template.words)), bool)
            for k in range(2 * slack + 1):
                want = s[:, None] + np.arange(len(template.words)) + k - slack
                at = np.minimum(np.searchsorted(keys, d[:, None] * step + want), len(keys) - 1)
                there[k] = (keys[at] == d[:, None] * step + want) & (number[at] == template.words) & (want >= 0)
            met = there.any(axis=0)
            agree = np.zeros((len(d), len(own)), bool)
            for q, w in enumerate(template.words):
                agree[:, column[w]] |= met[:, q]
            looked = asked[d]
            good = (agree & looked).sum(axis=1) >= (looked.sum(axis=1) if template.exact else np.minimum(AGREE, looked.sum(axis=1)))
            for key in template.keys:
                good &= there[:, :, key].all(axis=2).any(axis=0)
            share = met @ weight if not template.exact else np.ones(len(d))
            good &= share >= SHARE
            found.append((d[good], np.full(int(good.sum()), t), np.maximum(s[good], 0), np.minimum(share[good], 1.0)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0)
    doc, t, start, share = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((t, start, doc))
    return doc[order], t[order], start[order], share[order]


def _scanned(index: Index, idf: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    labels = np.array([t.label for t in index.templates], object)
    exact = np.array([t.exact for t in index.templates], bool)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, text, place, number = licence_words(batch.column("text"), index)
            doc, t, start, share = matches(total, text, place, number, index, idf)
            cells = pa.StructArray.from_arrays([pa.array(labels[t], pa.string()), pa.array(exact[t], pa.bool_()), pa.array(start, pa.int64()), pa.array(share, pa.float64())], names=["label", "phrase", "start", "share"])
            cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(total)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), pa.ListArray.from_arrays(pa.array(cuts), cells)], names=["doc_id", "n_words", "matches"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str, Sequence[str]]] = NOTICES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, and matches, an array of (label, phrase,
    start, share) by place: what phrase (phrase true, share 1) or notice stands where.

    Words are runs of digits, letters and whatever is not ASCII, A-Z lower-cased; starts count
    words from 0. A notice proposed at several starts a few words apart has a match for each.
    Null and empty texts have no words and no matches. Texts are read whole, in parts if
    long. Rows that repeat or tie in doc_id are scanned each. An empty table gives an
    empty result; other columns of docs, whatever their names, are ignored. The index goes
    to every task; its size is the caller's list of licences.
    """
    tune(docs.sparkSession)
    index = Index(phrases, notices)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.select("text").mapInArrow(_frequencies(index), "number int, n long").groupBy("number").agg(F.sum("n").alias("n")).collect()  # a row a word of the index
    n = {r["number"]: r["n"] for r in known}
    idf = np.log1p(n.get(-1, 0) / (1.0 + np.array([n.get(i, 0) for i in range(len(index.names))])))
    idf = np.maximum(idf, 1e-9)
    match = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("phrase", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("share", T.DoubleType())]))
    return rows.mapInArrow(_scanned(index, idf), T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("matches", match)]))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of scanned files."""
    base = F.filter("matches", lambda m: m["phrase"])
    names = lambda col: F.array_join(F.array_sort(F.array_distinct(F.transform(col, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("matches")).alias("labels"), score.alias("score"))
