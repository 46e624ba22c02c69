"""Substring dedup by recompression.

Words become symbols; rounds then name pairs and runs of them. In a round every
symbol falls to the left or the right side by its name; a left one followed by a
right one merge into a new symbol, and of what is left over, runs of equal symbols
do. A name is a hash of what it stands for, so all tasks name alike and a round needs
no exchange. With each symbol goes the range of words that its existence depends on:
equal ranges hold equal symbols, wherever they lie.

A window of WIDTH words is led by the symbol, among those whose range lies in it, of
the best class and the smallest hash: equal windows have equal leaders. So only
windows whose leader's name occurs twice can repeat. Names only nominate: what they
lead is verified by 128-bit BLAKE2 digests of the words themselves. Neighbouring
windows with one leader make a group, whose words are verified first; where all groups
of a name agree, they repeat whole, and only the windows of the other names are
verified one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import mix64, ragged, stage, tune, utf8
from mnemolake.llm.flat_words import hashes, words

WIDTH = 35
ROUNDS = 6
#: Lengths to which ranges are rounded up, and how good a leader each makes: long
#: enough to be rare, short enough that each window holds several.
LENGTHS = (1, 2, 5, 8, 12, 16, 24)
CLASSES = (6, 5, 3, 1, 0, 2, 4)
#: Words that are parsed at once, and bytes of texts laid end to end.
SEGMENT = 1 << 18
PIECE = 1 << 21
FAR = 1 << 40
_BASE = 0x5851F42D4C957F2D


def _powers(base: int, n: int) -> np.ndarray:
    out, step = np.ones(1, np.uint64), base
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(step)])
            step = step * step % (1 << 64)
    return out[:n]


_UP = _powers(_BASE, SEGMENT + WIDTH + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), SEGMENT + WIDTH + 1)
_NONE = np.uint64((1 << 64) - 1)
_K = np.uint64(0x9E3779B97F4A7C15)


def _named(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the words lo..hi-1, from sums of word * base**place."""
    return mix64((prefix[hi] - prefix[lo]) * _DOWN[lo] + np.uint64(salt))


def symbols(word: np.ndarray, text: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lo, hi) of the ranges that words, and then each round's new symbols, depend on;
    outside 0..n where that includes the end of a text."""
    sym, doc = word, text
    lo = np.arange(len(word), dtype=np.int64)
    hi = lo + 1
    yield lo, hi
    for r in range(rounds):
        n = len(sym)
        if n < 2:
            return
        side = (mix64(sym + _K * np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        near = doc[1:] == doc[:-1]
        pair = ~side[:-1] & side[1:] & near
        left, right = np.append(pair, False), np.append(False, pair)
        alone = ~(left | right)
        # what stays alone does so because of both neighbours, and they of all they depend on
        lo2, hi2 = lo.copy(), hi.copy()
        np.minimum(lo2[1:], np.where(near, lo[:-1], -FAR), out=lo2[1:], where=alone[1:])
        np.minimum(lo2[:-1], np.where(near, lo[1:], FAR), out=lo2[:-1], where=alone[:-1])
        np.maximum(hi2[:-1], np.where(near, hi[1:], FAR), out=hi2[:-1], where=alone[:-1])
        np.maximum(hi2[1:], np.where(near, hi[:-1], -FAR), out=hi2[1:], where=alone[1:])
        # an equal neighbour that pairs off ends the run only because of the pair's other side
        same = near & (sym[1:] == sym[:-1])
        ends = np.nonzero(alone[:-1] & same & left[1:])[0]
        hi2[ends] = np.maximum(hi2[ends], hi[np.minimum(ends + 2, n - 1)])
        starts = np.nonzero(alone[1:] & same & right[:-1])[0] + 1
        lo2[starts] = np.minimum(lo2[starts], lo[np.maximum(starts - 2, 0)])
        if alone[0]:
            lo2[0] = -FAR
        if alone[-1]:
            hi2[-1] = FAR
        run = alone[:-1] & alone[1:] & same
        head = np.nonzero(~(right | np.append(False, run)))[0]
        size = np.diff(np.append(head, n))
        after = sym[np.minimum(head + 1, n - 1)]
        sym2 = sym[head]
        sym2 = np.where(left[head], mix64(mix64(sym2 + np.uint64(r)) * _K + after), np.where(size > 1, mix64(sym2 * _K + size.astype(np.uint64) + np.uint64(r << 8)), sym2))
        lo, hi = np.minimum.reduceat(lo2, head), np.maximum.reduceat(hi2, head)
        made = size > 1
        yield lo[made], hi[made]
        sym, doc = sym2, doc[head]


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width]."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def leaders(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, leader's name, whether the leader's first occurrence in it starts
    with it, so that the next window has another) of each window."""
    n = len(word)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(word * _UP[:n], dtype=np.uint64)])
        best = {q: np.full(n, _NONE) for q in LENGTHS}
        for lo, hi in symbols(word, text):
            size = hi - lo
            slot = np.searchsorted(LENGTHS, size)
            for k, q in enumerate(LENGTHS):
                at = np.nonzero((slot == k) & (lo >= 0) & (lo + q <= n))[0]
                if len(at):
                    name = _named(prefix, lo[at], hi[at], 11) >> np.uint64(3) | np.uint64(CLASSES[k] << 61)
                    np.minimum.at(best[q], lo[at], name)
        starts = n - WIDTH + 1
        lead = first = np.full(starts, _NONE)
        for q in LENGTHS:
            first = np.minimum(first, best[q][:starts])
            lead = np.minimum(lead, _slide(best[q], WIDTH - q + 1)[:starts])
        at = np.nonzero(text[:starts] == text[WIDTH - 1 :])[0]
        return at, lead[at], (first == lead)[at]


class Piece:
    """Texts a..b-1 of a batch, their words joined by one blank, laid end to end."""

    def __init__(self, a: int, b: int, texts: list[bytes]) -> None:
        self.a, self.b, self.data = a, b, b"".join(texts)
        self.raw = np.frombuffer(self.data, np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.first, self.last, self.text = words(at, self.raw)
        self.word = hashes(self.raw, self.first, self.last)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """leaders() segment by segment; a window's leader depends on its words only, so
        segments overlap by a window less one word."""
        for a in range(0, max(len(self.word) - WIDTH + 1, 0), SEGMENT):
            at, lead, leaves = leaders(self.word[a : a + SEGMENT + WIDTH - 1], self.text[a : a + SEGMENT + WIDTH - 1])
            if len(at):
                yield at + a, lead, leaves

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """128 bits, as two longs, of each run of words lo..hi-1."""
        digest, data = hashlib.blake2b, self.data
        out = b"".join([digest(data[x:y], digest_size=16).digest() for x, y in zip(self.first[lo].tolist(), self.last[hi - 1].tolist(), strict=True)])
        return np.frombuffer(out, np.int64).reshape(-1, 2)


def _pieces(batch: pa.RecordBatch) -> Iterator[Piece]:
    at, raw = utf8(batch.column("text"))
    n, a, data = len(at) - 1, 0, raw.tobytes()
    while a < n:
        b = a + 1
        while b < n and at[b + 1] - at[a] <= PIECE:
            b += 1
        yield Piece(a, b, [b" ".join(data[x:y].split()) for x, y in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist(), strict=True)])
        a = b


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, g1, g2, rid): a row for each group of neighbouring windows led by one
    occurrence of a symbol, so no two windows of a group can be equal."""
    for batch in batches:
        ids = batch.column("rid")
        for p in _pieces(batch):
            for at, lead, leaves in p.windows():
                owner = p.text[at]
                head = np.nonzero(np.append(True, (lead[1:] != lead[:-1]) | (owner[1:] != owner[:-1]) | leaves[:-1]))[0]
                g = p.digests(at[head], at[np.append(head[1:], len(at)) - 1] + WIDTH)
                yield pa.RecordBatch.from_arrays([pa.array(lead[head].view(np.int64)), pa.array(g[:, 0]), pa.array(g[:, 1]), ids.take(pa.array(p.a + owner[head]))], names=["lead", "g1", "g2", "rid"])


def _listed(batch: pa.RecordBatch, name: str, a: int, b: int) -> np.ndarray:
    """Sorted marks of (text - a, value) for the lists of texts a..b-1."""
    column = batch.column(name).slice(a, b - a)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    size = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    return np.sort(_mark(np.repeat(np.arange(b - a), size), flat))


def _mark(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(value + mix64((text + 1).astype(np.uint64) * _K))


def _among(marks: np.ndarray, text: np.ndarray, value: np.ndarray) -> np.ndarray:
    if not len(marks):
        return np.zeros(len(text), bool)
    m = _mark(text, value)
    return marks[np.minimum(np.searchsorted(marks, m), len(marks) - 1)] == m


def _chosen(p: Piece, at: np.ndarray, lead: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in at, digest) of the windows whose leader is among the marks."""
    hit = np.nonzero(_among(marks, p.text[at], lead))[0]
    return hit, p.digests(at[hit], at[hit] + WIDTH) if len(hit) else np.zeros((0, 2), np.int64)


def _single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, g1, g2, rid) of each window whose leader is in the text's list `some`."""
    for batch in batches:
        ids = batch.column("rid")
        for p in _pieces(batch):
            marks = _listed(batch, "some", p.a, p.b)
            for at, lead, _ in p.windows():
                hit, g = _chosen(p, at, lead, marks)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(lead[hit].view(np.int64)), pa.array(g[:, 0]), pa.array(g[:, 1]), ids.take(pa.array(p.a + p.text[at[hit]]))], names=["lead", "g1", "g2", "rid"])


def _joined(g: np.ndarray) -> np.ndarray:
    """One 64-bit number of a digest; the expression in substring_dedup is the same."""
    return (g[:, 0] ^ g[:, 1]).view(np.uint64)


def _removed(full: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total, removed, digest, kept_text = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            for p in _pieces(batch):
                a, b, text = p.a, p.b, p.text
                groups, some, single = (_listed(batch, c, a, b) for c in ("groups", "some", "single"))
                edge = np.zeros(len(text) + 1, np.int64)
                if len(groups) or len(single):
                    for at, lead, _ in p.windows():
                        hit, g = _chosen(p, at, lead, some)
                        again = hit[_among(single, text[at[hit]], _joined(g))]
                        gone = np.union1d(at[_among(groups, text[at], lead)], at[again])
                        np.add.at(edge, gone, 1)
                        np.add.at(edge, gone + WIDTH, -1)
                keep = np.cumsum(edge)[:-1] == 0
                total[a:b] = np.bincount(text, minlength=b - a)
                removed[a:b] = np.bincount(text[~keep], minlength=b - a)
                # kept words, each with one byte more: a blank, cut off where a text ends
                f, size, own = p.first[keep], (p.last - p.first)[keep], text[keep]
                out = np.full(int(size.sum()) + len(size), 32, np.uint8)
                starts = np.concatenate([[0], np.cumsum(size + 1)])
                out[ragged(starts[:-1], size)] = p.raw[ragged(f, size)]
                ends = starts[np.searchsorted(own, np.arange(b - a + 1))]
                data = out.tobytes()
                for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    digest.append(hashlib.sha256(data[x : max(x, y - 1)]).hexdigest())
                    if full:
                        kept_text.append(data[x : max(x, y - 1)].decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), pa.array(total), pa.array(removed), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept_text, pa.string())] if full else columns, names=[*names, "kept_text"] if full else names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256; with full also
    kept_text.

    A word goes if a window of WIDTH words that covers it starts anywhere else too, in
    the same text or another; windows are judged on the input. Null, empty and blank
    texts have no words; a text of fewer than WIDTH words loses none. Texts count whole,
    however long, in segments. Rows that repeat, or share a doc_id or a null one, are
    texts like any other, so windows of repeated rows all go. An empty table gives an
    empty result; other columns of docs, whatever their names, are ignored. Names that
    occur in very many texts are counted by partial sums and joined back over split
    partitions; no task gathers a name's texts.
    """
    spark = docs.sparkSession
    tune(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rid deals lists of repeated names to rows; a row that gets another's names is not
    # harmed, as the lists hold what repeats anywhere
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = rows.select("rid", "text")
    groups = stage(texts.mapInArrow(_groups, "lead long, g1 long, g2 long, rid long"), "groups")
    ends = [f(c).alias(f"{name}{c}") for c in ("g1", "g2") for name, f in (("a", F.min), ("b", F.max))]
    twice = groups.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), *ends).filter("n > 1")
    # stored, so that both sides of the join are dealt by it alone and a hot name can be split
    twice = stage(twice.select(F.col("lead").alias("name"), F.expr("ag1 <> bg1 or ag2 <> bg2").alias("mixed")), "twice")
    told = groups.join(twice, F.col("lead") == F.col("name")).select("rid", "lead", "mixed")
    lists = told.groupBy(F.col("rid").alias("mid")).agg(F.collect_set(F.when(F.col("mixed"), F.col("lead"))).alias("some"), F.collect_set(F.when(~F.col("mixed"), F.col("lead"))).alias("groups"))
    lists = stage(lists, "lists")
    asked = texts.join(lists.filter(F.size("some") > 0).select("mid", "some"), F.col("mid") == F.col("rid")).select("rid", "text", "some")
    single = stage(asked.mapInArrow(_single, "lead long, g1 long, g2 long, rid long"), "windows")
    again = single.groupBy("lead", "g1", "g2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = stage(again.select(F.col("lead").alias("l2"), F.col("g1").alias("x1"), F.col("g2").alias("x2")), "again")
    hit = single.join(again, F.expr("lead = l2 and g1 = x1 and g2 = x2"))
    found = hit.groupBy(F.col("rid").alias("sid")).agg(F.collect_set(F.expr("g1 ^ g2")).alias("single"))
    both = lists.join(found, F.col("mid") == F.col("sid"), "left").select("mid", "groups", "some", "single")
    last = rows.join(both, F.col("mid") == F.col("rid"), "left")
    empty = F.array().cast("array<bigint>")
    last = last.select("doc_id", "text", *[F.coalesce(c, empty).alias(c) for c in ("groups", "some", "single")])
    more = ", kept_text string" if full else ""
    return last.mapInArrow(_removed(full), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string{more}")


#: DuckDB, over whole tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
s AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
g AS (SELECT r, unnest(range(i, CASE WHEN nxt IS NULL OR nxt > i + 35 THEN i + 35 ELSE nxt END)) AS j FROM s),
x AS (SELECT r, j, ws[j] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS j FROM d)),
k AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS kept FROM x ANTI JOIN g USING (r, j) GROUP BY r),
c AS (SELECT r, count(*) AS n_removed FROM g GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r) LEFT JOIN c USING (r)
"""
