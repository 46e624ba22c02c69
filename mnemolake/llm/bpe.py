"""Byte-level BPE encoding and decoding with batched merge rounds.

Texts are cut into words by the tokenizer's own pattern. The symbols of many words
lie in one flat array; a round looks up all neighbouring pairs by binary search in
the sorted pair keys, finds each word's lowest rank and merges its occurrences from
left to right, until no word has a pair left. Ids of common words are kept in a
bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import ragged, tune, with_fields

#: Fixed value: the public byte-level pattern; \s is Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes from which on a word is merged in rounds by rank, which are many and small; those
#: of short words, by each one's lowest rank, are few and large.
LONG_WORD = 512
#: What the cache may hold, with some bytes an entry for the tables themselves.
CACHED_BYTES, ENTRY = 128 << 20, 240
#: Characters of a chunk between blanks that is cached whole; longer ones go word by word.
CHUNK = 64
#: Characters of short texts whose new chunks are learned together.
TOGETHER = 1 << 21
#: Characters of a text cut into words at once.
SEGMENT = 1 << 18
NONE = np.int64(1 << 60)
#: The same pattern for the built-in engine, and the characters on whose classes the
#: engines could differ: all but ASCII's printable ones and Latin letters.
PLAIN = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
#: White space but the blank and the line feed: texts with it are not cut at blanks.
ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CUT = regex.compile(r"\P{White_Space}(?=\p{White_Space})")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 for itself, the other
    bytes in order from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """Tables of one byte-level BPE file."""

    def __init__(self, spec_text: str) -> None:
        spec = json.loads(spec_text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        self.width = np.int64(max([*vocab.values(), *self.specials.values()]) + 1)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in merges]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        #: If every merge makes a token of its own, whatever holds that token ranks
        #: later, and all occurrences of a word's lowest pair can merge at once.
        self.at_once = len(np.unique(made)) == len(made)
        self.token_bytes = [b""] * int(self.width)
        for t, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in self.specials.items():
            self.token_bytes[i] = t.encode()
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.cache: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.held = 0
        self.by_rank = np.argsort(self.ranks)
        self.decimal = [str(i) for i in range(int(self.width))]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no merge) and index of each pair, by binary search."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, end to end; how many of each), merged in common rounds."""
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), np.array([len(w) for w in words], np.int64))
        done_sym, done_word = [], []
        rank, which = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        fresh = np.arange(len(sym))  # symbols whose pair with the next is not looked up yet
        while len(sym):
            fresh = fresh[fresh < len(sym) - 1]
            linked = word[fresh] == word[fresh + 1]
            rank[fresh[~linked]] = NONE
            fresh = fresh[linked]
            rank[fresh], which[fresh] = self.lookup(sym[fresh], sym[fresh + 1])
            rank[-1] = NONE
            begin = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
            low = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(sym))))
            over = low == NONE
            if over.any():  # finished words leave the array
                done_sym.append(sym[over])
                done_word.append(word[over])
                stay = ~over
                sym, word, rank, which, low = sym[stay], word[stay], rank[stay], which[stay], low[stay]
            where = np.nonzero(rank == low)[0]
            if not len(where):
                break
            if self.at_once:  # of overlapping pairs (aaa) every other one, from the left
                run = np.append(True, np.diff(where) > 1)
                start = where[np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))]
                where = where[(where - start) % 2 == 0]
            else:
                _, first = np.unique(word[where], return_index=True)
                where = where[first]
            sym[where] = self.made[which[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            fresh = where - np.arange(len(where))  # where the merged symbols move to
            fresh = np.concatenate([fresh, fresh[fresh > 0] - 1])
            sym, word, rank, which = sym[keep], word[keep], rank[keep], which[keep]
        sym, word = np.concatenate([sym, *done_sym]), np.concatenate([word, *done_word])
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def merge_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As merge_words, for long words: a round merges all pairs of the lowest rank there
        is, and looks up only what that changed, so it costs what it merges. The flat
        array keeps its places; symbols know their neighbours."""
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        after[ends - 1], before[ends - size] = -1, -1
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank, _ = self.lookup(sym[at], sym[after[at]])
            at, rank = at[rank != NONE], rank[rank != NONE]
            order = np.argsort(rank, kind="stable")
            cuts = np.nonzero(np.diff(rank[order]))[0] + 1
            for some in np.split(order, cuts) if len(order) else []:
                r = int(rank[some[0]])
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(at[some])

        note(np.arange(len(sym)))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            pair = self.by_rank[r]
            left, right, made = self.keys[pair] // self.width, self.keys[pair] % self.width, self.made[pair]
            at = at[(sym[at] == left) & (after[at] >= 0)]
            at = at[sym[after[at]] == right]
            if not len(at):
                continue
            if self.at_once:  # of overlapping pairs (aaa) every other one, from the left
                run = np.append(True, after[at[:-1]] != at[1:])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            else:
                rest = at
                _, first = np.unique(np.searchsorted(ends, at, "right"), return_index=True)
                at = at[first]
                waiting[r] = [rest]
                heapq.heappush(heap, r)
            gone = after[at]
            sym[at], sym[gone] = made, -1
            after[at] = after[gone]
            follow = after[at]
            before[follow[follow >= 0]] = at[follow >= 0]
            note(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        alive = sym >= 0
        return sym[alive], np.bincount(np.searchsorted(ends, np.nonzero(alive)[0], "right"), minlength=len(words))

    def ensure(self, chunks: set[str]) -> None:
        """Puts the ids of chunks, as decimals, into the cache. It has two generations of at
        most CACHED_BYTES / 2, but for what one call asks: what is used again moves to the
        new one, the rest goes with the old."""
        miss = chunks - self.cache.keys()
        if not miss:
            return
        if self.held > CACHED_BYTES // 2:
            self.old, self.cache, self.held, miss = self.cache, {}, 0, chunks
        again = miss & self.old.keys()
        fresh = {c: self.old[c] for c in again}
        new = list(miss - again)
        parts = [self.words(c) for c in new]
        ids = self.word_ids(list({w for p in parts for w in p}))
        fresh.update((c, ids[p[0]] if len(p) == 1 else ",".join([ids[w] for w in p])) for c, p in zip(new, parts, strict=True))
        self.cache.update(fresh)
        self.held += ENTRY * len(fresh) + 4 * sum(map(len, fresh)) + sum(map(len, fresh.values()))

    def word_ids(self, words: list[str]) -> dict[str, str]:
        raw = [w.encode() for w in words]
        out: dict[str, str] = {}
        for merge, some in ((self.merge_words, [k for k, w in enumerate(raw) if len(w) < LONG_WORD]), (self.merge_long, [k for k, w in enumerate(raw) if len(w) >= LONG_WORD])):
            if some:
                flat, count = merge([raw[k] for k in some])
                text = list(map(self.decimal.__getitem__, flat.tolist()))
                ends = np.cumsum(count).tolist()
                out.update((words[k], ",".join(text[e - n : e])) for k, e, n in zip(some, ends, count.tolist(), strict=True))
        return out

    def words(self, text: str) -> list[str]:
        """The pattern's words; by the built-in engine where both agree. A blank and
        letters are one word, a mark after them another."""
        if text[:1] == " ":
            if text[1:].isalpha():
                return [text]
            if text[-1] in ".,;:!?" and text[1:-1].isalpha():
                return [text[:-1], text[-1]]
        return (PLAIN if not ODD.search(text) else self.pattern).findall(text)

    def segments(self, text: str) -> Iterator[str]:
        """Pieces that end before a white space that follows another character:
        no word of the pattern spans such a place, nor looks across it."""
        at = 0
        while len(text) - at > SEGMENT:
            m = CUT.search(text, at + SEGMENT)
            if not m:
                break
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:]

    def chunks(self, text: str) -> list[str]:
        """Cut before each lone blank: what follows it depends on nothing before."""
        found = self.cut(text)
        if len(text) > CHUNK and max(map(len, found)) > CHUNK:
            return [w for c in found for w in (self.words(c) if len(c) > CHUNK else (c,))]
        return found

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if ODD_SPACE.search(text) or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
            return self.words(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Text between special tokens, and those."""
        if self.split is None or not any(s in text for s in self.specials):
            yield text, False
            return
        for k, part in enumerate(self.split.split(text)):
            if part:
                yield part, k % 2 == 1

    def encode(self, text: str) -> Iterator[str]:
        """Decimal ids joined by commas, piece after piece."""
        for part, special in self.pieces(text):
            if special:
                yield str(self.specials[part])
                continue
            for seg in self.segments(part):
                if chunks := self.chunks(seg):
                    self.ensure(set(chunks))
                    yield ",".join(map(self.cache.__getitem__, chunks))

    def encode_many(self, texts: list[str]) -> Iterator[Iterable[str]]:
        """encode() of each; the new chunks of plain texts are learned together."""
        plain = [self.chunks(t) if len(t) <= SEGMENT and not any(s in t for s in self.specials) else None for t in texts]
        self.ensure(set().union(*[p for p in plain if p]))
        known = self.cache
        for t, p in zip(texts, plain, strict=True):
            yield self.encode(t) if p is None else [",".join(map(known.__getitem__, p))] if p else []

    def forget(self) -> None:
        """Empties the cache."""
        self.cache, self.old, self.held = {}, {}, 0

    def ids(self, text: str) -> list[int]:
        return [int(x) for part in self.encode(text) for x in part.split(",")]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


@lru_cache(2)
def tokenizer(spec_text: str) -> Tokenizer:
    return Tokenizer(spec_text)


def _all(coder: Tokenizer, texts: list[str]) -> Iterator[Iterable[str]]:
    some: list[str] = []
    room = TOGETHER
    for t in texts:
        some.append(t)
        room -= len(t)
        if room < 0:
            yield from coder.encode_many(some)
            some, room = [], TOGETHER
    yield from coder.encode_many(some)


def _coder(shared: object, full: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(shared.value)  # type: ignore[attr-defined]
        by_text = {str(i): b for i, b in enumerate(coder.token_bytes)}
        try:
            for batch in batches:
                count, ids_sha, text_sha, ids_all, decoded = [], [], [], [], []
                for coded in _all(coder, batch.column("__text").to_pylist()):
                    n, sha, back, first, some, whole = 0, hashlib.sha256(), hashlib.sha256(), True, [], []
                    for part in coded:
                        n += part.count(",") + 1
                        sha.update(part.encode() if first else b"," + part.encode())
                        first = False
                        raw = b"".join([by_text[x] for x in part.split(",")])
                        # decoded per piece: pieces end where characters do
                        back.update(raw)
                        if full:
                            some.extend(map(int, part.split(",")))
                            whole.append(raw)
                    count.append(n)
                    ids_sha.append(sha.hexdigest())
                    text_sha.append(back.hexdigest())
                    if full:
                        ids_all.append(some)
                        decoded.append(b"".join(whole).decode("utf-8", "replace"))
                names = [x for x in batch.schema.names if x != "__text"]
                cols = [batch.column(x) for x in names] + [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                more = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    cols += [pa.array(ids_all, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    more += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *more])
        finally:
            coder.forget()  # what a worker holds between tasks is the vocabulary alone

    return run


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False, *carry: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with full also ids and decoded.

    As the tokenizers library encodes: specials in a text are recognised, none are
    added. vocabulary is the path of its file on the driver, which ships the file's text
    (one file, whatever the corpus). Null texts count as empty: 0 tokens, the digests of
    nothing. Rows are coded one by one, so ties, repeats and empty tables need no rule;
    texts of any length are coded in pieces that end at safe places. Columns that are not
    carried may have any name; a carried one may not be named as those that are added.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    more = ", ids array<int>, decoded string" if full else ""
    fields = with_fields(rows, ("__text",), f"n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return rows.mapInArrow(_coder(shared, full), fields)
