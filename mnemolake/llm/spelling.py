"""Spelling variants: words one edit apart, found by Levenshtein automata over trie shards.

The vocabulary is sorted, cut into ranges of at most SHARD words, and each range becomes
a compact trie: nodes above a single word have no children, the word's tail stands for
them. Shards are broadcast in waves of at most WAVE bytes, one wave a job. Each word's
distance-one automaton is intersected with every shard of the wave, depth first: a stack
holds blocks of (word, node, automaton state), the deepest block is taken, all its states
take one step, and what survives goes back on the stack. Accepting states at the end of
a word are neighbours. A word's count of neighbours and its best one are reduced over
shards and waves.

An automaton state after d letters is a flag (no edit so far) and three bits: with the one
edit made, the word may have been read up to d - 1, d or d + 1.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import discard, ragged, stage, tune, utf8

#: A shard's words and bytes of words at most (one word at least).
SHARD, SHARD_BYTES = 1 << 15, 1 << 22
#: Bytes of shards that are broadcast together (one shard at least).
WAVE = 64 << 20
#: States that take a step together, and words whose automata run together.
BLOCK, WORDS = 1 << 17, 1 << 13
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 18
#: Characters of a text that are cut into words at once.
PIECE = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_OTHER = re.compile("[^a-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end between words."""
    at = 0
    while len(text) - at > PIECE:
        end = _OTHER.search(text, at + PIECE)
        stop = end.start() if end else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


def _counts(least: int, slip_every: int | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall
        counts: Counter[str] = Counter()
        told = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        crc32 = zlib.crc32
        for batch in batches:
            at, raw = utf8(batch.column("text"))
            data = raw.tobytes().translate(_LOWER)
            for name, a, b in zip(batch.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own: Counter[str] = Counter()
                for piece in _pieces(data[a:b].decode()):
                    own.update(found(piece))
                if slip_every is None:
                    counts.update(own)
                else:
                    head = crc32(f"{name}:".encode())
                    for run, m in own.items():
                        h = crc32(run.encode(), head)
                        if h % slip_every == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                            if len(run) < least:
                                continue
                        counts[run] += m
                if len(counts) >= HELD:
                    yield told()
                    counts.clear()
        if counts:
            yield told()

    return run


def flat(words: list[bytes], before: int = 0, after: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters with zeros around each word, where each word starts, its length)."""
    size = np.array([len(w) for w in words], np.int64)
    pad = np.cumsum(size + before + after) - size - after
    joined = (b"\0" * after + b"\0" * before).join(words)
    return np.frombuffer(b"\0" * before + joined + b"\0" * after, np.uint8), pad, size


class Trie:
    """Node 0 is the root; a node's children are start..stop-1, by letter. ends: the word
    that ends at an inner node, or -1; only: the one word of a leaf, or -1."""

    ARRAYS = ("letters", "at", "size", "n", "key", "label", "start", "stop", "ends", "only")

    def __init__(self, words: list[bytes], counts: np.ndarray) -> None:
        """words: sorted and distinct."""
        self.letters, self.at, self.size = flat(words)
        self.n = counts.astype(np.int64)
        label, start, stop, ends, only, key = [np.zeros(1, np.uint8)], [], [], [], [np.array([0 if len(words) == 1 else -1])], []
        active, node, nodes, depth, level = np.arange(len(words)), np.zeros(len(words), np.int64), 1, 0, np.zeros(1, np.int64)
        if len(words) == 1:
            active, node = active[:0], node[:0]
        while True:
            here = np.full(len(level), -1, np.int64)
            over = self.size[active] == depth
            here[node[over] - level[0]] = active[over]
            active, node = active[~over], node[~over]
            ch = self.letters[self.at[active] + depth].astype(np.int64)
            first = np.concatenate([[True], (node[1:] != node[:-1]) | (ch[1:] != ch[:-1])]) if len(node) else np.zeros(0, bool)
            child = nodes + np.cumsum(first) - 1
            parents, made = node[first], int(first.sum())
            ends.append(here)
            start.append(nodes + np.searchsorted(parents, level))
            stop.append(nodes + np.searchsorted(parents, level, "right"))
            if not made:
                break
            key.append(parents * 256 + ch[first])
            label.append(ch[first].astype(np.uint8))
            alone = np.bincount(child - nodes, minlength=made) == 1
            word = np.full(made, -1, np.int64)
            word[alone] = active[first][alone]
            only.append(word)
            stay = ~alone[child - nodes]
            level, active, node = np.arange(nodes, nodes + made), active[stay], child[stay]
            nodes, depth = nodes + made, depth + 1
        self.label, self.only, self.key = np.concatenate(label), np.concatenate(only).astype(np.int32), np.concatenate([*key, np.zeros(0, np.int64)])
        self.start, self.stop, self.ends = (np.concatenate(x).astype(np.int32) for x in (start, stop, ends))

    def packed(self) -> bytes:
        parts = [getattr(self, a) for a in self.ARRAYS]
        head = ";".join(f"{p.dtype.str}{len(p)}" for p in parts).encode()
        return len(head).to_bytes(4, "little") + head + b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        out, k = cls.__new__(cls), 4 + int.from_bytes(data[:4], "little")
        for name, kind in zip(cls.ARRAYS, data[4:k].decode().split(";"), strict=True):
            n = int(kind[3:])
            part = np.frombuffer(data, np.dtype(kind[:3]), n, k)
            setattr(out, name, part)
            k += part.nbytes
        return out

    def word(self, i: int) -> str:
        return self.letters[self.at[i] : self.at[i] + self.size[i]].tobytes().decode("latin-1")


def neighbours(trie: Trie, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, word of the trie) for all pairs that one insertion, deletion or replacement parts."""
    read, at, size = flat(words, 1, 3)
    none = np.zeros(0, np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    q = np.arange(len(words))
    # before a letter is read: no edit (flag), or the first letter deleted (third bit)
    stack = [(0, q, np.zeros(len(q), np.int64), np.ones(len(q), bool), np.full(len(q), 4, np.uint8))]
    while stack:
        depth, q, node, clean, bits = stack.pop()
        if len(q) > BLOCK:
            stack.append((depth, q[BLOCK:], node[BLOCK:], clean[BLOCK:], bits[BLOCK:]))
            q, node, clean, bits = q[:BLOCK], node[:BLOCK], clean[:BLOCK], bits[:BLOCK]
        only = trie.only[node].astype(np.int64)
        leaf = only >= 0
        # accepted: the trie's word ends here, and the edit's bits reach the end of the own word
        here = np.where(leaf, np.where(trie.size[only] == depth, only, -1), trie.ends[node])
        shift = size[q] - depth
        good = (here >= 0) & (np.abs(shift) <= 1) & ~(clean & (shift == 0))
        good &= ((bits >> np.clip(shift + 1, 0, 2).astype(np.uint8)) & 1) > 0
        pairs.append((q[good], here[good]))
        # one letter on: along a word's tail, to all children, or to those that the edit's bits ask for
        tail = leaf & (trie.size[only] > depth) & (np.abs(trie.size[only] - size[q]) <= 1)
        inner = np.nonzero(~leaf & clean)[0]
        wide = (trie.stop[node[inner]] - trie.start[node[inner]]).astype(np.int64)
        from_, to = [np.nonzero(tail)[0], np.repeat(inner, wide)], [node[tail], ragged(trie.start[node[inner]].astype(np.int64), wide)]
        letter = [trie.letters[trie.at[only[tail]] + depth] if tail.any() else none.astype(np.uint8), trie.label[to[1]]]
        rest = np.nonzero(~leaf & ~clean)[0]
        if len(rest) and len(trie.key):
            base, had = at[q[rest]] + depth, []
            for bit, step in ((1, -1), (2, 0), (4, 1)):
                asked = read[base + step]
                ask = (bits[rest] & bit > 0) & (asked > 0)
                for earlier, was in had:  # the same letter is asked for once
                    ask &= ~(was & (earlier == asked))
                had.append((asked, ask))
                key = node[rest][ask] * 256 + asked[ask]
                k = np.minimum(np.searchsorted(trie.key, key), len(trie.key) - 1)
                there = trie.key[k] == key
                from_.append(rest[ask][there])
                to.append(k[there] + 1)
                letter.append(asked[ask][there])
        f, node, ch = np.concatenate(from_), np.concatenate(to), np.concatenate(letter)
        q, was_clean, was = q[f], clean[f], bits[f]
        base = at[q] + depth
        own = read[base] == ch
        clean = was_clean & own
        now = (was & 1) * (read[base - 1] == ch) | (was & 2) * own | (was & 4) * (read[base + 1] == ch)
        now |= np.where(was_clean, 3, 0).astype(np.uint8) | np.where(clean, 4, 0).astype(np.uint8)
        keep = now > 0
        if keep.any():
            stack.append((depth + 1, q[keep], node[keep], clean[keep], now[keep]))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words into tries."""
    words: list[bytes] = []
    counts: list[int] = []
    held = 0

    def built() -> pa.RecordBatch:
        blob = Trie(words, np.array(counts)).packed()
        return pa.RecordBatch.from_pydict({"first": pa.array([words[0].decode("latin-1")]), "shard": pa.array([blob], pa.binary()), "size": pa.array([len(blob)], pa.int64())})

    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if words and (len(words) >= SHARD or held + len(word) > SHARD_BYTES):
                yield built()
                words, counts, held = [], [], 0
            words.append(word.encode("latin-1"))
            counts.append(n)
            held += len(word)
    if words:
        yield built()


_known: dict[str, list[Trie]] = {}


def _search(sent: Broadcast, name: str, all_words: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _known:  # a worker holds one wave at a time
            _known.clear()
            _known[name] = [Trie.unpacked(x) for x in sent.value]
        tries = _known[name]
        for batch in batches:
            for a in range(0, len(batch), WORDS):
                part = batch.slice(a, WORDS)
                words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
                near, best_n, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full((len(words), 2), -1, np.int64)
                for t, trie in enumerate(tries):
                    q, v = neighbours(trie, words)
                    near += np.bincount(q, minlength=len(words))
                    order = np.lexsort((v, -trie.n[v], q))
                    q, v = q[order], v[order]
                    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
                    q, v = q[first], v[first]
                    more = trie.n[v] > best_n[q]  # of equal counts, the earlier shard's comes first
                    best_n[q[more]] = trie.n[v[more]]
                    best[q[more]] = np.stack([np.full(int(more.sum()), t), v[more]], axis=1)
                told = np.nonzero(near > 0)[0] if not all_words else np.arange(len(words))
                form = [tries[t].word(v) if t >= 0 else None for t, v in best[told].tolist()]
                yield pa.RecordBatch.from_arrays([part.column("word").take(pa.array(told)), part.column("n").take(pa.array(told)), pa.array(near[told]), pa.array(form, pa.string()), pa.array(best_n[told])], names=["word", "n", "n_near", "near", "near_n"])

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, at_least: int = 2, slip_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters of at least ``least`` code points, A-Z lower-cased."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_counts(least, slip_every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, at_least: int = 2, ratio: int = 10, slip_every: int | None = None) -> DataFrame:
    """One row per word of at least ``least`` code points and ``at_least`` occurrences: word,
    form, root, n, n_near, form_n.

    A word's form is its most frequent neighbour (ties: the first in code-point order) if that
    occurs ``ratio`` times as often or more; its root is what forms lead to in the end. Null
    and empty texts have no words; a null id counts as an empty one, and ids matter only
    with ``slip_every``: an occurrence whose crc32 of ``id:word`` it divides loses the code
    point at that number modulo the length, a planted slip. Rows that repeat count each.
    Texts and words may be of any length. An empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    words = stage(vocabulary(docs, id_col, text_col, least, at_least, slip_every), "words")
    total = words.count()
    parts = max(1, -(-total // SHARD))
    cut = words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(_shards, "first string, shard binary, size long")
    shards = stage(cut.withColumn("no", F.monotonically_increasing_id()), "tries")
    waves: list[list[int]] = []
    held = WAVE
    for no, size in shards.select("no", "size").orderBy("first").collect():  # a row for SHARD words
        if held + size > WAVE:
            waves.append([])
            held = 0
        waves[-1].append(no)
        held += size
    dealt = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    found = []
    for i, wave in enumerate(waves):
        sent = spark.sparkContext.broadcast([bytes(r["shard"]) for r in shards.filter(F.col("no").isin(wave)).orderBy("first").collect()])  # WAVE bytes at most
        found.append(stage(words.repartition(dealt, "word").mapInArrow(_search(sent, uuid.uuid4().hex, i == 0), "word string, n long, n_near long, near string, near_n long"), "near"))
        sent.unpersist()
    if not found:
        return spark.createDataFrame([], "word string, form string, root string, n long, n_near long, form_n long")
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    near = near.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best)
    kept = -F.col("best.less") >= F.col("n") * ratio
    forms = stage(near.select("word", F.when(kept, F.col("best.near")).alias("form"), "n", "n_near", F.when(kept, -F.col("best.less")).alias("form_n")), "forms")
    for x in (words, shards, *found):
        discard(x)
    # each step doubles how far a root is followed; counts grow tenfold along a chain, so it is short
    roots = forms.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("more"))
    while not roots.filter("more").isEmpty():
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stage(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("more")), "roots")
    return forms.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB; crc32 by its table, neighbours by the strings that one deletion leaves.
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
o AS (SELECT doc_id, word, count(*) AS m FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS word FROM documents) WHERE length(word) > 6 GROUP BY ALL),
h AS (SELECT word, m, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || word, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM o, crc),
x AS (SELECT CASE WHEN h % 31 = 0 THEN word[:h % length(word)] || word[h % length(word) + 2:] ELSE word END AS word, m FROM h),
w AS (SELECT word, sum(m)::BIGINT AS n FROM x WHERE length(word) > 6 GROUP BY word HAVING sum(m) > 1),
d AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.s = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.s = w.word),
g AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-v.n, p.near)) AS best, max(v.n) AS best_n FROM p JOIN w v ON v.word = p.near GROUP BY p.word),
f AS (SELECT w.word, CASE WHEN best_n >= 10 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM w LEFT JOIN g USING (word)),
r AS (SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, coalesce(t.root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) t USING (word)
"""
