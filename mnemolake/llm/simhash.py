"""SimHash near-dedup with BK-trees.

Fingerprints are compared within shards: the 64 bits fall into m blocks, and of
two fingerprints that differ in at most r bits, m - r blocks agree; so each choice
of m - r blocks, with their values, names a shard, and every link falls into some
shard. A shard is a BK-tree: a child is keyed by its integer Hamming distance to
its parent, and a query at distance d from a node follows only the edges d - r to
d + r. Trees are built and searched level by level, for all shards of a task at
once.

Trees are shipped to the tasks that hold their queries, not to every executor:
their number grows with the data, so a broadcast would have no bound. Shards of
over TREE fingerprints become several trees of that size at most, and queries go
to their own and to the later ones, in parts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import keyed, ragged, stage, tune, utf8
from mnemolake.llm.components import components

SEED = 42
RADIUS = 4
TREE = 4096
#: Parts of a shard that query one copy of a tree.
SALT = 4
#: Shingles of a text that are hashed before their bits are counted.
PIECE = 1 << 16
#: bits[b]: the eight bits of byte b, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Bit k is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # both in ASCII terms: A-Z and \x20 \x09-\x0D
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for a in range(0, len(starts), PIECE):
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(starts[a : a + PIECE], stops[a : a + PIECE], strict=True)], np.uint64)
        by = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(by[:, k], minlength=256) @ _BITS
    return sum(1 << k for k in np.nonzero(2 * ones > len(starts))[0].tolist())


def _fingerprints(shingle: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = utf8(batch.column("text"))
            data = raw.tobytes()
            fps = [fingerprint(data[a:b], shingle) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "th", "fp"])

    return run


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints; those of several words are rows."""
    d = np.bitwise_count(a ^ b).astype(np.int64)
    return d.sum(axis=1) if d.ndim == 2 else d


class Forest:
    """BK-trees of many shards: node i holds fp[i]; edge[i] is its distance to
    parent; a node's children lie together, sorted by edge."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray) -> None:
        """shard: 0..k-1, sorted; the first fingerprint of a shard is its root."""
        self.fp = fp
        n = len(fp)
        self.span = 64 * (fp.shape[1] if fp.ndim == 2 else 1) + 1
        roots = np.nonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))[0] if n else np.zeros(0, np.int64)
        self.root = roots
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        rest = np.ones(n, bool)
        rest[roots] = False
        rest = np.nonzero(rest)[0]
        at = roots[shard[rest]]
        while len(rest):
            d = apart(fp[rest], fp[at])
            key = at * self.span + d
            order = np.argsort(key, kind="stable")  # earlier fingerprints first
            key = key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            new = rest[order[first]]
            parent[new], edge[new] = at[order[first]], d[order[first]]
            stay = ~first
            at = new[np.cumsum(first) - 1][stay]
            rest = rest[order[stay]]
        self.key = parent * self.span + edge
        self.order = np.argsort(self.key, kind="stable")
        self.key = self.key[self.order]

    def within(self, queries: np.ndarray, trees: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, distance) at most radius apart, level by level."""
        for a in range(0, len(queries), PIECE):
            q = np.arange(a, min(a + PIECE, len(queries)))
            node = self.root[trees[q]]
            while len(q):
                d = apart(queries[q], self.fp[node])
                hit = d <= radius
                yield q[hit], node[hit], d[hit]
                low = np.searchsorted(self.key, node * self.span + np.maximum(d - radius, 0))
                high = np.searchsorted(self.key, node * self.span + np.minimum(d + radius, self.span - 1), "right")
                q, node = np.repeat(q, high - low), self.order[ragged(low, high - low)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, by pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _spanned(radius: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (shard, tree, own, fp) sorted by (shard, tree), own first: own rows make
    the tree, all rows query it. Emits links that span what the task found linked,
    at most one for each row of the tree or query."""

    def links(shard: np.ndarray, own: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], shard[1:] != shard[:-1]])
        shard = np.cumsum(new) - 1
        mine = np.nonzero(own)[0]
        has = np.zeros(shard[-1] + 1, bool)
        has[shard[mine]] = True
        forest = Forest((np.cumsum(has) - 1)[shard[mine]], fp[mine])
        asks = np.nonzero(has[shard])[0]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        root = np.arange(len(fp))
        for q, node, d in forest.within(fp[asks], (np.cumsum(has) - 1)[shard[asks]], radius):
            a, b = asks[q], mine[node]
            far = (root[a] != root[b]) & (fp[a] != fp[b])
            left.append(a[far])
            right.append(b[far])
            if sum(map(len, left)) > 4 * len(fp) + PIECE:  # keep only what joins components
                root = _roots(len(fp), np.concatenate([root, *left]), np.concatenate([np.arange(len(fp)), *right]))
                left, right = [], []
        root = _roots(len(fp), np.concatenate([root, *left]), np.concatenate([np.arange(len(fp)), *right]))
        linked = np.nonzero(root != np.arange(len(fp)))[0]
        return pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64))], names=["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            shard = batch.column("tree").to_numpy()
            own, fp = batch.column("own").to_numpy(zero_copy_only=False).astype(bool), batch.column("fp").to_numpy().view(np.uint64)
            # whole trees at a time: at most a tree and its queries wait
            if not len(shard):
                continue
            last = np.nonzero(shard != shard[-1])[0]
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and cut == 0 and held[-1][0][-1] != shard[0]:
                yield links(*[np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            if cut:
                held.append((shard[:cut], own[:cut], fp[:cut]))
                yield links(*[np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            held.append((shard[cut:], own[cut:], fp[cut:]))
        if held:
            yield links(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def blocks_for(n: int, radius: int) -> int:
    """So many blocks that a shard of even fingerprints has some dozens."""
    m = radius + 1
    while (n >> (64 * (m - radius) // m)) > 64 and m < 2 * radius + 2:
        m += 1
    return m


def linked(fps: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(u, v): links that span the components of distinct fingerprints (fp) under
    a Hamming distance of at most radius."""
    spark: SparkSession = fps.sparkSession
    m = blocks_for(fps.count(), radius)
    edges = [64 * k // m for k in range(m + 1)]
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in some) for some in itertools.combinations(range(m), m - radius)]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    shards = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x).cast("long")) for x in signed])).alias("block", "bits"))
    shards = shards.select("fp", F.xxhash64("block", "bits").alias("shard"))
    sizes = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shard", F.ceil(F.col("n") / tree).cast("int").alias("trees"))
    dealt = shards.join(sizes, "shard").withColumn("part", F.expr("cast(pmod(xxhash64(fp, 1), trees) as int)"))
    # a row asks its own tree and the later ones of its shard; a tree is shipped to every
    # SALT parts' worth of its queries, so no task holds more than these
    asks = dealt.withColumn("to", F.explode(F.sequence("part", F.col("trees") - 1)))
    last = F.floor(F.col("to") / SALT).cast("int")
    salt = F.when(F.col("to") == F.col("part"), F.sequence(F.lit(0), last)).otherwise(F.array(F.floor(F.col("part") / SALT).cast("int")))
    rows = asks.withColumn("salt", F.explode(salt)).select(F.xxhash64("shard", "to", "salt").alias("tree"), (F.col("to") == F.col("part")).alias("own"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "tree").sortWithinPartitions("tree").mapInArrow(_spanned(radius), "u long, v long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, root (a
    fingerprint that names the component), th (a hash of the text).

    component_id is the smallest doc_id reachable over links of fingerprints at most
    radius bits apart, own one included (null ids last; null if all are null). Texts
    of fewer than `shingle` words count as one shingle; null, empty and blank texts
    have fingerprint zero and are linked like any other. Whole texts count, however
    long; rows that repeat get equal answers, so ties need no rule. Copies share a
    fingerprint, so links are sought between distinct fingerprints only and no group is
    paired out. An empty table gives an empty result; other columns of docs, whatever
    their names, are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    slim = stage(rows.mapInArrow(_fingerprints(shingle), f"doc_id {kind}, th long, fp long"), "simhash")
    distinct = stage(slim.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(linked(distinct.select("fp"), radius))
    placed = distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = stage(placed.join(best, "root").select(F.col("fp").alias("key"), "component_id", "root"), "component")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return slim.join(answer, F.col("fp") == F.col("key")).select("doc_id", hexed.alias("fingerprint"), "component_id", "root", "th")
