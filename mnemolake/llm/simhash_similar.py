"""SimHash near-dedup at a similarity: texts whose sets of five-word shingles have a
Jaccard similarity of LEAST or more.

A radius of some bits cannot tell that similarity from a little less, and one wide
enough leaves no blocks of equal bits to shard by. So fingerprints have 256 bits (of
two sets at 0.8, some 39 differ, give or take 6; RADIUS is 72), shards are formed by
min-hashes, and what the BK-trees link is verified by whole shingle sets.

1. A shard is a bucket: texts that share one of BANDS groups of WIDTH min-hashes. A pair
   at 0.8 shares none with a probability of (1 - 0.8 ** 4) ** 32, or 5e-8.
2. In each bucket every text is verified against one, its hub. Groups of copies are
   thus linked without pairing them out.
3. Texts that are not linked to their hub make the BK-trees of the hub's family, TREE of
   them at most; all texts of the family's buckets query the trees within RADIUS, some
   ASKS of them to a copy of a tree, and what is found is verified there and then, unless
   it is linked already. So all pairs of a bucket are linked, or tried, and no set travels
   once a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import keyed, mix64, ragged, stage, tune, utf8
from mnemolake.llm.components import components
from mnemolake.llm.simhash import Forest

SEED = 42
SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
BANDS, WIDTH = 32, 4
#: 64-bit words of a fingerprint, and bits that linked ones may differ in. At 0.8 a bit
#: differs with a probability of acos(8/9) / pi: 72 is 5.8 standard deviations above.
LONGS, RADIUS = 4, 72
#: Sets too small for that estimate pass unfiltered.
FEW = 32
#: Texts of a tree at most, and shingles in it at most (but for one text alone).
TREE, HELD = 4096, 1 << 20
#: Texts that query one copy of a tree, or as many as it holds if those are more.
ASKS = 512
#: Shingles that meet all hash functions at once.
PIECE = 1 << 12
_K = np.arange(1, BANDS * WIDTH + 1, dtype=np.uint64)[:, None]
_XOR, _ODD = mix64(_K * np.uint64(2)), mix64(_K * np.uint64(2) + np.uint64(1)) | np.uint64(1)
_SALT = mix64(np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than SHINGLE are one."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - SHINGLE + 1)].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def buckets(found: np.ndarray) -> np.ndarray:
    """One number per band."""
    low = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), PIECE):
        np.minimum(low, ((found[None, a : a + PIECE] ^ _XOR) * _ODD).min(1), out=low)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, WIDTH).T:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return out


def fingerprint(found: np.ndarray) -> np.ndarray:
    """LONGS words; a bit is 1 if it is set in over half of the shingles' hashes."""
    ones = np.zeros((LONGS, 64), np.int64)
    for a in range(0, len(found), PIECE):
        for k in range(LONGS):
            bits = np.unpackbits(mix64(found[a : a + PIECE] ^ _SALT[k]).view(np.uint8).reshape(-1, 8), axis=1)
            ones[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), axis=1).view(np.uint64).ravel()


def _words(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    at, raw = utf8(batch.column("text"))
    data = raw.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[a:b].lower().split()  # both in ASCII terms: A-Z and \x20 \x09-\x0D


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node names a text but for case and white space; n counts its shingles."""
    for batch in batches:
        node, n, rows = [], [], [np.zeros(0, np.uint64)]
        for words in _words(batch):
            found = shingles(words)
            node.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
            n.append(len(found))
            rows.append(buckets(found))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(rows).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), lists], names=["doc_id", "th", "node", "n", "buckets"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(w) for w in _words(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([fingerprint(x).tobytes() for x in found], pa.binary())], names=["node", "found", "fp"])


def similar(a: int, b: int, shared: int) -> bool:
    """Whether sets of a and b shingles that share some have LEAST or more, in whole numbers."""
    return LEAST[1] * shared >= LEAST[0] * (a + b - shared)


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for p, q in zip(batch.column("x"), batch.column("y"), strict=True):
            a, b = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
            ok.append(similar(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))


class Tree:
    """A BK-tree of texts, with their shingles as posting lists to verify what it links."""

    def __init__(self) -> None:
        self.node: list[int] = []
        self.root: list[int] = []
        self.sets: list[np.ndarray] = []
        self.fp: list[np.ndarray] = []
        self.asks = 0
        self.up: dict[int, int] = {}
        self.ready = False

    def top(self, x: int) -> int:
        """The component of a root, as far as the tree has linked them."""
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def build(self) -> None:
        """One tree node for each distinct fingerprint; those of too small sets are apart."""
        self.ready = True
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        own, self.which = np.unique(np.stack(self.fp), axis=0, return_inverse=True)
        self.which = self.which.ravel()
        self.forest = Forest(np.zeros(len(own), np.int64), own)
        self.small = np.nonzero(self.sizes < FEW)[0]
        order = np.argsort(self.which, kind="stable")
        self.holders, self.begin = order, np.searchsorted(self.which[order], np.arange(len(own) + 1))
        flat, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.values, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.owner = owner[order]

    def links(self, nodes: list[int], roots: list[int], sets: list[np.ndarray], fps: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(text asked, text of the tree) that join what was apart."""
        near: list[list[np.ndarray]] = [[] for _ in nodes]
        asked = np.arange(len(nodes))
        for q, at, _ in self.forest.within(np.stack(fps), np.zeros(len(nodes), np.int64), RADIUS):
            for k in np.unique(q).tolist():
                hit = at[q == k]
                near[k].append(self.holders[ragged(self.begin[hit], self.begin[hit + 1] - self.begin[hit])])
        for k in asked.tolist():
            some = [*near[k], self.small if len(sets[k]) >= FEW else np.arange(len(self.node))]
            tops = {}
            mine = self.top(roots[k])
            for j in np.unique(np.concatenate(some)).tolist():
                if self.top(self.root[j]) != mine:
                    tops[j] = True
            if not tops:
                continue
            # how many shingles each text of the tree shares with this one
            at = np.minimum(np.searchsorted(self.values, sets[k]), len(self.values) - 1)
            at = at[self.values[at] == sets[k]]
            shared = np.bincount(self.owner[ragged(self.first[at], self.first[at + 1] - self.first[at])], minlength=len(self.node))
            for j in tops:
                if similar(len(sets[k]), int(self.sizes[j]), int(shared[j])) and (other := self.top(self.root[j])) != self.top(roots[k]):
                    self.up[other] = self.top(roots[k])
                    yield nodes[k], self.node[j]


def _searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (family, tree), those of the tree first, and of them those that ask it
    here. Memory: a tree and a batch."""
    key, tree = None, Tree()
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("family", "tree", "own", "asks", "node", "root", "found", "fp")), strict=True))
        found: list[tuple[int, int]] = []
        a = 0
        while a < len(rows):
            b = a
            while b < len(rows) and rows[b][:4] == rows[a][:4]:
                b += 1
            if rows[a][:2] != key:
                found += _own_links(tree)
                key, tree = rows[a][:2], Tree()
            nodes, roots = [r[4] for r in rows[a:b]], [r[5] for r in rows[a:b]]
            sets, fps = [np.frombuffer(r[6], np.uint64) for r in rows[a:b]], [np.frombuffer(r[7], np.uint64) for r in rows[a:b]]
            if rows[a][2]:
                tree.node += nodes
                tree.root += roots
                tree.sets += sets
                tree.fp += fps
                tree.asks += len(nodes) if rows[a][3] else 0  # those that ask here come first
            else:
                found += _own_links(tree)
                if tree.node:
                    found += tree.links(nodes, roots, sets, fps)
            a = b
        yield _pairs(found)
    yield _pairs(_own_links(tree))


def _own_links(tree: Tree) -> list[tuple[int, int]]:
    """Builds the tree, once, and lets its own texts query it."""
    if tree.ready or not tree.node:
        return []
    tree.build()
    k = tree.asks if len(tree.node) > 1 else 0
    return list(tree.links(tree.node[:k], tree.root[:k], tree.sets[:k], tree.fp[:k])) if k else []


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])


def _fits(a: str, b: str) -> Column:
    """Sizes that allow the similarity."""
    return LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b)


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, th (a hash of the text), root (names the component).

    Components are those of texts whose sets of lower-case five-word shingles have a
    Jaccard similarity of 0.8 or more; texts of fewer words have one shingle. Null, empty
    and blank texts are one component. Whole texts count, however long; rows that repeat
    get equal answers, so ties need no rule. An empty table gives an empty result; other
    columns of docs, whatever their names, are ignored. A family's unlinked texts meet all
    its texts, so work grows with their product; sizes that rule the similarity out are
    tried no more than the trees' own search.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    slim = stage(rows.mapInArrow(_sketched, f"doc_id {kind}, th long, node long, n long, buckets array<long>"), "sketches")
    one = slim.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.min("th").alias("th"))
    placed = one.select("node", "n", "th", F.explode("buckets").alias("bucket"))
    hub = F.min(F.struct(F.xxhash64("node", F.lit(0)).alias("k"), "node", "n"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), hub.alias("h")).filter("size > 1")
    sizes = stage(sizes.select("bucket", F.col("h.node").alias("hub"), F.col("h.n").alias("m")), "buckets")
    shared = stage(placed.join(sizes, "bucket"), "shared")
    # a text's hash finds one row of each candidate; rows that share it have equal texts
    asked = shared.select("node", F.col("th").alias("_th")).distinct()
    texts = rows.join(asked, F.col("th") == F.col("_th")).select("node", "text").dropDuplicates(["node"])
    sets = stage(texts.mapInArrow(_sets, "node long, found binary, fp binary"), "sets")
    # stored first, so a hot hub is split
    pairs = shared.filter((F.col("node") != F.col("hub")) & _fits("n", "m")).select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    pairs = stage(pairs, "pairs")
    x, y = sets.select(F.col("node").alias("u"), F.col("found").alias("x")), sets.select(F.col("node").alias("v"), F.col("found").alias("y"))
    links = stage(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_verified, "u long, v long"), "linked")
    roots = stage(components(links), "roots")

    named = lambda c: roots.select(F.col("u").alias(f"_{c}"), F.col("root").alias(f"{c}_root"))
    own = shared.select("bucket", "node", "hub", "n").join(named("node"), F.col("node") == F.col("_node"), "left").join(named("hub"), F.col("hub") == F.col("_hub"), "left")
    own = own.select("bucket", "node", "n", F.coalesce("node_root", "node").alias("root"), F.coalesce("hub_root", "hub").alias("family"))
    own = stage(own.withColumn("apart", F.col("root") != F.col("family")), "own")
    open_ = own.filter("apart").select("bucket").distinct()
    members = own.join(open_, "bucket", "left_semi").groupBy("family", "node").agg(F.max("apart").alias("apart"), F.first("root").alias("root"), F.first("n").alias("n"))
    members = stage(members, "members")
    apart = F.count(F.when(F.col("apart"), 1))
    count = F.greatest(F.ceil(apart / TREE), F.ceil(F.sum(F.when(F.col("apart"), F.col("n"))) / HELD)).cast("int")
    trees = members.groupBy("family").agg(count.alias("trees"), F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(ASKS), apart / count)).cast("int").alias("salts"))
    # stored, so that the join's sides are dealt by it alone and a large family is split
    dealt = members.join(stage(trees, "counts"), "family").withColumns({"part": F.when(F.col("apart"), F.expr("cast(pmod(xxhash64(node, 1), trees) as int)")), "place": F.expr("cast(pmod(xxhash64(node, 2), salts) as int)")})
    # all texts ask all trees, each in its own place; a tree's texts are shipped to every place
    dealt = dealt.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))).withColumn("own", F.col("part").isNotNull() & (F.col("tree") == F.col("part")))
    dealt = dealt.withColumn("salt", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("place"))))
    dealt = dealt.select("family", F.xxhash64("tree", "salt").alias("tree"), "own", (F.col("salt") == F.col("place")).alias("asks"), "node", "root")
    dealt = stage(dealt, "trees").join(sets, "node").select("family", "tree", "own", "asks", "node", "root", "found", "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    late = dealt.repartition(n, "family", "tree").sortWithinPartitions("family", "tree", F.desc("own"), F.desc("asks"))
    links = links.unionByName(stage(late.mapInArrow(_searched, "u long, v long"), "late"))
    roots = stage(components(links), "roots")
    return slim.join(roots, F.col("node") == F.col("u"), "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
