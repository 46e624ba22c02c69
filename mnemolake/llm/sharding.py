"""Sharding by a k-d tree over metadata, cut at distributed weighted medians.

Points are the groups of equal texts, weighed by their bytes; their coordinates are
the metadata of their first row, each scaled to 0..1. A node that holds k times the
target bytes is cut along its widest dimension where k//2 of its k shares of the bytes
lie below, until leaves hold the target bytes. All nodes of a level are cut together,
digit by digit: an aggregate per node and digit of the coordinate (with a hash of the
text below it, so that ties can be cut too), of which the driver sees the one digit a
node at which the running sum gets there, until that digit weighs next to nothing or
no digit is left.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.llm.common import discard, numbered, stage

DIGIT = 10
#: Coordinates have 20 bits, the hash below them 30.
CELL, BELOW = 20, 30
#: A digit at the cut that weighs less than this share of its node is not split.
FINE = 1e-4


@dataclass
class Node:
    shards: int
    first: int
    dim: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def leaves(node: Node) -> list[Node]:
    return [node] if node.left is None or node.right is None else leaves(node.left) + leaves(node.right)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row a node, for a broadcast: nodes are fewer than twice the shards."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def grown(points: DataFrame, dims: int, shards: int) -> tuple[Node, DataFrame]:
    """The tree, and points with the first shard of the leaf (node) each falls into.

    points: w (bytes) and k0..k{dims-1}, longs of CELL + BELOW bits. A level is cut at once: points
    bear their node, and one look-up in a table of the level's cuts hands them to its
    halves. What the driver sees of a level is a row a node, at each digit.
    """
    spark, keys = points.sparkSession, F.array(*[F.col(f"k{d}") for d in range(dims)])
    root = Node(shards, 0)
    at, held, tips = points.withColumn("node", F.lit(0).cast("long")), None, [root]
    while open_ := {n.first: n for n in tips if n.shards > 1}:
        own = at.join(_table(spark, [(i,) for i in open_], "node long"), "node", "left_semi")
        spread = own.groupBy("node").agg(F.sum("w").alias("w"), *[(F.max(f"k{d}") - F.min(f"k{d}")).alias(f"s{d}") for d in range(dims)]).collect()  # a row a node
        weight = {r["node"]: r["w"] for r in spread}
        for r in spread:
            wide = [r[f"s{d}"] >> BELOW for d in range(dims)]
            open_[r["node"]].dim = wide.index(max(wide))
        want = {i: weight.get(i, 0) * (n.shards // 2) / n.shards for i, n in open_.items()}
        low, below, going = dict.fromkeys(open_, 0), dict.fromkeys(open_, 0), {i for i in open_ if i in weight}
        for shift in range(CELL + BELOW - DIGIT, -1, -DIGIT):
            if not going:
                break
            asked = _table(spark, [(i, open_[i].dim, low[i] >> (shift + DIGIT), below[i], float(want[i])) for i in sorted(going)], "node long, dim int, prefix long, below long, want double")
            key = F.element_at(keys, F.col("dim") + 1)
            digits = own.join(asked, "node").filter(F.shiftright(key, shift + DIGIT) == F.col("prefix")).groupBy("node", "below", "want", (F.shiftright(key, shift) % (1 << DIGIT)).alias("digit")).agg(F.sum("w").alias("w"))
            run = F.sum("w").over(W.partitionBy("node").orderBy("digit")) + F.col("below")
            reached = digits.withColumn("run", run).filter(F.col("run") >= F.col("want")).groupBy("node").agg(F.min(F.struct("digit", "w", "run")).alias("c")).select("node", "c.*").collect()  # a row a node
            for r in reached:
                i, w = r["node"], r["w"]
                # the cut lies in this digit, or at one of its ends if it is light
                low[i] += r["digit"] << shift
                below[i] = r["run"] - w
                if shift == 0 or w <= FINE * weight[i]:
                    if want[i] - below[i] > w / 2:
                        low[i] += 1 << shift
                    going.discard(i)
            going &= {r["node"] for r in reached}
        tips = []
        for i, n in open_.items():
            n.cut = low[i]
            n.left, n.right = Node(n.shards // 2, n.first), Node(n.shards - n.shards // 2, n.first + n.shards // 2)
            tips += [n.left, n.right]
        cuts = _table(spark, [(i, n.dim, n.cut, n.right.first) for i, n in open_.items() if n.right], "node long, dim int, cut long, right long")
        side = F.when(F.element_at(keys, F.greatest("dim", F.lit(0)) + 1) >= F.col("cut"), F.col("right")).otherwise(F.col("node"))
        after = stage(at.join(cuts, "node", "left").withColumn("node", side).select(*points.columns, "node"), "halves")
        if held is not None:
            discard(held)
        at = held = after
    return root, at


def grow(points: DataFrame, dims: int, shards: int) -> Node:
    return grown(points, dims, shards)[0]


def shard(docs: DataFrame, shards: int | None = 8, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang"), target_bytes: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: shards hold nearly equal sums of sizes (UTF-8 bytes of the
    text, null none, plus 1); grown_shard is null. Equal texts share a shard, so a
    group of copies that outweighs a share makes its shard heavier. The target is
    target_bytes, or an equal share of all for each of so many shards. Dimensions are the
    columns named by dims, as far as docs has them, and the size; numbers keep their
    order, other values go by a hash, nulls come first; where coordinates tie, a hash of
    the text decides. slot numbers a shard's rows from 0 without gaps, in an order of
    hashes; rows that repeat whole follow each other in any order. Texts count whole,
    however long. An empty table gives an empty result; other columns of docs, whatever
    their names, are ignored.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    numeric = ("byte", "short", "integer", "long", "float", "double")
    kinds = {f.name: f.dataType.typeName() for f in docs.schema.fields}
    coords = [F.col(c).cast("double") if kinds[c] in numeric else F.crc32(F.col(c).cast("string")).cast("double") for c in dims if c in kinds]
    coords.append(F.log2(F.octet_length(text) + 1))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("same"), F.struct(*[c.alias(f"x{i}") for i, c in enumerate(coords)]).alias("x"))
    slim = stage(rows, "sizes")
    groups = slim.groupBy("same").agg(F.sum("size").alias("w"), F.min_by("x", F.struct("doc_id", "x")).alias("x"))
    n = len(coords)
    ends = slim.agg(F.sum("size").alias("bytes"), *[f(F.col(f"x.x{i}")).alias(f"{name}{i}") for i in range(n) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    below = F.conv(F.substring("same", 1, 7), 16, 10).cast("long") * 4
    keys = []
    for i in range(n):
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        cell = F.when(F.col(f"x.x{i}").isNull(), 0).otherwise(F.floor((F.col(f"x.x{i}") - lo) / ((hi - lo) or 1.0) * ((1 << CELL) - 1)))
        keys.append((cell.cast("long") * (1 << BELOW) + below).alias(f"k{i}"))
    points = stage(groups.select("same", "w", *keys), "points")
    _, leaf = grown(points, n, shards or max(1, math.ceil((ends["bytes"] or 0) / target_bytes)))
    placed = leaf.select(F.col("same").alias("other"), F.col("node").alias("shard"))
    joined = stage(slim.join(placed, F.col("same") == F.col("other")).select("doc_id", "size", "text_crc32", "same", "shard"), "placed")
    out = numbered(joined, "shard", F.xxhash64("doc_id", "same"), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
