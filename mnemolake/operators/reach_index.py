"""Reachability by chain labels: whether one node leads to another is two look-ups.

Nodes are put on chains, which are paths of the graph that share no node: each node wishes for one
successor, each successor takes one of those that wish for it, and places on a chain come
by pointer doubling. For a node it is then enough to know the first place of each chain that
it leads to, as what follows on the chain follows. Along a chain these firsts only grow, so
of a pair of chains a staircase is kept: its steps, not its nodes. Staircases start from
the edges between chains and are composed with each other until nothing gets lower; each
round doubles the chains that a path may change between. Cycles need no contraction: a
chain's staircase to itself says how far back it leads.

Graphs, chains and steps are rows; no group holds a graph, and no table holds all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.session import shared_dir

#: Rounds in which nodes find their successor on a chain.
WISHES = 4


def _kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def chains(edges: DataFrame) -> DataFrame:
    """(graph, node, chain, place): every node of edges (graph, source, target) is on one chain,
    named after its first node; places count from 0."""
    e = edges.select("graph", "source", "target").distinct()
    nodes = e.select("graph", F.explode(F.array("source", "target")).alias("node")).distinct()
    left, links = e.filter("source <> target"), None
    for _ in range(WISHES):  # who was not taken wishes again, for what is free; fewer chains make shorter labels
        wished = left.groupBy("graph", "source").agg(F.min("target").alias("target"))
        taken = _kept(wished.groupBy("graph", "target").agg(F.min("source").alias("source")))
        if links is not None and taken.isEmpty():
            break
        links = taken if links is None else links.unionByName(taken)
        left = left.join(taken.select("graph", "source"), ["graph", "source"], "left_anti").join(taken.select("graph", "target"), ["graph", "target"], "left_anti")
    # back: the node that lies 2^k places before, null beyond a chain's first; low: the least node on the way and how far back it is
    at = nodes.join(links.withColumnRenamed("target", "node").withColumnRenamed("source", "back"), ["graph", "node"], "left")
    first = F.when(F.col("back").isNull(), F.col("node"))
    here = F.struct(F.col("node").alias("node"), F.lit(0).cast("long").alias("far"))
    at = _kept(at.select("graph", "node", "back", first.alias("head"), F.when(F.col("back").isNull(), 0).otherwise(1).cast("long").alias("far"), F.least(here, F.when(F.col("back").isNotNull(), F.struct(F.col("back").alias("node"), F.lit(1).cast("long").alias("far")))).alias("low")))
    span, longest = 1, at.groupBy("graph").count().agg(F.max("count")).first()[0] or 0
    while span < longest and not at.filter("back is not null").isEmpty():
        b = at.select("graph", F.col("node").alias("back"), F.col("back").alias("back2"), F.col("head").alias("head2"), F.col("far").alias("far2"), F.col("low").alias("low2"))
        low = F.least("low", F.when(F.col("low2").isNotNull(), F.struct(F.col("low2.node").alias("node"), (F.col("low2.far") + F.col("far")).alias("far"))))
        at = _kept(at.join(b, ["graph", "back"], "left").select("graph", "node", F.col("back2").alias("back"), F.coalesce("head", "head2").alias("head"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), low.alias("low")))
        span *= 2
    # what has no first node by now is a ring, which is cut before its least node
    return at.select("graph", "node", F.coalesce("head", "low.node").alias("chain"), F.when(F.col("head").isNull(), F.col("low.far")).otherwise(F.col("far")).alias("place"))


def _stairs(rows: DataFrame) -> DataFrame:
    """The steps (graph, chain, last, to, first): from places up to ``last`` of chain, and of no
    earlier step, chain ``to`` is reached at ``first`` at the lowest."""
    low = rows.groupBy("graph", "chain", "last", "to").agg(F.min("first").alias("first"))
    later = W.partitionBy("graph", "chain", "to").orderBy(F.desc("last")).rowsBetween(W.unboundedPreceding, -1)
    return low.withColumn("_best", F.min("first").over(later)).filter(F.col("_best").isNull() | (F.col("first") < F.col("_best"))).drop("_best")


def _spans(steps: DataFrame) -> DataFrame:
    """Steps with ``since``: the places from since to last take the step."""
    w = W.partitionBy("graph", "chain", "to").orderBy("last")
    return steps.withColumn("since", F.coalesce(F.lag("last").over(w) + 1, F.lit(0)))


def labels(edges: DataFrame, on: DataFrame) -> DataFrame:
    """The staircases of all pairs of chains that lead to each other."""
    side = lambda n, c, p: on.select("graph", F.col("node").alias(n), F.col("chain").alias(c), F.col("place").alias(p))
    e = edges.select("graph", "source", "target").distinct().join(side("source", "chain", "last"), ["graph", "source"]).join(side("target", "to", "first"), ["graph", "target"])
    ahead = (F.col("chain") == F.col("to")) & (F.col("first") >= F.col("last"))  # says no more than the chain itself
    steps = _kept(_stairs(e.filter(~ahead).select("graph", "chain", "last", "to", "first")))
    while True:
        b = _spans(steps).select("graph", F.col("chain").alias("to"), "since", F.col("last").alias("until"), F.col("to").alias("on"), F.col("first").alias("then"))
        met = steps.join(b, ["graph", "to"]).filter((F.col("first") >= F.col("since")) & (F.col("first") <= F.col("until")))
        more = met.select("graph", "chain", "last", F.col("on").alias("to"), F.col("then").alias("first")).filter((F.col("chain") != F.col("to")) | (F.col("first") < F.col("last")))
        after = _kept(_stairs(steps.unionByName(more)))
        if after.join(steps, ["graph", "chain", "last", "to", "first"], "left_anti").isEmpty():
            return after
        steps = after


@dataclass
class ReachIndex:
    on: DataFrame
    spans: DataFrame

    @classmethod
    def build(cls, edges: DataFrame) -> ReachIndex:
        """edges: (graph, source, target); nulls are no nodes."""
        known = edges.select("graph", "source", "target").filter("graph is not null and source is not null and target is not null")
        on = chains(known)
        return cls(on, _kept(_spans(labels(known, on))))

    def reaches(self, pairs: DataFrame, name: str = "reaches") -> DataFrame:
        """pairs (graph, source, target, ...) gain name: whether edges lead from source to
        target; a node reaches itself, known or not."""
        side = lambda n, c, p: self.on.select(F.col("graph").alias("_g"), F.col("node").alias("_n"), F.col("chain").alias(c), F.col("place").alias(p)).withColumnRenamed("_n", f"_{n}").withColumnRenamed("_g", f"_g{n}")
        out = pairs
        for n, c, p in (("source", "_a", "_p"), ("target", "_b", "_q")):
            out = out.join(side(n, c, p), (F.col("graph") == F.col(f"_g{n}")) & (F.col(n) == F.col(f"_{n}")), "left").drop(f"_g{n}", f"_{n}")
        s = self.spans.select(F.col("graph").alias("_gs"), F.col("chain").alias("_c"), F.col("to").alias("_t"), "since", "last", F.col("first").alias("_first"))
        out = out.join(s, (F.col("graph") == F.col("_gs")) & (F.col("_a") == F.col("_c")) & (F.col("_b") == F.col("_t")) & (F.col("_p") >= F.col("since")) & (F.col("_p") <= F.col("last")), "left")
        ahead = (F.col("_a") == F.col("_b")) & (F.col("_p") <= F.col("_q"))
        found = F.coalesce(F.col("source") == F.col("target"), F.lit(False)) | F.coalesce(ahead, F.lit(False)) | F.coalesce(F.col("_first") <= F.col("_q"), F.lit(False))
        return out.withColumn(name, found).drop("_a", "_p", "_b", "_q", "_gs", "_c", "_t", "since", "last", "_first")
