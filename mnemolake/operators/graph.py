"""Task graphs: reachability by iterated joins, roots, paths."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.operators.reach_index import ReachIndex
from mnemolake.session import shared_dir


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, root, node): nodes reachable from starts (graph, root) along edges (graph,
    source, target), roots included. A round joins the frontier only, drops what is
    known, and the last one finds nothing new, however long a path. Rounds take one step
    at first; long paths are then walked in strides, whose steps share a job. The
    frontier is checkpointed to cut lineage."""
    spark = starts.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    out = edges.select("graph", F.col("source").alias("node"), "target")
    known = frontier = starts.select("graph", "root", F.col("root").alias("node")).distinct()
    rounds, stride = 0, 1
    while True:
        steps, at = [], frontier
        for k in range(stride):
            at = at.join(out, ["graph", "node"]).select("graph", "root", F.col("target").alias("node")).distinct()
            steps.append(at.withColumn("step", F.lit(k)))
        found = reduce(DataFrame.unionByName, steps).groupBy("graph", "root", "node").agg(F.min("step").alias("step"))
        new = found.join(known, ["graph", "root", "node"], "left_anti").checkpoint()
        if new.isEmpty():
            return known
        known = known.unionByName(new.drop("step"))
        # what earlier steps of the round found has been followed within it
        frontier = new.filter(F.col("step") == stride - 1).drop("step")
        rounds += 1
        if rounds % 16 == 0:
            known = known.checkpoint()
        if rounds >= 8 and rounds % 4 == 0:
            stride = min(2 * stride, 16)


def makes_cycle(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """candidates (graph, source, target) gain cycle: whether source is reachable from target, by
    two look-ups of chain labels each."""
    turned = candidates.withColumnRenamed("source", "_from").withColumnRenamed("target", "source").withColumnRenamed("_from", "target")
    told = ReachIndex.build(edges).reaches(turned, "cycle")
    return told.withColumnRenamed("source", "_to").withColumnRenamed("target", "source").withColumnRenamed("_to", "target").select(*candidates.columns, "cycle")


def root_task(nodes: DataFrame) -> DataFrame:
    """Per graph: an open task, else one not frozen, else any; newest, most important."""
    rank = F.when(F.col("status").isin("active", "blocked"), 0).when(F.col("status") != "frozen", 1).otherwise(2)
    w = W.partitionBy("graph").orderBy(rank, F.desc("updated_at"), F.desc("importance"), "id")
    return nodes.filter("kind = 'task'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def task_subgraph(roots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Reachable from the root without crossing another task."""
    inner = nodes.filter("kind <> 'task'").select("graph", F.col("id").alias("target"))
    return reachable(roots, edges.join(inner, ["graph", "target"], "left_semi"))


def side_branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes behind edges of type side_branch, tasks left out."""
    inner = nodes.filter("kind <> 'task'").select("graph", F.col("id").alias("target"))
    own = edges.join(inner, ["graph", "target"], "left_semi")
    return reachable(own.filter("type = 'side_branch'").select("graph", F.col("target").alias("root")), own).select("graph", "node").distinct()


def blocks_first(status: Column) -> Column:
    return F.when(status == "blocked", 0).otherwise(1)


def _leads(how: str, from_root: bool, source: str | None, target: str | None) -> bool:
    """Whether a path may take an edge: from the root by decomposition; else to what is
    blocked, on from what is frozen, or on from what has not failed."""
    if from_root:
        return how == "decomposes"
    return {"blocks": target == "blocked", "supersedes": source == "frozen", "continues": source not in ("failed", "frozen")}.get(how, False)


def active_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, path): node ids from the root to the best open node that leads back to it,
    first parents by id; the root alone if there is none. A graph
    is one session's, and fits a worker."""

    def run(key: tuple, ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        tasks = ns[ns.kind == "task"].copy()
        if tasks.empty:
            return pd.DataFrame({"graph": [key[0]], "path": [[]]})
        tasks["r"] = tasks.status.map(lambda s: 0 if s in ("active", "blocked") else 2 if s == "frozen" else 1)
        root = tasks.sort_values(["r", "updated_at", "importance", "id"], ascending=[True, False, False, True]).iloc[0]["id"]
        kind = dict(zip(ns.id, ns.kind, strict=True))
        out: dict = {}
        for s, t in zip(es.source, es.target, strict=True):
            out.setdefault(s, []).append(t)

        def spread(first: list) -> set:
            seen, todo = set(), list(first)
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [y for y in out.get(x, []) if kind.get(y, "task") != "task"]
            return seen

        sides = spread([t for t, k in zip(es.target, es.type, strict=True) if k == "side_branch" and kind.get(t) != "task"])
        inner = spread([root]) - sides
        front = ns[ns.id.isin(inner) & (ns.kind != "task") & ns.status.isin(["active", "blocked"])].copy()
        front["b"] = front.status != "blocked"
        state = dict(zip(ns.id, ns.status, strict=True))
        leads: dict = {}
        for p, t, how in zip(es.source, es.target, es.type, strict=True):
            if p in inner and t in inner and _leads(how, p == root, state.get(p), state.get(t)):
                leads.setdefault(t, []).append(p)
        for x in front.sort_values(["b", "importance", "updated_at", "id"], ascending=[True, False, False, True]).id:
            # breadth first back to the root, over the edges that a path may take
            after, todo = {x: None}, [x]
            while todo and root not in after:
                at = todo.pop(0)
                for p in sorted(leads.get(at, [])):
                    if p not in after:
                        after[p] = at
                        todo.append(p)
            if root in after:
                path, at = [], root
                while at is not None:
                    path.append(at)
                    at = after[at]
                return pd.DataFrame({"graph": [key[0]], "path": [path]})
        return pd.DataFrame({"graph": [key[0]], "path": [[root]]})

    return nodes.groupBy("graph").cogroup(edges.groupBy("graph")).applyInPandas(run, "graph long, path array<long>")


def unreachable(added: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Added nodes (graph, node) that no task reaches."""
    tasks = nodes.filter("kind = 'task'").select("graph", F.col("id").alias("root"))
    return added.join(reachable(tasks, edges).select("graph", "node").distinct(), ["graph", "node"], "left_anti")


def transition_faults(nodes: DataFrame, edges: DataFrame, added: DataFrame) -> DataFrame:
    """(graph, fault): more than one open task; an added task that is not open, or whose one
    incoming edge from a task does not suit how that task ended."""
    tasks = nodes.filter("kind = 'task'")
    many = tasks.filter(F.col("status").isin("active", "blocked")).groupBy("graph").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("graph", F.lit("several open tasks").alias("fault"))
    new = added.join(tasks.select("graph", F.col("id").alias("node"), "status"), ["graph", "node"])
    shut = new.filter(~F.col("status").isin("active", "blocked")).select("graph", F.lit("added task is not open").alias("fault"))
    old = tasks.select("graph", F.col("id").alias("source"), F.col("status").alias("ended"))
    into = edges.withColumnRenamed("target", "node").join(new.select("graph", "node"), ["graph", "node"]).join(old, ["graph", "source"], "left")
    want = F.when(F.col("ended").isin("done", "failed"), "continues").when(F.col("ended") == "frozen", "supersedes")
    g = into.groupBy("graph", "node").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("type") == want).cast("int")).alias("ok"))
    odd = g.filter((F.col("n") != 1) | (F.coalesce("ok", F.lit(0)) == 0)).select("graph", F.lit("transition does not fit").alias("fault"))
    return many.unionByName(shut).unionByName(odd)


def builder_context(nodes: DataFrame, most: int) -> DataFrame:
    """Tasks and open nodes always, then others by importance up to `most` a graph; the
    ones that must be there may exceed it."""
    must = (F.col("kind") == "task") | F.col("status").isin("active", "blocked")
    w = W.partitionBy("graph").orderBy(F.desc(must), F.desc("importance"), F.desc("updated_at"), "id")
    return nodes.withColumn("_n", F.row_number().over(w)).filter(must | (F.col("_n") <= most)).drop("_n")
