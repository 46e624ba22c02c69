"""Chain labels against walks."""

from __future__ import annotations

import random

import pytest

from mnemolake.operators.reach_index import ReachIndex


def walked(edges):
    out = {}
    for g, s, t in edges:
        out.setdefault((g, s), set()).add(t)
    reach = {}
    for g, s in {(g, x) for g, a, b in edges for x in (a, b)}:
        seen, todo = {s}, [s]
        while todo:
            for t in out.get((g, todo.pop()), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[g, s] = seen
    return reach


@pytest.mark.parametrize("kind", ["sparse", "acyclic", "dense"])
def test_random_graphs(spark, kind):
    rng = random.Random(kind)
    edges = []
    for g in range(12):
        n = rng.randint(2, 22)
        for _ in range(int(n * {"sparse": 1.1, "acyclic": 2.0, "dense": 3.0}[kind])):
            a, b = rng.randrange(n), rng.randrange(n)
            edges.append((g, min(a, b), max(a, b)) if kind == "acyclic" and a != b else (g, a, b))
    edges += [(100, i, (i + 1) % 7) for i in range(7)] + [(100, 3, 10), (101, 5, 5), (102, 1, 2), (102, 2, 1), (102, 2, 3), (102, 3, 4), (102, 4, 3)]
    reach = walked(edges)
    pairs = [(g, a, b) for g, a in reach for h, b in reach if g == h] + [(0, 999, 999), (0, 999, 0), (999, 1, 1), (999, 1, 2), (None, 1, 2), (0, None, 1)]
    index = ReachIndex.build(spark.createDataFrame([*edges, *edges[:5], (None, 1, 2), (3, None, 2)], "graph long, source long, target long"))
    got = {(r["graph"], r["source"], r["target"]): r["ok"] for r in index.reaches(spark.createDataFrame(pairs, "graph long, source long, target long"), "ok").collect()}
    assert got == {(g, a, b): (a == b and a is not None) or b in reach.get((g, a), ()) for g, a, b in pairs}
    on = index.on.collect()
    assert len(on) == len(reach) and len({(r["graph"], r["chain"], r["place"]) for r in on}) == len(on)


def test_long_paths_have_short_labels(spark):
    """Two paths of 600 nodes with rungs between them, closed to a ring by one edge or not."""
    n = 600
    edges = [(1, i, i + 2) for i in range(2 * n - 2)] + [(1, i, i + 1) for i in range(0, 2 * n - 1, 100)]
    pairs = [(1, 0, 2 * n - 2), (1, 0, 2 * n - 1), (1, 1, 0), (1, 1, 2 * n - 2), (1, 701, 700), (1, 2 * n - 1, 0), (1, 100, 101), (1, 102, 103)]
    to = lambda e: {r["target"] * 10_000 + r["source"]: r["ok"] for r in ReachIndex.build(spark.createDataFrame(e, "graph long, source long, target long")).reaches(spark.createDataFrame(pairs, "graph long, source long, target long"), "ok").collect()}
    up = lambda s, t: t * 10_000 + s
    assert to(edges) == {up(0, 2 * n - 2): True, up(0, 2 * n - 1): True, up(1, 0): False, up(1, 2 * n - 2): False, up(701, 700): False, up(2 * n - 1, 0): False, up(100, 101): True, up(102, 103): False}
    assert all(to([*edges, (1, 2 * n - 1, 0)]).values())
    index = ReachIndex.build(spark.createDataFrame(edges, "graph long, source long, target long"))
    assert index.spans.count() <= 2 * n // 100 + 2 and index.on.select("chain").distinct().count() == 2


def test_no_edges(spark):
    none = spark.createDataFrame([], "graph long, source long, target long")
    asked = spark.createDataFrame([(1, 2, 2), (1, 2, 3)], none.schema)
    assert [r["reaches"] for r in ReachIndex.build(none).reaches(asked).orderBy("target").collect()] == [True, False]
