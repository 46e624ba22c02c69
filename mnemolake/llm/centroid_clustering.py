"""Centroid clustering by exponion search.

Every vector carries an upper bound on the distance to its centroid and a lower one
on the distance to all others. After a round the bounds are loosened by how far the
centroids moved; a vector whose bounds still keep it is not looked at. The others
scan only the centroids inside a ball around their current one, of radius twice their
own distance plus that centroid's distance to its nearest neighbour: it holds the
vector's nearest and second nearest centroid. Each centroid has a list of the others
sorted by distance, so a ball is a prefix of a list; balls are taken in prefixes of
1, 2, 4, ... centroids, one block product each. Radii are inclusive, so ties are seen.

Components are integers and distances exact. A round writes the vectors with their
bounds to the shared folder, with one row of sums a task and cluster beside them; the
driver sees as many rows as there are centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm.common import discard, stage, tune

#: Components are held between -LIMIT and LIMIT, so that squared distances of up to 64 of them fit a long.
LIMIT = 1 << 27
#: The sorted lists hold k * k distances and go to every task.
MOST_CENTROIDS = 2048
#: Bounds are rounded square roots; tests on them leave this much room.
ROOM = 1e-9


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v to all rows of c, int64."""
    high = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if v.shape[1] * high * high * 4 < 1 << 53:  # every term is an integer that a double holds
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(axis=1) for row in c], axis=1) if len(c) else np.zeros((len(v), 0), np.int64)


class Centroids:
    """What a round ships: the centroids, how far each moved, and for each the others by distance."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None) -> None:
        self.at = at
        k = len(at)
        moved = np.zeros(k) if before is None else np.sqrt(((at - before) ** 2).sum(axis=1).astype(np.float64))
        self.moved = moved
        top = np.argsort(-moved, kind="stable")[:2]
        # the farthest move of any centroid but the own
        self.others_moved = np.full(k, moved[top[0]] if k else 0.0)
        if k:
            self.others_moved[top[0]] = moved[top[1]] if k > 1 else 0.0
        gap = np.sqrt(squared(at, at).astype(np.float64))
        order = np.argsort(gap + np.where(np.eye(k, dtype=bool), np.inf, 0.0), axis=1, kind="stable")
        self.order = order[:, : k - 1]
        self.gap = np.take_along_axis(gap, self.order, axis=1)
        self.nearest = self.gap[:, 0] if k > 1 else np.full(k, np.inf)


def chosen(d: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, distance, distance of the second) of each row's nearest; the smaller number wins ties."""
    least = d.min(axis=1)
    best = np.where(d == least[:, None], number, np.iinfo(np.int64).max).min(axis=1)
    second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) if d.shape[1] > 1 else np.full(len(d), np.inf)
    return best, least, second


def assign(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(own, upper, lower, distances taken) after a round; own is -1 where there is none yet."""
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    k, taken = len(c.at), 0
    new = np.nonzero(own < 0)[0]
    if len(new):
        best, least, second = chosen(squared(v[new], c.at), np.arange(k)[None, :])
        own[new], upper[new], lower[new] = best, np.sqrt(least.astype(np.float64)), second
        taken += k * len(new)
    old = np.ones(len(v), bool)
    old[new] = False
    upper[old] += c.moved[own[old]]
    lower[old] -= c.others_moved[own[old]]
    doubt = lambda rows: rows[upper[rows] * (1 + ROOM) + ROOM >= np.maximum(lower[rows], c.nearest[own[rows]] / 2)]
    rows = doubt(np.nonzero(old)[0])
    upper[rows] = np.sqrt(((v[rows] - c.at[own[rows]]) ** 2).sum(axis=1).astype(np.float64))
    taken += len(rows)
    rows = doubt(rows)
    if k < 2 or not len(rows):
        return own, upper, lower, taken
    radius = (2 * upper[rows] + c.nearest[own[rows]]) * (1 + ROOM) + ROOM
    inside = np.empty(len(rows), np.int64)
    for a in np.unique(own[rows]).tolist():
        of = own[rows] == a
        inside[of] = np.searchsorted(c.gap[a], radius[of], "right")
    ring = np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64)
    group = own[rows] * 64 + ring
    for g in np.unique(group).tolist():
        of, a = rows[group == g], g // 64
        near = np.concatenate([[a], c.order[a][: 1 << (g % 64)]])
        best, least, second = chosen(squared(v[of], c.at[near]), near[None, :])
        own[of], upper[of], lower[of] = best, np.sqrt(least.astype(np.float64)), second
        taken += len(of) * (len(near) - 1)
    return own, upper, lower, taken


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _round(c: Centroids, last: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows go on with their new bounds; at a task's end, one row of (count, sums) a cluster.
    The last round has (count, high and low half of the distances' sum) for sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = c.at.shape
        sums = np.zeros((k, 3 if last else d + 1), np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field("vec_id").type
            if not len(batch):
                continue
            v = _matrix(batch.column("v"))
            own, upper, lower = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("cluster", "upper", "lower"))
            own, upper, lower, _ = assign(v, own.astype(np.int64), upper, lower, c)
            if last:
                exact = ((v - c.at[own]) ** 2).sum(axis=1)
                more = np.stack([np.ones(len(v), np.int64), exact >> 31, exact & ((1 << 31) - 1)], axis=1)
            else:
                more = np.concatenate([np.ones((len(v), 1), np.int64), v], axis=1)
            order = np.argsort(own, kind="stable")
            first = np.nonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))[0]
            sums[own[order][first]] += np.add.reduceat(more[order], first, axis=0)
            none = pa.nulls(len(v), pa.list_(pa.int64()))
            told = [pa.array(own.astype(np.int32)), none]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *told, pa.array(exact)] if last else [batch.column("vec_id"), *told, batch.column("v"), pa.array(upper), pa.array(lower)], names=["vec_id", "cluster", "sums", "distance"] if last else ["vec_id", "cluster", "sums", "v", "upper", "lower"])
        if kind is not None and sums[:, 0].any():
            of = np.nonzero(sums[:, 0])[0]
            head = [pa.nulls(len(of), kind), pa.array(of.astype(np.int32)), pa.array(sums[of].tolist(), pa.list_(pa.int64()))]
            tail = {"distance": pa.int64()} if last else {"v": pa.list_(pa.int32()), "upper": pa.float64(), "lower": pa.float64()}
            yield pa.RecordBatch.from_arrays([*head, *[pa.nulls(len(of), t) for t in tail.values()]], names=["vec_id", "cluster", "sums", *tail])

    return run


def integers(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the rows with exactly dims finite components, as integers."""
    x = F.col(vector_col).cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    held = lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")
    return vectors.filter(F.col(vector_col).isNotNull() & (F.size(x) == dims) & F.forall(x, finite)).select(F.col(id_col).alias("vec_id"), F.transform(x, held).alias("v"))


def exponion_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """One row per vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly dims components, none null, NaN or infinite; a null or short
    vector has no row. Components become floor(scale * x), held between -2**27 and 2**27. The
    first centroids are the k vectors with the smallest hash of ``seed:id`` (a null id is
    empty; rows that share an id go by their components); with fewer than k vectors, all are.
    Rows that repeat count each. Ties in distance go to the smaller number; an empty cluster
    keeps its centroid. An inertia beyond a long is null. An empty table gives an empty
    result; other columns, whatever their names, are ignored. k is at most MOST_CENTROIDS.
    """
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"k must be from 1 to {MOST_CENTROIDS}: the centroids' distances to each other go to every task")
    spark = vectors.sparkSession
    tune(spark)
    kept = stage(integers(vectors, id_col, vector_col, dims, scale), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    at = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    kind = kept.schema["vec_id"].dataType
    own = [T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("sums", T.ArrayType(T.LongType()))]
    bounds = [T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())]

    def totals(state: DataFrame, width: int) -> dict[int, list[int]]:
        by = state.filter("sums is not null").groupBy("cluster").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        return {r["cluster"]: [int(r[f"s{i}"]) for i in range(width)] for r in by.collect()}  # k rows at most

    state, before = kept.select("vec_id", F.lit(-1).alias("cluster"), "v", F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")), None
    held = kept
    for _ in range(rounds):
        told = stage(state.mapInArrow(_round(Centroids(at, before), False), T.StructType(own + bounds)), "bounds")
        discard(held)
        held, before, at = told, at, at.copy()
        for c, (n, *sums) in totals(told, dims + 1).items():
            at[c] = [s // n for s in sums]
        state = told.filter("sums is null").select("vec_id", "cluster", "v", "upper", "lower")
    last = stage(state.mapInArrow(_round(Centroids(at, before), True), T.StructType([*own, T.StructField("distance", T.LongType())])), "clusters")
    discard(held)
    parts = {c: (high << 31) + low for c, (_, high, low) in totals(last, 3).items()}
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(c, fits(x), fits(sum(parts.values())), hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()) for c, x in sorted(parts.items())]
    known = spark.createDataFrame(rows, "number int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return last.filter("sums is null").join(F.broadcast(known), F.col("cluster") == F.col("number")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """DuckDB: every round over all vectors and centroids."""
    apart = "list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    out = f"""WITH x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM x ORDER BY h, v LIMIT {k}))"""
    for i in range(rounds + 1):
        out += f""",
a{i} AS (SELECT r, arg_min(c, [d, c]) AS c, min(d) AS d FROM (SELECT a.r, c.c, {apart} AS d FROM x a, c{i} c) GROUP BY r)"""
        if i < rounds:
            out += f""",
s{i} AS (SELECT c, j, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT a{i}.c, unnest(x.v) AS e, unnest(range({dims})) AS j FROM x JOIN a{i} USING (r)) GROUP BY c, j),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))"""
    return out + f"""
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN x USING (r) JOIN c{rounds} c ON a.c = c.c"""
