"""Hybrid retrieval: routes, ranks, fusion, caps, rollups, diversity.

Candidates are rows (query_id, id, tier, layer, channel, raw, ...): every step is a
window or an aggregate by query, so many queries run in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions.vector import cosine, dot, normalized
from mnemolake.operators import ranges as R

TEXT_CHANNELS = ("fts", "pattern", "structural")
#: Pool caps by tier, the fusion constant, floors, the diversity weight.
CAPS = {"tier1": 12, "tier2": 20, "tier3": 8}
RRF, FLOOR, MIN_SCORE, LAMBDA, SEED_RATIO = 60, 0.2, 0.2, 0.7, 0.7
#: Hits that a route hands on of a layer (vec: by layer); no window holds more of a tier than ROUTE_LIMIT.
ROUTE_CAPS = {"fts": 20, "pattern": 20, "structural": 10}
VECTOR_CAPS = {"Skill": 12, "L1": 20, "L2": 20, "L3": 8}
ROUTE_LIMIT = 500


def vector_topk(vectors: DataFrame, query: Column, ident: str, vector: str, k: int, newest: str | None = None, window: int = 2000) -> DataFrame:
    """The k nearest by exact cosine, of the newest `window` rows if newest is given: the
    limit comes before the scores, as it changes the answer."""
    pool = vectors.orderBy(F.desc(newest), F.desc(ident)).limit(window) if newest else vectors
    return pool.filter(F.size(vector) == F.size(query)).withColumn("score", cosine(F.col(vector), query)).orderBy(F.desc("score"), ident).limit(k)


def best_match(left: DataFrame, right: DataFrame, score: Column, left_id: str, right_id: str, floor: float) -> DataFrame:
    """For each left row the right row of the highest score, if it reaches floor; the first
    right id wins ties. right is a small table (policies), whose size decides the join."""
    scored = left.crossJoin(right).withColumn("score", score)
    best = scored.groupBy(left_id).agg(F.max_by(F.struct(right_id, "score"), F.struct(F.col("score"), -F.col(right_id))).alias("b"))
    return best.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.score").alias("score")).filter(F.col("score") >= floor)


def postings(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, term, tf): the inverted index."""
    words = docs.select(ident, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("term")).filter("term <> ''")
    return words.groupBy(ident, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, ident: str, text: str, asked: Sequence[str], at_least: int = 1, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, hits, bm25) of documents with at least so many of the asked terms. Document
    frequencies and lengths are those of the whole index. Only asked terms' postings
    leave the scan."""
    terms = list(dict.fromkeys(t.lower() for t in asked))
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    sized = docs.select(ident, F.size(words).alias("len"), F.filter(words, lambda t: t.isin(terms)).alias("found"))
    whole = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))
    tf = sized.filter(F.size("found") > 0).select(ident, "len", F.explode("found").alias("term")).groupBy(ident, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count("tf").alias("df"))  # over all of tf's columns, so that its shuffle is reused
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    joined = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole))
    return joined.groupBy(ident).agg(F.count(F.lit(1)).alias("hits"), F.sum(part).alias("bm25")).filter(F.col("hits") >= at_least)


def rank_score(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The first rows by order, scored 1 / (place)."""
    top = df.orderBy(*order).offset(offset).limit(limit)
    return top.withColumn("score", 1 / (offset + F.row_number().over(W.partitionBy().orderBy(*order))))


def text_routes(memories: DataFrame, **scores: Column) -> DataFrame:
    """(query_id, id, channel, raw) of the channels whose score is positive: one pass over the
    texts, whatever the number of channels."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), x.cast("double").alias("raw")) for c, x in scores.items()]))
    return memories.select(F.lit(1).cast("long").alias("query_id"), "id", each.alias("r")).select("query_id", "id", "r.channel", "r.raw").filter("raw > 0")


def union_routes(*routes: DataFrame) -> DataFrame:
    """Best score per (query, id, channel)."""
    out = routes[0]
    for r in routes[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.groupBy("query_id", "id", "channel").agg(F.max("raw").alias("raw"))


def routed(hits: DataFrame, scale: int = 1) -> DataFrame:
    """The best hits of each query, layer and channel, ``scale`` times as many as the caps say;
    tasks cut theirs before the shuffle."""
    cap = F.lit(max(VECTOR_CAPS.values()))
    for layer, n in VECTOR_CAPS.items():
        cap = F.when(F.col("layer") == layer, n).otherwise(cap)
    for channel, n in ROUTE_CAPS.items():
        cap = F.when(F.col("channel") == channel, n).otherwise(cap)
    w = W.partitionBy("query_id", "layer", "channel").orderBy(F.desc("raw"), "id")
    most = scale * max(*ROUTE_CAPS.values(), *VECTOR_CAPS.values())
    return hits.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= most) & (F.col("_n") <= cap * scale)).drop("_n")


def channel_ranks(hits: DataFrame, most: int = ROUTE_LIMIT) -> DataFrame:
    """rank from 0 within query, tier and channel by raw score, of the best ``most``: a top-k
    that tasks cut before the shuffle. Text channels are then scored by rank."""
    w = W.partitionBy("query_id", "tier", "channel").orderBy(F.desc("raw"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).withColumn("rank", F.col("rank") - 1)
    return _by_rank(ranked)


def all_ranks(hits: DataFrame, path: str) -> DataFrame:
    """channel_ranks of every hit. Hits are sorted by ranges into a Parquet table at path, a new
    folder that driver and executors share, and numbered within their range by counts of
    the ranges before it, so no task holds a tier's hits of a channel."""
    keys = ["query_id", "tier", "channel"]
    hits.repartitionByRange(*keys, F.desc("raw"), "id").withColumn("range", F.spark_partition_id()).write.parquet(path)
    stored = hits.sparkSession.read.parquet(path)
    return _by_rank(R.numbered(stored, keys, [F.desc("raw"), "id"], "rank").drop("range"))


def _by_rank(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("score", F.when(F.col("channel").isin(*TEXT_CHANNELS), 1 / (F.col("rank") + 1)).otherwise(F.col("raw")))


def fused(ranked: DataFrame, bonus: Column, keep: Sequence[str] = ("tier", "layer")) -> DataFrame:
    """A row per candidate: relevance (best channel and bonus), rrf, channels."""
    g = ranked.groupBy("query_id", "id", *keep).agg(F.max(F.greatest("score", F.lit(0.0))).alias("best"), F.sum(1 / (F.lit(RRF + 1) + F.col("rank"))).alias("rrf"), F.count_distinct("channel").alias("channels"), F.max(F.when(F.col("channel").startswith("vec"), F.col("raw")).otherwise(0.0)).alias("vector_score"), F.max(F.col("channel").isin(*TEXT_CHANNELS)).alias("keyword"))
    return g.withColumn("relevance", F.col("best") + bonus)


def capped(candidates: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The best of each tier by relevance, channels, vector score."""
    cap, most = F.lit(0), max((caps or CAPS).values())
    for tier, n in (caps or CAPS).items():
        cap = F.when(F.col("tier") == tier, n).otherwise(cap)
    w = W.partitionBy("query_id", "tier").orderBy(F.desc("relevance"), F.desc("channels"), F.desc("vector_score"), "id")
    return candidates.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= most) & (F.col("_n") <= cap)).drop("_n")


def thresholded(candidates: DataFrame, floor: float = FLOOR, bypass: bool = True) -> DataFrame:
    """relevance gains 0.4 rrf; rows under floor of the query's best go, unless two
    channels found them."""
    c = candidates.withColumn("relevance", F.col("relevance") + 0.4 * F.col("rrf"))
    top = F.max("relevance").over(W.partitionBy("query_id"))
    return c.withColumn("_cut", top * floor).filter((F.col("relevance") >= F.col("_cut")) | (F.lit(bypass) & (F.col("channels") >= 2))).drop("_cut")


def episode_rollups(candidates: DataFrame, top: int = 5, min_sim: float = 0.45) -> DataFrame:
    """Episodes with two or more of the query's top traces, whose best trace by value is
    similar enough and not negative. Needs episode_id and value."""
    w = W.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc("channels"), F.desc("vector_score"), "id")
    best = candidates.filter("layer = 'L1' and episode_id is not null").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top)
    g = best.groupBy("query_id", "episode_id").agg(F.count_distinct("id").alias("traces"), F.max_by(F.struct("id", "vector_score", "value"), F.struct("value", "vector_score")).alias("r"), F.max("best").alias("best"), F.max("value").alias("max_value"))
    return g.filter((F.col("traces") >= 2) & (F.col("r.vector_score") >= min_sim) & (F.col("r.value") >= 0)).select("query_id", "episode_id", "traces", F.col("r.id").alias("representative"), F.greatest("best", "r.vector_score").alias("best"), "max_value")


def without_covered_traces(candidates: DataFrame, episodes: DataFrame) -> DataFrame:
    """An episode always beats its own traces."""
    e = episodes.select(F.col("query_id").alias("_q"), F.col("episode_id").alias("_e"))
    return candidates.join(e, (F.col("query_id") == F.col("_q")) & (F.col("episode_id") == F.col("_e")), "left_anti")


def without_covered_policies(policies: DataFrame, skills: DataFrame) -> DataFrame:
    """Drops policies that the last skill citing them (by ord) is at least as new as."""
    cited = skills.select(F.explode("policy_ids").alias("_p"), "ord", "updated_at").groupBy("_p").agg(F.max_by("updated_at", "ord").alias("_at"))
    return policies.join(cited, F.col("id") == F.col("_p"), "left").filter(F.col("_p").isNull() | (F.col("updated_at") > F.col("_at"))).drop("_p", "_at")


def span_cap(hits: DataFrame, trace: str, is_span: str, score: str, most: int = 2) -> DataFrame:
    """Traces with a span among the hits go; of the spans of a trace the best stay."""
    w = W.partitionBy("query_id", trace)
    best = W.partitionBy("query_id", trace, is_span).orderBy(F.desc(score), "id")
    covered = hits.withColumn("_has", F.max(F.col(is_span).cast("int")).over(w)).withColumn("_n", F.row_number().over(best))
    return covered.filter((F.col(is_span) & (F.col("_n") <= most)) | (~F.col(is_span) & (F.col("_has") == 0))).drop("_has", "_n")


def fuse_queries(hits: DataFrame, limit: int, constant: int = 8) -> DataFrame:
    """Hits (query_id, id, rank from 0) of rewritten queries: reserved slots of each
    query first, then by reciprocal rank."""
    n = hits.agg(F.count_distinct("query_id").alias("_q"))
    reserve = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_q"))))
    g = hits.crossJoin(F.broadcast(n)).withColumn("_r", reserve).groupBy("id").agg(F.sum(1 / (constant + 1 + F.col("rank"))).alias("rrf"), F.max(F.col("rank") < F.col("_r")).alias("reserved"), F.min("rank").alias("best_rank"))
    return g.orderBy(F.desc("reserved"), F.desc("rrf"), "id").limit(limit)


def mmr(candidates: DataFrame, limit: int = 8, lam: float = LAMBDA, seed_ratio: float = SEED_RATIO) -> DataFrame:
    """(query_id, id, tier, rrf, score, place): greedy choice by relevance less redundancy, one
    seed per good tier first. A query's pool is capped before (capped()); the choice is a fold
    over it: each step takes the best row left, and then knows for every other row its largest
    similarity to what is chosen."""
    unit = F.when(F.col("vector").isNotNull(), normalized(F.col("vector")))
    row = F.struct((-F.col("relevance")).alias("less"), "id", "tier", "rrf", "relevance", unit.alias("vector"))
    pool = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    rows, zero = F.col("rows"), F.lit(0.0)
    at = lambda i: F.get(rows, i)
    bound = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  (value is made once)
    cut = at(F.lit(0))["relevance"] * seed_ratio
    start = F.struct(F.array().cast("array<int>").alias("chosen"), F.array().cast("array<double>").alias("scores"), F.lit(False).alias("seen"), F.transform(rows, lambda r: zero).alias("far"))

    def step(state: Column, k: Column) -> Column:
        def score(i: Column) -> Column:
            rel = at(i)["relevance"]
            return F.when(state["seen"], lam * rel - (1 - lam) * F.get(state["far"], i)).otherwise(rel)

        def after(best: Column, vector: Column) -> Column:
            same = lambda r: F.when(F.size(r["vector"]) == F.size(vector), dot(r["vector"], vector)).otherwise(0.0)
            near = lambda r, f: F.when(r["vector"].isNull(), f).when(state["seen"], F.greatest(f, same(r))).otherwise(same(r))
            far = F.when(vector.isNull(), state["far"]).otherwise(F.zip_with(rows, state["far"], near))
            return F.struct(F.concat(state["chosen"], F.array((-best["i"]).cast("int"))).alias("chosen"), F.concat(state["scores"], F.array(best["score"])).alias("scores"), (state["seen"] | vector.isNotNull()).alias("seen"), far.alias("far"))

        seed = F.when(k == 0, "tier1").when(k == 1, "tier2").otherwise("tier3")
        free = lambda i: ~F.array_contains(state["chosen"], i) & ((k >= 3) | ((at(i)["tier"] == seed) & (at(i)["relevance"] >= cut)))
        left = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), free)
        found = F.array_max(F.transform(left, lambda i: F.struct(score(i).alias("score"), (-i).alias("i"))))
        taken = bound(found, lambda best: F.when(best.isNull(), state).otherwise(bound(at(-best["i"])["vector"], lambda v: after(best, v))))
        return F.when(F.size(state["chosen"]) >= limit, state).otherwise(taken)

    told = pool.withColumn("end", F.aggregate(F.sequence(F.lit(0), F.lit(limit + 2)), start, step))
    line = F.transform(F.arrays_zip("end.chosen", "end.scores"), lambda c, n: F.struct((-c["scores"]).alias("less"), (-at(c["chosen"])["rrf"]).alias("less_rrf"), n.alias("n"), at(c["chosen"])["id"].alias("id"), at(c["chosen"])["tier"].alias("tier"), at(c["chosen"])["rrf"].alias("rrf"), c["scores"].alias("score")))
    return told.select("query_id", F.posexplode(F.array_sort(line)).alias("place", "c")).select("query_id", "c.id", "c.tier", "c.rrf", "c.score", F.col("place").cast("long").alias("place"))
