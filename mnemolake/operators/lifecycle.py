"""Skills, trials, policies, world models, timelines, exports."""

from __future__ import annotations

import base64
import math
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions.rules import ascii_edges
from mnemolake.functions.scoring import beta_posterior, success_rate
from mnemolake.session import ship


def skill_usage(trials: DataFrame, skill: str, newest: str, cap: int = 1000) -> DataFrame:
    """Over a skill's newest trials: used, last use, pending, attempted, passed, rate, mean."""
    w = W.partitionBy(skill).orderBy(F.desc(newest), F.desc("id"))
    t = trials.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    done = F.col("outcome").isin("pass", "fail")
    g = t.groupBy(skill).agg(F.count(F.lit(1)).alias("used"), F.max(newest).alias("last_used"), F.count(F.when(F.col("outcome") == "pending", 1)).alias("pending"), F.count(F.when(done, 1)).alias("attempted"), F.count(F.when(F.col("outcome") == "pass", 1)).alias("passed"))
    a, p = F.col("attempted"), F.col("passed")
    return g.withColumn("rate", success_rate(a, p)).withColumn("posterior", beta_posterior(a, p)["mean"])


def outcome_from_feedback(polarity: Column, magnitude: Column) -> Column:
    return F.when(magnitude > 0, F.when(polarity == "positive", "pass").when(polarity == "negative", "fail"))


def outcome_from_reward(r: Column, success: float = 0.5, failure: float = -0.15) -> Column:
    return F.when(r >= success, "pass").when(r <= failure, "fail").otherwise("unknown")


def trial_feedback(trials: DataFrame, feedback: DataFrame) -> DataFrame:
    """(trial_id, feedback_id): by the explicit id, else the newest of the same turn, else
    the newest of the same session and episode."""
    best = lambda keys: feedback.groupBy(*keys).agg(F.max_by("feedback_id", F.struct("at", "feedback_id")).alias("f"))
    t = trials.join(feedback.select(F.col("feedback_id").alias("asked"), F.col("feedback_id").alias("f1")), "asked", "left")
    t = t.join(best(["turn_id"]).withColumnRenamed("f", "f2"), "turn_id", "left").join(best(["session_id", "episode_id"]).withColumnRenamed("f", "f3"), ["session_id", "episode_id"], "left")
    return t.select("trial_id", F.coalesce("f1", "f2", "f3").alias("feedback_id"))


def tool_outcomes(calls: DataFrame, group: str, order: str, tool: str, ok: str) -> DataFrame:
    """Calls, failures and the last call of a group, which decides."""
    return calls.groupBy(group).agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(~F.col(ok), 1)).alias("failed"), F.max_by(F.struct(tool, ok), order).alias("z")).select(group, "calls", "failed", F.col(f"z.{tool}").alias("last_tool"), F.when(F.col(f"z.{ok}"), "success").otherwise("failure").alias("outcome"))


def value_contrast(traces: DataFrame, key: str, recency: str, value: str, limit: int = 3, high: float = 0.5, low: float = 0.0) -> DataFrame:
    """Per signature the first `limit` high and low traces by recency, numbered by value."""
    side = F.when(F.col(value) >= high, "high").when(F.col(value) <= low, "low")
    w = W.partitionBy(key, "side").orderBy(F.desc(recency), "id")
    first = traces.withColumn("side", side).filter("side is not null").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
    return first.withColumn("place", F.row_number().over(W.partitionBy(key, "side").orderBy(F.desc(value), "id")))


def reward_gate(turns: DataFrame, group: str, role: str, text: str, min_turns: int = 2, min_chars: int = 40, min_distinct: float = 0.4) -> DataFrame:
    """Why an episode gets no reward: too few turns, too little text, too much repetition."""
    g = turns.groupBy(group).agg(F.count(F.when(F.col(role) == "user", 1)).alias("user_turns"), F.sum(F.length(text)).alias("chars"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower(F.trim(text))).alias("kinds"))
    reason = F.when(F.col("user_turns") < min_turns, "few_turns").when(F.col("chars") < min_chars, "little_text").when(F.col("kinds") / F.col("n") < min_distinct, "repetitive").otherwise("")
    return g.select(group, "user_turns", "chars", reason.alias("skip"))


def merge_entries(entries: DataFrame, group: str, key: str, order: str, most: int = 24) -> DataFrame:
    """Last value per key, in the order of first sight, cut at most."""
    one = entries.groupBy(group, key).agg(F.min(order).alias("_first"), F.max_by("value", order).alias("value"))
    w = W.partitionBy(group).orderBy("_first")
    return one.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("_first")


def overlap(a: Column, b: Column) -> Column:
    """Shared over the smaller set."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def timeline(items: DataFrame, episode: str, at: str, limit: int, cursor: int = 0) -> DataFrame:
    """A slice of each episode's items, oldest first."""
    w = W.partitionBy(episode).orderBy(at, "id")
    return items.withColumn("place", F.row_number().over(w) - 1).filter((F.col("place") >= cursor) & (F.col("place") < cursor + limit))


def refs(rows: DataFrame, links: DataFrame, ident: str, link: str, target: str, cap: int) -> DataFrame:
    """(id, n, refs): up to cap link targets, in order."""
    w = W.partitionBy(link).orderBy(target)
    few = links.select(link, target).distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    g = few.groupBy(F.col(link).alias("_l")).agg(F.array_join(F.array_sort(F.collect_list(target)), ",").alias("refs"), F.count(F.lit(1)).alias("n"))
    return rows.select(ident).join(g, F.col(ident) == F.col("_l"), "left").select(ident, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("refs", F.lit("")).alias("refs"))


def redact_bundle(turns: DataFrame, columns: list[str]) -> DataFrame:
    return turns.withColumns({c: F.lit(None).cast(turns.schema[c].dataType) for c in columns})


def _packed(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: base64.b64encode(struct.pack(f"<{len(v)}f", *v)).decode())


def _unpacked(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: list(struct.unpack(f"<{len(base64.b64decode(t)) // 4}f", base64.b64decode(t))))


def packed_vector(vector: Column) -> Column:
    """Little-endian float32, base64."""
    ship()
    return F.pandas_udf(_packed, "string")(vector)


def unpacked_vector(text: Column) -> Column:
    ship()
    return F.pandas_udf(_unpacked, "array<float>")(text)


def packed_evidence(traces: DataFrame, group: str, order: str, text: str, most: int) -> DataFrame:
    """Texts in order until the budget; the block at its end is cut."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    room = most - F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return traces.withColumn("room", room).filter("room > 0").withColumn("part", F.substring(F.col(text), F.lit(1), F.col("room").cast("int"))).drop("room")


def gain_reference(evidence: DataFrame, traces: DataFrame, newest: str, window: int = 2000) -> DataFrame:
    """The evidence, and of the newest traces those of the same episodes, once each."""
    pool = traces.orderBy(F.desc(newest), F.desc("id")).limit(window)
    same = pool.join(evidence.select("episode_id").distinct(), "episode_id", "left_semi")
    return evidence.select("id").unionByName(same.select("id")).distinct()


def world_clusters(policies: DataFrame, key: str, min_policies: int = 1, min_similarity: float = 0.3) -> DataFrame:
    """Policies (id, key, gain, vec) gathered by domain: how they cohere around their
    centroid, whether those near it suffice (strict) or all are taken (loose), and the
    confidence of the model that comes of it."""
    from mnemolake.functions.scoring import clamp01, world_confidence
    from mnemolake.functions.vector import centroids, cosine

    c = centroids(policies, key, "vec", "id").withColumnRenamed("centroid", "_c")
    p = policies.join(F.broadcast(c), key, "left").withColumn("sim", F.when(F.size("vec") > 0, cosine(F.col("_c"), F.col("vec"))))
    near = F.col("sim").isNull() | (F.col("sim") >= min_similarity)
    g = p.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(near, 1)).alias("strict"), F.coalesce(F.avg("sim"), F.lit(0.0)).alias("cohesion"), F.avg(F.when(near, F.col("gain"))).alias("g1"), F.avg("gain").alias("g2")).filter(F.col("n") >= min_policies)
    admission = F.when(F.col("strict") >= min_policies, "strict").otherwise("loose")
    gain = F.when(admission == "strict", F.col("g1")).otherwise(F.col("g2"))
    return g.select(key, "n", "strict", "cohesion", admission.alias("admission"), world_confidence(clamp01(gain * 0.7 + F.col("cohesion") * 0.3), admission, F.col("cohesion")).alias("confidence"))


def overlaps(items: DataFrame, wide: int = 1024) -> DataFrame:
    """(a, b, score) of keys that share an item: shared items over the smaller set. items: key,
    item; repeats count once, a null item counts for its set's size alone.

    Where there are ``wide`` items or fewer, a set is a row of bits, and blocks of sets meet each
    other: a pair costs some operations on words, however many items it shares, and is made
    where it is told, without a shuffle of pairs. Else keys meet by their items."""
    held = items.filter("key is not null")
    names = [r["item"] for r in held.select("item").filter("item is not null").distinct().limit(wide + 1).collect()]
    return _met_by_items(held) if len(names) > wide else _met_by_bits(held, names)


def _met_by_items(items: DataFrame) -> DataFrame:
    t = items.distinct()
    n = t.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # few rows, but many pairs an item: dealt to all tasks, which adaptive execution would merge
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = t.select(F.col("key").alias("a"), "item").repartition(parts, "item")
    y = t.select(F.col("key").alias("b"), "item").repartition(parts, "item")
    shared = x.join(y, "item").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(n.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", (F.col("shared") / F.least("na", "nb")).alias("score"))


def _met_by_bits(items: DataFrame, names: list, block: int = 4096) -> DataFrame:
    spark, words = items.sparkSession, max(1, -(-len(names) // 64))
    at = spark.range(1).select(F.posexplode(F.lit(names) if names else F.array()).alias("at", "_i")).select("at", F.col("_i").cast(items.schema["item"].dataType).alias("item"))
    placed = items.join(F.broadcast(at), "item", "left")
    word = lambda w: F.bit_or(F.when(F.shiftright("at", 6) == w, F.expr("shiftleft(1L, at % 64)")))
    sets = placed.groupBy("key").agg(*[F.coalesce(word(w), F.lit(0).cast("long")).alias(f"w{w}") for w in range(words)], F.max(F.col("item").isNull().cast("int")).alias("more"))
    sets = sets.withColumn("n", sum((F.bit_count(f"w{w}") for w in range(words)), F.col("more"))).drop("more")
    # blocks of bounded size, and enough pairs of them for all tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-items.agg(F.approx_count_distinct("key")).first()[0] // block), math.ceil(math.sqrt(2 * parts)))
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    groups = blocks * (blocks + 1) // 2
    side = lambda s, p, q: sets.select(*[F.col(c).alias(f"{s}_{c}") for c in sets.columns], p.alias("p"), q.alias("q")).repartition(min(groups, 8192), "p", "q")
    x = side("x", own, F.explode(F.sequence(own, F.lit(blocks - 1))))
    y = side("y", F.explode(F.sequence(F.lit(0), own)), own)
    shared = sum((F.bit_count(F.col(f"x_w{w}").bitwiseAND(F.col(f"y_w{w}"))) for w in range(1, words)), F.bit_count(F.col("x_w0").bitwiseAND(F.col("y_w0"))))
    pairs = x.join(y, ["p", "q"]).filter("p < q or x_key < y_key")
    told = pairs.select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b"), shared.alias("shared"), F.least("x_n", "y_n").alias("n"))
    return told.filter("shared > 0").select("a", "b", (F.col("shared") / F.col("n")).alias("score"))


def merge_target(drafts: DataFrame, models: DataFrame, min_overlap: float = 0.6) -> DataFrame:
    """(key, model): the model of the same key, else the one whose policies overlap most.
    Equal sets of policies are one class: of a class's models the best stands for all, and a
    class of drafts looks once. Classes meet by a shared policy, so no pair without one is made."""
    exact = drafts.select("key").join(models.select(F.col("key"), F.col("id").alias("exact")), "key", "left")
    own = F.array_sort(F.array_distinct("policy_ids")).alias("set")
    wanted = drafts.select("key", own).withColumn("dn", F.size("set"))
    held = models.select(own, "id", "confidence").groupBy("set").agg(F.max_by(F.struct("id", "confidence"), F.struct("confidence", -F.col("id"))).alias("m"))
    d = wanted.select("set", "dn").distinct().select(F.col("set").alias("dp"), "dn", F.explode("set").alias("p"))
    m = held.select("m.id", "m.confidence", F.size("set").alias("mn"), F.explode("set").alias("p"))
    shared = d.join(m, "p").groupBy("dp", "dn", "id", "confidence", "mn").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.withColumn("score", F.col("shared") / F.least("mn", "dn")).filter(F.col("score") >= min_overlap)
    best = scored.groupBy("dp").agg(F.max(F.struct("score", "shared", "confidence", (-F.col("id")).alias("less"), "id")).alias("best"))
    near = wanted.join(best, F.col("set") == F.col("dp")).groupBy("key").agg(F.max("best")["id"].alias("near"))
    return exact.join(near, "key", "left").select("key", F.coalesce("exact", "near").alias("model"))


def task_candidates(queries: DataFrame, group: str, score: str, at: str, least: float = 3, most: int = 4) -> DataFrame:
    """Groups by their best score and up to three for their size; strong ones only."""
    g = queries.groupBy(group).agg(F.max(score).alias("s"), F.count(F.lit(1)).alias("n"), F.max(at).alias("latest"))
    return g.filter(F.col("s") >= least).select(group, (F.col("s") + F.least("n", F.lit(3))).alias("score"), "latest").orderBy(F.desc("score"), F.desc("latest"), group).limit(most)


def pattern_counts(texts: DataFrame, text: str, patterns: dict[str, str], most: int = 8) -> DataFrame:
    """How many texts each pattern is found in, letters of either case and edges of words as in
    ASCII, in one pass; the most frequent first."""
    flags = F.array_compact(F.array(*[F.when(F.col(text).rlike("(?i)" + ascii_edges(p)), k) for k, p in patterns.items()]))
    return texts.select(F.explode(flags).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)
