"""Conversations, turns, episodes: splitting, completeness, windows, idleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.operators import ranges as R


def split_turns(df: DataFrame, conv: str, order: str, role: str) -> DataFrame:
    """turn_no: a new turn at every user message; messages before the first user's form
    a turn of their own."""
    w = W.partitionBy(conv).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    opened = F.sum((F.col(role) == "user").cast("int")).over(w) - (F.first(role).over(w) == "user").cast("int")
    return df.withColumn("turn_no", F.greatest(opened, F.lit(0)).cast("long"))


def complete_turns(turns: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """One row per turn; complete: a user's message first, an assistant's last, neither blank."""
    ends = turns.groupBy(conv, "turn_no").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(role, text), order).alias("a"), F.max_by(F.struct(role, text), order).alias("z"), F.min(order).alias("first_at"))
    full = lambda s: F.trim(F.coalesce(F.col(f"{s}.{text}"), F.lit(""))) != ""
    return ends.withColumn("complete", (F.col(f"a.{role}") == "user") & (F.col(f"z.{role}") == "assistant") & full("a") & full("z")).drop("a", "z")


def dedup_key(source: str, message: Column) -> Column:
    return F.sha2(F.concat(F.lit(source + "::"), message), 256)


def stable_turn_id(source: str, identity: Column) -> Column:
    return F.concat(F.lit(source + ":"), F.substring(F.sha2(identity, 256), 1, 24))


def conversation_window(df: DataFrame, conv: str, order: str, at: str, since: object, most: int | None) -> DataFrame:
    """Whole conversations with a message at or after since; in order of first message,
    as many as stay within most messages, the first always. Sums run over one row per
    conversation."""
    per = df.groupBy(conv).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"), F.max(at).alias("_last")).filter(F.col("_last") >= F.lit(since))
    if most is not None:
        w = W.partitionBy().orderBy("_first", conv)
        # each has a message at least, so no more than the first `most` can fit: a top-k before the sum
        per = per.orderBy("_first", conv).limit(max(most, 1)).withColumn("_sum", F.sum("_n").over(w)).withColumn("_k", F.row_number().over(w)).filter((F.col("_sum") <= most) | (F.col("_k") == 1))
    return df.join(per.select(conv), conv, "left_semi")


def checkpoint_filter(convs: DataFrame, checkpoints: DataFrame, conv: str) -> DataFrame:
    """Conversations whose newest message or content hash differs from the checkpoint."""
    known = checkpoints.select(F.col(conv).alias("_c"), F.col("last_turn").alias("_t"), F.col("content_hash").alias("_h"))
    return convs.join(known, F.col(conv) == F.col("_c"), "left").filter(F.col("_c").isNull() | (F.col("last_turn") > F.col("_t")) | (F.col("content_hash") != F.col("_h"))).drop("_c", "_t", "_h")


def checkpoints_of(df: DataFrame, conv: str, order: str, text: str) -> DataFrame:
    """Newest message and a hash of all, per conversation."""
    return df.groupBy(conv).agg(F.max(order).alias("last_turn"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: s["t"]), "\n")).alias("content_hash"))


def idle_groups(df: DataFrame, group: str, at: str, before: object) -> DataFrame:
    """Groups whose latest activity lies before the given time."""
    return df.groupBy(group).agg(F.max(at).alias("last_at")).filter(F.col("last_at") < F.lit(before))


def credit(df: DataFrame, group: str, order: list[str], alpha: str, reward: Column, gamma: float = 0.9, lam: float = 0.5, delta: float = 0.1, range_col: str | None = None) -> DataFrame:
    """value: the reward's share of each trace of a group: alpha, more for later ones and
    for a recovery after an alpha of 0, normalised over the group. Where df says in
    range_col which stretch of the group's order a row is in, no task orders a whole group."""
    boost = F.when((F.col(alpha) > 0) & (F.col("_was") == 0), 1 + delta).otherwise(1.0)
    weight = F.col(alpha) * ((1 - lam) + lam * F.pow(F.lit(gamma), F.col("_n") - 1 - F.col("_i"))) * boost
    if range_col is None:
        w, whole = W.partitionBy(group).orderBy(*order), W.partitionBy(group)
        out = df.withColumns({"_i": F.row_number().over(w) - 1, "_was": F.lag(alpha).over(w), "_n": F.count(F.lit(1)).over(whole)}).withColumn("_w", weight).withColumn("_total", F.sum("_w").over(whole))
    else:
        out = R.previous(R.numbered(df, [group], order, "_i", range_col), [group], order, {"_was": F.col(alpha)}, range_col)
        out = R.beside(out, df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), [group]).withColumn("_w", weight)
        out = R.beside(out, out.groupBy(group).agg(F.sum("_w").alias("_total")), [group])
    return out.withColumn("value", F.when(F.col("_total") > 0, F.col("_w") / F.col("_total") * reward).otherwise(0.0)).drop("_w", "_n", "_i", "_was", "_total")


def failure_bursts(df: DataFrame, key: str, step: str, failed: str, window: int = 5, most: int = 3, rows: int = R.ROWS) -> DataFrame:
    """Failures at which the last `window` steps of the key hold at least `most` failures
    and no success. A key of more than `rows` steps is dealt to several tasks by ranges of
    steps, each with the last steps before it."""
    own = R.dealt(df, key, step, rows, reach=window - 1, range_col="_range")
    w = W.partitionBy(key, "_range").orderBy(step).rangeBetween(-(window - 1), 0)
    bad, good = F.sum(F.col(failed).cast("int")).over(w), F.sum((~F.col(failed)).cast("int")).over(w)
    told = own.withColumn("failures", bad).withColumn("_good", good)
    return told.filter(~F.col("_halo") & F.col(failed) & (F.col("failures") >= most) & (F.col("_good") == 0)).drop("_good", "_range", "_halo")


def reflection_windows(df: DataFrame, group: str, n: str, size: int = 6, overlap: int = 1) -> DataFrame:
    """(group, start, end) of overlapping windows over n rows, the last one cut short."""
    stride = max(1, size - overlap)
    last = F.greatest(F.ceil((F.col(n) - size) / stride), F.lit(0)).cast("int")
    return df.filter(F.col(n) > 0).select(group, n, F.explode(F.sequence(F.lit(0), last)).alias("k")).select(group, (F.col("k") * stride).alias("start"), F.least(F.col("k") * stride + size, F.col(n)).alias("end"))


def merge_windows(scores: DataFrame, group: str, idx: str, rank: str, start: str) -> DataFrame:
    """Of a row's scores the best rank, and of those the earliest window."""
    w = W.partitionBy(group, idx).orderBy(F.desc(rank), start)
    return scores.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def balanced_sample(df: DataFrame, source: str, recency: str, ident: str, limit: int) -> DataFrame:
    """Round robin over sources, newest first, until limit rows."""
    w = W.partitionBy(source).orderBy(F.desc(recency), ident)
    return df.withColumn("turn_in", F.row_number().over(w)).orderBy("turn_in", source).limit(limit)


def incremental_turns(df: DataFrame, conv: str, order: str, role: str, text: str, at: str, boundary: object) -> DataFrame:
    """Messages of complete turns that begin after the boundary; what precedes a
    conversation's first user message belongs to no turn."""
    t = split_turns(df, conv, order, role)
    whole = complete_turns(t, conv, order, role, text).filter("complete").select(F.col(conv).alias("_c"), F.col("turn_no").alias("_t"))
    began = t.groupBy(F.col(conv).alias("_c2"), F.col("turn_no").alias("_t2")).agg(F.min(at).alias("_at")).filter(F.col("_at") > F.lit(boundary))
    kept = t.join(whole, (F.col(conv) == F.col("_c")) & (F.col("turn_no") == F.col("_t")), "left_semi")
    return kept.join(began, (F.col(conv) == F.col("_c2")) & (F.col("turn_no") == F.col("_t2")), "left_semi")


def latest_episode(df: DataFrame, session: str) -> DataFrame:
    """Open before processing before closed; newest update, newest opening, last inserted."""
    rank = F.when(F.col("status") == "open", 0).when(F.col("status") == "processing", 1).otherwise(2)
    w = W.partitionBy(session).orderBy(rank, F.desc("updated_at"), F.desc("opened_at"), F.desc("ord"))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def appended_turns(turns: DataFrame, episode: str, raw: str, memory: str, order: str) -> DataFrame:
    """Per episode the distinct raw turns and memories, in order of first sight."""
    seen = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda s: s["v"]))
    return turns.groupBy(episode).agg(seen(raw).alias("raw_turn_ids"), seen(memory).alias("memory_ids")).withColumn("turn_count", F.size("raw_turn_ids"))


def closed(episodes: DataFrame, which: Column, now: Column) -> DataFrame:
    """Closes episodes; ones that are closed keep their time."""
    end = which & (F.col("status") != "closed")
    return episodes.withColumns({"closed_at": F.when(which, F.coalesce("closed_at", now)).otherwise(F.col("closed_at")), "status": F.when(end, "closed").otherwise(F.col("status"))})


def reopened(episodes: DataFrame, which: Column) -> DataFrame:
    """Opens episodes again: no close time, no reward."""
    null = lambda c: F.when(which, None).otherwise(F.col(c))
    return episodes.withColumns({"status": F.when(which, "open").otherwise(F.col("status")), "closed_at": null("closed_at"), "r_task": null("r_task")})


def has_matching_turn(episodes: DataFrame, turns: DataFrame, episode: str, own: Column, text: str, query: str) -> DataFrame:
    """Episodes that hold the query themselves or in one of their turns."""
    hit = turns.filter(F.contains(F.lower(text), F.lit(query.strip().lower()))).select(F.col(episode).alias("_e")).distinct()
    return episodes.join(hit, F.col(episode) == F.col("_e"), "left").filter(F.contains(F.lower(own), F.lit(query.strip().lower())) | F.col("_e").isNotNull()).drop("_e")
