"""Counts, series, latencies, rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts_of(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """(key, n) for each of the given keys, 0 where there is no row."""
    fixed = df.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    seen = df.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return fixed.join(seen, F.col("key") == F.col("k"), "left").select("key", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def day_list(df: DataFrame, last: str, days: int) -> DataFrame:
    """One row (date) for each of the days that end with last."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))).alias("date"))


def local_day(ts: Column, offset_minutes: int = 0) -> Column:
    """The date at a fixed offset, resolved once and not per instant."""
    return (ts + F.expr(f"interval {offset_minutes} minutes")).cast("date")


def daily_counts(df: DataFrame, ts: str, last: str, days: int, offset_minutes: int = 0) -> DataFrame:
    seen = df.groupBy(local_day(F.col(ts), offset_minutes).alias("day")).agg(F.count(F.lit(1)).alias("c"))
    return day_list(df, last, days).join(seen, F.col("date") == F.col("day"), "left").select(F.col("date").cast("string").alias("date"), F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts, and percents to one decimal of the exact double."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percentage", F.round(F.col("n") / F.sum("n").over(W.partitionBy()) * 100, 1))


def latency(df: DataFrame, tool: str, ms: str) -> DataFrame:
    """Calls, rounded mean and nearest-rank 95th percentile per tool."""
    d = F.greatest(F.floor(F.col(ms) + 0.5), F.lit(0))
    return df.groupBy(F.col(tool).alias("name")).agg(F.count(F.lit(1)).alias("calls"), F.floor(F.avg(d) + 0.5).cast("long").alias("avg_ms"), F.expr(f"percentile_disc(0.95) within group (order by greatest(floor({ms} + 0.5), 0))").cast("long").alias("p95_ms"))


def latency_series(df: DataFrame, tool: str, ms: str, ts: str, last: str, days: int) -> DataFrame:
    """Mean per tool and day, 0 for days without calls."""
    d = F.greatest(F.floor(F.col(ms) + 0.5), F.lit(0))
    seen = df.groupBy(F.col(tool).alias("t"), F.col(ts).cast("date").alias("d")).agg(F.floor(F.avg(d) + 0.5).cast("long").alias("m"))
    grid = df.select(F.col(tool).alias("name")).distinct().join(F.broadcast(day_list(df, last, days)))
    return grid.join(seen, (F.col("name") == F.col("t")) & (F.col("date") == F.col("d")), "left").select("name", F.col("date").cast("string").alias("date"), F.coalesce("m", F.lit(0)).cast("long").alias("avg_ms"))


def usage_rollup(df: DataFrame, provider: str, kind: str, model: str, tokens: str, ts: str) -> DataFrame:
    """Total, by kind, by provider and kind (without null providers), by all keys: one
    pass over grouping sets; grouping_id tells null keys from rolled-up ones."""
    df = df.select(F.col(provider).alias("provider"), F.col(kind).alias("kind"), F.col(model).alias("model"), F.col(tokens).alias("tokens"), F.col(ts).alias("ts"))
    sets = df.groupingSets([[], ["kind"], ["provider", "kind"], ["provider", "kind", "model"]], "provider", "kind", "model")
    out = sets.agg(F.grouping_id("provider", "kind", "model").cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("ts").alias("last_at"))
    return out.filter("level <> 1 or provider is not null")


def provider_rollup(df: DataFrame, provider: str, kind: str, tokens: str) -> DataFrame:
    """Per provider the sum, and its kinds as a sorted array."""
    one = df.filter(F.col(provider).isNotNull()).groupBy(provider, kind).agg(F.sum(tokens).alias("t"))
    return one.groupBy(F.col(provider).alias("provider")).agg(F.sum("t").alias("tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), "t"))), lambda s: F.concat_ws("=", s["k"], s["t"].cast("string"))), ",").alias("by_kind"))


def softmax_mean(df: DataFrame, group: str, value: str, tau: float) -> DataFrame:
    """Mean of values weighted by exp((v - max) / tau)."""
    top = df.groupBy(group).agg(F.max(value).alias("_top"))
    e = F.exp((F.col(value) - F.col("_top")) / max(tau, 1e-6))
    return df.join(top, group).groupBy(group).agg((F.sum(F.col(value) * e) / F.sum(e)).alias("weighted"))


def policy_gain(df: DataFrame, policy: str, used: str, value: str, tau: float = 0.5) -> DataFrame:
    """Mean of the traces with a policy (weighted, from three on) less the mean of those
    without, shrunk by five pseudo-rows at the clamped mean of the pool."""
    yes, v = F.col(used), F.col(value)
    top = df.groupBy(policy).agg(F.max(F.when(yes, v)).alias("_top"))
    e = F.when(yes, F.exp((v - F.col("_top")) / max(tau, 1e-6)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = df.join(top, policy).groupBy(policy).agg(
        F.count(F.when(yes, 1)).alias("n_with"), F.count(F.when(~yes, 1)).alias("n_without"), zero(F.avg(F.when(yes, v))).alias("with_mean"), zero(F.avg(F.when(~yes, v))).alias("without_mean"), zero(F.sum(v * e) / F.sum(e)).alias("weighted_with"), F.avg(v).alias("pool")
    )
    baseline = F.greatest(F.lit(0.2), F.least(F.lit(0.5), F.col("pool")))
    blended = (F.col("without_mean") * F.col("n_without") + baseline * 5) / (F.col("n_without") + 5)
    return g.withColumn("baseline", baseline).withColumn("gain", F.when(F.col("n_with") >= 3, F.col("weighted_with")).otherwise(F.col("with_mean")) - blended).drop("pool")


def human_score(df: DataFrame, group: str, order: str) -> DataFrame:
    """Signed mean of explicit feedback (channel, polarity, magnitude), or of the first
    item if none is explicit; neutral and zero ones do not count."""
    m = F.least(F.abs(F.coalesce("magnitude", F.lit(1.0))), F.lit(1.0))
    counted = F.when(F.col("polarity") == "neutral", 0.0).otherwise(m)
    sign = F.when(F.col("polarity") == "positive", 1.0).otherwise(-1.0)
    explicit = F.col("channel") == "explicit"
    g = df.groupBy(group).agg(
        F.count(F.when(explicit, 1)).alias("n_explicit"), F.sum(F.when(explicit, sign * counted)).alias("s"), F.sum(F.when(explicit, counted)).alias("w"), F.min_by(sign * counted, order).alias("fs"), F.min_by(counted, order).alias("fw")
    )
    s, w = F.when(F.col("n_explicit") > 0, F.col("s")).otherwise(F.col("fs")), F.when(F.col("n_explicit") > 0, F.col("w")).otherwise(F.col("fw"))
    return g.select(group, F.when(w == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / w))).alias("r_human"), F.when(F.col("n_explicit") > 0, "explicit").otherwise("heuristic").alias("origin"))


def next_run_at(*queues: DataFrame) -> DataFrame:
    """The least time at which any of the queues has something due."""
    out = queues[0]
    for q in queues[1:]:
        out = out.unionByName(q)
    return out.agg(F.min("at").alias("next_at"))
