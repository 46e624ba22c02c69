"""Queues, change feed, retention, merges: as rewrites of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Order of job types.
PRIORITY = {"trace_summary": 1, "import_summary": 2, "embedding": 3, "episode_idle_close": 10, "reflection": 20, "reward": 30, "span_big_turn": 35, "l2_association": 40, "l2_induction": 50, "l3_abstraction": 60, "skill_crystallization": 70, "skill_trial_resolve": 80}


def job_priority(job_type: Column, origin: Column) -> Column:
    out = F.lit(100)
    for t, p in PRIORITY.items():
        out = F.when(job_type == t, p).otherwise(out)
    return F.when(origin == "memory.processing.manual_retry", 0).otherwise(out)


def leasable(jobs: DataFrame, now: str) -> DataFrame:
    """Queued or expired, with attempts left, and due."""
    at = F.lit(now).cast("timestamp")
    waiting = (F.col("status") == "queued") | ((F.col("status") == "leased") & (F.col("lease_until") < at))
    return jobs.filter(waiting & (F.col("attempts") < F.col("max_attempts")) & (F.col("run_after").isNull() | (F.col("run_after") <= at)))


def lease(jobs: DataFrame, now: str, limit: int) -> DataFrame:
    """The next jobs in lease order: priority, stage, leased first, oldest first."""
    stage = F.when(F.col("job_type").isin("trace_summary", "import_summary"), 0).when(F.col("job_type") == "embedding", 1).otherwise(2)
    order = [job_priority(F.col("job_type"), F.col("origin")), stage, (F.col("status") != "leased").cast("int"), F.col("created_at"), F.col("id")]
    return leasable(jobs, now).orderBy(*order).limit(limit)


def failed(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("attempts") >= F.col("max_attempts"), "dead_letter").otherwise("failed"))


def requeued(jobs: DataFrame) -> DataFrame:
    """Failed jobs with attempts left are queued again."""
    again = (F.col("status") == "failed") & (F.col("attempts") < F.col("max_attempts"))
    return jobs.withColumn("status", F.when(again, "queued").otherwise(F.col("status")))


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart: leased jobs are queued, and their attempt is given back."""
    held = F.col("status") == "leased"
    return jobs.withColumns({"attempts": F.when(held, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")), "status": F.when(held, "queued").otherwise(F.col("status"))})


def retries_recovered(retries: DataFrame, held: str = "in_progress", waiting: str = "pending") -> DataFrame:
    """After a restart: retries in progress and failed ones wait again, the latter anew."""
    status = F.col("status")
    return retries.withColumns({"attempts": F.when(status == "failed", 0).otherwise(F.col("attempts")), "status": F.when(status.isin(held, "failed"), waiting).otherwise(status)})


def retained(log: DataFrame, order: list[Column], newest: int) -> DataFrame:
    """The newest rows of one log table: a global top-k, not a window over everything."""
    return log.orderBy(*order).limit(newest)


def changes_after(log: DataFrame, seq: str, cursor: int, limit: int, newest_first: bool = True) -> DataFrame:
    """Rows past the cursor. Newest first, a gap of over limit rows skips old ones; oldest
    first, none is skipped."""
    return log.filter(F.col(seq) > cursor).orderBy(F.desc(seq) if newest_first else F.col(seq)).limit(limit)


def last_write(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_write(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return last_write(df, key, order)


def upsert(base: DataFrame, new: DataFrame, key: list[str], tags: str, version: str) -> DataFrame:
    """Rows merged by key: the base row's id and owner stay, the value is the new one, tags
    are united, the version goes up."""
    old = base.select(*key, F.struct(*base.columns).alias("o"))
    fresh = new.select(*key, F.struct(*new.columns).alias("n"))
    j = old.join(fresh, key, "full_outer")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
    rest = [c for c in base.columns if c not in (*key, "id", "user_id", tags, version)]
    return j.select(
        *key, pick("id").alias("id"), pick("user_id").alias("user_id"), F.array_sort(F.array_union(F.coalesce(F.col(f"o.{tags}"), F.array()), F.coalesce(F.col(f"n.{tags}"), F.array()))).alias(tags), F.when(both, F.col(f"o.{version}") + 1).otherwise(pick(version)).alias(version), *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest]
    )


def imported(base: DataFrame, new: DataFrame, key: str, on_conflict: str) -> DataFrame:
    """skip: the base row stays; replace: the new one does; error: none may meet."""
    if on_conflict == "error" and new.join(base, key, "left_semi").limit(1).count():
        raise ValueError("rows to import are there already")
    if on_conflict == "replace":
        return base.join(new.select(key), key, "left_anti").unionByName(new)
    return base.unionByName(new.join(base.select(key), key, "left_anti"))


def merged_payload(a: Column, b: Column) -> Column:
    """Shallow merge of maps, the second one's entries winning."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def retry_upsert(queue: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Retries (target_id, status, attempts, next_at, claimed_by) merged with new targets
    (target_id): failed and succeeded ones start anew, the earliest next time stays, the
    claim always goes."""
    j = queue.join(new.select("target_id", F.lit(True).alias("_new")), "target_id", "full_outer")
    asked, fresh = F.coalesce("_new", F.lit(False)), F.col("status").isNull()
    anew = asked & (fresh | F.col("status").isin("failed", "succeeded"))
    return j.select(
        "target_id", F.when(anew, "pending").otherwise(F.col("status")).alias("status"), F.when(anew, 0).otherwise(F.col("attempts")).alias("attempts"), F.when(asked, F.least(F.coalesce("next_at", F.lit(now)), F.lit(now))).otherwise(F.col("next_at")).alias("next_at"), F.when(asked, None).otherwise(F.col("claimed_by")).alias("claimed_by")
    )


def fenced(queue: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates (id, worker, lease, status) that still hold the row's claim apply; others
    do not."""
    u = updates.select(F.col("id").alias("_i"), F.col("worker").alias("_w"), F.col("lease").alias("_l"), F.col("status").alias("_s"))
    j = queue.join(u, (F.col("id") == F.col("_i")) & (F.col("worker") == F.col("_w")) & (F.col("lease") == F.col("_l")), "left")
    return j.withColumn("status", F.coalesce("_s", "status")).drop("_i", "_w", "_l", "_s")


def retry_order(retries: DataFrame, memories: DataFrame) -> DataFrame:
    """Retries with a place: first reports, then interactive traces, then imported ones,
    then others; newest memory first."""
    m = memories.select(F.col("id").alias("_m"), "layer", F.col("tags").alias("_t"), F.col("created_at").alias("_c"))
    j = retries.join(m, F.col("target_id") == F.col("_m"), "left")
    has = lambda *t: F.coalesce(F.arrays_overlap(F.transform("_t", F.lower), F.array(*map(F.lit, t))), F.lit(False))
    trace = (F.col("target_kind") == "trace") & (F.col("layer") == "L1")
    rank = F.when(has("first-encounter-report", "onboarding-report"), -100).when(trace & ~has("agent-source"), 0).when(trace, 1).otherwise(2)
    return j.withColumn("rank", rank).orderBy("rank", F.desc("_c"), "next_at", "created_at", "id").drop("_m", "_t", "layer")
