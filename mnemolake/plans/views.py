"""The driver's tables seen as memory-service tables, in Spark and as SQL text.

Derived columns are fixed arithmetic on ids, so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories of four layers, with scope, status and times."""
    i = F.col("doc_id")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (i % n + 1).cast("int"))
    created = F.timestamp_seconds(F.lit(1704067200) + i * 2220)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("mem_"), i).alias("id"),
        i.alias("ord"),
        pick(4, "L1", "L2", "L3", "Skill").alias("layer"),
        F.concat(F.lit("key_"), (i % 300).cast("string")).alias("memory_key"),
        F.concat(F.lit("user_"), (i % 5).cast("string")).alias("user_id"),
        F.concat(F.lit("ep_"), F.floor(i / 8).cast("string")).alias("episode_id"),
        F.when(i % 19 == 0, None).otherwise(F.concat(F.lit(" Agent-"), F.col("source"))).alias("agent_id"),
        F.when(i % 11 == 0, "archived").when(i % 13 == 0, "deleted").when(i % 7 == 0, "resolving").otherwise("activated").alias("status"),
        F.array(F.lit("trace"), F.col("lang"), F.upper("source")).alias("tags"),
        "source",
        F.col("text").alias("value"),
        created.alias("created_at"),
        (F.timestamp_seconds(F.lit(1704067200) + i * 2220 + (i % 100) * 3600)).alias("updated_at"),
        (i % 17 == 0).alias("deleted"),
        ((i * 37 % 101) / F.lit(100.0) - 0.3).alias("score"),
        F.concat(F.lit('{"source":"'), F.col("source"), F.lit('","internal":{"eta":'), (i % 10).cast("string"), F.lit("}}")).alias("info"),
    )


MEMORIES = """
memories AS (SELECT 'mem_' || doc_id AS id, doc_id AS ord, ['L1','L2','L3','Skill'][doc_id % 4 + 1] AS layer, 'key_' || doc_id % 300 AS memory_key,
 'user_' || doc_id % 5 AS user_id, 'ep_' || doc_id // 8 AS episode_id, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE ' Agent-' || source END AS agent_id,
 CASE WHEN doc_id % 11 = 0 THEN 'archived' WHEN doc_id % 13 = 0 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'resolving' ELSE 'activated' END AS status,
 ['trace', lang, upper(source)] AS tags, source, text AS value, to_timestamp(1704067200 + doc_id * 2220)::TIMESTAMP AS created_at,
 to_timestamp(1704067200 + doc_id * 2220 + (doc_id % 100) * 3600)::TIMESTAMP AS updated_at, doc_id % 17 = 0 AS deleted,
 (doc_id * 37 % 101) / 100.0::DOUBLE - 0.3::DOUBLE AS score, '{"source":"' || source || '","internal":{"eta":' || doc_id % 10 || '}}' AS info FROM documents)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queue jobs."""
    i = F.col("event_id")
    types = ["trace_summary", "import_summary", "embedding", "episode_idle_close", "reflection", "reward", "l2_association", "skill_trial_resolve"]
    return table(spark, sf_dir, "events").select(
        i.alias("id"),
        F.element_at(F.array(*map(F.lit, types)), (i % 8 + 1).cast("int")).alias("job_type"),
        F.when(i % 10 < 4, "queued").when(i % 10 < 6, "leased").when(i % 10 == 6, "failed").when(i % 10 == 7, "dead_letter").otherwise("succeeded").alias("status"),
        (i % 4).alias("attempts"),
        F.lit(3).alias("max_attempts"),
        F.concat(F.lit("mem_"), (i % 1500).cast("string")).alias("target_id"),
        F.col("ts").alias("created_at"),
        F.when(i % 3 == 0, None).otherwise(F.col("ts") + F.expr("interval 1 hour")).alias("run_after"),
        (F.col("ts") + F.expr("interval 1 minute")).alias("lease_until"),
        "user_id",
        F.when(i % 50 == 0, "memory.processing.manual_retry").alias("origin"),
    )


JOBS = """
jobs AS (SELECT event_id AS id, ['trace_summary','import_summary','embedding','episode_idle_close','reflection','reward','l2_association','skill_trial_resolve'][event_id % 8 + 1] AS job_type,
 CASE WHEN event_id % 10 < 4 THEN 'queued' WHEN event_id % 10 < 6 THEN 'leased' WHEN event_id % 10 = 6 THEN 'failed' WHEN event_id % 10 = 7 THEN 'dead_letter' ELSE 'succeeded' END AS status,
 event_id % 4 AS attempts, 3 AS max_attempts, 'mem_' || event_id % 1500 AS target_id, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 1 HOUR END AS run_after,
 ts + INTERVAL 1 MINUTE AS lease_until, user_id, CASE WHEN event_id % 50 = 0 THEN 'memory.processing.manual_retry' END AS origin FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the number of the turn each message belongs to."""
    from mnemolake.operators.sessions import split_turns

    return split_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


TURNS = """
turns AS (SELECT *, greatest(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w - CASE WHEN first_value(role) OVER w = 'user' THEN 1 ELSE 0 END, 0)::BIGINT AS turn_no
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",".join(parts)
