"""Remaining reads and writes over service tables."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions.memory import first_text
from mnemolake.functions.scoring import clamp01
from mnemolake.functions.text import clip
from mnemolake.session import ship

#: Typed views of the JSON that memories carry.
TRACE_SCHEMA = "struct<ts: bigint, episode_id: string, userText: string, agentText: string, summary: string, reflection: string, alpha: double, value: double, priority: double, error_signatures: array<string>>"
POLICY_SCHEMA = "struct<title: string, trigger: string, procedure: string, verification: string, boundary: string, support: double, gain: double, confidence: double, salience: double, status: string, signature: string>"
SKILL_SCHEMA = "struct<name: string, status: string, eta: double, sourcePolicyIds: array<string>, invocationGuide: string, trialsAttempted: bigint, trialsPassed: bigint>"
WORLD_SCHEMA = "struct<title: string, summary: string, body: string, domainTags: array<string>, policyIds: array<string>, confidence: double>"


def meta(info: Column, name: str, schema: str) -> Column:
    """The typed record at internal_info.<name>; null if it is absent."""
    return F.from_json(F.get_json_object(info, f"$.internal_info.{name}"), schema)


def index_document(layer: Column, value: Column, skill: Column, world: Column, tags: Column) -> Column:
    """What full text sees of a memory: a skill's name and guide, a world model's summary,
    else the value."""
    s = F.concat_ws("\n", skill["name"], skill["invocationGuide"], F.array_join(tags, " "))
    w = F.concat_ws("\n", world["title"], world["summary"], F.array_join(world["domainTags"], " "), F.when(F.coalesce(world["summary"], F.lit("")) == "", world["body"]))
    return F.when((layer == "Skill") & skill.isNotNull(), s).when((layer == "L3") & world.isNotNull(), w).otherwise(value)


def vector_rows(memories: DataFrame, fields: tuple[str, ...] = ("vec_summary", "vec_action", "vec")) -> tuple[DataFrame, DataFrame]:
    """Rows without their vectors, and the vectors in long form (id, field, dim, vector)."""
    have = [f for f in fields if f in memories.columns]
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("vector")) for f in have])
    long = memories.select("id", F.explode(parts).alias("p")).select("id", "p.field", F.size("p.vector").alias("dim"), "p.vector").filter("vector is not null and dim > 0")
    return memories.drop(*have), long


def hydrated(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, vectors): a map from field to vector."""
    g = vectors.groupBy(F.col("id").alias("_i")).agg(F.map_from_entries(F.collect_list(F.struct("field", "vector"))).alias("vectors"))
    return ids.join(g, F.col("id") == F.col("_i"), "left").drop("_i")


def captured(turns: DataFrame) -> DataFrame:
    """One trace per turn that has text: value 0, priority 0.5, a summary."""
    text = first_text(F.col("user_text"), F.col("agent_text"))
    return turns.filter(text.isNotNull()).select("id", "episode_id", clip(text, 140).alias("summary"), F.lit(0.0).alias("value"), F.lit(0.5).alias("priority"))


def span_id(trace: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("span_"), F.substring(F.sha2(F.concat(F.lit('"'), trace, F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit('"')), 256), 1, 20))


def job_dedupe_key(job_type: Column, episode: Column, target: Column, content_hash: Column) -> Column:
    """What makes two jobs the same; null if nothing does."""
    hashed = F.when(job_type.isin("embedding", "trace_summary", "import_summary") & target.isNotNull(), F.concat_ws(":", job_type, target, F.coalesce(content_hash, F.lit("current"))))
    by_episode = F.when(job_type.isin("reflection", "reward"), F.concat(job_type, F.lit(":"), F.coalesce(episode, target)))
    by_target = F.when(job_type.isin("span_big_turn", "l2_association"), F.concat(job_type, F.lit(":"), target))
    seeded = F.when(job_type.isin("l2_induction", "skill_crystallization", "skill_trial_resolve", "l3_abstraction"), F.concat(job_type, F.lit(":"), F.coalesce(target, episode)))
    return F.coalesce(hashed, by_episode, by_target, seeded)


def enqueued(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """New jobs (key, ...) without one whose key is queued or leased already."""
    active = jobs.filter(F.col("status").isin("queued", "leased")).select(F.col("key").alias("_k"))
    once = new.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("id"))).filter((F.col("_n") == 1) | F.col("key").isNull()).drop("_n")
    return once.join(active, F.col("key") == F.col("_k"), "left_anti")


def change_kind(layer: Column) -> Column:
    return F.when(layer == "L1", "trace").when(layer == "L2", "policy").when(layer == "L3", "world_model").when(layer == "Skill", "skill").otherwise("memory")


def change_op(change: Column) -> Column:
    c = F.lower(change)
    return F.when(c.rlike("creat|insert|add"), "created").when(c.rlike("delet|remov"), "deleted").when(c.rlike("archiv"), "archived").otherwise("updated")


def advanced(marks: DataFrame, seen: DataFrame) -> DataFrame:
    """Watermarks (source, at) moved on by what was seen (source, at); never back."""
    return marks.unionByName(seen.select("source", "at")).groupBy("source").agg(F.max("at").alias("at"))


def discontiguous(messages: DataFrame, conv: str, order: str) -> DataFrame:
    """Conversations that begin again after another came between, in the order of one
    stream (column stream tells streams apart)."""
    w = W.partitionBy("stream").orderBy(order)
    starts = messages.withColumn("_new", F.coalesce(F.lag(conv).over(w) != F.col(conv), F.lit(True)))
    return starts.filter("_new").groupBy("stream", conv).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("stream", conv)


def idempotent(requests: DataFrame, known: DataFrame) -> DataFrame:
    """requests (key, hash) gain outcome: replay, conflict (same key, another hash), new."""
    k = known.select(F.col("key").alias("_k"), F.col("hash").alias("_h"))
    return requests.join(k, F.col("key") == F.col("_k"), "left").withColumn("outcome", F.when(F.col("_k").isNull(), "new").when(F.col("_h") == F.col("hash"), "replay").otherwise("conflict")).drop("_k", "_h")


def usage_key(kind: Column, source: Column, operation: Column) -> Column:
    return F.concat_ws(":", kind, source, operation)


def skill_draft(policies: DataFrame, min_eta: float = 0.1, min_support: float = 1, min_gain: float = 0.02) -> DataFrame:
    """Active policies with gain, support and a success behind them; eta from both."""
    kinds = ("failure_avoidance", "repair_instruction", "preference")
    anchored = F.col("eligible") & ~F.col("experience_type").isin(*kinds) & F.col("polarity").isin("positive", "mixed")
    eta = clamp01(F.greatest(F.lit(min_eta), 0.5 * clamp01(F.col("gain")) + 0.5 * F.least(F.lit(1.0), F.col("support") / max(1, min_support))))
    return policies.filter((F.col("status") == "active") & (F.col("gain") >= min_gain) & (F.col("support") >= min_support) & anchored).withColumn("eta", eta)


def skill_verdict(drafts: DataFrame, min_coverage: float = 0.5, min_resonance: float = 0.5) -> DataFrame:
    """drafts (tools, evidence_tools, resonance, n_evidence) gain coverage and reason."""
    lower = lambda c: F.transform(c, F.lower)
    missing = F.size(F.array_except(lower("tools"), lower("evidence_tools")))
    coverage = F.when(F.size("tools") == 0, 1.0).otherwise((F.size("tools") - missing) / F.size("tools"))
    reason = F.when(F.col("n_evidence") == 0, "no-evidence").when((coverage < min_coverage) & (F.size("tools") > 0), "coverage").when(F.col("resonance") < min_resonance, "resonance").otherwise("")
    return drafts.withColumns({"coverage": F.when(F.col("n_evidence") == 0, 0.0).otherwise(coverage), "reason": reason})


def existing_skill(skills: DataFrame) -> DataFrame:
    """(policy, skill): the newest skill, not archived, that cites a policy."""
    cited = skills.filter("status <> 'archived'").select(F.explode("policy_ids").alias("policy"), "id", "updated_at")
    return cited.groupBy("policy").agg(F.max_by("id", F.struct("updated_at", "id")).alias("skill"))


def pending_trials(feedback: DataFrame, trials: DataFrame, most: int = 20) -> DataFrame:
    """(feedback_id, trial_id): pending trials of the same turn, or of the same episode if
    no turn is told; up to `most`, newest first."""
    p = trials.filter("outcome = 'pending'").select("trial_id", F.col("turn_id").alias("_t"), F.col("episode_id").alias("_e"), F.col("at").alias("_at"))

    def newest(key: str) -> DataFrame:  # before the join, which then takes `most` rows a feedback at most
        w = W.partitionBy(key).orderBy(F.desc("_at"), "trial_id")
        return p.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)

    by_turn = feedback.filter("turn_id is not null").join(newest("_t"), F.col("turn_id") == F.col("_t"))
    by_episode = feedback.filter("turn_id is null").join(newest("_e"), F.col("episode_id") == F.col("_e"))
    return by_turn.unionByName(by_episode).select("feedback_id", "trial_id")


def repairs(contrast: DataFrame, recent: DataFrame, key: str, value: str, least: float = 0.5) -> DataFrame:
    """Signatures with traces of both sides whose mean values differ enough, and no repair
    within the cool-down."""
    g = contrast.groupBy(key).agg(F.avg(F.when(F.col("side") == "high", F.col(value))).alias("high"), F.avg(F.when(F.col("side") == "low", F.col(value))).alias("low"))
    apart = g.filter(F.col("high").isNotNull() & F.col("low").isNotNull() & (F.col("high") - F.col("low") >= least))
    return apart.join(recent.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def merged_world(old: DataFrame, new: DataFrame, delta: float = 0.05) -> DataFrame:
    """Models merged by key: ids and tags united, confidence up by delta, at most 1."""
    n = new.select("key", F.col("policy_ids").alias("_p"), F.col("tags").alias("_t"))
    j = old.join(n, "key", "left")
    unite = lambda a, b: F.array_sort(F.array_union(a, F.coalesce(b, F.array().cast("array<string>"))))
    return j.select("key", unite("policy_ids", F.col("_p")).alias("policy_ids"), unite("tags", F.col("_t")).alias("tags"), F.when(F.col("_p").isNotNull(), F.least(F.col("confidence") + delta, F.lit(1.0))).otherwise(F.col("confidence")).alias("confidence"))


def processing(states: DataFrame, retries: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Rows in the wanted states, oldest first, with whether a retry is scheduled."""
    r = retries.select(F.col("target_id").alias("_r")).distinct()
    return states.filter(F.col("state").isin(*wanted)).join(r, F.col("memory_id") == F.col("_r"), "left").withColumn("retry_scheduled", F.col("_r").isNotNull()).drop("_r").orderBy("updated_at", "memory_id")


def current_summaries(log: DataFrame, memories: DataFrame) -> DataFrame:
    """log (seq, hits: array of struct(id, summary)) with the summaries that memories hold now."""
    one = log.select("seq", F.posexplode_outer("hits").alias("pos", "h"))
    m = memories.select(F.col("id").alias("_m"), F.col("summary").alias("_s"))
    j = one.join(m, F.col("h.id") == F.col("_m"), "left").select("seq", "pos", F.struct(F.col("h.id").alias("id"), F.coalesce("_s", F.col("h.summary")).alias("summary")).alias("h"))
    return j.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda s: s["h"]).alias("hits"))


def context_text(hits: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """The texts of a query's hits in order, numbered; nothing is trimmed."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return hits.groupBy(group).agg(rows.alias("_r")).select(group, F.array_join(F.transform("_r", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["t"])), "\n").alias("context"))


_SECRET = re.compile(r"key|token|secret|password|credential", re.IGNORECASE)


def _redacted(texts: pd.Series) -> pd.Series:
    def walk(v: object, hide: bool = False) -> object:
        if isinstance(v, dict):
            return {k: walk(x, bool(_SECRET.search(k))) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x, hide) for x in v]
        return "[redacted]" if hide and v not in (None, "") else v

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(walk(json.loads(t)), ensure_ascii=False)
        except ValueError:
            return t

    return texts.map(one)


def redacted_config(text: Column) -> Column:
    """Values under secret-sounding keys, at any depth, are masked; other text stays."""
    ship()
    return F.pandas_udf(_redacted, "string")(text)
