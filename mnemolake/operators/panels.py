"""Lists, details and small state changes of a memory service, as rewrites of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions.text import clip
from mnemolake.operators.graph import transition_faults, unreachable
from mnemolake.operators.queues import job_priority


def completed(jobs: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Jobs named in ids (id) have succeeded: no lease, updated at."""
    done = jobs.join(ids.select(F.col("id").alias("_d")).distinct(), F.col("id") == F.col("_d"), "left")
    hit = F.col("_d").isNotNull()
    return done.withColumns({"status": F.when(hit, "succeeded").otherwise(F.col("status")), "lease_until": F.when(~hit, F.col("lease_until")), "updated_at": F.when(hit, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("updated_at"))}).drop("_d")


def job_list(jobs: DataFrame, status: str | None, limit: int) -> DataFrame:
    """The first jobs in lease order, of one status or of all."""
    stage = F.when(F.col("job_type").isin("trace_summary", "import_summary"), 0).when(F.col("job_type") == "embedding", 1).otherwise(2)
    order = [job_priority(F.col("job_type"), F.col("origin")), stage, (F.col("status") != "leased").cast("int"), F.col("created_at"), F.col("id")]
    return (jobs.filter(F.col("status") == status) if status else jobs).orderBy(*order).limit(limit)


def with_error(jobs: DataFrame) -> DataFrame:
    """Jobs with what a panel shows of their last error; null without one."""
    told = F.col("last_error")
    return jobs.withColumn("error", F.when(F.coalesce(told, F.lit("")) != "", F.struct(F.lit("worker_error").alias("code"), told.alias("message"))))


def pending_job(jobs: DataFrame) -> DataFrame:
    """(target_id, job_type): the first waiting or leased job of each, with its content hash."""
    w = W.partitionBy("target_id", "job_type").orderBy("created_at", "id")
    return jobs.filter(F.col("status").isin("queued", "leased")).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def candidates_upserted(pool: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates by id: what is there keeps its key, owner, status and birth; value, score,
    evidence, update and expiry are the new ones'. New ones are pending."""
    o, n = pool.select("id", F.struct(*pool.columns).alias("o")), new.select("id", F.struct(*new.columns).alias("n"))
    j = o.join(n, "id", "full_outer")
    fresh = ("value", "score", "evidence", "updated_at", "expires_at")
    pick = lambda c: (F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in fresh else F.coalesce(f"o.{c}", f"n.{c}")).alias(c)
    status = F.when(F.col("o").isNull(), "pending").otherwise(F.col("o.status")).alias("status")
    return j.select("id", *[status if c == "status" else pick(c) for c in pool.columns if c != "id"])


def candidates_promoted(pool: DataFrame, promotions: DataFrame, at: Column) -> DataFrame:
    """Candidates of a key and source that are named (candidate_key, source_id, policy_id)
    become that policy's; evidence is a map of strings. Of several promotions the first
    policy by id holds."""
    p = promotions.groupBy(F.col("candidate_key").alias("_k"), F.col("source_id").alias("_s")).agg(F.min("policy_id").alias("_p"))
    j = pool.join(p, (F.col("candidate_key") == F.col("_k")) & (F.col("source_id") == F.col("_s")), "left")
    hit = F.col("_p").isNotNull()
    kept = F.map_filter("evidence", lambda k, _: k != "policyId")
    evidence = F.when(hit, F.map_concat(kept, F.create_map(F.lit("policyId"), F.col("_p")))).otherwise(F.col("evidence"))
    return j.withColumns({"status": F.when(hit, "promoted").otherwise(F.col("status")), "evidence": evidence, "updated_at": F.when(hit, at).otherwise(F.col("updated_at"))}).drop("_k", "_s", "_p")


def turns_claimed(turns: DataFrame, now: Column) -> DataFrame:
    """Per session: running turns fall back to retry; then the first one that waits, and is due
    unless it is blocked, is running from now on."""
    back = turns.withColumn("status", F.when(F.col("status") == "running", "retry").otherwise(F.col("status")))
    free = F.col("status").isin("pending", "retry", "blocked") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now) | (F.col("status") == "blocked"))
    first = back.filter(free).groupBy("session").agg(F.min("message_start").alias("_first"))
    j = back.join(first, "session", "left")
    claimed = free & (F.col("message_start") == F.col("_first"))
    return j.withColumn("started_at", F.when(claimed, now)).withColumn("status", F.when(claimed, "running").otherwise(F.col("status"))).drop("_first")


def first_line(text: Column) -> Column:
    """The first line with something in it, trimmed; null without one."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != ""), 0)


def episode_detail(episodes: DataFrame, turns: DataFrame, memories: DataFrame) -> DataFrame:
    """One record per episode (id, title, summary, status, turn_count, updated_at): a title and a
    summary, from its first user text where it has none, its tags, a version and counts.
    turns: episode_id, place, user_text; memories: episode_id, id."""
    said = F.trim(F.coalesce("user_text", F.lit("")))
    t = turns.groupBy(F.col("episode_id").alias("_t")).agg(F.count(F.lit(1)).alias("raw_turns"), F.min_by(F.when(said != "", said), F.when(said != "", F.col("place"))).alias("first_text"))
    m = memories.groupBy(F.col("episode_id").alias("_m")).agg(F.count_distinct("id").alias("memories"))
    j = episodes.join(t, F.col("id") == F.col("_t"), "left").join(m, F.col("id") == F.col("_m"), "left").na.fill(0, ["raw_turns", "memories"])
    line = first_line(F.coalesce("first_text", F.lit("")))
    title = F.coalesce("title", first_line(F.coalesce("first_text", "summary", F.lit(""))), "id")
    counts = F.concat(F.col("memories").cast("string"), F.lit(" memory item(s), "), F.col("raw_turns").cast("string"), F.lit(" raw turn(s)"))
    return j.select("id", clip(title, 120).alias("title"), F.coalesce("summary", line, counts).alias("summary"), F.array(F.lit("episode"), F.col("status")).alias("tags"), F.greatest(F.lit(1), "turn_count", "memories", "raw_turns").cast("long").alias("version"), "updated_at", "memories", "raw_turns")


def success_anchor(policies: DataFrame) -> Column:
    """Whether a policy may anchor a skill by its success."""
    barred = F.col("experience_type").isin("failure_avoidance", "repair_instruction", "preference")
    return F.col("eligible") & ~barred & F.col("polarity").isin("positive", "mixed")


def turn_start_recall(events: DataFrame) -> DataFrame:
    """The newest recall of each session and turn whose request says turn_start."""
    mode = F.get_json_object("request", "$.retrievalMode")
    return events.filter(mode == "turn_start").groupBy("session_id", "turn_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def recall_outcomes(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events with the outcomes given (id, outcome), the last one by seq."""
    last = outcomes.groupBy(F.col("id").alias("_o")).agg(F.max_by("outcome", "seq").alias("_v"))
    return events.join(last, F.col("id") == F.col("_o"), "left").withColumn("outcome", F.coalesce("_v", "outcome")).drop("_o", "_v")


def journal(rows: DataFrame, job: str, order: str, json_columns: dict[str, str]) -> DataFrame:
    """A scan's rows of each job, numbered in their order, with JSON columns parsed: malformed
    ones are empty, as replay must not fail on them."""
    place = F.row_number().over(W.partitionBy(job).orderBy(order))
    parsed = {c: F.coalesce(F.from_json(c, t), F.from_json(F.lit("[]" if t.startswith("array") else "{}"), t)) for c, t in json_columns.items()}
    return rows.withColumn("place", place).withColumns(parsed)


def listed(rows: DataFrame, equal: dict[str, object], newest: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows that match all that is asked (None asks nothing), the newest first."""
    for c, v in equal.items():
        if v is not None:
            rows = rows.filter(F.col(c) == F.lit(v))
    return rows.orderBy(*[F.desc(c) for c in newest]).offset(offset).limit(limit)


def patched(nodes: DataFrame, edges: DataFrame, added: DataFrame, updates: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, faults) after patches, one a graph, which hold whole or not at all.

    added: graph, temp_id, id, kind, status; updates: graph, id, status, seq (the last one
    holds); links: graph, source, target, type, which may name temp_ids. A link that is
    there already is not added again. A graph whose patch leaves an added node out of its
    tasks' reach, or breaks the transitions between tasks, keeps its old state."""
    names = added.select(F.col("graph").alias("_g"), F.col("temp_id").alias("_t"), F.col("id").alias("_id"))
    out = links
    for end in ("source", "target"):
        out = out.join(names, (F.col("graph") == F.col("_g")) & (F.col(end) == F.col("_t")), "left").withColumn(end, F.coalesce("_id", end)).drop("_g", "_t", "_id")
    key = ["graph", "source", "target", "type"]
    fresh = out.select(*key).distinct().join(edges.select(*key), key, "left_anti")
    last = updates.groupBy(F.col("graph").alias("_g"), F.col("id").alias("_u")).agg(F.max_by("status", "seq").alias("_s"))
    moved = nodes.join(last, (F.col("graph") == F.col("_g")) & (F.col("id") == F.col("_u")), "left").withColumn("status", F.coalesce("_s", "status")).drop("_g", "_u", "_s")
    all_nodes = moved.select("graph", "id", "kind", "status").unionByName(added.select("graph", "id", "kind", "status"))
    all_edges = edges.select(*key).unionByName(fresh)
    steps = added.filter("kind <> 'task'").select("graph", F.col("id").alias("node"))
    tasks = added.filter("kind = 'task'").select("graph", F.col("id").alias("node"))
    lost = unreachable(steps, all_nodes, all_edges).select("graph", F.lit("added node is out of reach").alias("fault"))
    faults = lost.unionByName(transition_faults(all_nodes, all_edges, tasks)).distinct()
    bad = faults.select("graph").distinct()
    keep = lambda new, old: new.join(bad, "graph", "left_anti").unionByName(old.join(bad, "graph", "left_semi"))
    return keep(all_nodes, nodes.select("graph", "id", "kind", "status")), keep(all_edges, edges.select(*key)), faults
