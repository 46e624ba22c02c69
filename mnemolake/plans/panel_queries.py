"""Registered queries over lists, details, records and state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions import memory as M
from mnemolake.functions import metadata as D
from mnemolake.functions import rules as R
from mnemolake.functions import scoring as S
from mnemolake.functions import text as T
from mnemolake.operators import graph as G
from mnemolake.operators import panels as P
from mnemolake.operators import queues as Q
from mnemolake.operators import sessions as C
from mnemolake.plans.queries import EDGES, Col, _edges, _nodes, query, words
from mnemolake.plans.views import jobs, memories, table

AT = "2024-03-01 00:00:00"


def _pick(values: list[str | None], by: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


# --- jobs ------------------------------------------------------------------------------
@query(words(f"{{jobs}} SELECT id, CASE WHEN id % 10 IN (4, 5) AND id % 3 = 0 THEN 'succeeded' ELSE status END AS status, CASE WHEN id % 10 IN (4, 5) AND id % 3 = 0 THEN NULL ELSE lease_until END AS lease_until, CASE WHEN id % 10 IN (4, 5) AND id % 3 = 0 THEN TIMESTAMP '{AT}' ELSE created_at END AS updated_at FROM jobs"))
def completed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).withColumn("updated_at", Col("created_at"))
    return P.completed(j, j.filter("status = 'leased' and id % 3 = 0").select("id"), AT).select("id", "status", "lease_until", "updated_at")


_ORDER = "CASE WHEN origin = 'memory.processing.manual_retry' THEN 0 ELSE CASE job_type WHEN 'trace_summary' THEN 1 WHEN 'import_summary' THEN 2 WHEN 'embedding' THEN 3 WHEN 'episode_idle_close' THEN 10 WHEN 'reflection' THEN 20 WHEN 'reward' THEN 30 WHEN 'l2_association' THEN 40 WHEN 'skill_trial_resolve' THEN 80 ELSE 100 END END"


@query(words(f"{{jobs}} SELECT id, status FROM jobs WHERE status = 'failed' ORDER BY {_ORDER}, CASE WHEN job_type IN ('trace_summary', 'import_summary') THEN 0 WHEN job_type = 'embedding' THEN 1 ELSE 2 END, created_at, id LIMIT 50"))
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.job_list(jobs(spark, sf_dir), "failed", 50).select("id", "status")


@query(words("{jobs} SELECT id, CASE WHEN status = 'failed' AND id % 3 > 0 THEN 'worker_error' END AS code, CASE WHEN status = 'failed' AND id % 3 > 0 THEN 'lost ' || id END AS message FROM jobs"))
def job_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when((Col("status") == "failed") & (Col("id") % 3 > 0), F.concat(F.lit("lost "), Col("id").cast("string"))).when(Col("id") % 2 == 0, "")
    return P.with_error(jobs(spark, sf_dir).withColumn("last_error", told)).select("id", Col("error.code").alias("code"), Col("error.message").alias("message"))


@query(words("{jobs} SELECT target_id, job_type, id FROM (SELECT *, row_number() OVER (PARTITION BY target_id, job_type ORDER BY created_at, id) AS n FROM jobs WHERE status IN ('queued', 'leased')) WHERE n = 1"))
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pending_job(jobs(spark, sf_dir)).select("target_id", "job_type", "id")


@query(words("{mem,}" + "j AS (SELECT DISTINCT 'ep_' || event_id % 200 AS episode_id FROM events WHERE event_id % 10 < 6 AND event_id % 8 = 5) SELECT DISTINCT episode_id, episode_id IN (SELECT episode_id FROM j) AS found FROM memories"))
def episode_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an episode has a waiting or leased reward job."""
    j = jobs(spark, sf_dir).filter("status in ('queued', 'leased') and job_type = 'reward'").select(F.concat(F.lit("ep_"), (Col("id") % 200).cast("string")).alias("_e")).distinct()
    e = memories(spark, sf_dir).select("episode_id").distinct()
    return e.join(j, Col("episode_id") == Col("_e"), "left").select("episode_id", Col("_e").isNotNull().alias("found"))


@query(words("{jobs} SELECT id, CASE WHEN status IN ('leased', 'failed') THEN 'queued' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts FROM jobs"))
def retry_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries after a restart: those in progress and those that failed wait again, the latter anew."""
    return Q.retries_recovered(jobs(spark, sf_dir), "leased", "queued").select("id", "status", "attempts")


# --- candidates ------------------------------------------------------------------------
_POOL = "pool AS (SELECT event_id AS id, user_id, 'k' || event_id % 40 AS candidate_key, event_id % 60 AS source_id, event_type AS value, value AS score, CASE WHEN event_id % 5 = 0 THEN 'promoted' ELSE 'pending' END AS status, ts AS updated_at FROM events)"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Col("event_id")
    return table(spark, sf_dir, "events").select(i.alias("id"), "user_id", F.concat(F.lit("k"), (i % 40).cast("string")).alias("candidate_key"), (i % 60).alias("source_id"), Col("event_type").alias("value"), Col("value").alias("score"), F.when(i % 5 == 0, "promoted").otherwise("pending").alias("status"), F.create_map(F.lit("n"), i.cast("string")).alias("evidence"), Col("ts").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))


@query(f"WITH {_POOL}, o AS (SELECT * FROM pool WHERE id % 3 > 0), n AS (SELECT * REPLACE (value || '!' AS value, score + 1 AS score, 'other' AS candidate_key) FROM pool WHERE id % 2 = 0) SELECT coalesce(o.id, n.id) AS id, coalesce(o.candidate_key, n.candidate_key) AS candidate_key, coalesce(n.value, o.value) AS value, round(coalesce(n.score, o.score), 6) AS score, coalesce(o.status, 'pending') AS status FROM o FULL JOIN n ON o.id = n.id")
def candidate_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pool(spark, sf_dir)
    new = p.filter("id % 2 = 0").withColumns({"value": F.concat("value", F.lit("!")), "score": Col("score") + 1, "candidate_key": F.lit("other")})
    return P.candidates_upserted(p.filter("id % 3 > 0"), new).select("id", "candidate_key", "value", F.round("score", 6).alias("score"), "status")


@query(f"WITH {_POOL}, pr AS (SELECT DISTINCT 'k' || o_custkey % 40 AS k, o_orderkey % 60 AS s, o_custkey % 7 AS p FROM orders WHERE o_orderstatus = 'F'), m AS (SELECT k, s, min('p' || p) AS p FROM pr GROUP BY 1, 2) SELECT id, CASE WHEN p IS NOT NULL THEN 'promoted' ELSE status END AS status, p AS policy, CASE WHEN p IS NOT NULL THEN TIMESTAMP '{AT}' ELSE updated_at END AS updated_at FROM pool LEFT JOIN m ON k = candidate_key AND s = source_id")
def candidate_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("k"), (Col("o_custkey") % 40).cast("string")).alias("candidate_key"), (Col("o_orderkey") % 60).alias("source_id"), F.concat(F.lit("p"), (Col("o_custkey") % 7).cast("string")).alias("policy_id"))
    done = P.candidates_promoted(_pool(spark, sf_dir), pr, F.lit(AT).cast("timestamp_ntz"))
    return done.select("id", "status", Col("evidence")["policyId"].alias("policy"), "updated_at")


# --- episodes, recalls, journals ---------------------------------------------------------
@query("WITH u AS (SELECT conv_id, count(*) AS n, arg_min(trim(text), turn) FILTER (role = 'user' AND trim(text) <> '') AS t FROM conversations GROUP BY 1), d AS (SELECT doc_id % 300 AS c, count(*) AS m FROM documents GROUP BY 1), x AS (SELECT conv_id, n, coalesce(m, 0) AS m, t, list_filter(list_transform(string_split(coalesce(t, ''), chr(10)), lambda l: trim(l)), lambda l: l <> '')[1] AS l FROM u LEFT JOIN d ON c = conv_id), y AS (SELECT *, trim(regexp_replace(CASE WHEN conv_id % 3 = 0 THEN 'Episode ' || conv_id ELSE coalesce(l, CASE WHEN conv_id % 2 = 0 THEN 'sum ' || conv_id END, conv_id::VARCHAR) END, '\\s+', ' ', 'g')) AS w FROM x) SELECT conv_id::VARCHAR AS id, CASE WHEN length(w) <= 120 THEN w ELSE left(w, 117) || '...' END AS title, coalesce(CASE WHEN conv_id % 2 = 0 THEN 'sum ' || conv_id END, l, m || ' memory item(s), ' || n || ' raw turn(s)') AS summary, 'episode,' || CASE WHEN conv_id % 4 = 0 THEN 'open' ELSE 'closed' END AS tags, greatest(1, conv_id % 5, m, n)::BIGINT AS version FROM y")
def episode_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    i = Col("conv_id")
    e = c.select("conv_id").distinct().select(i.cast("string").alias("id"), F.when(i % 3 == 0, F.concat(F.lit("Episode "), i.cast("string"))).alias("title"), F.when(i % 2 == 0, F.concat(F.lit("sum "), i.cast("string"))).alias("summary"), F.when(i % 4 == 0, "open").otherwise("closed").alias("status"), (i % 5).alias("turn_count"), F.lit(None).cast("timestamp").alias("updated_at"))
    t = c.select(i.cast("string").alias("episode_id"), Col("turn").alias("place"), F.when(Col("role") == "user", Col("text")).alias("user_text"))
    m = table(spark, sf_dir, "documents").select((Col("doc_id") % 300).cast("string").alias("episode_id"), Col("doc_id").alias("id"))
    return P.episode_detail(e, t, m).select("id", "title", "summary", F.array_join("tags", ",").alias("tags"), "version")


@query("SELECT user_id AS session_id, event_id % 30 AS turn_id, arg_max(event_id, (ts, event_id)) AS id FROM events WHERE event_id % 4 = 1 GROUP BY 1, 2")
def turn_start_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(Col("event_id") % 4 == 1, "turn_start").otherwise("search")
    e = table(spark, sf_dir, "events").select(Col("event_id").alias("id"), Col("user_id").alias("session_id"), (Col("event_id") % 30).alias("turn_id"), F.to_json(F.struct(mode.alias("retrievalMode"))).alias("request"), Col("ts").alias("created_at"))
    return P.turn_start_recall(e)


@query("SELECT event_id AS id, CASE WHEN event_id % 6 = 0 THEN 'used' WHEN event_id % 3 = 0 THEN 'ignored' ELSE 'unknown' END AS outcome FROM events")
def recall_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later of two outcomes holds."""
    e = table(spark, sf_dir, "events").select(Col("event_id").alias("id"), F.lit("unknown").alias("outcome"))
    told = e.filter("id % 3 = 0").select("id", F.lit("ignored").alias("outcome"), F.lit(1).alias("seq")).unionByName(e.filter("id % 6 = 0").select("id", F.lit("used").alias("outcome"), F.lit(2).alias("seq")))
    return P.recall_outcomes(e, told).select("id", "outcome")


@query("SELECT conv_id AS job, turn AS message_order, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, CASE WHEN turn % 3 > 0 THEN role END AS lang FROM conversations")
def journal_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows hold malformed JSON."""
    c = table(spark, sf_dir, "conversations").select(Col("conv_id").alias("job"), Col("turn").alias("message_order"), F.when(Col("turn") % 3 == 0, "{oops").otherwise(F.to_json(F.struct(Col("role").alias("who")))).alias("raw_meta"))
    return P.journal(c, "job", "message_order", {"raw_meta": "map<string, string>"}).select("job", "message_order", "place", Col("raw_meta")["who"].alias("lang"))


@query("SELECT l_orderkey AS job, l_linenumber AS result_order, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 0 END AS memories FROM lineitem")
def journal_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(Col("l_orderkey").alias("job"), Col("l_linenumber").alias("result_order"), F.when(Col("l_linenumber") % 2 == 0, '["a","b"]').alias("memory_ids"))
    return P.journal(li, "job", "result_order", {"memory_ids": "array<string>"}).select("job", "result_order", "place", F.size("memory_ids").alias("memories"))


def _lists(name: str, sql: str, equal: dict[str, object], newest: list[str], source: str, id_: str, limit: int, offset: int = 0) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.listed(table(spark, sf_dir, source), equal, newest, limit, offset).select(id_)

    f.__name__ = name
    query(sql)(f)


_lists("feedback_list", "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100", {"event_type": "click", "user_id": None}, ["ts", "event_id"], "events", "event_id", 100)
_lists("trial_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50", {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None}, ["o_orderdate", "o_orderkey"], "orders", "o_orderkey", 50)
_lists("repair_list", "SELECT event_id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 50", {"user_id": 7}, ["ts", "event_id"], "events", "event_id", 50)
_lists("audit_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 20", {"o_orderstatus": "F"}, ["o_orderdate", "o_orderkey"], "orders", "o_orderkey", 50, 20)


@query(words("{mem,} e AS (SELECT episode_id, min(created_at) AS opened_at, max(updated_at) AS updated_at FROM memories GROUP BY 1) SELECT episode_id FROM e ORDER BY opened_at DESC, updated_at DESC, episode_id DESC LIMIT 50 OFFSET 10"))
def episode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = memories(spark, sf_dir).groupBy("episode_id").agg(F.min("created_at").alias("opened_at"), F.max("updated_at").alias("updated_at"))
    return P.listed(e, {}, ["opened_at", "updated_at", "episode_id"], 50, 10).select("episode_id")


# --- graphs ----------------------------------------------------------------------------
@query("WITH t AS (SELECT c_nationkey AS session, c_custkey AS id, ['pending', 'running', 'done', 'blocked', 'retry'][c_custkey % 5 + 1] AS s, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 END AS due FROM customer), b AS (SELECT session, id, due, CASE WHEN s = 'running' THEN 'retry' ELSE s END AS s FROM t), f AS (SELECT session, min(id) AS id FROM b WHERE s IN ('pending', 'retry', 'blocked') AND (due IS NULL OR due <= 3 OR s = 'blocked') GROUP BY 1) SELECT b.session, b.id, CASE WHEN f.id IS NOT NULL THEN 'running' ELSE s END AS status FROM b LEFT JOIN f ON f.session = b.session AND f.id = b.id")
def turn_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = Col("c_custkey")
    t = table(spark, sf_dir, "customer").select(Col("c_nationkey").alias("session"), k.alias("message_start"), _pick(["pending", "running", "done", "blocked", "retry"], k).alias("status"), F.when(k % 3 == 0, k % 7).alias("next_retry_at"))
    return P.turns_claimed(t, F.lit(3)).select("session", Col("message_start").alias("id"), "status")


_TASKS = "n AS (SELECT c_nationkey AS graph, c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'task' ELSE 'step' END AS kind FROM customer)"


@query(f"WITH RECURSIVE {EDGES}, {_TASKS}, r(graph, root, node) AS (SELECT graph, id, id FROM n WHERE kind = 'task' UNION SELECT r.graph, r.root, e.target FROM r JOIN edges e ON e.graph = r.graph AND e.source = r.node JOIN n ON n.graph = e.graph AND n.id = e.target AND n.kind <> 'task') SELECT graph::BIGINT AS graph, root, count(*) AS n FROM r GROUP BY 1, 2")
def task_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir)
    r = G.task_subgraph(n.filter("kind = 'task'").select("graph", Col("id").alias("root")), n, _edges(spark, sf_dir))
    return r.groupBy("graph", "root").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {EDGES}, a AS (SELECT c_nationkey AS graph, c_custkey AS k FROM customer WHERE c_custkey % 40 = 3), l AS (SELECT graph, k AS source, 1000000 + k AS target FROM a UNION SELECT graph, source, target FROM edges),
r(graph, node) AS (SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey % 7 = 0 UNION SELECT r.graph, l.target FROM r JOIN l ON l.graph = r.graph AND l.source = r.node),
lost AS (SELECT DISTINCT graph FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.graph = a.graph AND r.node = 1000000 + a.k)),
g AS (SELECT c_nationkey AS graph, count(*) AS nodes, count(*) FILTER (c_custkey % 7 = 0 AND c_custkey % 4 IN (0, 3) AND c_custkey % 9 <> 0) AS open_tasks, count(*) FILTER (c_custkey % 9 = 0) AS u FROM customer GROUP BY 1),
b AS (SELECT graph, nodes, graph IN (SELECT graph FROM lost) OR open_tasks > 1 AS bad FROM g)
SELECT graph::BIGINT AS graph, CASE WHEN bad THEN nodes ELSE nodes + (SELECT count(*) FROM a WHERE a.graph = b.graph) END AS nodes, NOT bad AS accepted FROM b""")
def graph_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fortieth customer brings a step below it, every ninth is done; a patch whose step no
    task reaches, or that leaves several tasks open, is not applied."""
    n, e = _nodes(spark, sf_dir).withColumn("id", Col("id").cast("string")), _edges(spark, sf_dir).select("graph", Col("source").cast("string").alias("source"), Col("target").cast("string").alias("target"), F.lit("continues").alias("type"))
    k = table(spark, sf_dir, "customer").filter("c_custkey % 40 = 3").select(Col("c_nationkey").cast("long").alias("graph"), Col("c_custkey").alias("k"))
    temp = F.concat(F.lit("new"), Col("k").cast("string"))
    added = k.select("graph", temp.alias("temp_id"), (Col("k") + 1000000).cast("string").alias("id"), F.lit("step").alias("kind"), F.lit("active").alias("status"))
    links = k.select("graph", Col("k").cast("string").alias("source"), temp.alias("target"), F.lit("continues").alias("type"))
    links = links.unionByName(links.withColumn("target", (Col("source").cast("long") + 25 * (Col("source").cast("long") % 3 + 1)).cast("string")))
    updates = n.filter("cast(id as long) % 9 = 0").select("graph", "id", F.lit("done").alias("status"), F.lit(1).alias("seq"))
    nodes, _, faults = P.patched(n, e, added, updates, links)
    bad = faults.select("graph").distinct().withColumn("bad", F.lit(True))
    return nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes")).join(bad, "graph", "left").select("graph", "nodes", Col("bad").isNull().alias("accepted"))


# --- records ---------------------------------------------------------------------------
def _info(spark: SparkSession, sf_dir: str, record: str, **fields: Column) -> DataFrame:
    m = memories(spark, sf_dir).withColumn("value", F.substring("value", 1, 200))
    told = F.to_json(F.struct(F.struct(F.struct(*[c.alias(n) for n, c in fields.items()]).alias(record), F.array(F.lit("f9")).alias("source_feedback_ids")).alias("internal_info")))
    return m.withColumn("info", F.when(Col("ord") % 10 == 9, "{}").otherwise(told))


@query(words("{mem} SELECT id, CASE WHEN ord % 3 = 0 THEN 'P' || ord ELSE memory_key END AS title, round(CASE WHEN ord % 8 = 1 THEN 0.7::DOUBLE ELSE least(1.0, greatest(0.0, 0.5 + score)) END, 6) AS confidence, CASE WHEN ord % 8 = 1 THEN 'active' ELSE 'candidate' END AS status, CASE WHEN ord % 8 = 5 THEN 'preference' ELSE 'success_pattern' END AS experience_type, ord % 3 <> 0 AS eligible, CASE WHEN ord % 3 = 0 THEN 'f1,f9' ELSE 'f9' END AS feedback, round(score, 6) AS salience, ord % 3 <> 0 AND ord % 8 <> 5 AS anchor FROM memories WHERE layer = 'L2' AND ord % 10 <> 9"))
def policy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth memory carries no record."""
    ordinal = Col("ord")
    three = ordinal % 3 == 0
    m = _info(
        spark, sf_dir, "policy", title=F.when(three, F.concat(F.lit("P"), ordinal.cast("string"))), gain=Col("score"), confidence=F.when(ordinal % 8 == 1, F.lit(0.7)), status=F.when(ordinal % 8 == 1, "active").otherwise("odd"),
        experience_type=F.when(ordinal % 8 == 5, "preference"), skill_eligible=F.when(three, F.lit(False)), source_feedback_ids=F.when(three, F.array(F.lit("f1"), F.lit("f9"))),
    )
    r = m.select("id", D.policy_meta(Col("layer"), Col("info"), Col("memory_key"), Col("value")).alias("p")).filter("p is not null").select("id", "p.*")
    return r.select("id", "title", F.round("confidence", 6).alias("confidence"), "status", "experience_type", "eligible", F.array_join("source_feedback_ids", ",").alias("feedback"), F.round("salience", 6).alias("salience"), P.success_anchor(r).alias("anchor"))


def _skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordinal = Col("ord")
    blurb = F.when(ordinal % 3 == 0, F.struct(F.lit("how to").alias("retrieval_blurb"), F.lit("when asked").alias("triggerContext")))
    m = _info(spark, sf_dir, "skill", name=F.when(ordinal % 5 != 0, F.concat(F.lit("S"), ordinal.cast("string"))), trials_attempted=(ordinal % 6).cast("double"), trials_passed=F.least(ordinal % 3, ordinal % 6).cast("double"), repairOrigin=F.when(ordinal % 7 == 0, F.lit(1)), procedure_json=blurb, evidence_anchor_ids=F.array(F.lit("e1")), evidence_anchors=F.when(ordinal % 2 == 1, F.array(F.lit("e2"))))
    return m.withColumn("s", D.skill_meta(Col("layer"), Col("info"), Col("memory_key"), Col("value")))


@query(words("{mem} SELECT id, CASE WHEN ord % 5 <> 0 THEN 'S' || ord ELSE memory_key END AS name, CASE WHEN ord % 3 = 0 THEN 'how to' END AS blurb, (ord % 6)::DOUBLE AS attempted, coalesce(ord % 7 = 0, false) AS repair_origin, round(CASE WHEN ord % 6 = 0 THEN 0 ELSE least(ord % 3, ord % 6) / (ord % 6) END, 6) AS success_rate, round((least(ord % 3, ord % 6) + 1) / (ord % 6 + 2), 6) AS posterior_mean, 'e1,e2' AS anchors FROM memories WHERE layer = 'Skill' AND ord % 10 <> 9"))
def skill_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _skills(spark, sf_dir).filter("s is not null").select("id", "s.*")
    return r.select("id", "name", "blurb", "attempted", "repair_origin", F.round("success_rate", 6).alias("success_rate"), F.round("posterior_mean", 6).alias("posterior_mean"), F.array_join("evidence_anchor_ids", ",").alias("anchors"))


def _worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordinal = Col("ord")
    fact = F.struct(F.struct(F.array(F.struct(F.lit("os").alias("label"), F.lit("linux").alias("description"))).alias("environment"), F.array(F.struct(F.lit("fast").alias("label"))).alias("inference")).alias("x")).getField("x")
    m = _info(spark, sf_dir, "world_model", title=F.when(ordinal % 3 == 0, " World "), domain_tags=F.array(F.lit("a"), F.lit("b")), cohesion=F.when(ordinal % 5 == 0, Col("score")), admission=F.when(ordinal % 4 == 2, "loose"), structure=fact, summary=F.when(ordinal % 6 == 0, F.lit("sum")))
    return m.withColumn("w", D.world_meta(Col("layer"), Col("info"), Col("memory_key"), Col("value"), Col("id")))


_VALUE = "left(value, 200)"
_LINE = "list_filter(list_transform(string_split(left(value, 200), chr(10)), lambda l: trim(l)), lambda l: l <> '')[1]"


@query(words(f"{{mem}} SELECT id, coalesce(CASE WHEN ord % 3 = 0 THEN 'World' END, {_LINE}, memory_key) AS title, '__generic|_' AS domain_key, round(CASE WHEN ord % 5 = 0 THEN score ELSE 1 END, 6) AS cohesion, CASE WHEN ord % 4 = 2 THEN 'loose' ELSE 'strict' END AS admission, 2 AS facts, CASE WHEN ord % 6 = 0 THEN 'sum' END AS summary FROM memories WHERE layer = 'L3' AND ord % 10 <> 9"))
def world_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _worlds(spark, sf_dir).filter("w is not null").select("id", "w.*")
    return r.select("id", "title", "domain_key", F.round("cohesion", 6).alias("cohesion"), "admission", F.size("facts").alias("facts"), "summary")


@query(words(f"{{mem,}} k AS (SELECT *, {_VALUE} AS v, {_LINE} AS l, array_to_string(tags, ' ') AS g FROM memories) SELECT id, CASE WHEN layer = 'Skill' AND ord % 10 <> 9 THEN CASE WHEN ord % 5 <> 0 THEN 'S' || ord ELSE memory_key END || chr(10) || CASE WHEN ord % 3 = 0 THEN 'how to' || chr(10) || 'when asked' ELSE v END || chr(10) || g WHEN layer = 'L3' AND ord % 10 <> 9 THEN coalesce(CASE WHEN ord % 3 = 0 THEN 'World' END, l, memory_key) || chr(10) || CASE WHEN ord % 6 = 0 THEN 'sum' || chr(10) ELSE '' END || 'a b' || CASE WHEN ord % 6 = 0 THEN chr(10) || 'os: linux' || chr(10) || 'fast' WHEN v <> '' THEN chr(10) || v ELSE '' END ELSE v END AS document FROM k WHERE value <> ''"))
def retrieval_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _skills(spark, sf_dir).select("id", "layer", "value", "tags", "s")
    w = _worlds(spark, sf_dir).select(Col("id").alias("_w"), "w")
    told = s.join(w, Col("id") == Col("_w")).filter("value <> ''")
    return told.select("id", D.retrieval_document(Col("s"), Col("w"), Col("value"), Col("tags")).alias("document"))


@query(words("{mem,} k AS (SELECT *, left(value, 200) AS v, len(regexp_extract_all(value, '[A-Za-z0-9]+')) AS n FROM memories WHERE value <> '' AND layer IN ('L1', 'L2')) SELECT id, CASE WHEN layer = 'L1' THEN 'S' || ord || CASE WHEN ord % 8 = 0 THEN chr(10) || 'R' ELSE '' END WHEN ord % 10 = 9 THEN v WHEN ord % 3 = 0 THEN CASE WHEN len(regexp_extract_all(v, '[A-Za-z0-9]+')) > 20 THEN 'T' || ord ELSE 'T' || ord || chr(10) || v END ELSE 'T' || ord || chr(10) || v || chr(10) || v END AS text FROM k"))
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warning policies of over 20 tokens are embedded by their title."""
    ordinal = Col("ord")
    m = _info(spark, sf_dir, "policy", title=F.concat(F.lit("T"), ordinal.cast("string")), trigger=F.substring("value", 1, 200), evidence_polarity=F.when(ordinal % 3 == 0, "negative"))
    m = m.filter(Col("layer").isin("L1", "L2") & (Col("value") != ""))
    p = D.policy_meta(Col("layer"), Col("info"), Col("memory_key"), Col("value"))
    first = Col("layer") == "L1"
    summary, reflection = F.when(first, F.concat(F.lit("S"), ordinal.cast("string"))), F.when(first & (ordinal % 8 == 0), "R")
    return m.select("id", D.embedding_text(summary, reflection, p, Col("value"), T.mixed_tokens(Col("value")) > 20).alias("text"))


# --- numbers and texts -----------------------------------------------------------------
@query("WITH e AS (SELECT event_id, 0.7 * least(event_id % 13 / 10.0::DOUBLE, 1) + 0.3 * (event_id % 7 / 10.0::DOUBLE) AS eta FROM events) SELECT event_id, round(eta, 6) AS eta, CASE WHEN event_id % 3 = 0 THEN 'archived' WHEN round(eta, 6) < 0.3 THEN 'archived' ELSE 'active' END AS status FROM e")
def eta_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Col("event_id")
    eta = F.round(S.eta_after_drift(i % 13 / 10.0, i % 7 / 10.0), 6)
    return table(spark, sf_dir, "events").select("event_id", eta.alias("eta"), S.status_after_drift(F.when(i % 3 == 0, "archived").otherwise("active"), eta).alias("status"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]')) + len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS mixed, ceil((length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))) / 4)::BIGINT AS estimate FROM documents WHERE text IS NOT NULL")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", T.mixed_tokens(Col("text")).cast("long").alias("mixed"), T.token_estimate(Col("text")).alias("estimate"))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity * l_discount >= 0 THEN floor(l_quantity * l_discount + 0.5) END)::BIGINT AS whole FROM lineitem")
def rounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Col("l_quantity") * Col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.round_exact(x, 0).cast("long").alias("whole"))


@query("SELECT event_id, least(30000 * power(2, event_id % 12 - 1), 3600000)::BIGINT AS wait FROM events WHERE event_id % 12 >= 1")
def retry_backoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_id % 12 >= 1").select("event_id", S.retry_backoff_ms(Col("event_id") % 12).cast("long").alias("wait"))


_MODES = ("tool_driven", "sub_agent", "skill_invoke", "decision_repair", "world_model", "turn_start", "search")


@query("SELECT DISTINCT event_type AS mode, CASE WHEN event_type = 'search' THEN 'Skill,L2,L1,L3' ELSE 'Skill,L2,L1,L3' END AS layers FROM events UNION ALL SELECT * FROM (VALUES ('tool_driven', 'L2,L1,L3'), ('sub_agent', 'L2,L1,L3'), ('skill_invoke', 'Skill,L2,L1'), ('decision_repair', 'Skill,L2,L1'), ('world_model', 'L3'), ('turn_start', 'Skill,L2,L1,L3'))")
def mode_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes that are not known search all layers."""
    modes = table(spark, sf_dir, "events").select(Col("event_type").alias("mode")).distinct().unionByName(spark.createDataFrame([(m,) for m in _MODES[:-1]], "mode string"))
    known = F.create_map(*[x for m in _MODES for x in (F.lit(m), F.lit(",".join(M.layers_for(m))))])
    return modes.select("mode", F.coalesce(known[Col("mode")], F.lit(",".join(M.layers_for()))).alias("layers"))


@query("SELECT conv_id, max(turn) AS last_turn, md5(string_agg(text, chr(10) ORDER BY turn)) AS content_hash FROM conversations GROUP BY 1")
def checkpoint_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.checkpoints_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "last_turn", "content_hash")


@query("""SELECT event_id, sha256('{"kind":"' || event_type || '","user":' || user_id || '}') AS hash FROM events""")
def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", M.stable_hash_of(user=Col("user_id"), kind=Col("event_type")).alias("hash"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_:-]{12,}'), lambda t: length(t) >= 16 AND regexp_matches(t, '[_:0-9-]') AND regexp_matches(t, '[A-Za-z]'))) > 0 AS found FROM documents")
def identifier_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.holds_identifier(Col("text")).alias("found"))
