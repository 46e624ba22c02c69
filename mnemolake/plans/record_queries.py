"""Registered queries over the remaining reads, writes and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions import rules as R
from mnemolake.operators import filters as P
from mnemolake.operators import graph as G
from mnemolake.operators import records as D
from mnemolake.operators import retrieval as X
from mnemolake.plans.queries import EDGES, Col, _edges, _first_vector, _nodes, query, words
from mnemolake.plans.search import search
from mnemolake.plans.views import jobs, memories, table


def _pick(values: list[str], by: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


@query()
def retrieval_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: routes, ranks, fusion, caps, threshold, diversity, score floor."""
    v = table(spark, sf_dir, "embeddings").select(Col("vec_id").alias("_v"), Col("embedding").alias("vector"))
    m = memories(spark, sf_dir)
    return search(m.join(v, Col("ord") == Col("_v"), "left").drop("_v"), "Apache License version, public domain", _first_vector(spark, sf_dir), 1707955200000).select("id", "tier", F.round("score", 5).alias("score"), "place")


@query(words("{mem} SELECT id, CASE WHEN ord % 4 = 0 THEN ord * 10 END AS ts, CASE WHEN ord % 4 = 0 THEN episode_id END AS episode FROM memories"))
def trace_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = F.when(Col("ord") % 4 == 0, F.to_json(F.struct(F.struct(F.struct((Col("ord") * 10).alias("ts"), "episode_id").alias("trace")).alias("internal_info")))).otherwise('{"internal_info":{}}')
    t = D.meta(info, "trace", D.TRACE_SCHEMA)
    return memories(spark, sf_dir).select("id", t["ts"].alias("ts"), t["episode_id"].alias("episode"))


@query("SELECT vec_id AS id, f AS field, len(embedding)::INT AS dim FROM embeddings, (VALUES ('vec_summary'), ('vec_action')) AS v(f) WHERE f = 'vec_summary' OR vec_id % 2 = 0")
def vector_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(Col("vec_id").alias("id"), Col("embedding").alias("vec_summary"), F.when(Col("vec_id") % 2 == 0, Col("embedding")).alias("vec_action"))
    return D.vector_rows(e)[1].select("id", "field", "dim")


@query("SELECT vec_id AS id, (1 + (vec_id % 2 = 0)::INT)::INT AS n FROM embeddings")
def vector_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(Col("vec_id").alias("id"), Col("embedding").alias("vec_summary"), F.when(Col("vec_id") % 2 == 0, Col("embedding")).alias("vec_action"))
    return D.hydrated(e.select("id"), D.vector_rows(e)[1]).select("id", F.size("vectors").alias("n"))


@query(r"SELECT conv_id * 1000 + turn AS id, CASE WHEN length(t) <= 140 THEN t ELSE left(t, 137) || '...' END AS summary FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user') WHERE trim(text) <> ''")
def trace_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select((Col("conv_id") * 1000 + Col("turn")).alias("id"), Col("conv_id").alias("episode_id"), Col("text").alias("user_text"), F.lit("").alias("agent_text"))
    return D.captured(c).select("id", "summary")


@query("""SELECT event_id, 'span_' || left(sha256('"t' || event_id || ':0:' || event_id % 9 || '"'), 20) AS span FROM events""")
def span_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", D.span_id(F.concat(F.lit("t"), "event_id"), F.lit(0), Col("event_id") % 9).alias("span"))


@query(words("{jobs} SELECT id, CASE job_type WHEN 'trace_summary' THEN job_type || ':' || target_id || ':' || CASE WHEN id % 3 = 0 THEN 'h' ELSE 'current' END WHEN 'import_summary' THEN job_type || ':' || target_id || ':' || CASE WHEN id % 3 = 0 THEN 'h' ELSE 'current' END WHEN 'embedding' THEN job_type || ':' || target_id || ':' || CASE WHEN id % 3 = 0 THEN 'h' ELSE 'current' END WHEN 'reflection' THEN job_type || ':' || CASE WHEN id % 2 = 0 THEN 'ep' ELSE target_id END WHEN 'reward' THEN job_type || ':' || CASE WHEN id % 2 = 0 THEN 'ep' ELSE target_id END WHEN 'l2_association' THEN job_type || ':' || target_id WHEN 'skill_trial_resolve' THEN job_type || ':' || target_id END AS key FROM jobs"))
def job_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = D.job_dedupe_key(Col("job_type"), F.when(Col("id") % 2 == 0, "ep"), Col("target_id"), F.when(Col("id") % 3 == 0, "h"))
    return jobs(spark, sf_dir).select("id", key.alias("key"))


@query("SELECT min(o_orderkey) AS id, o_custkey % 500 AS key FROM orders WHERE o_custkey % 500 NOT IN (SELECT event_id % 500 FROM events WHERE event_id % 10 < 6) GROUP BY 2")
def job_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "events").select((Col("event_id") % 500).alias("key"), F.when(Col("event_id") % 10 < 6, "queued").otherwise("succeeded").alias("status"))
    new = table(spark, sf_dir, "orders").select(Col("o_orderkey").alias("id"), (Col("o_custkey") % 500).alias("key"))
    return D.enqueued(old, new)


@query(words("{mem} SELECT id, CASE layer WHEN 'L1' THEN 'trace' WHEN 'L2' THEN 'policy' WHEN 'L3' THEN 'world_model' ELSE 'skill' END AS kind, CASE status WHEN 'archived' THEN 'archived' WHEN 'deleted' THEN 'deleted' ELSE 'updated' END AS op FROM memories"))
def change_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", D.change_kind(Col("layer")).alias("kind"), D.change_op(Col("status")).alias("op"))


@query("""SELECT source, max("at") AS "at" FROM (SELECT event_type AS source, max(ts) AS "at" FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT event_type, ts FROM events WHERE event_id % 2 = 1) GROUP BY 1""")
def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(Col("event_type").alias("source"), Col("ts").alias("at"), "event_id")
    return D.advanced(e.filter("event_id % 2 = 0").groupBy("source").agg(F.max("at").alias("at")), e.filter("event_id % 2 = 1"))


@query("SELECT user_id AS stream, c FROM (SELECT user_id, event_id // 3 % 50 AS c, lag(event_id // 3 % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> c GROUP BY 1, 2 HAVING count(*) > 1")
def contiguity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(Col("user_id").alias("stream"), F.expr("event_id div 3 % 50").alias("c"), "event_id")
    return D.discontiguous(e, "c", "event_id")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 2 = 0 THEN 'replay' ELSE 'conflict' END AS outcome FROM orders")
def idempotent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(Col("o_orderkey").alias("key"), Col("o_orderstatus").alias("hash"))
    known = o.filter("key % 3 <> 0").withColumn("hash", F.when(Col("key") % 2 == 0, Col("hash")).otherwise("?"))
    return D.idempotent(o, known).select("key", "outcome")


@query("SELECT event_id AS id, round(least(1.0, greatest(0.1, 0.5 * least(greatest(value / 100, 0), 1) + 0.5 * least(1, event_id % 4))), 6) AS eta FROM events WHERE event_id % 3 = 0 AND value / 100 >= 0.02 AND event_id % 4 >= 1 AND event_id % 5 <> 0")
def skill_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Col("event_id")
    p = table(spark, sf_dir, "events").select(i.alias("id"), _pick(["active", "candidate", "archived"], i).alias("status"), (Col("value") / 100).alias("gain"), (i % 4).cast("double").alias("support"), F.lit(True).alias("eligible"), F.when(i % 5 == 0, "preference").otherwise("success").alias("experience_type"), F.lit("positive").alias("polarity"))
    return D.skill_draft(p).select("id", F.round("eta", 6).alias("eta"))


@query("SELECT p AS policy, arg_max(id, (u, id)) AS skill FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS u, unnest([l_suppkey, l_suppkey + 1]) AS p, l_returnflag FROM lineitem) WHERE l_returnflag <> 'R' GROUP BY 1")
def existing_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((Col("l_orderkey") * 10 + Col("l_linenumber")).alias("id"), Col("l_shipdate").alias("updated_at"), F.array(Col("l_suppkey"), Col("l_suppkey") + 1).alias("policy_ids"), F.when(Col("l_returnflag") == "R", "archived").otherwise("active").alias("status"))
    return D.existing_skill(li)


@query("WITH f AS (SELECT event_id AS fid, CASE WHEN event_id % 2 = 0 THEN event_id % 90 END AS t, event_id % 70 AS e FROM events), p AS (SELECT o_orderkey AS trial, o_orderkey % 90 AS t, o_custkey % 70 AS e, o_orderdate AS d FROM orders WHERE o_orderstatus = 'O'), j AS (SELECT fid, trial, d FROM f JOIN p ON f.t = p.t UNION ALL SELECT fid, trial, d FROM f JOIN p ON f.t IS NULL AND f.e = p.e) SELECT fid AS feedback_id, trial AS trial_id FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY d DESC, trial) AS n FROM j) WHERE n <= 20")
def pending_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").select(Col("event_id").alias("feedback_id"), F.when(Col("event_id") % 2 == 0, Col("event_id") % 90).alias("turn_id"), (Col("event_id") % 70).alias("episode_id"))
    t = table(spark, sf_dir, "orders").select(Col("o_orderkey").alias("trial_id"), (Col("o_orderkey") % 90).alias("turn_id"), (Col("o_custkey") % 70).alias("episode_id"), Col("o_orderdate").alias("at"), F.when(Col("o_orderstatus") == "O", "pending").otherwise("pass").alias("outcome"))
    return D.pending_trials(f, t)


@query(words("{mem,} s AS (SELECT source, score, CASE WHEN score >= 0.5 THEN 'high' WHEN score <= 0 THEN 'low' END AS side FROM memories) SELECT source FROM s GROUP BY source HAVING avg(score) FILTER (side = 'high') - avg(score) FILTER (side = 'low') >= 0.5 AND source NOT IN ('src1', 'src2')"))
def value_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).select("source", "score", F.when(Col("score") >= 0.5, "high").when(Col("score") <= 0, "low").alias("side"))
    return D.repairs(m, spark.createDataFrame([("src1",), ("src2",)], "source string"), "source", "score").select("source")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS ids, round(CASE WHEN c_custkey % 2 = 0 THEN least(c_custkey % 10 / 10.0::DOUBLE + 0.05, 1.0) ELSE c_custkey % 10 / 10.0::DOUBLE END, 6) AS confidence FROM customer")
def world_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(Col("c_custkey").alias("key"), F.array(F.lit("a"), F.lit("b")).alias("policy_ids"), F.array(Col("c_mktsegment")).alias("tags"), (Col("c_custkey") % 10 / 10.0).alias("confidence"))
    new = c.filter("key % 2 = 0").withColumn("policy_ids", F.array(F.lit("c"), F.lit("b")))
    return D.merged_world(c, new).select("key", F.array_join("policy_ids", ",").alias("ids"), F.round("confidence", 6).alias("confidence"))


@query(words("{mem} SELECT id, ord % 3 = 0 AS retry_scheduled FROM memories WHERE ord % 4 IN (0, 2)"))
def processing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    s = m.select(Col("id").alias("memory_id"), _pick(["summary_pending", "done", "embedding_pending", "failed"], Col("ord")).alias("state"), "updated_at")
    r = m.filter("ord % 3 = 0").select(Col("id").alias("target_id"))
    return D.processing(s, r, ("summary_pending", "embedding_pending")).select(Col("memory_id").alias("id"), "retry_scheduled")


@query("SELECT conv_id AS seq, string_agg(CASE WHEN turn % 2 = 0 THEN 'now' || turn ELSE 'old' END, ',' ORDER BY turn) AS summaries FROM conversations GROUP BY 1")
def log_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    hit = F.struct(Col("turn").cast("string").alias("id"), F.lit("old").alias("summary"))
    log = c.groupBy(Col("conv_id").alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", hit.alias("h")))), lambda s: s["h"]).alias("hits"))
    now = c.select("turn").distinct().filter("turn % 2 = 0").select(Col("turn").cast("string").alias("id"), F.concat(F.lit("now"), "turn").alias("summary"))
    return D.current_summaries(log, now).select("seq", F.array_join(F.transform("hits", lambda h: h["summary"]), ",").alias("summaries"))


@query("SELECT conv_id, md5(string_agg(n || '. ' || text, chr(10) ORDER BY turn)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.context_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("context").alias("digest"))


@query("""SELECT event_id, '{"api_key": "[redacted]", "k": ' || (props->>'$.k') || '}' AS config FROM events""")
def config_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", D.redacted_config(F.concat(F.lit('{"api_key": "abc", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))).alias("config"))


@query("SELECT event_type || ':' || user_id % 3 || ':' || event_id % 40 AS key, max(event_id) AS event_id FROM events GROUP BY 1")
def usage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("key", D.usage_key(Col("event_type"), (Col("user_id") % 3).cast("string"), (Col("event_id") % 40).cast("string")))
    return e.groupBy("key").agg(F.max("event_id").alias("event_id"))


@query("WITH s AS (SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) AS c FROM embeddings), a AS (SELECT label, avg(round(c, 6)) FILTER (round(c, 6) >= 0.05) AS m FROM s GROUP BY 1) SELECT label, round(m, 5) AS score FROM a WHERE m IS NOT NULL")
def bucket_policy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the passing similarities of a bucket's traces, per policy."""
    from mnemolake.functions.vector import cosine

    v = F.array(*map(F.lit, _first_vector(spark, sf_dir)))
    s = table(spark, sf_dir, "embeddings").select("label", F.round(cosine(Col("embedding"), v), 6).alias("c"))
    return s.groupBy("label").agg(F.avg(F.when(Col("c") >= 0.05, Col("c"))).alias("m")).filter("m is not null").select("label", F.round("m", 5).alias("score"))


@query(words("{mem} SELECT id FROM memories m WHERE layer = 'L2' AND ('mem_' || (ord - 1) IN (SELECT id FROM memories WHERE score > 0.655) OR episode_id IN (SELECT episode_id FROM memories WHERE score > 0.655))"))
def context_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies linked to injected memories by trace or by episode."""
    m = memories(spark, sf_dir)
    used = m.filter("score > 0.655")
    p = m.filter("layer = 'L2'").withColumn("trace", F.concat(F.lit("mem_"), Col("ord") - 1))
    by_trace, by_episode = P.having(p, used, "trace", "id"), P.having(p, used, "episode_id", "episode_id")
    return by_trace.select("id").unionByName(by_episode.select("id")).distinct()


@query(words("{mem} SELECT source, count(DISTINCT coalesce(CASE WHEN ord % 5 = 0 THEN NULL ELSE episode_id END, id)) AS support FROM memories GROUP BY 1"))
def policy_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.when(Col("ord") % 5 == 0, None).otherwise(Col("episode_id"))
    return memories(spark, sf_dir).groupBy("source").agg(F.count_distinct(F.coalesce(e, "id")).alias("support"))


@query("SELECT c_nationkey::BIGINT AS graph, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey % 7 = 0 OR c_custkey % 4 IN (0, 3)) DESC, c_acctbal DESC, c_custkey * 13 % 97 DESC, c_custkey) AS n FROM customer) WHERE c_custkey % 7 = 0 OR c_custkey % 4 IN (0, 3) OR n <= 40 GROUP BY 1")
def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.builder_context(_nodes(spark, sf_dir), 40).groupBy("graph").agg(F.count(F.lit(1)).alias("n"))


_ADDED = "c_custkey % 21 = 0"


@query(f"""WITH {EDGES}, t AS (SELECT c_nationkey AS graph, c_custkey AS id, ['active', 'done', 'frozen', 'blocked'][c_custkey % 4 + 1] AS status, {_ADDED} AS added FROM customer WHERE c_custkey % 7 = 0),
i AS (SELECT a.graph, a.id, CASE WHEN e.source % 3 = 0 THEN 'supersedes' ELSE 'continues' END AS type, CASE WHEN o.status = 'done' THEN 'continues' WHEN o.status = 'frozen' THEN 'supersedes' END AS want FROM t a JOIN edges e ON e.graph = a.graph AND e.target = a.id LEFT JOIN t o ON o.graph = e.graph AND o.id = e.source WHERE a.added)
SELECT graph::BIGINT AS graph, 'several open tasks' AS fault FROM t WHERE status IN ('active', 'blocked') GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT graph::BIGINT, 'added task is not open' FROM t WHERE added AND status NOT IN ('active', 'blocked')
UNION ALL SELECT graph::BIGINT, 'transition does not fit' FROM i GROUP BY graph, id HAVING count(*) <> 1 OR NOT coalesce(bool_or(type = want), false)""")
def graph_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three faults: every third task is one that was added."""
    added = table(spark, sf_dir, "customer").filter(_ADDED).select(Col("c_nationkey").cast("long").alias("graph"), Col("c_custkey").alias("node"))
    kinds = F.when(Col("source") % 3 == 0, "supersedes").otherwise("continues")
    return G.transition_faults(_nodes(spark, sf_dir), _edges(spark, sf_dir).withColumn("type", kinds), added)


@query("SELECT doc_id, term, tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2)")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
