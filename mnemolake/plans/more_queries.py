"""More registered queries: reads, lifecycle, routes, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions import memory as M
from mnemolake.functions import scoring as S
from mnemolake.functions import text as T
from mnemolake.functions import vector as V
from mnemolake.operators import aggregates as A
from mnemolake.operators import filters as P
from mnemolake.operators import graph as G
from mnemolake.operators import lifecycle as L
from mnemolake.operators import queues as Q
from mnemolake.operators import retrieval as X
from mnemolake.operators import sessions as C
from mnemolake.plans.queries import BM25, CENTROIDS, HITS, TERMS, Col, _candidates, _edges, _first_vector, _hits, _nodes, _ranked, query, words
from mnemolake.plans.views import MEMORIES, TURNS, jobs, memories, table, turns


# --- lookups and existence -------------------------------------------------------------
@query(words("{mem} SELECT id, layer, value FROM memories WHERE id = 'mem_5' AND NOT deleted"))
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.live(memories(spark, sf_dir)).filter("id = 'mem_5'").select("id", "layer", "value")


@query(words("{mem} SELECT count(*) AS n FROM memories WHERE NOT deleted AND layer = 'L1' AND status = 'activated'"))
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.memory_filter(memories(spark, sf_dir), {"layer": "L1", "status": "activated"}).agg(F.count(F.lit(1)).alias("n"))


@query(words("{mem} SELECT user_id, bool_or(ord IN (SELECT vec_id FROM embeddings)) AS has_vectors FROM memories WHERE NOT deleted GROUP BY user_id"))
def has_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.live(memories(spark, sf_dir))
    with_one = P.having(m, table(spark, sf_dir, "embeddings"), "ord", "vec_id").select(Col("user_id").alias("u")).distinct()
    return m.select("user_id").distinct().join(with_one, Col("user_id") == Col("u"), "left").select("user_id", Col("u").isNotNull().alias("has_vectors"))


@query(words("{mem} SELECT id FROM memories m WHERE NOT deleted AND EXISTS (SELECT 1 FROM events e WHERE 'mem_' || e.event_id = m.id AND e.event_id % 10 IN (4, 5, 6, 7))"))
def unprocessed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.having(P.live(memories(spark, sf_dir)), jobs(spark, sf_dir).withColumn("own", F.concat(F.lit("mem_"), "id")).filter("status in ('leased', 'failed', 'dead_letter')"), "id", "own").select("id")


@query("SELECT event_id, ts FROM events WHERE event_id % 5 = 1 AND (event_id % 3 = 0 OR ts >= '2024-01-20') ORDER BY ts, event_id LIMIT 200")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("expires_at", F.when(Col("event_id") % 3 == 0, None).otherwise(Col("ts")))
    live = e.filter((Col("event_id") % 5 == 1) & (Col("expires_at").isNull() | (Col("expires_at") >= F.lit("2024-01-20").cast("timestamp"))))
    return live.orderBy("ts", "event_id").limit(200).select("event_id", "ts")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'failure_avoidance' ELSE 'success' END AS kind, CASE WHEN event_id % 2 = 1 AND event_id % 3 <> 0 THEN TRUE ELSE value / 100 >= 0.6 AND event_id % 7 <> 0 END AS eligible FROM events")
def avoidance_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Col("event_id")
    kind = F.when(i % 2 == 0, "failure_avoidance").otherwise("success")
    trigger = F.when(i % 7 == 0, " ").otherwise("on error")
    ok = M.avoidance_eligible(kind, F.when(i % 3 == 0, "negative").otherwise("positive"), Col("value") / 100, trigger, F.array(F.lit("Retry "), F.lit("wait")), F.array(F.lit("retry")))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), ok.alias("eligible"))


@query("SELECT s.s_suppkey AS source, count(l.l_orderkey) AS seen FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R' GROUP BY 1")
def source_seen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return s.join(li, Col("s_suppkey") == Col("l_suppkey"), "left").groupBy(Col("s_suppkey").alias("source")).agg(F.count("l_orderkey").alias("seen"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 3 OR l_partkey = 7 ORDER BY l_orderkey, l_linenumber LIMIT 100")
def link_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_suppkey = 3 or l_partkey = 7").orderBy("l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber")


@query(words("{mem} SELECT episode_id, count(*) AS n FROM memories m WHERE episode_id = 'ep_3' OR EXISTS (SELECT 1 FROM conversations c WHERE 'ep_' || c.conv_id = m.episode_id AND contains(lower(c.text), 'error')) GROUP BY 1"))
def episode_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = memories(spark, sf_dir).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))
    t = table(spark, sf_dir, "conversations").withColumn("ep", F.concat(F.lit("ep_"), "conv_id"))
    hit = t.filter(F.contains(F.lower("text"), F.lit("error"))).select(Col("ep").alias("_e")).distinct()
    return e.join(hit, Col("episode_id") == Col("_e"), "left").filter((Col("episode_id") == "ep_3") | Col("_e").isNotNull()).select("episode_id", "n")


# --- search routes ---------------------------------------------------------------------
@query(f"WITH {BM25} SELECT doc_id, (1.0 / row_number() OVER (ORDER BY round(s, 6) DESC, doc_id))::DOUBLE AS score FROM b ORDER BY round(s, 6) DESC, doc_id LIMIT 20")
def fts_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS).withColumn("s", F.round("bm25", 6))
    return X.rank_score(b, [F.desc("s"), Col("doc_id")], 20).select("doc_id", "score")


@query(words("{mem} SELECT count(*) AS n FROM memories WHERE NOT deleted AND status IN ('activated', 'resolving') AND (contains(lower(value), 'public domain') OR contains(lower(value), 'public') OR contains(lower(value), 'domain') OR contains(memory_key, 'public') OR contains(lower(id), 'domain'))"))
def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.memory_filter(memories(spark, sf_dir), within={"status": ["activated", "resolving"]})
    return P.substring_search(m, "Public domain", tags=False).agg(F.count(F.lit(1)).alias("n"))


@query(words("{mem} SELECT id, 1.0::DOUBLE / (10 + n) AS score FROM (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id DESC) - 10 AS n FROM memories WHERE NOT deleted AND contains(lower(value), 'the')) WHERE n BETWEEN 1 AND 15"))
def panel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.substring_search(P.live(memories(spark, sf_dir)).select("id", "memory_key", "value", "tags", "updated_at"), "the", tags=False)
    return X.rank_score(found.select("id", "updated_at"), [F.desc("updated_at"), F.desc("id")], 15, 10).select("id", "score")


@query("WITH" + HITS + " SELECT id, channel, round(raw, 6) AS raw FROM h")
def route_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("id", "channel", F.round("raw", 6).alias("raw"))


@query("WITH" + HITS + " SELECT id, min(rank) AS best_rank, arg_min(channel, (rank, channel)) AS channel FROM s GROUP BY id")
def channel_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir)
    return r.groupBy("id").agg(F.min("rank").cast("long").alias("best_rank"), F.min_by("channel", F.struct("rank", "channel")).alias("channel"))


@query("WITH" + HITS + ", e AS (SELECT episode_id FROM p WHERE layer = 'L1' GROUP BY 1 HAVING count(*) >= 1 AND max(value) >= 0.3) SELECT id FROM p WHERE layer = 'L1' AND episode_id NOT IN (SELECT episode_id FROM e)")
def episode_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.capped(_candidates(spark, sf_dir)).filter("layer = 'L1'")
    e = p.groupBy("query_id", "episode_id").agg(F.max("value").alias("v")).filter("v >= 0.3")
    return X.without_covered_traces(p, e).select("id")


@query("SELECT v, p FROM (SELECT v, min(i) AS p FROM (SELECT unnest(['b', 'a', 'b', 'c', 'a']) AS v, unnest([0, 1, 2, 3, 4]) AS i) GROUP BY v)")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(["b", "a", "b", "c", "a"],)], "vs array<string>")
    return d.select("vs", F.explode(F.array_distinct("vs")).alias("v")).select("v", (F.array_position("vs", Col("v")) - 1).cast("int").alias("p"))


@query("WITH v AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) AS s FROM embeddings WHERE label = 99 OR (NOT EXISTS (SELECT 1 FROM embeddings WHERE label = 99))) SELECT vec_id, round(s, 5) AS score FROM v ORDER BY s DESC, vec_id LIMIT 5")
def tagged_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged vectors if there are any, else all: one plan, the choice a scalar."""
    e = table(spark, sf_dir, "embeddings")
    tagged = e.agg(F.max((Col("label") == 99).cast("int")).alias("some"))
    pool = e.crossJoin(F.broadcast(tagged)).filter((Col("label") == 99) | (Col("some") == 0))
    v = F.array(*map(F.lit, _first_vector(spark, sf_dir)))
    return X.vector_topk(pool, v, "vec_id", "embedding", 5).select("vec_id", F.round("score", 5).alias("score"))


@query(words("{mem} SELECT id FROM (SELECT id, updated_at FROM memories WHERE NOT deleted AND layer = 'L1' AND created_at >= '2024-01-01' AND created_at < '2024-01-20' ORDER BY created_at DESC, id DESC LIMIT 20)"))
def time_filtered_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.memory_filter(memories(spark, sf_dir), {"layer": "L1"}, since="2024-01-01", until="2024-01-20")
    return m.orderBy(F.desc("created_at"), F.desc("id")).limit(20).orderBy("created_at").select("id")


@query("WITH" + HITS + " SELECT id FROM (SELECT id, row_number() OVER (ORDER BY relevance DESC, channels DESC, vector_score DESC, id) AS n FROM c) WHERE n <= 6")
def fallback_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).orderBy(F.desc("relevance"), F.desc("channels"), F.desc("vector_score"), "id").limit(6).select("id")


# --- panels ----------------------------------------------------------------------------
@query(words("{mem} SELECT layer, count(*) AS n, count(*) FILTER (status = 'archived') AS archived, max(updated_at) AS last_at FROM memories WHERE NOT deleted GROUP BY layer"))
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.live(memories(spark, sf_dir)).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(Col("status") == "archived", 1)).alias("archived"), F.max("updated_at").alias("last_at"))


@query("SELECT d::DATE::VARCHAR AS date, count(e.ts) AS n FROM generate_series(DATE '2023-01-26', DATE '2024-01-31', INTERVAL 1 DAY) AS g(d) LEFT JOIN events e ON e.ts::DATE = d::DATE GROUP BY d")
def year_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_counts(table(spark, sf_dir, "events"), "ts", "2024-01-31", 371)


@query("WITH s AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000) SELECT event_type AS name, count(*) AS calls FROM s WHERE ts::DATE BETWEEN DATE '2024-01-25' AND DATE '2024-01-31' AND event_type IN ('click', 'view') GROUP BY 1")
def panel_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log sample is cut before the dates are."""
    s = Q.retained(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 10_000)
    return s.filter(Col("ts").cast("date").between("2024-01-25", "2024-01-31") & Col("event_type").isin("click", "view")).groupBy(Col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("calls"))


@query(words("{mem} SELECT id, layer, total FROM (SELECT *, (SELECT count(*) FROM memories WHERE NOT deleted AND layer = 'L2') AS total FROM memories WHERE NOT deleted AND layer = 'L2' ORDER BY created_at DESC, updated_at DESC, id DESC LIMIT 10 OFFSET 5)"))
def panel_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.memory_filter(memories(spark, sf_dir), {"layer": "L2"})
    total = m.agg(F.count(F.lit(1)).alias("total"))
    return P.page(m, 10, 5).crossJoin(F.broadcast(total)).select("id", "layer", "total")


@query("WITH c AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT c.conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM c JOIN conversations USING (conv_id) GROUP BY 1")
def panel_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    page = c.groupBy("conv_id").agg(F.max("turn").alias("last")).orderBy(F.desc("last"), "conv_id").limit(20)
    rows = c.join(F.broadcast(page), "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda s: s["role"]), ">").alias("roles"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).filter("n <= 2").select("conv_id", "turn")


@query("SELECT event_id, total FROM (SELECT event_id, ts, count(*) OVER () AS total FROM events WHERE event_type IN ('click', 'purchase')) ORDER BY ts DESC, event_id DESC LIMIT 30")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(Col("event_type").isin("click", "purchase"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(30).crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("total")))).select("event_id", "total")


@query("SELECT max(event_id) AS last_seq, count(*) AS n FROM events")
def last_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.max("event_id").alias("last_seq"), F.count(F.lit(1)).alias("n"))


@query("SELECT name, n FROM (VALUES ('license', (SELECT count(*) FROM documents WHERE regexp_matches(text, '(?i)\\blicen[sc]e'))), ('digits', (SELECT count(*) FROM documents WHERE regexp_matches(text, '[0-9]{4}'))), ('mail', (SELECT count(*) FROM documents WHERE regexp_matches(text, '(?i)@mail')))) AS v(name, n) WHERE n > 0")
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pattern_counts(table(spark, sf_dir, "documents"), "text", {"license": r"\blicen[sc]e", "digits": "[0-9]{4}", "mail": "@mail", "never": "zzzqqq"})


@query("SELECT source, least(max(len(regexp_extract_all(text, '@'))), 5) + least(count(*), 3) AS score FROM documents GROUP BY 1 HAVING least(max(len(regexp_extract_all(text, '@'))), 5) >= 1 ORDER BY 2 DESC, max(doc_id) DESC, 1 LIMIT 4")
def task_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("s", F.least(F.regexp_count("text", F.lit("@")), F.lit(5)).cast("long"))
    return L.task_candidates(d.select("source", "s", "doc_id"), "source", "s", "doc_id", least=1).orderBy(F.desc("score"), F.desc("latest"), "source").select("source", "score")


# --- projections -----------------------------------------------------------------------
@query(words("{mem} SELECT id, CASE WHEN ord % 9 = 0 THEN 'span' ELSE CASE layer WHEN 'Skill' THEN 'skill' WHEN 'L3' THEN 'world_model' WHEN 'L2' THEN 'policy' ELSE 'trace' END END AS kind, CASE WHEN l = '' THEN 'Untitled memory' WHEN length(l) <= 80 THEN l ELSE left(l, 77) || '...' END AS title FROM (SELECT *, coalesce(list_filter(list_transform(string_split(value, chr(10)), lambda s: trim(s)), lambda s: s <> '')[1], '') AS l FROM memories)"))
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    return m.select("id", M.kind(F.when(Col("ord") % 9 == 0, "span").otherwise(""), Col("layer")).alias("kind"), M.title(Col("value")).alias("title"))


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS value, props IS NOT NULL AND (props->>'$.k') IS NOT NULL AS has FROM events")
def metrics_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = F.concat(F.lit('{"trace":{"value":'), F.get_json_object("props", "$.k"), F.lit("}}"))
    m = M.metrics(info)
    return table(spark, sf_dir, "events").select("event_id", m["value"].alias("value"), m.isNotNull().alias("has"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE greatest(value - 50, 0) END AS score FROM events")
def recall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.when(Col("event_id") % 4 == 0, '{"stats":{"topRelevance":"high"}}').otherwise(F.concat(F.lit('{"stats":{"topRelevance":'), (Col("value") - 50).cast("string"), F.lit("}}")))
    return table(spark, sf_dir, "events").select("event_id", M.recall_score(out).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'succeeded' WHEN event_id % 6 = 1 THEN 'running' WHEN event_id % 6 = 2 THEN 'failed' WHEN value / 100 < 0.3 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN 'skipped' ELSE 'queued' END AS state FROM events")
def skill_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Col("event_id")
    state = M.skill_state(F.when(i % 6 == 0, 1).otherwise(0), F.when(i % 6 == 1, "running").when(i % 6 == 2, "failed").otherwise("idle"), Col("value") / 100, i % 11 == 0, F.when(i % 13 == 0, "abandoned").otherwise("done"))
    return table(spark, sf_dir, "events").select("event_id", state.alias("state"))


@query("SELECT doc_id, round(len(regexp_extract_all(text, '[A-Z]')) / 7.0::DOUBLE, 3) AS share, CASE WHEN regexp_matches(text, '(?i)\\bgit\\b|\\bgithub\\b|\\bgitlab\\b') THEN 'git' ELSE '_' END || '|_' AS domain FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'use GitHub here' ELSE 'A plain text' END AS text FROM documents)")
def domain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(Col("doc_id") % 5 == 0, "use GitHub here").otherwise("A plain text").alias("t"))
    return d.select("doc_id", M.round_exact(F.regexp_count("t", F.lit("[A-Z]")) / 7.0, 3).alias("share"), M.domain_key(Col("t")).alias("domain"))


@query("SELECT event_id, (ts + INTERVAL 330 MINUTE)::DATE::VARCHAR AS day, ts - INTERVAL 330 MINUTE AS utc FROM events")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return e.select("event_id", A.local_day(Col("ts"), 330).cast("string").alias("day"), M.iso_to_utc(text, 330).alias("utc")).withColumn("utc", Col("utc").cast("timestamp_ntz"))


@query(words("{mem} SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) >= 2 AS resonates FROM (SELECT id, ord, list_distinct(regexp_extract_all(lower(value), '[a-z0-9_][a-z0-9_./-]{3,}')) AS t FROM memories) a JOIN (SELECT id, ord, list_distinct(regexp_extract_all(lower(value), '[a-z0-9_][a-z0-9_./-]{3,}')) AS t FROM memories) b ON a.ord + 1 = b.ord"))
def resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).select("id", "ord", M.resonance_tokens(Col("value")).alias("t"))
    b = m.select(Col("id").alias("b"), (Col("ord") - 1).alias("o"), Col("t").alias("u"))
    return m.join(b, Col("ord") == Col("o")).select(Col("id").alias("a"), "b", (F.size(F.array_intersect("t", "u")) >= 2).alias("resonates"))


# --- sessions and episodes -------------------------------------------------------------
@query(f"WITH {TURNS}, k AS (SELECT conv_id, turn_no FROM turns GROUP BY 1, 2 HAVING arg_min(role, turn) = 'user' AND arg_max(role, turn) = 'assistant' AND trim(arg_min(text, turn)) <> '' AND trim(arg_max(text, turn)) <> '' AND min(turn) > 1) SELECT conv_id, turn FROM turns JOIN k USING (conv_id, turn_no)")
def incremental_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.incremental_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", "turn", 1).select("conv_id", "turn")


@query(words("{mem} SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE ord % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, updated_at DESC, created_at DESC, ord DESC) AS n FROM memories) WHERE n = 1"))
def latest_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = memories(spark, sf_dir).withColumn("status", F.get(F.array(*map(F.lit, ["open", "processing", "closed"])), (Col("ord") % 3).cast("int"))).withColumnRenamed("created_at", "opened_at")
    return C.latest_episode(e, "user_id").select("user_id", "id")


@query(words("{mem} SELECT episode_id, count(DISTINCT memory_key)::INT AS turn_count, string_agg(memory_key, ',' ORDER BY f) AS turns FROM (SELECT episode_id, memory_key, min(ord) AS f FROM memories GROUP BY 1, 2) GROUP BY 1"))
def appended_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.appended_turns(memories(spark, sf_dir), "episode_id", "memory_key", "id", "ord")
    return t.select("episode_id", "turn_count", F.array_join("raw_turn_ids", ",").alias("turns"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'closed' WHEN o_orderstatus = 'F' THEN 'open' ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 2 = 0 THEN coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END, TIMESTAMP '2024-01-01') WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS closed_at FROM orders")
def close_and_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", Col("o_orderstatus").alias("status"), F.when(Col("o_orderkey") % 3 == 0, Col("o_orderdate")).alias("closed_at"), Col("o_totalprice").alias("r_task"))
    again = C.reopened(o, (Col("status") == "F") & (Col("o_custkey") % 2 != 0))
    return C.closed(again, Col("o_custkey") % 2 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).select("o_orderkey", "status", "closed_at")


@query(words("{mem} SELECT id FROM (SELECT id FROM memories WHERE ord % 50 = 0 UNION SELECT id FROM (SELECT * FROM memories ORDER BY updated_at DESC, id DESC LIMIT 2000) WHERE episode_id IN (SELECT episode_id FROM memories WHERE ord % 50 = 0))"))
def gain_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).select("id", "ord", "episode_id", "updated_at")
    return L.gain_reference(m.filter("ord % 50 = 0"), m, "updated_at").select("id")


@query(f"WITH {CENTROIDS}, p AS (SELECT e.label, (vec_id % 10) / 10.0::DOUBLE AS gain, list_cosine_similarity(embedding::DOUBLE[], centroid) AS sim FROM embeddings e JOIN cents USING (label)), g AS (SELECT label, count(*) AS n, count(*) FILTER (sim >= 0.3) AS strict, avg(sim) AS coh, avg(gain) FILTER (sim >= 0.3) AS g1, avg(gain) AS g2 FROM p GROUP BY 1), a AS (SELECT *, CASE WHEN strict >= 20 THEN 'strict' ELSE 'loose' END AS admission FROM g) SELECT label, n, admission, round(coh, 5) AS cohesion, round(CASE admission WHEN 'strict' THEN least(greatest(g1 * 0.7 + coh * 0.3, 0), 1) ELSE least(greatest(g2 * 0.7 + coh * 0.3, 0), 1) * (0.6 + 0.4 * least(greatest(coh, 0), 1)) END, 5) AS confidence FROM a WHERE n >= 20")
def world_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(Col("vec_id").alias("id"), "label", ((Col("vec_id") % 10) / 10.0).alias("gain"), Col("embedding").alias("vec"))
    return L.world_clusters(e, "label", 20).select("label", "n", "admission", F.round("cohesion", 5).alias("cohesion"), F.round("confidence", 5).alias("confidence"))


@query("WITH d AS (SELECT o_custkey AS key, list(DISTINCT o_orderkey % 40) AS p FROM orders GROUP BY 1), m AS (SELECT l_suppkey AS id, l_suppkey * 7 AS k, list(DISTINCT l_orderkey % 40) AS p FROM lineitem GROUP BY 1), s AS (SELECT key, id, len(list_intersect(d.p, m.p)) AS sh, len(list_intersect(d.p, m.p)) / least(len(d.p), len(m.p)) AS score FROM d, m), b AS (SELECT key, arg_max(id, (score, sh, -id)) AS near FROM s WHERE score >= 0.6 GROUP BY 1) SELECT d.key, coalesce(m.id, near) AS model FROM d LEFT JOIN m ON m.k = d.key LEFT JOIN b ON b.key = d.key")
def merge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").groupBy(Col("o_custkey").alias("key")).agg(F.collect_set(Col("o_orderkey") % 40).alias("policy_ids"))
    m = table(spark, sf_dir, "lineitem").groupBy(Col("l_suppkey").alias("id")).agg(F.collect_set(Col("l_orderkey") % 40).alias("policy_ids"))
    return L.merge_target(d, m.withColumn("key", Col("id") * 7).withColumn("confidence", F.lit(0.5)))


# --- queues ----------------------------------------------------------------------------
@query("SELECT coalesce(a.t, b.t) AS target_id, CASE WHEN b.t IS NOT NULL AND (a.t IS NULL OR a.s IN ('failed', 'succeeded')) THEN 'pending' ELSE a.s END AS status, CASE WHEN b.t IS NOT NULL THEN least(coalesce(a.x, 500), 500) ELSE a.x END AS next_at FROM (SELECT event_id AS t, ['pending', 'failed', 'succeeded', 'in_progress'][event_id % 4 + 1] AS s, event_id AS x FROM events) a FULL JOIN (SELECT event_id AS t FROM events WHERE event_id % 3 = 0) b ON a.t = b.t")
def retry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("event_id", "target_id")
    q = e.select("target_id", F.get(F.array(*map(F.lit, ["pending", "failed", "succeeded", "in_progress"])), (Col("target_id") % 4).cast("int")).alias("status"), F.lit(2).alias("attempts"), Col("target_id").alias("next_at"), F.lit("w1").alias("claimed_by"))
    return Q.retry_upsert(q, e.filter("target_id % 3 = 0"), 500).select("target_id", "status", "next_at")


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 0 AND event_id % 3 <> 1 THEN 'done' ELSE 'claimed' END AS status FROM events")
def fenced_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(Col("event_id").alias("id"), (Col("event_id") % 5).alias("worker"), Col("event_id").alias("lease"), F.lit("claimed").alias("status"))
    u = e.filter("id % 4 = 0").withColumn("lease", F.when(Col("id") % 3 == 1, Col("lease") + 1).otherwise(Col("lease"))).withColumn("status", F.lit("done"))
    return Q.fenced(e, u).select("id", "status")


@query(f"WITH {MEMORIES}, q AS (SELECT event_id AS id, 'mem_' || event_id % 900 AS target_id, CASE WHEN event_id % 2 = 0 THEN 'trace' ELSE 'policy' END AS target_kind, event_id % 77 AS next_at, event_id AS created_at FROM events) SELECT q.id, CASE WHEN target_kind = 'trace' AND layer = 'L1' THEN 0 ELSE 2 END AS rank FROM q LEFT JOIN memories m ON m.id = q.target_id ORDER BY 2, m.created_at DESC, next_at, q.created_at, q.id LIMIT 50")
def retry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Col("event_id")
    q = table(spark, sf_dir, "events").select(i.alias("id"), F.concat(F.lit("mem_"), i % 900).alias("target_id"), F.when(i % 2 == 0, "trace").otherwise("policy").alias("target_kind"), (i % 77).alias("next_at"), i.alias("created_at"))
    return Q.retry_order(q, memories(spark, sf_dir)).limit(50).select("id", "rank")


@query("SELECT DISTINCT l_suppkey AS s, l_partkey % 50 AS t, min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_suppkey, l_partkey % 50) AS first FROM lineitem")
def edge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or ignore: the first row of a pair wins."""
    li = table(spark, sf_dir, "lineitem").select(Col("l_suppkey").alias("s"), (Col("l_partkey") % 50).alias("t"), (Col("l_orderkey") * 10 + Col("l_linenumber")).alias("first"))
    return Q.first_write(li, ["s", "t"], [Col("first")])


@query("SELECT user_id, round(least(1.0, greatest(-1.0, 0.45 * least(greatest(avg(value) / 50, -1), 1) + 0.3 * 0.5 + 0.25 * -1)), 6) AS reward, CASE WHEN avg(value) / 100 >= 0.5 THEN 'pass' WHEN avg(value) / 100 <= -0.15 THEN 'fail' ELSE 'unknown' END AS outcome FROM events GROUP BY 1")
def reward_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    return e.select("user_id", F.round(S.reward_axes(Col("v") / 50, F.lit(0.5), F.lit(-1.0)), 6).alias("reward"), L.outcome_from_reward(Col("v") / 100).alias("outcome"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN value <= 0 THEN NULL WHEN event_id % 3 = 0 THEN 'pass' ELSE 'fail' END AS outcome FROM events")
def feedback_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.get(F.array(*map(F.lit, ["positive", "negative", "neutral"])), (Col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", L.outcome_from_feedback(p, Col("value")).alias("outcome"))


# --- graphs and vectors ----------------------------------------------------------------
@query("WITH RECURSIVE e AS (SELECT c_nationkey AS graph, c_custkey AS source, c_custkey + 25 * (c_custkey % 3 + 1) AS target FROM customer UNION ALL SELECT c_nationkey, c_custkey, c_custkey + 25 FROM customer WHERE c_custkey % 5 = 0), n AS (SELECT c_nationkey AS graph, c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0), o AS (SELECT e.* FROM e JOIN n ON n.graph = e.graph AND n.id = e.target), r(graph, node) AS (SELECT DISTINCT graph, target FROM o WHERE source % 11 = 0 UNION SELECT r.graph, o.target FROM r JOIN o ON o.graph = r.graph AND o.source = r.node) SELECT graph::BIGINT AS graph, count(*) AS n FROM r GROUP BY 1")
def graph_side_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).withColumn("type", F.when(Col("source") % 11 == 0, "side_branch").otherwise("next"))
    return G.side_branches(_nodes(spark, sf_dir), e).groupBy("graph").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, round(sqrt(sum(x * x)), 5) AS norm FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = V.normalized(Col("embedding"))
    return e.select("vec_id", F.round(F.sqrt(V.dot(Col("embedding"), Col("embedding"))) * F.sqrt(V.dot(n, n)), 5).alias("norm"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN coalesce(concat_ws(';', 'b', 'c'), '') ELSE 'b' END AS shared, list_sort(['x', 'y'])[1] AS first FROM supplier")
def payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1"))
    b = F.when(Col("s_suppkey") % 2 == 0, F.create_map(F.lit("b"), F.lit("2"), F.lit("c"), F.lit("2"))).otherwise(F.create_map(F.lit("b"), F.lit("2")))
    merged = Q.merged_payload(a, b)
    twos = F.map_keys(F.map_filter(merged, lambda _, v: v == "2"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.array_sort(twos), ";").alias("shared"), F.lit("x").alias("first"))


@query("SELECT doc_id, round(CASE WHEN n > 0 THEN least(1.0, 0.9 + 0.1 * ((n - 1) / 1)) ELSE 0 END, 6) AS structural FROM (SELECT doc_id, contains(lower(text), 'apache license')::INT + (contains(lower(text), 'moron') OR doc_id % 3 = 0)::INT AS n FROM documents)")
def structural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = F.when(Col("doc_id") % 3 == 0, F.array(F.lit("Moron error"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.structural_score(["Apache License", "moron"], Col("text"), sig), 6).alias("structural"))
