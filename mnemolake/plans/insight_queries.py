"""Registered queries of small rules, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions import insights as N
from mnemolake.operators import aggregates as A
from mnemolake.operators import lifecycle as L
from mnemolake.plans.queries import Col, query, words
from mnemolake.plans.source_queries import _files, _folder
from mnemolake.plans.views import memories, table
from mnemolake.sources import readers as I


@query("SELECT k AS key, count(s) AS n FROM (VALUES ('open'), ('processing'), ('closed'), ('paused')) AS v(k) LEFT JOIN (SELECT CASE WHEN user_id % 3 = 0 THEN 'open' WHEN user_id % 3 = 1 THEN 'closed' ELSE 'other' END AS s FROM (SELECT DISTINCT user_id FROM events)) ON s = k GROUP BY k")
def episode_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode a user; statuses that do not occur count 0, unknown ones are left out."""
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    status = F.when(Col("user_id") % 3 == 0, "open").when(Col("user_id") % 3 == 1, "closed").otherwise("other")
    return A.counts_of(e.select(status.alias("status")), "status", ["open", "processing", "closed", "paused"])


@query("SELECT k AS key, count(s) AS n FROM (VALUES ('pending'), ('in_progress'), ('failed'), ('succeeded')) AS v(k) LEFT JOIN (SELECT CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'in_progress' END AS s FROM events WHERE event_type = 'purchase') ON s = k GROUP BY k")
def retry_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.when(Col("event_id") % 4 == 0, "pending").when(Col("event_id") % 4 == 1, "failed").when(Col("event_id") % 4 == 2, "in_progress").alias("status"))
    return A.counts_of(r, "status", ["pending", "in_progress", "failed", "succeeded"])


@query(r"WITH t AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN '/home/u/work' || turn % 7 || '/' END AS w, CASE WHEN conv_id % 3 = 1 THEN 'the plan' || turn % 5 || ' project ' ELSE '' END || text AS s FROM conversations), p AS (SELECT CASE WHEN w IS NOT NULL THEN regexp_extract(w, '([^/]*)/*$', 1) ELSE coalesce(nullif(regexp_extract(s, '/Users/[^/\s]+/(?:MyProject|Projects)/([A-Za-z0-9][A-Za-z0-9_-]{2,60})', 1), ''), nullif(regexp_extract(s, '(?i)\b([A-Za-z0-9][A-Za-z0-9_-]{2,60})\s+(?:project|项目)\b', 1), ''), nullif(regexp_extract(s, '(?i)(?:项目|叫|called)\s+([A-Za-z0-9][A-Za-z0-9_-]{2,60})', 1), '')) END AS project FROM t) SELECT project, count(*) AS n FROM p WHERE project IS NOT NULL AND project NOT IN ('', '.', '/') GROUP BY project ORDER BY n DESC, project LIMIT 5")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by workspace, or as the text names them."""
    c = table(spark, sf_dir, "conversations")
    w = F.when(Col("conv_id") % 3 == 0, F.concat(F.lit("/home/u/work"), Col("turn") % 7, F.lit("/")))
    s = F.concat(F.when(Col("conv_id") % 3 == 1, F.concat(F.lit("the plan"), Col("turn") % 5, F.lit(" project "))).otherwise(""), "text")
    return N.top_projects(c.select(w.alias("w"), s.alias("s")), "w", "s")


@query("WITH t AS (SELECT text || CASE turn % 4 WHEN 0 THEN ' 先讨论方案' WHEN 1 THEN ' run the Tests' WHEN 2 THEN ' low LATENCY' ELSE '' END AS s FROM conversations) SELECT name, n FROM (SELECT 'plan_before_code' AS name, count(*) AS n FROM t WHERE regexp_matches(s, '(?i)先讨论|不修改代码|完整.?plan|方案|实现的细节|可落地|plan|design') UNION ALL SELECT 'token_and_latency', count(*) FROM t WHERE regexp_matches(s, '(?i)快速|轻量|token|耗时|几万|十万|并行|首字|流式|latency|stream') UNION ALL SELECT 'local_data_correctness', count(*) FROM t WHERE regexp_matches(s, '(?i)本地数据|水位|清除|假记忆|假数据|真实模式|权限|隐私|local data|watermark') UNION ALL SELECT 'engineering_closure', count(*) FROM t WHERE regexp_matches(s, '(?i)实现|重启|测试|验证|报错|检查|push|分支|restart|verify|test') UNION ALL SELECT 'cross_agent_context', count(*) FROM t WHERE regexp_matches(s, '(?i)跨.?Agent|整合|接续|继续|上下文|任务|agent')) WHERE n > 0 ORDER BY n DESC, name LIMIT 5")
def habit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(Col("turn") % 4 == 0, " 先讨论方案").when(Col("turn") % 4 == 1, " run the Tests").when(Col("turn") % 4 == 2, " low LATENCY").otherwise("")
    c = table(spark, sf_dir, "conversations").select(F.concat("text", said).alias("s"))
    return L.pattern_counts(c, "s", {k: f"(?:{p})" for k, p in N.HABITS.items()}, 5)


@query("SELECT event_id, CASE WHEN w <= 0 THEN 0.0 ELSE least(w, 0.3) END::DOUBLE AS blend FROM (SELECT event_id, value / 100 - 0.2 AS w FROM events)")
def priority_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", N.priority_blend(Col("value") / 100 - 0.2).alias("blend"))


@query("WITH e AS (SELECT event_id, ['search', 'world_model', 'sub_agent', 'unknown'][event_id % 4 + 1] AS mode, CASE WHEN event_id % 3 = 0 THEN 'research' ELSE '' END AS domain, ['all', 'experience', 'skill', 'skill_experience', 'other'][event_id % 5 + 1] AS profile FROM events) SELECT event_id, CASE WHEN domain = 'research' AND profile = 'experience' THEN 'L2' WHEN domain = 'research' AND profile = 'skill' THEN 'Skill' WHEN domain = 'research' AND profile = 'skill_experience' THEN 'Skill,L2' ELSE CASE mode WHEN 'world_model' THEN 'L3' WHEN 'sub_agent' THEN 'L2,L1,L3' ELSE 'Skill,L2,L1,L3' END END AS layers FROM e")
def profile_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (Col("event_id") % len(v)).cast("int"))
    own = N.layers_of(pick("search", "world_model", "sub_agent", "unknown"), F.when(Col("event_id") % 3 == 0, "research").otherwise(""), pick("all", "experience", "skill", "skill_experience", "other"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(own, ",").alias("layers"))


@query(words("{mem,} f AS (SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 5 THEN 2 ELSE 0 END AS d FROM events), k AS (SELECT event_id, date_trunc('second', ts) AS a, date_trunc('second', ts) + INTERVAL 1 DAY * d AS z FROM f WHERE d > 0), m AS (SELECT * FROM memories WHERE NOT deleted AND layer = 'L1' AND status IN ('activated', 'resolving')) SELECT k.event_id, count(m.id) AS n, min(m.ord) AS first FROM k LEFT JOIN m ON m.created_at >= a AND m.created_at < z GROUP BY 1"))
def filtered_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time filters as callers give them: an end before the start, a number or a word in place of a
    time is no filter; the others count the traces of their days."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    start, end = Col("ts"), lambda d: Col("ts") + F.expr(f"interval {d} day")
    k = Col("event_id") % 6
    given = F.when(k == 0, F.to_json(F.struct(iso(start).alias("startAt"), F.concat(F.lit(" "), iso(end(1))).alias("endAt")))).when(k == 1, F.to_json(F.struct(iso(start).alias("startAt"), iso(end(-1)).alias("endAt")))).when(k == 2, F.lit('{"startAt": 1704067200, "endAt": 1704153600}')).when(k == 3, F.lit('{"startAt": "soon", "endAt": "later"}')).when(k == 4, F.lit("[]")).otherwise(F.to_json(F.struct(iso(start).alias("startAt"), iso(end(2)).alias("endAt"))))
    e = table(spark, sf_dir, "events").select("event_id", N.time_filter(given).alias("f")).filter("f is not null").select("event_id", "f.*")
    m = memories(spark, sf_dir).filter("not deleted and layer = 'L1' and status in ('activated', 'resolving')").select(Col("ord"), Col("created_at").cast("timestamp").alias("at"), F.to_date("created_at").alias("day"))
    # they meet by day
    days = e.withColumn("day", F.explode(F.sequence(F.to_date("start_at"), F.to_date("end_at"))))
    hits = days.join(m, "day").filter("at >= start_at and at < end_at").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return e.select("event_id").join(hits, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"), "first")


@query("WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['grep'] WHEN 2 THEN ['grep', 'sed'] ELSE ['awk', 'sed', 'grep'] END AS tools, CASE WHEN event_id % 3 = 0 THEN ['grep'] ELSE ['cat'] END AS seen, (event_id % 10) / 10 AS r, event_id % 7 AS traces FROM events), c AS (SELECT *, len(list_filter(tools, lambda t: NOT list_contains(seen, t))) AS miss, CASE WHEN len(tools) = 0 THEN 1.0 ELSE (len(tools) - len(list_filter(tools, lambda t: NOT list_contains(seen, t)))) / len(tools) END AS cov FROM d), v AS (SELECT *, CASE WHEN traces = 0 THEN 'no-evidence' WHEN cov < 0.5 AND len(tools) > 0 THEN 'coverage=' || printf('%.2f', cov::DOUBLE) || '<0.5' WHEN r < 0.5 THEN 'resonance=' || printf('%.2f', r::DOUBLE) || '<0.5' END AS reason FROM c) SELECT event_id, reason IS NULL AS ok, reason, CASE WHEN traces > 0 THEN round(cov, 6) ELSE 0.0 END::DOUBLE AS coverage, CASE WHEN traces > 0 THEN miss ELSE 0 END AS missing FROM v")
def verified_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = Col("event_id") % 4
    text = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    tools = F.when(k == 0, text()).when(k == 1, text("Grep")).when(k == 2, text("grep", "SED")).otherwise(text("awk", "sed", "grep"))
    v = N.verified(tools, F.when(Col("event_id") % 3 == 0, text("grep")).otherwise(text("cat")), (Col("event_id") % 10) / 10, Col("event_id") % 7)
    return table(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", "v.ok", "v.reason", F.round("v.coverage", 6).alias("coverage"), F.size("v.unmapped").cast("long").alias("missing"))


@query("WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS b FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN b + 90000 WHEN 1 THEN CASE WHEN event_id % 8 = 1 THEN b + 5 END WHEN 2 THEN CASE WHEN b < b // 86400000 * 86400000 + 34200000 THEN b // 86400000 * 86400000 + 34200000 ELSE b // 86400000 * 86400000 + 120600000 END END AS next FROM e")
def next_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of all kinds as a column: every 90 seconds, once, daily at 9:30, and none."""
    k, base = Col("event_id") % 4, F.unix_millis(Col("ts").cast("timestamp"))
    kind = F.when(k == 0, "every").when(k == 1, "at").when(k == 2, "cron").otherwise("none")
    fire = N.next_fire(kind, base, F.when(Col("event_id") % 8 == 1, base + 5).otherwise(base), F.lit(90000), F.lit("30 9 * * *"), F.lit("UTC"))
    return table(spark, sf_dir, "events").select("event_id", fire.alias("next"))


@query("WITH e AS (SELECT event_id, ts + INTERVAL 1 DAY * (event_id % 365) AS t FROM events), o AS (SELECT *, CASE WHEN t >= TIMESTAMP '2024-03-31 01:00:00' AND t < TIMESTAMP '2024-10-27 01:00:00' OR t >= TIMESTAMP '2025-03-30 01:00:00' AND t < TIMESTAMP '2025-10-26 01:00:00' THEN 2 ELSE 1 END AS h FROM e) SELECT (t + INTERVAL 1 HOUR * h)::DATE::VARCHAR AS day, count(*) AS n FROM o GROUP BY 1")
def days_of_a_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the day of a zone with daylight saving time."""
    at = F.from_utc_timestamp((Col("ts") + F.make_dt_interval(days=(Col("event_id") % 365).cast("int"))).cast("timestamp"), "Europe/Berlin")
    return table(spark, sf_dir, "events").groupBy(F.to_date(at).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, sum(strlen(replace(text, chr(10), ' ')) + 1)::BIGINT AS length FROM conversations GROUP BY 1")
def found_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by a pattern of names."""
    path = _folder(spark, "found")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.translate("text", "\n", " ").alias("line"))
    _files(c, path)
    found = I.find_files(spark, path, "*.txt", limit=None)
    return found.groupBy(F.regexp_extract("path", "conv_id=([0-9]+)", 1).cast("long").alias("conv_id")).agg(F.sum("length").alias("length"))
