"""Small rules about people's work: projects, habits, time filters, verification of skills, schedules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.memory import LAYERS, PROFILES, next_run
from mnemolake.session import ship

#: Habits, and what a text that tells of one holds.
HABITS = {
    "plan_before_code": r"先讨论|不修改代码|完整.?plan|方案|实现的细节|可落地|plan|design",
    "token_and_latency": r"快速|轻量|token|耗时|几万|十万|并行|首字|流式|latency|stream",
    "local_data_correctness": r"本地数据|水位|清除|假记忆|假数据|真实模式|权限|隐私|local data|watermark",
    "engineering_closure": r"实现|重启|测试|验证|报错|检查|push|分支|restart|verify|test",
    "cross_agent_context": r"跨.?Agent|整合|接续|继续|上下文|任务|agent",
}
#: How a text names a project.
_NAME = "([A-Za-z0-9][A-Za-z0-9_-]{2,60})"
_PROJECT_PATHS = rf"/Users/[^/\s]+/(?:MyProject|Projects)/{_NAME}"
_BEFORE = rf"(?i)(?<![A-Za-z0-9_]){_NAME}\s+(?:project(?![A-Za-z0-9_])|项目(?=[A-Za-z0-9_]))"
_AFTER = rf"(?i)(?:项目|叫|called)\s+{_NAME}"


def project_name(workspace: Column, text: Column) -> Column:
    """The last part of a workspace's path; without one, what the text calls a project."""
    base = F.regexp_extract(workspace, "([^/]*)/*$", 1)
    said = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    found = F.when(F.coalesce(workspace, F.lit("")) != "", base).otherwise(F.coalesce(said(_PROJECT_PATHS), said(_BEFORE), said(_AFTER)))
    return F.when(~found.isin("", ".", "/"), found)


def top_projects(df: DataFrame, workspace: str, text: str, most: int = 5) -> DataFrame:
    """(project, n): the most frequent first, then by name."""
    named = df.select(project_name(F.col(workspace), F.col(text)).alias("project")).filter("project is not null")
    return named.groupBy("project").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project").limit(most)


def priority_blend(weight: Column) -> Column:
    return F.when(weight <= 0, 0.0).otherwise(F.least(weight, F.lit(0.3)))


def layers_of(mode: Column, domain: Column, profile: Column) -> Column:
    """The layers of a row's mode; in the research domain its profile's, if that names some."""
    lists = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.coalesce(lists(LAYERS)[mode], F.array(*map(F.lit, LAYERS["search"])))
    return F.when(domain == "research", F.coalesce(lists(PROFILES)[profile], own)).otherwise(own)


def time_filter(json: Column) -> Column:
    """struct(start_at, end_at) of an object with both as text; null unless the end is later."""

    def at(name: str) -> Column:
        value = F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_to_timestamp(F.trim(F.get_json_object(json, f"$.{name}"))))

    return F.when(at("endAt") > at("startAt"), F.struct(at("startAt").alias("start_at"), at("endAt").alias("end_at")))


def verified(tools: Column, evidence: Column, resonance: Column, traces: Column, least: float = 0.5) -> Column:
    """struct(ok, coverage, resonance, unmapped, reason) of a skill's draft: half of its tools, if
    it names any, must be among the evidence's, and the resonance must reach least."""
    asked = F.transform(tools, F.lower)
    unmapped = F.filter(asked, lambda t: ~F.array_contains(evidence, t))
    coverage = F.when(F.size(asked) == 0, 1.0).otherwise((F.size(asked) - F.size(unmapped)) / F.size(asked))
    fixed = lambda label, c, end: F.concat(F.lit(label), F.format_string("%.2f", c), F.lit(end))
    low = (coverage < 0.5) & (F.size(asked) > 0)
    reason = F.when(traces == 0, "no-evidence").when(low, fixed("coverage=", coverage, "<0.5")).when(resonance < least, fixed("resonance=", resonance, f"<{least:g}"))
    some = traces > 0
    return F.struct(reason.isNull().alias("ok"), F.when(some, coverage).otherwise(0.0).alias("coverage"), F.when(some, resonance).otherwise(0.0).alias("resonance"), F.when(some, unmapped).otherwise(F.array().cast("array<string>")).alias("unmapped"), reason.alias("reason"))


def _next_runs(kind: pd.Series, base: pd.Series, at: pd.Series, every: pd.Series, cron: pd.Series, zone: pd.Series) -> pd.Series:
    whole = lambda v: None if pd.isna(v) else int(v)
    return pd.Series([next_run(k, int(b), whole(a), whole(e), c or "", z or "UTC") for k, b, a, e, c, z in zip(kind, base, at, every, cron, zone, strict=True)], dtype="Int64")


def next_fire(kind: Column, base_ms: Column, at_ms: Column, every_ms: Column, cron: Column, zone: Column) -> Column:
    """When an `at`, `every` or `cron` schedule runs next, in milliseconds; null if never."""
    ship()
    return F.pandas_udf(_next_runs, "long")(kind, base_ms, at_ms, every_ms, cron, zone)
