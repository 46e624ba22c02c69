"""Projections of memory rows: kinds, titles, metrics, eligibility, query plans."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.text import first_line

#: Layers by mode and profile.
LAYERS = {"tool_driven": ("L2", "L1", "L3"), "sub_agent": ("L2", "L1", "L3"), "skill_invoke": ("Skill", "L2", "L1"), "decision_repair": ("Skill", "L2", "L1"), "world_model": ("L3",), "turn_start": ("Skill", "L2", "L1", "L3"), "search": ("Skill", "L2", "L1", "L3")}
PROFILES = {"experience": ("L2",), "skill": ("Skill",), "skill_experience": ("Skill", "L2")}
#: Domains and tools of a policy, by the words it uses.
DOMAINS = ((r"\bdocker|\bcontainer|\bpodman\b", "docker"), (r"\bnode\.?js?|\bnpm\b|\byarn\b|\bpnpm\b", "node"), (r"\bpython\b|\bpip\b|\bpoetry\b|\bconda\b", "python"), (r"\brust\b|\bcargo\b", "rust"), (r"\bjava\b|\bmaven\b|\bgradle\b", "java"), (r"\bpostgres|\bmysql|\bsqlite|\bredis", "db"), (r"\bnetwork|\bdns\b|\bproxy\b|\btls\b|\bhttps?\b", "network"), (r"\bgit\b|\bgithub\b|\bgitlab\b", "git"), (r"\bkubernetes|\bk8s\b|\bhelm\b", "k8s"), (r"\baws\b|\bgcp\b|\bazure\b", "cloud"))
TOOLS = ((r"\bpip install|\bpip3\b", "pip"), (r"\bnpm (?:install|i|publish)\b", "npm"), (r"\byarn install\b", "yarn"), (r"\bcargo install\b|\bcargo build\b", "cargo"), (r"\bdocker build|\bdocker run\b", "docker-cli"), (r"\bgit (?:clone|push|pull|checkout)\b", "git-cli"))


def layers_for(mode: str = "search", domain: str = "", profile: str = "all") -> tuple[str, ...]:
    """The profile narrows the layers in the research domain only."""
    return PROFILES.get(profile, LAYERS.get(mode, LAYERS["search"])) if domain == "research" else LAYERS.get(mode, LAYERS["search"])


def kind(explicit: Column, layer: Column) -> Column:
    return F.coalesce(F.when(explicit != "", explicit), F.when(layer == "Skill", "skill").when(layer == "L3", "world_model").when(layer == "L2", "policy").otherwise("trace"))


def title(value: Column) -> Column:
    line = first_line(value)
    return F.when(line == "", "Untitled memory").when(F.length(line) <= 80, line).otherwise(F.concat(F.substring(line, 1, 77), F.lit("...")))


def first_text(*candidates: Column) -> Column:
    """The first candidate that is not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in candidates])


def metrics(info: Column) -> Column:
    """struct(value, alpha, reflection_done) from either place; null if all are absent."""
    num = lambda k: F.coalesce(F.get_json_object(info, f"$.{k}"), F.get_json_object(info, f"$.trace.{k}")).try_cast("double")
    text = first_text(F.get_json_object(info, "$.reflection"), F.get_json_object(info, "$.trace.reflection"))
    return F.when(num("value").isNotNull() | num("alpha").isNotNull() | text.isNotNull(), F.struct(num("value").alias("value"), num("alpha").alias("alpha"), text.isNotNull().alias("reflection_done")))


def recall_score(output: Column) -> Column:
    """$.stats.topRelevance, at least 0; null if it is no finite number."""
    x = F.get_json_object(output, "$.stats.topRelevance").try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.greatest(x, F.lit(0.0)))


def avoidance_eligible(kind_: Column, polarity: Column, confidence: Column, trigger: Column, prefer: Column, avoid: Column) -> Column:
    """Failure-avoiding policies need confidence, a trigger, and a preference that is not
    itself an anti-pattern; others pass."""
    clean = lambda a: F.filter(F.transform(a, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    good = (confidence >= 0.6) & (F.trim(trigger) != "") & (F.size(clean(avoid)) > 0) & (F.size(F.array_except(clean(prefer), clean(avoid))) > 0)
    return ((kind_ != "failure_avoidance") & (polarity != "negative")) | good


def domain_key(text: Column) -> Column:
    first = lambda rules: F.coalesce(*[F.when(text.rlike("(?i)" + p), t) for p, t in rules], F.lit("_"))
    return F.concat_ws("|", first(DOMAINS), first(TOOLS))


def skill_state(skills: Column, pipeline: Column, r_task: Column, skipped: Column, closed_as: Column) -> Column:
    """What became of an episode's skill."""
    return F.when(skills > 0, "succeeded").when(pipeline.isin("running", "failed"), pipeline).when((r_task < 0.3) | skipped | (closed_as == "abandoned"), "skipped").otherwise("queued")


def resonance_tokens(text: Column) -> Column:
    """Words of four or more characters, as a set."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_][a-z0-9_./-]{3,}"), F.lit(0)))


def stable_hash(value: object) -> str:
    """SHA-256 of JSON with sorted keys."""
    import hashlib

    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def stable_hash_of(**fields: Column) -> Column:
    """stable_hash of an object with these fields, none of them null."""
    return F.sha2(F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)])), 256)


def round_exact(x: Column, decimals: int) -> Column:
    """Rounds the exact binary value, so that 1.005 becomes 1.00."""
    return F.round(F.format_string("%.30f", x).cast("decimal(38,30)"), decimals).cast("double")


def iso_to_utc(text: Column, offset_minutes: int = 0) -> Column:
    """Values without an offset are local at the given one."""
    has = text.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(has, F.try_to_timestamp(text)).otherwise(F.try_to_timestamp(text) - F.make_dt_interval(mins=F.lit(offset_minutes)))


def zone_offset(zone: str | None, now: datetime) -> int:
    """Minutes from UTC of a fixed offset (UTC+5:30, -08), or of a named zone as it is now: it
    holds for all instants, whatever the season. None is UTC."""
    name = (zone or "").strip()
    if not name:
        return 0
    fixed = re.fullmatch(r"(?i)(?:(?:UTC|GMT)\s*)?([+-])(\d{1,2})(?::?(\d{2}))?", name)
    if fixed:
        return (1 if fixed[1] == "+" else -1) * (int(fixed[2]) * 60 + int(fixed[3] or 0))
    try:
        return int(now.astimezone(ZoneInfo(name)).utcoffset().total_seconds() // 60)  # type: ignore[union-attr]
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise ValueError(f"no such time zone: {name}") from e


def _cron_field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        first, _, last = span.partition("-")
        a = low if span == "*" else int(first)
        b = int(last) if last else high if span == "*" or step else a
        if not low <= a <= b <= high:
            raise ValueError(f"not within {low}-{high}: {part}")
        out.update(range(a, b + 1, int(step or 1)))
    return out


def next_cron(expression: str, base_ms: int, zone: str = "UTC") -> int | None:
    """The first minute after base that a five-field expression names, in the zone; where both
    are restricted, the day of the month or of the week must fit. None within five years."""
    minute, hour, day, month, weekday = expression.split()
    minutes, hours, days, months = _cron_field(minute, 0, 59), _cron_field(hour, 0, 23), _cron_field(day, 1, 31), _cron_field(month, 1, 12)
    weekdays = {d % 7 for d in _cron_field(weekday, 0, 7)}
    tz = ZoneInfo(zone)
    at = datetime.fromtimestamp(base_ms // 60_000 * 60, tz)
    for k in range(366 * 5):
        date = (at + timedelta(days=k)).date()
        fits = [date.day in days, (date.weekday() + 1) % 7 in weekdays]
        if date.month not in months or not (any(fits) if day != "*" and weekday != "*" else all(fits)):
            continue
        for h in sorted(hours):
            for m in sorted(minutes):
                t = datetime(date.year, date.month, date.day, h, m, tzinfo=tz)
                if t.timestamp() * 1000 > base_ms:
                    return int(t.timestamp() * 1000)
    return None


def next_run(kind_: str, base_ms: int, at_ms: int | None = None, every_ms: int | None = None, cron: str = "", zone: str = "UTC") -> int | None:
    """The next time of an `at`, `every` or `cron` schedule; None when there is none."""
    if kind_ == "at":
        return at_ms if at_ms is not None and at_ms > base_ms else None
    if kind_ == "cron":
        return next_cron(cron, base_ms, zone) if cron else None
    return base_ms + every_ms if kind_ == "every" and every_ms and every_ms > 0 else None
