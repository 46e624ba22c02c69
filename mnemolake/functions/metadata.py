"""Typed records of the JSON that policies, skills and world models carry.

A field that is missing, or holds what its type does not admit, takes its default; other
layers have no record.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.scoring import clamp01, success_rate
from mnemolake.functions.text import first_line

#: Fields as stored, and what some of them may hold.
_GUIDANCE = "struct<preference: array<string>, anti_pattern: array<string>, antiPattern: array<string>>"
POLICY = f"struct<title: string, trigger: string, procedure: string, verification: string, boundary: string, support: double, gain: double, raw_gain: double, policy_confidence: double, confidence: double, salience: double, status: string, experience_type: string, evidence_polarity: string, skill_eligible: boolean, signature: string, source_episode_ids: array<string>, source_trace_ids: array<string>, source_feedback_ids: array<string>, decision_guidance: {_GUIDANCE}>"
_BLURB = "struct<retrievalBlurb: string, retrieval_blurb: string, triggerContext: string, trigger_context: string>"
SKILL = f"struct<name: string, eta: double, status: string, support: double, source_policy_ids: array<string>, source_world_model_ids: array<string>, evidence_anchor_ids: array<string>, evidence_anchors: array<string>, invocation_guide: string, procedure_json: {_BLURB}, trials_attempted: double, trials_passed: double, repairOrigin: string, repair_origin: string, success_rate: double, beta_posterior: struct<alpha: double, beta: double, mean: double>>"
_FACTS = "array<struct<label: string, description: string>>"
WORLD = f"struct<title: string, domain_key: string, domain_tags: array<string>, policy_ids: array<string>, confidence: double, cohesion: double, admission: string, structure: struct<environment: {_FACTS}, inference: {_FACTS}, constraints: {_FACTS}>, summary: string, body: string>"
LIFE = ("candidate", "active", "archived")
EXPERIENCE = ("success_pattern", "repair_validated", "failure_avoidance", "repair_instruction", "preference", "verifier_feedback")
POLARITY = ("positive", "negative", "mixed", "neutral")
ADMISSION = ("strict", "loose")


def _record(info: Column, name: str, schema: str) -> Column:
    return F.from_json(F.get_json_object(info, f"$.internal_info.{name}"), schema)


def _one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def _list(value: Column) -> Column:
    return F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda x: x.isNotNull())


def _said(value: Column, default: Column | str) -> Column:
    return F.coalesce(value, F.lit(default) if isinstance(default, str) else default)


def _number(*values: Column, default: float = 0.0) -> Column:
    return F.coalesce(*values, F.lit(default))


def policy_meta(layer: Column, info: Column, key: Column, value: Column) -> Column:
    """The record of an L2 memory; null without one."""
    p = _record(info, "policy", POLICY)
    outer = F.from_json(F.get_json_object(info, "$.internal_info.source_feedback_ids"), "array<string>")
    g = p["decision_guidance"]
    return F.when(
        (layer == "L2") & p.isNotNull(),
        F.struct(
            F.coalesce(p["title"], key, first_line(value)).alias("title"),
            _said(p["trigger"], "").alias("trigger"),
            _said(p["procedure"], value).alias("procedure"),
            _said(p["verification"], "").alias("verification"),
            _said(p["boundary"], "").alias("boundary"),
            _number(p["support"]).alias("support"),
            _number(p["gain"]).alias("gain"),
            F.coalesce(p["policy_confidence"], p["confidence"], clamp01(0.5 + _number(p["gain"]))).alias("confidence"),
            _one_of(p["status"], LIFE, "candidate").alias("status"),
            _one_of(p["experience_type"], EXPERIENCE, "success_pattern").alias("experience_type"),
            _one_of(p["evidence_polarity"], POLARITY, "positive").alias("polarity"),
            F.coalesce(p["skill_eligible"], F.lit(True)).alias("eligible"),
            _said(p["signature"], "_|_|_|_").alias("signature"),
            _list(p["source_episode_ids"]).alias("source_episode_ids"),
            _list(p["source_trace_ids"]).alias("source_trace_ids"),
            F.array_distinct(F.concat(_list(p["source_feedback_ids"]), _list(outer))).alias("source_feedback_ids"),
            _list(g["preference"]).alias("preference"),
            F.array_distinct(F.concat(_list(g["anti_pattern"]), _list(g["antiPattern"]))).alias("anti_pattern"),
            _number(p["salience"], p["raw_gain"], p["gain"]).alias("salience"),
        ),
    )


def skill_meta(layer: Column, info: Column, key: Column, value: Column) -> Column:
    """The record of a Skill memory; null without one."""
    s = _record(info, "skill", SKILL)
    b = F.coalesce(s["procedure_json"], _record(info, "procedure_json", _BLURB))
    tried, passed = _number(s["trials_attempted"]), _number(s["trials_passed"])
    whole = F.greatest(F.floor(tried), F.lit(0))
    good = F.least(whole, F.greatest(F.floor(passed), F.lit(0)))
    mean = F.coalesce(F.when(s["beta_posterior"]["alpha"].isNotNull() & s["beta_posterior"]["beta"].isNotNull(), clamp01(s["beta_posterior"]["mean"])), (good + 1) / (whole + 2))
    truth = lambda c: F.when(c == "true", True).when(c == "false", False).otherwise(c.try_cast("double") != 0)
    return F.when(
        (layer == "Skill") & s.isNotNull(),
        F.struct(
            F.coalesce(s["name"], key, first_line(value)).alias("name"),
            _number(s["eta"]).alias("eta"),
            _one_of(s["status"], LIFE, "candidate").alias("status"),
            _number(s["support"]).alias("support"),
            _list(s["source_policy_ids"]).alias("source_policy_ids"),
            _list(s["source_world_model_ids"]).alias("source_world_model_ids"),
            F.concat(_list(s["evidence_anchor_ids"]), _list(s["evidence_anchors"])).alias("evidence_anchor_ids"),
            _said(s["invocation_guide"], value).alias("invocation_guide"),
            F.coalesce(b["retrievalBlurb"], b["retrieval_blurb"]).alias("blurb"),
            F.coalesce(b["triggerContext"], b["trigger_context"]).alias("trigger_context"),
            tried.alias("attempted"),
            passed.alias("passed"),
            F.coalesce(truth(s["repairOrigin"]), truth(s["repair_origin"]), F.lit(False)).alias("repair_origin"),
            F.coalesce(s["success_rate"], success_rate(tried, passed)).alias("success_rate"),
            mean.alias("posterior_mean"),
        ),
    )


def world_meta(layer: Column, info: Column, key: Column, value: Column, id_: Column) -> Column:
    """The record of an L3 memory; null without one."""
    w = _record(info, "world_model", WORLD)
    line = first_line(value)
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    entries = lambda c: F.coalesce(c, F.array().cast(_FACTS))
    return F.when(
        (layer == "L3") & w.isNotNull(),
        F.struct(
            F.coalesce(filled(w["title"]), filled(line), filled(key), id_).alias("title"),
            _said(w["domain_key"], "__generic|_").alias("domain_key"),
            _list(w["domain_tags"]).alias("domain_tags"),
            _list(w["policy_ids"]).alias("policy_ids"),
            _number(w["confidence"]).alias("confidence"),
            _number(w["cohesion"], default=1.0).alias("cohesion"),
            _one_of(w["admission"], ADMISSION, "strict").alias("admission"),
            F.concat(entries(w["structure"]["environment"]), entries(w["structure"]["inference"]), entries(w["structure"]["constraints"])).alias("facts"),
            F.coalesce(w["summary"], F.get_json_object(info, "$.internal_info.summary")).alias("summary"),
            _said(w["body"], value).alias("body"),
        ),
    )


def _lines(*parts: Column) -> Column:
    """What is not empty, line by line."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def retrieval_document(skill: Column, world: Column, value: Column, tags: Column) -> Column:
    """What retrieval sees of a memory: a skill's name, its blurb and trigger (else its guide)
    and tags; a world model's title, summary, tags and facts (without a summary, its
    body); else the value."""
    short = _lines(skill["blurb"], skill["trigger_context"])
    guide = F.when(short != "", short).otherwise(skill["invocation_guide"])
    told = F.transform(world["facts"], lambda e: F.array_join(F.filter(F.array(e["label"], e["description"]), lambda x: F.coalesce(x, F.lit("")) != ""), ": "))
    facts = F.when(F.coalesce(world["summary"], F.lit("")) != "", F.array_join(F.filter(told, lambda x: x != ""), "\n")).otherwise(world["body"])
    return F.when(skill.isNotNull(), _lines(skill["name"], guide, F.array_join(tags, " "))).when(world.isNotNull(), _lines(world["title"], world["summary"], F.array_join(world["domain_tags"], " "), facts)).otherwise(value)


def embedding_text(summary: Column, reflection: Column, policy: Column, document: Column, too_long: Column) -> Column:
    """What is embedded: a trace's summary and reflection; of a policy that warns its title and
    trigger, the title alone if those are too long, of another all its parts; else the
    retrieval document."""
    warns = (policy["experience_type"] == "failure_avoidance") | (policy["polarity"] == "negative")
    warning = F.when(too_long, policy["title"]).otherwise(_lines(policy["title"], policy["trigger"]))
    parts = _lines(policy["title"], policy["trigger"], policy["procedure"], policy["verification"], policy["boundary"])
    return F.when(summary.isNotNull() | reflection.isNotNull(), _lines(summary, reflection)).when(policy.isNotNull(), F.when(warns, warning).otherwise(parts)).otherwise(document)
