"""Learning statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def priority(value: Column, ts_ms: Column, now_ms: int, half_life_days: float = 30.0) -> Column:
    """max(value, 0), halved every half-life; a future time does not decay."""
    days = F.greatest((F.lit(now_ms) - ts_ms) / DAY_MS, F.lit(0.0))
    return F.greatest(value, F.lit(0.0)) * F.pow(F.lit(0.5), days / max(1.0, half_life_days))


def reflection_alpha(label: Column, alpha: Column) -> Column:
    own, text = clamp01(F.coalesce(alpha, F.lit(0.0))), F.trim(F.coalesce(label, F.lit("")))
    return F.when(text == "", F.when(own > 0, own).otherwise(0.5)).when(text == "IRRELEVANT", 0.0).when(text.isin("RELATED", "RELATED_DEFAULT"), 0.5).when(text == "PIVOTAL", 1.0).otherwise(own)


def reward_axes(goal: Column, process: Column, satisfaction: Column) -> Column:
    goal, process, satisfaction = (clamp(x, -1.0, 1.0) for x in (goal, process, satisfaction))
    return clamp(0.45 * goal + 0.30 * process + 0.25 * satisfaction, -1.0, 1.0)


def gain_ema(new: Column, current: Column, alpha: float, first: Column) -> Column:
    a = min(max(alpha, 0.0), 1.0)
    return F.when(first, new).otherwise(a * new + (1 - a) * current)


def policy_status(status: Column, support: Column, gain: Column, min_support: float = 2, min_gain: float = 0.1, archive_gain: float = -0.05) -> Column:
    candidate = F.when((support >= min_support) & (gain >= min_gain), "active").otherwise("candidate")
    return F.when(status == "archived", "archived").when(status == "candidate", candidate).when((gain < archive_gain) | (support <= 0), "archived").otherwise("active")


def success_rate(attempted: Column, passed: Column) -> Column:
    return F.when(attempted <= 0, 0.0).otherwise(clamp01(passed / attempted))


def beta_posterior(attempted: Column, passed: Column) -> dict[str, Column]:
    """alpha, beta and mean under a uniform prior."""
    n = F.greatest(F.floor(attempted), F.lit(0))
    p = F.least(n, F.greatest(F.floor(passed), F.lit(0)))
    return {"alpha": p + 1, "beta": n - p + 1, "mean": (p + 1) / (n + 2)}


def eta_after_trial(eta: Column, attempts: Column, passes: Column, next_attempts: Column, next_passes: Column) -> Column:
    """Takes the old trials out of eta to find the prior, then averages anew."""
    n0 = F.greatest(attempts, F.lit(0))
    p0 = F.least(F.greatest(passes, F.lit(0)), n0)
    n1 = F.greatest(n0, next_attempts)
    p1 = F.least(F.greatest(next_passes, F.lit(0)), n1)
    return clamp01((clamp01(eta * (1 + n0) - p0) + p1) / (1 + n1))


def status_after_trial(status: Column, eta: Column, attempts: Column, candidate_trials: int = 3, floor: float = 0.5, archive: float = 0.3) -> Column:
    decided = F.when((status == "candidate") & (attempts >= max(1, candidate_trials)), F.when(eta >= floor, "active").otherwise("archived")).otherwise(status)
    return F.when((decided == "active") & (eta < archive), "archived").otherwise(decided)


def eta_after_drift(eta: Column, magnitude: Column) -> Column:
    return clamp01(0.7 * clamp01(eta) + 0.3 * clamp01(magnitude))


def status_after_drift(status: Column, eta: Column, archive: float = 0.3) -> Column:
    return F.when((status != "archived") & (eta < archive), "archived").otherwise(status)


def world_confidence(base: Column, admission: Column, cohesion: Column) -> Column:
    """Loose admission is damped by how far the cluster coheres."""
    return F.when(admission == "strict", clamp01(base)).otherwise(clamp01(clamp01(base) * (0.6 + 0.4 * clamp01(cohesion))))


def layer_weight(layer: Column) -> Column:
    return F.when(layer == "Skill", 1.25).when(layer == "L2", 1.15).when(layer == "L3", 1.05).otherwise(1.0)


def layer_bonus(layer: Column, eta: Column, value_priority: Column, gain: Column, eta_blend: float = 0.15, priority_blend: float = 0.3) -> Column:
    """What a candidate's layer adds to its best channel score."""
    return F.when(layer == "Skill", eta_blend * F.coalesce(eta, F.lit(0.0))).when(layer == "L1", priority_blend * F.coalesce(value_priority, F.lit(0.0))).when(layer == "L2", 0.2 * clamp01(F.coalesce(gain, F.lit(0.0)))).otherwise(0.0)


def retry_backoff_ms(attempt: Column, base: int = 30_000, most: int = 3_600_000) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(most)).cast("long")
