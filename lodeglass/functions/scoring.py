"""Scores, severities and bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions import lexicons


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def band(x: Column, steps: list[tuple[float, str]], other: str, strict: float | None = None) -> Column:
    """The label of the first step that x reaches; a step equal to `strict` must be passed."""
    out = None
    for least, label in steps:
        hit = x > least if least == strict else x >= least
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


def severity(score: Column) -> Column:
    return band(score, [(0.8, "critical"), (0.6, "high"), (0.3, "medium"), (0.0, "low")], "none", strict=0.0)


def severity_rank(name: Column) -> Column:
    """0 for none to 4 for critical; null for any other word."""
    return F.nullif(F.array_position(F.array(*map(F.lit, lexicons.SEVERITIES)), name), F.lit(0)) - 1


def raised_severity(score: Column, prior: Column) -> Column:
    """The severity of a score, but never under a known prior one; an unknown prior word stays."""
    now = severity(score)
    return F.when(prior.isNull(), now).when(severity_rank(now) >= severity_rank(prior), now).otherwise(prior)


def gated_severity(name: Column, has_delta: Column) -> Column:
    return F.when((name == "critical") & ~has_delta, "high").otherwise(name)


def overridden_severity(name: Column, recommendation: Column) -> Column:
    return F.when((recommendation == "dismiss") & name.isin("high", "critical"), "medium").otherwise(name)


def combined_score(model: Column, heuristic: Column, boost: Column, penalty: Column, model_weight: float = 0.85, heuristic_weight: float = 0.15) -> Column:
    return clamp(F.greatest(model, model * model_weight + heuristic * heuristic_weight) + boost - penalty)


def claim_points(benchmark: Column, value: Column, delta: Column, tags: Column) -> Column:
    """What one claim adds to an article's heuristic score."""
    arc = benchmark.isin("ARC", "ARC-AGI", "ARC-AGI-2")
    points = F.when(benchmark.isNotNull() & (benchmark != ""), 0.03).otherwise(0.0)
    points += F.when(arc & (value >= 25), 0.15).when(arc & (value >= 10), 0.1).otherwise(0.0)
    points += F.when(delta >= 10, 0.1).when(delta >= 5, 0.05).otherwise(0.0)
    return points + F.when(F.array_contains(tags, "human-level"), 0.06).otherwise(0.0) + F.when(F.array_contains(tags, "generalization"), 0.04).otherwise(0.0)


def progress(top: Column) -> Column:
    """How far a top score is from the baseline 0.04 to 1, in percent."""
    return clamp((top - 0.04) / 0.96 * 100, 0.0, 100.0)


def progress_status(top: Column) -> Column:
    return band(top, [(0.75, "exceptional"), (0.5, "strong"), (0.25, "notable"), (0.1, "watch")], "baseline")


def score_label(score: Column) -> Column:
    return band(score, [(0.7, "Critical watch signal"), (0.5, "High-watch signal"), (0.3, "Needs review"), (0.1, "Low-watch signal")], "No clear signal")


def outlier_band(distance: Column) -> Column:
    return band(distance, [(0.8, "highly unusual"), (0.6, "notable"), (0.4, "moderate")], "minor")


def feedback_impact(kind: Column, score: Column) -> Column:
    """The score that feedback of a kind asks for."""
    return F.when(kind == "critical", F.least(F.lit(1.0), score * 1.2)).when(kind == "noise", score * 0.5).when(kind == "false_positive", score * 0.3).otherwise(score)


def validated_score(recommendation: Column, score: Column, corrected: Column, penalty: Column) -> Column:
    """The score after a validation: held, lowered, dismissed, under investigation, or as corrected."""
    out = F.when(recommendation == "investigate", F.least(F.greatest(score, corrected), F.greatest(F.lit(0.35), score)))
    out = out.when(recommendation == "lower", F.least(F.greatest(F.lit(0.0), score - 0.1 - penalty), corrected))
    out = out.when(recommendation == "dismiss", F.least(F.lit(0.2), corrected)).when(recommendation == "hold", F.greatest(F.lit(0.0), score - penalty))
    return clamp(out.otherwise(corrected))
