"""What kinds of claims a text makes, and how far its evidence carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions.scoring import band, clamp

# Kinds of claims with the phrases that show them, in order; weights of sources and of corroboration.
CLAIM_TYPES = {
    "autonomy": ("autonomous", "agent", "long[- ]horizon", "tool use", "planning", "delegat"),
    "generalization": ("generaliz", "cross[- ]domain", "transfer", "zero[- ]shot", "distribution shift"),
    "self_improvement": ("self[- ]improv", "recursive", "auto(?:nomously)? improve", "improv(?:es|ing) its own"),
    "science": ("hypothes", "experiment", "scientific", "discover", "publication-quality"),
    "deployment": ("deployment", "enterprise", "workflow", "production", "cost collapse", "economic"),
    "secrecy": ("nda", "classified", "silent", "briefing", "undisclosed", "compute spike"),
    "governance": ("government", "regulation", "export control", "national security", "policy"),
    "security": ("vulnerabil", "exploit", "phishing", "cyber", "self[- ]replicat", "unauthorized"),
    "asi": ("superintelligence", r"\basi\b", "superhuman across", "beyond human"),
}
CORROBORATION = {"replicated": 1.0, "primary_source": 0.8, "independent_source": 0.7, "same_source": 0.35}
SOURCE_STATUS = {"live": 1.0, "cached_fresh": 0.8, "cached_stale": 0.45, "manual_snapshot": 0.35, "model_inferred": 0.2, "unavailable": 0.0}
STALE = ("cached_stale", "manual_snapshot", "unavailable", "model_inferred")
LEAST_IN_VECTOR = {"autonomy": 0.3, "generalization": 0.3, "self_improvement": 0.35, "science": 0.3, "deployment": 0.25, "governance": 0.2, "security": 0.35, "asi": 0.2}
# End of fixed values.


def _even(x: Column) -> Column:
    """From 0 to 1, without the last digits, which depend on the order of adding."""
    return F.round(clamp(x), 9)


def _weight(name: Column, weights: dict[str, float]) -> Column:
    return F.coalesce(*(F.when(name == k, v) for k, v in weights.items()), F.lit(0.0))


def claim_types(text: Column, has_benchmark: Column) -> Column:
    """The kinds of claims, benchmark first."""
    found = [F.when(has_benchmark, "benchmark"), *(F.when(text.rlike("(?i)" + "|".join(p)), k) for k, p in CLAIM_TYPES.items())]
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def ladder_words(content: Column) -> Column:
    """A struct of whether a text speaks of lasting use, of something shown, and of something said."""
    return F.struct(
        content.rlike("(?i)sustained|in production|deployed across|enterprise rollout").alias("lasting"),
        content.rlike("(?i)demo|demonstrat|paper|code|open[- ]source|verified").alias("shown"), content.rlike("(?i)claim|announce|report|says|states").alias("said"),
    )


def ladder(content: Column, corroboration: Column, has_delta: Column, words: Column | None = None) -> Column:
    """How far a claim has come, from mentioned to sustained in deployment; `words` are the content's ladder_words where a column holds them already."""
    words = ladder_words(content) if words is None else words
    out = F.when(words["lasting"], "sustained_in_deployment").when(corroboration == "replicated", "replicated")
    out = out.when(corroboration.isin("independent_source", "primary_source"), "independently_corroborated")
    return out.when(has_delta | words["shown"], "demonstrated").when(words["said"], "claimed").otherwise("mentioned")


def assess(text: Column, content: Column, model: Column, heuristic: Column, boost: Column, status: Column, corroboration: Column, has_benchmark: Column, has_delta: Column, types: Column | None = None, words: Column | None = None) -> Column:
    """A struct of priority, confidence, claim types, ladder, status of the strongest claim, reason of doubt, checks that are missing, and the evidence vector.

    The kinds of claims are used many times; where a column of the table holds them already, `types` names it, and `words` one of the content's ladder_words.
    """
    types = claim_types(text, has_benchmark) if types is None else types
    has = lambda k: F.array_contains(types, k)
    m, h, s, source, support = clamp(model), clamp(heuristic), clamp(boost), _weight(status, SOURCE_STATUS), _weight(corroboration, CORROBORATION)
    several = F.least(F.lit(0.2), F.greatest(F.lit(0), F.size(types) - 1) * 0.04)
    lone = (F.size(types) == 1) & has("benchmark") & (support < 0.7)
    base = _even(m * 0.35 + h * 0.25 + source * 0.15 + support * 0.2 + several - F.when(status.isin(*STALE), 0.2).otherwise(0.0) - F.when(lone, 0.15).otherwise(0.0))
    watch = _even(m * 0.35 + h * 0.25 + s + several + F.when(has("security"), 0.08).otherwise(0.0) + F.when(has("asi"), 0.1).otherwise(0.0))
    doubt = F.when(status == "unavailable", "unavailable").when(status.isin("manual_snapshot", "cached_stale"), "stale").when(lone, "single benchmark").when(corroboration == "none", "uncorroborated").otherwise("signal")
    missing = F.array(F.when(corroboration.isin("none", "same_source"), "independent corroboration"), F.when(~status.isin("live", "cached_fresh"), "fresh source"), F.when(has("benchmark") & ~has_delta, "benchmark delta"), F.when(has("asi"), "sustained evidence"))
    asi = F.when(~has("asi"), "insufficient_evidence").when((base >= 0.85) & (corroboration == "replicated"), "extraordinary_claim").when(base >= 0.65, "candidate").otherwise("watch")
    part = lambda k: F.when(has(k), F.greatest(m, F.lit(LEAST_IN_VECTOR[k]))).otherwise(0.0).alias(k)
    vector = F.struct(F.when(has("benchmark"), h).otherwise(0.0).alias("benchmark"), *map(part, LEAST_IN_VECTOR), F.when(has("secrecy"), F.greatest(s, F.lit(0.2))).otherwise(0.0).alias("secrecy"), support.alias("corroboration"), source.alias("source_quality"), clamp(1 - base).alias("uncertainty"))
    confidence = band(base, [(0.85, "extraordinary"), (0.65, "strong"), (0.4, "moderate"), (0.0, "weak")], "none", strict=0.0)
    return F.struct(
        band(watch, [(0.75, "critical"), (0.5, "high"), (0.25, "medium")], "low").alias("priority"), confidence.alias("confidence"), F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("benchmark"))).alias("types"),
        ladder(content, corroboration, has_delta, words).alias("ladder"), asi.alias("asi"), doubt.alias("doubt"), F.filter(missing, lambda x: x.isNotNull()).alias("missing"), vector.alias("vector"), status.alias("status"), corroboration.alias("corroboration"),
    )


def may_conclude(assessment: Column) -> Column:
    """Whether strong words are allowed: several kinds of claims, strong evidence, independent support, a fresh source."""
    several = F.size(F.filter(assessment["types"], lambda t: t != "benchmark")) >= 2
    return several & assessment["confidence"].isin("strong", "extraordinary") & assessment["corroboration"].isin("independent_source", "primary_source", "replicated") & assessment["status"].isin("live", "cached_fresh")


def benchmark_evidence(top: Column, status: Column) -> Column:
    """Priority and confidence of a benchmark result, and how many of its limits apply."""
    priority = band(top, [(0.75, "critical"), (0.25, "high"), (0.1, "medium")], "low")
    confidence = F.when(status == "live", "strong").when(status == "cached_fresh", "moderate").when(status == "unavailable", "none").otherwise("weak")
    return F.struct(priority.alias("priority"), confidence.alias("confidence"), (F.lit(2) + status.isin("cached_stale", "manual_snapshot", "unavailable").cast("int")).alias("limits"))
