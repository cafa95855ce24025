"""From articles and a model's replies to analyses, metric rows and secrecy rows, from one scan of the articles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions import assessment, lexicons, scoring, text
from lodeglass.operators import evidence, secrecy
from lodeglass.operators.joins import corroborated
from lodeglass.operators.storage import cut

_INDICATOR = "array<struct<type: string, term: string, severity: string, confidence: double, evidence: string>>"


@dataclass(frozen=True)
class Terms:
    """The word lists of the whole plan."""

    capability: tuple[str, ...] = lexicons.CAPABILITY
    noise: tuple[str, ...] = lexicons.NOISE
    keywords: tuple[str, ...] = lexicons.EVIDENCE
    benchmarks: tuple[tuple[str, str], ...] = tuple(lexicons.BENCHMARKS.items())
    metrics: tuple[str, ...] = lexicons.METRICS
    secrecy: tuple[str, ...] = lexicons.SECRECY
    caution: tuple[str, ...] = lexicons.CAUTION
    government: tuple[str, ...] = lexicons.GOVERNMENT
    leaving: tuple[str, ...] = lexicons.DEPARTURE
    senior: tuple[str, ...] = lexicons.SENIOR


def read(articles: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """What the plan needs of each article (id, source, title, content), in one pass and without its content.

    id, source, filtered, reason, claims (structs), snippets (their number), signs (structs of secrecy), types of claims and
    ladder words. All is worked out inside the row: no sentence and no content is shuffled. What triage sets aside is read
    no further.
    """
    rows = evidence.triage(articles.select("id", "source", "title", "content"), terms.capability, terms.noise)
    rows = rows.select("id", "source", "content", F.col("skip").alias("filtered"), "reason")
    good = ~F.col("filtered")
    rows = evidence.with_snippets(rows, "best", terms.keywords, tuple(t for t, _ in terms.benchmarks), wanted=good)
    made = F.transform(F.slice("best", 1, 4), lambda s: evidence.claim(s["snippet"], s["tags"], dict(terms.benchmarks), terms.metrics))
    rows = rows.withColumns({"claims": made, "low": F.when(good, F.lower("content"))})
    found = F.transform(secrecy.hit_array(F.col("low"), terms.secrecy, terms.caution, terms.government), lambda h: F.struct(h["type"].alias("type"), h["term"].alias("term"), h["severity"].alias("severity"), h["confidence"].alias("confidence"), secrecy.context(F.col("content"), h["term"]).alias("evidence")))
    left = F.struct(F.lit("departure").alias("type"), F.lit(None).cast("string").alias("term"), F.lit("high").alias("severity"), F.lit(0.6).alias("confidence"), F.substring("content", 1, 200).alias("evidence"))
    gone = text.any_term(F.col("low"), terms.leaving) & text.any_term(F.col("low"), terms.senior)
    signs = F.concat(F.coalesce(found, F.array().cast(_INDICATOR)), F.when(gone, F.array(left)).otherwise(F.array().cast(_INDICATOR)))
    whole = F.concat_ws(" ", "content", F.transform("claims", lambda c: c["claim"]))
    kinds = F.when(good, assessment.claim_types(whole, F.exists("claims", lambda c: F.coalesce(c["benchmark"] != "", F.lit(False)))))
    return rows.select("id", "source", "filtered", "reason", "claims", F.size("best").alias("snippets"), signs.alias("signs"), kinds.alias("types"), F.when(good, assessment.ladder_words(F.col("content"))).alias("words"))


def _references(models: DataFrame, articles: DataFrame) -> DataFrame:
    """id and whether any reference of its model's reply is the source of a stored article, of replies that have references."""
    named = models.select("id", F.explode("refs").alias("ref"))
    return corroborated(named, articles).groupBy("id").agg(F.bool_or("found").alias("known"))


def analysed(articles: DataFrame, models: DataFrame, terms: Terms = Terms(), stored: DataFrame | None = None, status: Column | None = None) -> DataFrame:
    """The whole result of every article with a model's reply, held in the shared folder for its three tables.

    `models` has id, model_score, confidence, severity (the model's own, or null), indicators and refs (arrays). References
    are checked against the sources of `stored` (by default the articles). Noise gets the fixed score 0.05 and costs no more. The
    others' scores combine the model's with the points of their claims and with signs of secrecy, less a penalty where no
    reference is a known source; their severity is that of the score but not under the model's own, and critical only
    with a gain in a benchmark. Replies' missing scores, lists and confidences are zeros and empty. The source's
    status is `status`, a column of the articles' sources, by default live.
    """
    asked = models.select("id", F.coalesce("model_score", F.lit(0.0)).alias("model_score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("severity").alias("prior"), F.coalesce("indicators", _no_names()).alias("indicators"), F.coalesce("refs", _no_names()).alias("refs"))
    known = _references(asked, articles if stored is None else stored)
    rows = read(articles, terms).join(asked, "id").join(known, "id", "left")
    critical, high = _has("critical"), _has("high")
    rows = rows.withColumns({
        "critical": critical, "boost": F.when(critical, 0.2).when(high, 0.1).otherwise(0.0), "heuristic": _heuristic(),
        "penalty": F.when((F.size("refs") > 0) & ~F.coalesce("known", F.lit(False)), 0.15).otherwise(0.0), "has_delta": F.exists("claims", evidence.has_gain),
        "has_benchmark": F.exists("claims", lambda c: F.coalesce(c["benchmark"] != "", F.lit(False))),
    })
    combined = F.round(scoring.combined_score(F.col("model_score"), F.col("heuristic"), F.col("boost"), F.col("penalty")), 6)
    support = F.when((F.size("refs") > 0) & (F.col("penalty") == 0), "same_source").otherwise("none")
    live = F.lit("live") if status is None else status
    judged = assessment.assess(F.lit(""), F.lit(""), F.col("model_score"), F.col("heuristic"), F.col("boost"), live, support, F.col("has_benchmark"), F.col("has_delta"), F.col("types"), F.col("words"))
    rows = rows.withColumns({"combined": combined, "judged": F.when(~F.col("filtered"), judged)})
    gated = scoring.gated_severity(scoring.raised_severity(F.col("combined"), F.col("prior")), F.col("has_delta"))
    named = F.transform(secrecy.described_array(F.col("signs")), lambda d: F.concat(F.lit("[SECRECY] "), d))
    either = lambda noise, other: F.when(F.col("filtered"), noise).otherwise(other)
    return cut(rows.select(
        "id", "source", "filtered", either(F.lit(0.05), F.col("combined")).alias("score"), either(F.lit(0.9), F.col("confidence")).alias("confidence"), either(F.lit("low"), gated).alias("severity"),
        either(F.lit(0.0), F.col("model_score")).alias("model_score"), either(F.lit(0.0), F.col("heuristic")).alias("heuristic"), either(_no_names(), F.concat("indicators", named)).alias("indicators"),
        either(F.lit(False), F.col("critical")).alias("requires_verification"), either(_no_names(), F.col("refs")).alias("refs"), "penalty",
        either(F.array().cast("array<struct<name: string, value: double, detail: string>>"), _signals()).alias("signals"), F.when(F.col("filtered"), F.concat(F.lit("Layer-0 noise filter: "), "reason")).alias("explanation"),
        F.col("judged").alias("assessment"), "signs",
    ))


def analyses(found: DataFrame) -> DataFrame:
    """The table of analyses: a row for each article."""
    return found.drop("signs", "source", "penalty")


def metric_rows(found: DataFrame) -> DataFrame:
    """id, metric, value: five rows for each analysis."""
    wide = found.select("id", "score", "model_score", F.col("heuristic").alias("heuristic_score"), "confidence", F.size("indicators").cast("double").alias("indicator_count"))
    return wide.unpivot("id", ["score", "model_score", "heuristic_score", "confidence", "indicator_count"], "metric", "value")


def secrecy_rows(found: DataFrame) -> DataFrame:
    """id, source, type, severity, confidence, evidence, description: a row for every sign of secrecy."""
    rows = found.select("id", F.coalesce("source", F.lit("Unknown")).alias("source"), F.inline("signs"))
    return secrecy.described(rows).select("id", "source", "type", "severity", "confidence", "evidence", "description")


def scored(articles: DataFrame, models: DataFrame, capability=lexicons.CAPABILITY, noise=lexicons.NOISE, benchmarks=lexicons.BENCHMARKS, metrics=lexicons.METRICS, secret=lexicons.SECRECY) -> DataFrame:
    """id, filtered, score, confidence and severity of every article with a model's score (id, model_score, confidence), from one lazy pass over the contents."""
    terms = Terms(tuple(capability), tuple(noise), benchmarks=tuple(benchmarks.items()), metrics=tuple(metrics), secrecy=tuple(secret), caution=(), government=())
    rows = read(articles, terms).join(models.select("id", "model_score", "confidence"), "id")
    critical, high = _has("critical"), _has("high")
    rows = rows.withColumns({"heuristic": _heuristic(), "boost": F.when(critical, 0.2).when(high, 0.1).otherwise(0.0), "has_delta": F.exists("claims", evidence.has_gain)})
    score = F.when(F.col("filtered"), 0.05).otherwise(F.round(scoring.combined_score(F.col("model_score"), F.col("heuristic"), F.col("boost"), F.lit(0.0)), 6))
    rows = rows.withColumn("score", score)
    gated = scoring.gated_severity(scoring.severity(F.col("score")), F.col("has_delta"))
    return rows.select("id", "filtered", "score", F.when(F.col("filtered"), 0.9).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("filtered"), "low").otherwise(gated).alias("severity"))


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _has(severity: str) -> Column:
    return F.exists("signs", lambda s: s["severity"] == severity)


def _heuristic() -> Column:
    return evidence.heuristic(F.col("claims"), F.col("snippets"))


def _signals() -> Column:
    return evidence.article_signals(F.col("claims"), F.col("snippets"), F.col("boost"), F.col("critical"), F.col("penalty"))
