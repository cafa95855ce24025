"""Signs of secrecy: lexicon hits, departures, publication gaps, removed content, and the risk they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeglass.functions import lexicons, text


def term_severity(term: Column) -> Column:
    has = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(term), t))
    return F.when(has(lexicons.CRITICAL_TERMS), "critical").when(has(lexicons.HIGH_TERMS), "high").otherwise("medium")


def context(content: Column, term: Column, reach: int = 50) -> Column:
    """The text around the first occurrence, between dots."""
    at = F.position(term, F.lower(content))
    first = F.greatest(F.lit(1), at - reach)
    return F.when(at > 0, F.concat(F.lit("..."), F.substring(content, first, at + F.length(term) + reach - first), F.lit("...")))


def hit_array(low: Column, secrecy=lexicons.SECRECY, caution=lexicons.CAUTION, government=lexicons.GOVERNMENT) -> Column:
    """An array of type, term, severity and confidence of every term of three lists in a content that is in lower case, in list order."""
    def found(terms, kind, severity, confidence) -> Column:
        hit = lambda t: F.struct(F.lit(kind).alias("type"), t.alias("term"), severity(t).alias("severity"), F.lit(confidence).alias("confidence"))
        return F.transform(text.terms_in(low, terms), hit)

    parts = (found(secrecy, "silence", term_severity, 0.7), found(caution, "safety_meeting", lambda t: F.lit("medium"), 0.5), found(government, "government", lambda t: F.lit("high"), 0.8))
    return F.concat(*parts)


def hits(articles: DataFrame, secrecy=lexicons.SECRECY, caution=lexicons.CAUTION, government=lexicons.GOVERNMENT) -> DataFrame:
    """id, type, term, severity, confidence and evidence of every term of three lists in an article; the lists are arrays, so nothing is joined."""
    rows = articles.select("id", "content", F.lower("content").alias("low"))
    rows = rows.select("id", "content", F.explode(hit_array(F.col("low"), secrecy, caution, government)).alias("hit")).select("id", "content", "hit.*")
    return rows.withColumn("evidence", context(F.col("content"), F.col("term"))).drop("content")


def departures(articles: DataFrame, leaving=lexicons.DEPARTURE, senior=lexicons.SENIOR) -> DataFrame:
    """One row for an article that has a term of leaving and one of a senior role."""
    low = articles.select("id", "content", F.lower("content").alias("low"))
    return low.filter(text.any_term(F.col("low"), leaving) & text.any_term(F.col("low"), senior)).select("id", F.lit("departure").alias("type"), F.lit(None).cast("string").alias("term"), F.lit("high").alias("severity"), F.lit(0.6).alias("confidence"), F.substring("content", 1, 200).alias("evidence"))


def publication_gaps(articles: DataFrame, as_of: Column, expected: dict[str, int] | None = None, usual: int = lexicons.USUAL_DAYS) -> DataFrame:
    """source, gap_days, expected_days, anomalous (over twice the expected) and severity (high over four times)."""
    days = F.coalesce(*(F.when(F.col("source") == s, n) for s, n in (lexicons.DAYS_BETWEEN_PUBLICATIONS if expected is None else expected).items()), F.lit(usual))
    last = articles.groupBy("source").agg(F.max("ts").alias("last"))
    rows = last.select("source", F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("last")) / 86400).alias("gap_days"), days.cast("bigint").alias("expected_days"))
    return rows.withColumns({"anomalous": F.col("gap_days") > 2 * F.col("expected_days"), "severity": F.when(F.col("gap_days") > 4 * F.col("expected_days"), "high").when(F.col("gap_days") > 2 * F.col("expected_days"), "medium")})


def removals(before: DataFrame, after: DataFrame, shown: int = 5) -> DataFrame:
    """source, removed, total, rate, severity where more than a tenth of the titles before are gone after; and the first `shown` of them, in order.

    Titles are cut to the first of each source in each task before they are brought together, so a source of any number of them is no group held at once.
    """
    gone = before.join(after.select("source", "title").distinct(), ["source", "title"], "left_anti")
    place = F.row_number().over(Window.partitionBy("source").orderBy("title"))
    first = gone.select("source", "title").distinct().withColumn("place", place).filter(F.col("place") <= shown).groupBy("source").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    counts = before.groupBy("source").agg(F.count("*").alias("total")).join(gone.groupBy("source").agg(F.count("*").alias("removed")), "source").join(first, "source", "left")
    rate = F.col("removed") / F.col("total")
    severity = F.when(rate > 0.3, "critical").when(rate > 0.2, "high").when(rate > 0.1, "medium")
    return counts.select("source", "removed", "total", rate.alias("rate"), severity.alias("severity"), "titles").filter("severity is not null")


def risk(indicators: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: counts of critical, high and all indicators and of anomalous gaps, and the risk that they add up to."""
    found = indicators.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.count("*").alias("total"))
    late = gaps.agg(F.count_if(F.col("anomalous")).alias("gaps"))
    c, h, t, g = (F.col(x) for x in ("critical", "high", "total", "gaps"))
    level = F.when((c > 0) | (h >= 3) & (g >= 2), "critical").when((h >= 2) | (h >= 1) & (g >= 2), "high").when((h >= 1) | (g >= 2) | (t >= 5), "medium").otherwise("low")
    return found.crossJoin(F.broadcast(late)).withColumn("risk", level)


def boosts(indicators: DataFrame) -> DataFrame:
    """id and boost: 0.2 with a critical indicator, else 0.1 with a high one."""
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "high", 1).otherwise(0)
    return indicators.groupBy("id").agg(F.max(rank).alias("r")).select("id", F.when(F.col("r") == 2, 0.2).when(F.col("r") == 1, 0.1).otherwise(0.0).alias("boost"))


# How indicators are described.
DESCRIPTIONS = {"silence": 'Secrecy-related language detected: "%s"', "safety_meeting": 'Unusual caution detected: "%s"', "government": 'Government involvement detected: "%s"', "departure": "Senior AI researcher departure detected"}


def _description(kind: Column, term: Column) -> Column:
    out = kind
    for name, shape in DESCRIPTIONS.items():
        out = F.when(kind == name, F.format_string(shape, term) if "%s" in shape else F.lit(shape)).otherwise(out)
    return out


def described(indicators: DataFrame) -> DataFrame:
    """Indicators (type, term, ...) with a description."""
    return indicators.withColumn("description", _description(F.col("type"), F.col("term")))


def described_array(indicators: Column) -> Column:
    """The descriptions of an array of indicators."""
    return F.transform(indicators, lambda i: _description(i["type"], i["term"]))


def merged_indicators(analyses: DataFrame, indicators: DataFrame) -> DataFrame:
    """id and indicators of analyses (id, crawl_id, indicators), followed by those of secrecy (id, type, term) of their article, each marked and in order of its description."""
    marked = described(indicators).groupBy(F.col("id").alias("crawl_id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("[SECRECY] "), "description"))).alias("more"))
    return analyses.join(marked, "crawl_id", "left").select("id", F.concat("indicators", F.coalesce("more", F.array().cast("array<string>"))).alias("indicators"))


def recent(indicators: DataFrame, articles: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Indicators (id, type, term, severity) of articles (id, ts) of the last days, with their time, newest first."""
    rows = indicators.join(articles.filter(F.col("ts") >= as_of - F.make_interval(days=F.lit(days))).select("id", "ts"), "id")
    return rows.select("id", "ts", "type", "term", "severity").orderBy(F.desc("ts"), "id", "type", "term")


def finding_articles(indicators: DataFrame, risks: DataFrame, shown: int = 5) -> DataFrame:
    """Article rows (title, content, source, kind) of indicators (id, source, type, term, severity, confidence, evidence) and their risk (one row of `risk`).

    A summary with the first `shown` indicators by id, type and term, unless there is no indicator and no late source;
    and one row for every critical or high indicator.
    """
    rows = described(indicators)
    source = F.lit("Secrecy Pattern Detection").alias("source")
    first = rows.orderBy("id", "type", "term").limit(shown).agg(F.array_sort(F.collect_list(F.struct("id", "type", "term", "description"))).alias("x"))
    listed = F.array_join(F.transform("x", lambda r: F.concat(r["type"], F.lit(": "), r["description"])), ". ")
    summary = risks.filter("total > 0 or gaps > 0").crossJoin(first).select(
        F.format_string("Secrecy Pattern Analysis: %s Risk", F.upper("risk")).alias("title"), F.concat(F.format_string("Secrecy analysis: %d indicators, %d late sources. ", "total", "gaps"), listed).alias("content"), source, F.lit("secrecy_analysis").alias("kind"),
    )
    said = F.format_string("%s indicator detected at %s. Evidence: %s. Confidence: %d%%", F.upper("type"), "source", "evidence", F.round(F.col("confidence") * 100).cast("int"))
    alerts = rows.filter(F.col("severity").isin("critical", "high")).select(F.concat(F.lit("Secrecy Alert: "), "description").alias("title"), said.alias("content"), source, F.lit("secrecy_indicator").alias("kind"))
    return summary.unionByName(alerts)
