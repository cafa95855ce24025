"""Trends, counts by window, co-occurrence, evaluation and trajectory statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(as_of: Column, days: int, column: str = "ts") -> Column:
    return F.col(column) >= as_of - F.make_interval(days=F.lit(days))


def _summary() -> list[Column]:
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return [zero(F.avg("score"), "avg_score"), zero(F.max("score"), "max_score"), zero(F.min("score"), "min_score"), F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical")]


def snapshot(analyses: DataFrame, as_of: Column, days: int) -> DataFrame:
    """One row of mean, highest, lowest score, count and critical count of the last days; zeros where there is nothing."""
    return analyses.filter(within(as_of, days)).agg(*_summary())


def trend(analyses: DataFrame, periods: dict[str, str]) -> DataFrame:
    """The same by period (a name) and date bucket (day, week from Monday, month), all periods in one pass."""
    buckets = F.array(*(F.struct(F.lit(name).alias("period"), F.date_trunc(unit, "ts").cast("date").alias("bucket")) for name, unit in periods.items()))
    return analyses.select("score", "severity", F.inline(buckets)).groupBy("period", "bucket").agg(*_summary())


def indicator_counts(analyses: DataFrame, as_of: Column, by: tuple[str, ...] = (), days: tuple[int, ...] = (30, 90, 180)) -> DataFrame:
    """Counts of each indicator (and of it by more columns) in several windows, in one scan of the longest."""
    rows = analyses.filter(within(as_of, max(days))).select(*by, "ts", F.explode("indicators").alias("indicator"))
    return rows.groupBy(F.lower("indicator").alias("indicator"), *by).agg(*(F.count_if(within(as_of, d)).alias(f"cnt_{d}") for d in days))


def co_occurrence(analyses: DataFrame, articles: DataFrame, claims: DataFrame, as_of: Column, days: int, least_sources: int = 2) -> DataFrame:
    """Indicator, benchmark and metric by the analyses and sources they meet in, with mean and highest gain; from two sources on.

    Ids of analyses and articles are unique. The window and the benchmark filter come before the joins, no content
    travels, and an article's claims are summed by benchmark and metric first, so that analyses never meet single
    claims. Rows are then counted by source, and these counts added up, which takes the place of distinct counts.
    """
    recent = analyses.filter(within(as_of, days)).select("crawl_id", "indicators")
    where = articles.select(F.col("id").alias("crawl_id"), "source")
    said = claims.filter("benchmark is not null and delta is not null").groupBy("crawl_id", "benchmark", "metric").agg(F.count("*").alias("n"), F.sum("delta").alias("s"), F.max("delta").alias("m"))
    rows = recent.join(where, "crawl_id").join(said, "crawl_id").withColumn("indicator", F.explode(F.array_distinct(F.transform("indicators", F.lower))))
    by_source = rows.groupBy("indicator", "benchmark", "metric", "source").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("m").alias("m"))
    out = by_source.groupBy("indicator", "benchmark", "metric").agg(
        F.sum("k").alias("analyses"), F.count("source").alias("n_sources"), F.array_sort(F.collect_list("source")).alias("sources"), (F.sum("s") / F.sum("n")).alias("avg_delta"), F.max("m").alias("max_delta"),
    )
    return out.filter(F.col("n_sources") >= least_sources)


def confusion(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of counts and rates of feedback (relevant and critical being right) against scores at a threshold; rates of nothing are zero."""
    right, high = F.col("feedback_type").isin("relevant", "critical"), F.col("score") >= threshold
    counts = rows.agg(F.count_if(right & high).alias("tp"), F.count_if(~right & high).alias("fp"), F.count_if(~right & ~high).alias("tn"), F.count_if(right & ~high).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "accuracy": share(tp + tn, tp + fp + tn + fn), "fpr": share(fp, fp + tn), "fnr": share(fn, fn + tp)})
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy_by(feedback: DataFrame, column: str, more_than: int = 0) -> DataFrame:
    """The share of right feedback by a column, for groups of more rows than `more_than`."""
    right = F.col("feedback_type").isin("relevant", "critical").cast("double")
    return feedback.filter(F.col(column).isNotNull()).groupBy(column).agg(F.avg(right).alias("accuracy"), F.count("*").alias("total")).filter(F.col("total") > more_than)


def fallback_insights(counts: DataFrame, window_days: int, most: int) -> DataFrame:
    """The top indicators of counts by source, with total, top three sources, number of sources and a confidence by it."""
    field = "cnt_30" if window_days <= 30 else "cnt_90" if window_days <= 90 else "cnt_180"
    rows = counts.filter(F.col(field) > 0).withColumn("n", F.row_number().over(Window.partitionBy("indicator").orderBy(F.desc(field), "source")))
    out = rows.groupBy("indicator").agg(F.sum(field).alias("total"), F.count("*").alias("n_sources"), F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "source")))).alias("top"))
    confidence = F.when(F.col("n_sources") >= 3, 0.6).when(F.col("n_sources") == 2, 0.5).otherwise(0.35)
    return out.orderBy(F.desc("total"), "indicator").limit(most).select("indicator", "total", "n_sources", F.array_join(F.transform("top", lambda x: x["source"]), ", ").alias("sources"), confidence.alias("confidence"))


def direction(rows: DataFrame, as_of: Column) -> DataFrame:
    """The useful share of the last seven days against the seven before: improving, declining or stable (within 0.05)."""
    useful, week = F.col("was_useful").cast("double"), within(as_of, 7, "created_at")
    both = rows.filter(within(as_of, 14, "created_at")).agg(F.avg(F.when(week, useful)).alias("recent"), F.avg(F.when(~week, useful)).alias("before"))
    gap = F.coalesce(F.col("recent"), F.lit(0.0)) - F.coalesce(F.col("before"), F.lit(0.0))
    return both.withColumn("direction", F.when(gap > 0.05, "improving").when(gap < -0.05, "declining").otherwise("stable"))


def recommendations(total: Column, accuracy: Column, false_terms: Column, worst_source: Column, critical_accuracy: Column) -> Column:
    """What to tune, as an array of sentences."""
    said = F.array(
        F.when(total < 10, "Collect more feedback"), F.when(accuracy < 0.7, "Overall accuracy is low"), F.when(F.size(false_terms) > 0, F.concat(F.lit("Terms in false alarms: "), F.array_join(F.slice(false_terms, 1, 3), ", "))),
        F.when(worst_source.isNotNull(), F.concat(F.lit("Source to review: "), worst_source)), F.when(critical_accuracy < 0.8, "Critical alerts are too often wrong"),
    )
    kept = F.filter(said, lambda s: s.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("Performing well")))


def portfolio_risk(analyses: DataFrame, as_of: Column) -> DataFrame:
    """One risk level of the last 30 days: over analyses backed by a gain (`has_delta`) if there are any, else over all."""
    recent = analyses.filter(within(as_of, 30))
    def of(pool: Column, name: str) -> Column:
        return F.struct(F.count_if(pool).alias("n"), F.count_if(pool & (F.col("severity") == "critical")).alias("c"), F.count_if(pool & (F.col("severity") == "high")).alias("h"), F.avg(F.when(pool, F.col("score"))).alias("m")).alias(name)

    both = recent.agg(of(F.col("has_delta"), "b"), of(F.lit(True), "a"))
    x = F.when(F.col("b.n") > 0, F.col("b")).otherwise(F.col("a"))
    level = F.when(x["n"] == 0, "LOW").when(x["c"] > 0, "HIGH").when(x["h"] >= 5, "MEDIUM").when(x["m"] < 0.3, "LOW").when(x["m"] < 0.6, "MEDIUM").when(F.col("b.n") > 0, "HIGH").otherwise("MEDIUM")
    return both.select((F.col("b.n") > 0).alias("verified"), x["n"].alias("n"), level.alias("level"))


def table_health(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """name, n, first, last of each table by its time column."""
    out = None
    for name, (rows, column) in tables.items():
        one = rows.agg(F.count("*").alias("n"), F.min(column).alias("first"), F.max(column).alias("last")).select(F.lit(name).alias("name"), "n", "first", "last")
        out = one if out is None else out.unionByName(one)
    return out


def job_progress(jobs: DataFrame, batches: DataFrame, planned: int) -> DataFrame:
    """job, batch, expanding mean batch time, percent done and the time left at that mean."""
    so_far = Window.partitionBy("job").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    rows = batches.withColumn("mean_ms", F.avg("batch_ms").over(so_far))
    return rows.select("job", "batch", "mean_ms", (F.col("batch") * 100.0 / planned).alias("percent"), (F.greatest(F.lit(0), F.lit(planned) - F.col("batch")) * F.col("mean_ms")).alias("eta_ms"))


def monitoring(sources: DataFrame, classes: dict[str, str], other: str = "other") -> DataFrame:
    """class, n, active, late, silent of sources (source, severity): those without a severity are active, with medium late, with high silent."""
    kind = F.coalesce(*(F.when(F.col("source") == s, c) for s, c in classes.items()), F.lit(other))
    n = lambda hit: F.count_if(F.coalesce(hit, F.lit(False)))
    return sources.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("severity").isNull()).alias("active"), n(F.col("severity") == "medium").alias("late"), n(F.col("severity") == "high").alias("silent"))
