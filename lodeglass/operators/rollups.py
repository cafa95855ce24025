"""Trends kept up as daily partials, so that windows and series need no old analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.operators.stored import StoredTable

_SCHEMA = "day string, total bigint, scored bigint, sum_score double, max_score double, min_score double, critical bigint, sources binary"


def partials(analyses: DataFrame) -> DataFrame:
    """What one day's analyses (score, severity, source, ts) add up to: counts, sum, extremes, and a sketch of distinct sources; rows without a time are left out."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return analyses.filter("ts is not null").groupBy(day).agg(
        F.count("*").alias("total"), F.count("score").alias("scored"), F.sum("score").alias("sum_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"),
        F.count_if(F.col("severity") == "critical").alias("critical"), F.hll_sketch_agg("source").alias("sources"),
    )


def _summed() -> list[Column]:
    return [
        F.sum("total").alias("total"), F.sum("scored").alias("scored"), F.sum("sum_score").alias("sum_score"), F.max("max_score").alias("max_score"), F.min("min_score").alias("min_score"),
        F.sum("critical").alias("critical"), F.hll_union_agg("sources").alias("sources"),
    ]


def merged(rows: DataFrame, *by: str) -> DataFrame:
    """Partials of equal names as one: sums of sums, extremes of extremes, a union of sketches."""
    return rows.groupBy(*by).agg(*_summed())


class TrendRollup:
    """Daily partials in a stored table, to which numbered batches of analyses are added once each."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.table = StoredTable(spark, folder, _SCHEMA, ["day"], "day")

    def add(self, analyses: DataFrame, batch: int) -> bool:
        """Adds a batch, late rows too, reading and rewriting only its own days; False, and no change, if a batch of this or a higher number has been added, as when a stream's batch runs again."""
        added = self.table.pointer()["note"]
        if added is not None and batch <= added:
            return False
        new = partials(analyses).cache()
        try:
            days = [r.day for r in new.select("day").collect()]
            self.table.upsert(merged(self.table.read(days).unionByName(new), "day"), (), batch)
        finally:
            new.unpersist()
        return True

    def window(self, as_of: Column, days: int) -> DataFrame:
        """One row of mean, highest, lowest score, counts and distinct sources of the last whole days up to that of `as_of`; zeros where there is nothing."""
        last = F.to_date(as_of)
        day = F.to_date("day")
        return shown(self.table.read().filter((day > F.date_sub(last, days)) & (day <= last)).agg(*_summed()))

    def series(self, period: str) -> DataFrame:
        """The same by day, week (from Monday) or month."""
        return shown(merged(self.table.read().withColumn("bucket", F.date_trunc(period, F.to_date("day")).cast("date")), "bucket"))


def shown(rows: DataFrame) -> DataFrame:
    """Summed partials as a trend: avg_score, max_score, min_score, total, critical, sources."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    keys = [c for c in rows.columns if c == "bucket"]
    return rows.select(*keys, F.coalesce(F.col("sum_score") / F.nullif("scored", F.lit(0)), F.lit(0.0)).alias("avg_score"), zero("max_score"), zero("min_score"), zero("total"), zero("critical"), F.coalesce(F.hll_sketch_estimate("sources"), F.lit(0)).alias("sources"))
