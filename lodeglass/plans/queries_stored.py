"""Registered queries over stored tables and kept-up rollups, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodeglass.operators.rollups import TrendRollup
from lodeglass.operators.storage import new_folder
from lodeglass.operators.stored import StoredTable
from lodeglass.plans.queries_relational import _r
from lodeglass.sources.adapters import Tables, with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, *tables: str):
    """Registers a function of Tables under its name, with its SQL after the named logical tables."""
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        QUERIES[f.__name__].__doc__ = f.__doc__
        ORACLE_SQL[f.__name__] = with_tables(sql, *tables)
        return f

    return add


_DAY = "strftime(ts, '%Y-%m-%d')"


@query(f"""WITH o AS (SELECT {_DAY} AS day, severity, count(*) AS total, round(avg(score), 6) AS mean FROM analyses WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL), n AS (SELECT {_DAY} AS day, severity, count(*) AS total, round(avg(score), 6) AS mean FROM analyses WHERE ts >= TIMESTAMP '2024-01-15' AND severity <> 'low' GROUP BY ALL)
SELECT day, severity, coalesce(n.total + 1000, o.total) AS total, coalesce(n.mean, o.mean) AS mean, CASE WHEN o.day IS NULL THEN 2 ELSE 1 END AS created_at FROM o FULL JOIN n USING (day, severity)""", "analyses")
def k1_stored_upsert(t):
    """Trends by day and severity, stored, then changed by newer ones: untouched days keep their files, and rows their time of creation."""
    rows = t.analyses().withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    trend = lambda part, more, at: part.groupBy("day", "severity").agg((F.count("*") + more).alias("total"), F.round(F.avg("score"), 6).alias("mean")).withColumn("created_at", F.lit(at))
    table = StoredTable(t.spark, new_folder(t.spark, "trends"), "day string, severity string, total bigint, mean double, created_at int", ["day", "severity"], "day")
    table.upsert(trend(rows.filter("ts < '2024-01-20'"), 0, 1))
    table.upsert(trend(rows.filter("ts >= '2024-01-15' and severity <> 'low'"), 1000, 2))
    return table.read()


@query("SELECT was_useful, count(*) AS kept, (SELECT count(*) FROM trajectories WHERE created_at < (SELECT t FROM as_of) - INTERVAL 10 DAY) AS deleted FROM trajectories WHERE created_at >= (SELECT t FROM as_of) - INTERVAL 10 DAY GROUP BY was_useful", "trajectories", "as_of")
def k6_stored_retention(t):
    """Trajectories stored by day, those of more than ten days deleted; what is kept, and how many went."""
    rows = t.trajectories().select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "id", "was_useful", "created_at")
    table = StoredTable(t.spark, new_folder(t.spark, "trajectories"), rows.schema, ["day", "id"], "day")
    table.upsert(rows, ())
    edge = rows.agg((F.max("created_at") - F.expr("interval 10 days")).alias("t")).first().t
    gone = table.retain(edge.strftime("%Y-%m-%d"), F.col("created_at") >= F.lit(edge))
    return table.read().groupBy("was_useful").agg(F.count("*").alias("kept"), F.lit(gone).cast("bigint").alias("deleted"))


def _kept_up(t) -> TrendRollup:
    """Analyses in three batches: most of the first days, the later days, and what came late."""
    rows = t.analyses().withColumn("source", F.get("indicators", F.lit(1)))
    early, late = F.col("ts") < "2024-01-18", F.col("id") % 11 == 0
    kept = TrendRollup(t.spark, new_folder(t.spark, "rollup"))
    for number, part in enumerate((rows.filter(early & ~late), rows.filter(~early & ~late), rows.filter(late))):
        kept.add(part, number)
    return kept


_TREND = "round(coalesce(avg(score), 0), 6)::DOUBLE AS avg_score, coalesce(max(score), 0)::DOUBLE AS max_score, coalesce(min(score), 0)::DOUBLE AS min_score, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(DISTINCT indicators[2]) AS sources"


@query(f"SELECT days, {_TREND} FROM analyses, (SELECT unnest([1, 7, 30]) AS days) WHERE ts::DATE > (SELECT t::DATE FROM as_of) - days::INTEGER GROUP BY days", "analyses", "as_of")
def a1_rollup_windows(t):
    """Windows of one, seven and thirty days, from daily partials alone, with distinct sources by a sketch (exact for so few)."""
    kept, as_of = _kept_up(t), t.as_of()
    found = reduce(lambda a, b: a.unionByName(b), (kept.window(as_of, days).withColumn("days", F.lit(days)) for days in (1, 7, 30)))
    return found.withColumn("avg_score", _r("avg_score", "avg_score"))


@query(f"SELECT date_trunc('week', ts)::DATE AS bucket, {_TREND} FROM analyses GROUP BY 1", "analyses")
def a3_rollup_weeks(t):
    """Weeks, from daily partials alone."""
    return _kept_up(t).series("week").withColumn("avg_score", _r("avg_score", "avg_score"))
