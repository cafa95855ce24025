"""Registered queries that run a stream over the events to its end, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.scoring import severity
from lodeglass.operators import evidence
from lodeglass.operators.storage import new_folder
from lodeglass.plans import article_scoring, queries_text
from lodeglass.plans.queries_text import CAPABILITY, MARKS, METRICS, NOISE, SECRET
from lodeglass.sources.adapters import SEVERITY_SQL
from lodeglass.streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def events_of(rows: DataFrame) -> DataFrame:
    """id, score, severity, source, user, ts of events, streamed or not."""
    score = F.least(F.lit(1.0), F.col("value") / 100)
    return rows.select(F.col("event_id").alias("id"), score.alias("score"), severity(score).alias("severity"), F.col("event_type").alias("source"), F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"))


def streamed(spark, folder: str, table: str) -> DataFrame:
    """A table as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")  # a pattern, as the table may be one file or a folder of them


def in_turns(parts: list[DataFrame], job: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = (), mode: str = "append") -> DataFrame:
    """All that a job gives of a stream that gets each of the given parts, as files of all their tasks, when it has ended with those before; so it stops and begins again with its state between any two."""
    spark = parts[0].sparkSession
    folder = new_folder(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        found = finished(job(spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in")), keys, mode, folder)
    return found


def query(sql: str, keys: tuple[str, ...] = (), mode: str = "complete", table: str | None = "events"):
    """Registers a function of a stream of events (or of spark and the tables' folder); of several results of the same keys the last counts."""
    def add(f):
        def run(spark, folder: str) -> DataFrame:
            found = f(events_of(streamed(spark, folder, table))) if table else f(spark, folder)
            return finished(found, keys, mode if keys else "append") if found.isStreaming else found

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def finished(stream: DataFrame, keys: tuple[str, ...], mode: str, folder: str | None = None) -> DataFrame:
    """All that a stream gives until its input ends, written to the shared folder and read again: of equal keys the last batch's row. In a folder that has been used before it goes on from there."""
    spark = stream.sparkSession
    folder = folder or new_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        batch.sparkSession.range(1).write.mode("overwrite").parquet(f"{folder}/written/batch={number}")

    with jobs.keyed_state(spark):
        query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/written")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in stream.dtypes)}, batch int").parquet(f"{folder}/out")
    if mode == "append":
        return rows.select(*stream.columns)
    if mode == "complete":
        last = spark.read.parquet(f"{folder}/written").agg(F.max("batch").cast("int").alias("batch"))
        return rows.join(F.broadcast(last), "batch").select(*stream.columns)  # one row
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return last.select(*keys, "x.*").select(*stream.columns)


_ROWS = f"SELECT event_id AS id, least(1.0::DOUBLE, value / 100) AS score, {SEVERITY_SQL.format('least(1.0::DOUBLE, value / 100)')} AS severity, event_type AS source, ts::TIMESTAMP AS ts FROM events"
_AGGREGATES = "round(avg(score), 6) AS avg_score, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical"


def _shown(windows: DataFrame) -> DataFrame:
    return windows.select(F.date_format("start", "yyyy-MM-dd").alias("start"), F.round("avg_score", 6).alias("avg_score"), "total", "critical")


@query(f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, {_AGGREGATES} FROM ({_ROWS}) GROUP BY 1", ("start",))
def x3_daily_windows(events):
    """Days of a stream."""
    return _shown(jobs.windows(events, "1 day"))


@query(f"SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS start, {_AGGREGATES} FROM ({_ROWS}) GROUP BY 1", ("start",))
def x3_weekly_windows(events):
    """Weeks of a stream, from Monday."""
    return _shown(jobs.windows(events, "7 days", offset="4 days"))


@query(f"SELECT strftime(date_trunc('day', ts) - to_days(k::INTEGER), '%Y-%m-%d') AS start, {_AGGREGATES} FROM ({_ROWS}), range(7) r(k) GROUP BY 1", ("start",))
def x4_sliding_windows(events):
    """Seven days of a stream, by the day."""
    return _shown(jobs.windows(events, "7 days", "1 day"))


_LATE = "user_id % 7 = 0"


@query(
    f"""WITH b AS (SELECT *, ts::TIMESTAMP >= TIMESTAMP '2024-01-21' AS second, {_LATE} AND ts::TIMESTAMP < TIMESTAMP '2024-01-21' AS late FROM events),
w AS (SELECT max(ts::TIMESTAMP) - INTERVAL 1 DAY AS mark FROM b WHERE ts::TIMESTAMP < TIMESTAMP '2024-01-19' AND NOT late)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, round(avg(least(1.0::DOUBLE, value / 100)), 6) AS avg_score, count(*) AS total, count(*) FILTER (least(1.0::DOUBLE, value / 100) >= 0.8) AS critical FROM b WHERE NOT late OR date_trunc('day', ts::TIMESTAMP) + INTERVAL 1 DAY > (SELECT mark FROM w) GROUP BY 1""",
    table=None,
)
def x3_late_windows(spark, folder):
    """Days of a stream in update mode that ends and begins again: late rows of the first twenty days come with the second part, and count only where their day was still open after the first."""
    rows = spark.read.parquet(f"{folder}/events.parquet")
    late = (F.col("user_id") % 7 == 0) & (F.col("ts").cast("timestamp") < "2024-01-21")
    early = F.col("ts").cast("timestamp") < "2024-01-19"
    parts = [events_of(rows.filter(early & ~late)), events_of(rows.filter(~early | late))]
    return in_turns(parts, lambda stream: _shown(jobs.windows(stream, "1 day")), ("start",), "update")


@query(f"""SELECT source, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source ORDER BY ts) < CASE source WHEN 'click' THEN INTERVAL 1 HOUR WHEN 'view' THEN INTERVAL 30 MINUTE ELSE INTERVAL 2 HOUR END THEN 0 ELSE 1 END AS fresh FROM ({_ROWS}))) GROUP BY source, s""", ("source", "start"))
def x5_bursts(events):
    """Sessions of a stream's sources, ended by two silent hours or by a source's own gap."""
    return jobs.bursts(events, "2 hours", gaps={"click": "1 hour", "view": "30 minutes"}).select("source", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(f"SELECT id, CASE source WHEN 'click' THEN 'news' ELSE 'other' END AS grp FROM ({_ROWS}) WHERE score > 0.5")
def x7_grouped(events):
    """A stream joined to a small static table."""
    groups = events.sparkSession.createDataFrame([("click", "news")], "source string, grp string")
    return jobs.with_groups(events.filter("score > 0.5"), groups).select("id", "grp")


@query("SELECT DISTINCT 'https://x/' || substr(sha256(split_part(text, chr(10), 1)), 1, 3) AS url FROM documents WHERE text IS NOT NULL", table=None)
def x1_new_articles(spark, folder):
    """Articles of a stream without copies of a content, then of a URL, which is the same for equal contents."""
    rows = streamed(spark, folder, "documents").filter("text is not null")
    url = F.concat(F.lit("https://x/"), F.substring(F.sha2(F.substring_index("text", "\n", 1), 256), 1, 3))
    stream = rows.select(url.alias("url"), F.col("text").alias("content"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, int(doc_id % 720))").alias("ts"))
    return jobs.new_articles(stream, "60 days").select("url")


def _x2_scored(spark, folder: str) -> DataFrame:
    """Articles of a stream triaged batch by batch, each written once, although the stream is run twice."""
    out = new_folder(spark, "stream")
    rows = streamed(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    for _ in range(2):
        jobs.append_scored(rows, lambda batch: evidence.triage(batch, ("arc", "nda"), ("em", "ation")).select("id", "skip"), f"{out}/scored", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/scored").select("id", "skip")


QUERIES["x2_scored"] = _x2_scored
ORACLE_SQL["x2_scored"] = """SELECT doc_id AS id, NOT (contains(t, 'arc') OR contains(t, 'nda')) AND (n < 120 OR contains(t, 'em') OR contains(t, 'ation')) AS skip
FROM (SELECT doc_id, lower(split_part(text, chr(10), 1) || ' ' || text) AS t, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM documents)"""


def _x2_analyses(spark, folder: str) -> DataFrame:
    """Articles of a stream scored by the whole plan, batch by batch, each written once, although the stream is run twice."""
    out = new_folder(spark, "stream")
    rows = streamed(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.col("text").alias("content"))

    def score(batch: DataFrame) -> DataFrame:
        models = batch.select("id", ((F.col("id") % 101) / 100).alias("model_score"), F.lit(0.5).alias("confidence"))
        return article_scoring.scored(batch, models, CAPABILITY, NOISE, MARKS, METRICS, SECRET)

    for _ in range(2):
        jobs.append_scored(rows, score, f"{out}/scored", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/scored").select("id", "filtered", "score", "confidence", "severity")


QUERIES["x2_analyses"] = _x2_analyses
ORACLE_SQL["x2_analyses"] = queries_text.ORACLE_SQL["p13_article_scoring"]


@query("""WITH u AS (SELECT 'u' || user_id AS source, max(ts::TIMESTAMP) AS last, CASE user_id WHEN 3 THEN 12 WHEN 4 THEN 6 WHEN 5 THEN 48 ELSE 24 END AS hours FROM events WHERE user_id > 2 GROUP BY user_id), m AS (SELECT max(last) + INTERVAL 3 DAY - INTERVAL 1 DAY AS mark FROM u)
SELECT source, severity, strftime(last, '%Y-%m-%d %H:%M:%S') AS last FROM u, (SELECT unnest(['medium', 'high']) AS severity, unnest([2, 4]) AS times), m WHERE epoch_ms(last) + times * hours * 3600000 <= epoch_ms(mark)""", table=None)
def x6_silences(spark, folder):
    """Alerts for users of a stream who are silent for twice and for four times the hours expected of them, as of two days after the last event."""
    rows = spark.read.parquet(f"{folder}/events.parquet").filter("user_id > 2")
    named = events_of(rows).select(F.concat(F.lit("u"), "user").alias("source"), "ts")
    clock = named.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts")).select(F.lit("clock").alias("source"), "ts")
    expected = spark.createDataFrame([("u3", 0.5), ("u4", 0.25), ("u5", 2.0)], "source string, days double")
    found = in_turns([named, clock], lambda stream: jobs.silences(stream, 1, expected=expected)).filter("source <> 'clock'")
    return found.select("source", "severity", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'noise' ELSE 'relevant' END AS feedback_type, id % 60 AS days FROM (SELECT event_id AS id FROM events) WHERE id % 60 <= 30", table=None)
def x8_reviewed(spark, folder):
    """Two streams: feedback on analyses within thirty days of them, of feedback that comes up to sixty days later."""
    analyses = events_of(streamed(spark, folder, "events")).select("id", "score", "ts")
    days = (F.col("id") % 60).cast("int")
    feedback = events_of(streamed(spark, folder, "events")).select(F.col("id").alias("analysis_id"), F.when(F.col("id") % 2 == 0, "noise").otherwise("relevant").alias("feedback_type"), (F.col("ts") + F.make_dt_interval(days=days)).alias("ts"))
    return jobs.reviewed(analyses, feedback).select("id", "feedback_type", F.datediff("given", "analysed").cast("bigint").alias("days"))
