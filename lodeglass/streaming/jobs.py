"""Structured Streaming versions of the incremental jobs."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def new_articles(articles: DataFrame, delay: str = "2 days") -> DataFrame:
    """Articles of a stream (url, content, ts, ...) without those that repeat a content, then those that repeat a URL, within the watermark."""
    once = articles.withColumn("content_hash", F.sha2("content", 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash"])
    return once.dropDuplicatesWithinWatermark(["url"]) if "url" in articles.columns else once


def append_scored(articles: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Scores each micro-batch once: a batch is written under its own number, so a batch that runs again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(analyses: DataFrame, length: str, step: str | None = None, offset: str | None = None, delay: str = "1 day") -> DataFrame:
    """Mean, highest, lowest score, count and critical count by window of event time; weeks from Monday are `7 days` with offset `4 days`."""
    over = F.window("ts", length, step or length, offset) if offset else F.window("ts", length, step or length)
    return analyses.withWatermark("ts", delay).groupBy(over.alias("w")).agg(
        F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"),
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "avg_score", "max_score", "min_score", "total", "critical")


def bursts(articles: DataFrame, gap: str = "14 days", delay: str = "1 day", gaps: dict[str, str] | None = None) -> DataFrame:
    """Sessions of each source's publications: they end where the source is silent for its own gap, or `gap`."""
    of = F.coalesce(*(F.when(F.col("source") == s, g) for s, g in gaps.items()), F.lit(gap)) if gaps else gap
    return articles.withWatermark("ts", delay).groupBy("source", F.session_window("ts", of).alias("w")).agg(F.count("*").alias("n")).select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


DAY_MS = 86_400_000


class Silence(StatefulProcessor):
    """A source's last publication and the days expected of it, with a timer for either alert."""

    def __init__(self, days: float) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint")
        self.usual = handle.getValueState("usual", "days double")

    def _due(self, last: int) -> dict[int, str]:
        days = self.usual.get()[0] if self.usual.exists() else self.days
        return {last + int(2 * days * DAY_MS): "medium", last + int(4 * days * DAY_MS): "high"}

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        self.usual.update((float(initialState.days),))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        newest = max(int(r.ts.replace(tzinfo=r.ts.tzinfo or UTC).timestamp() * 1000) for r in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.last.update((newest,))
            for due in self._due(newest):
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        last, due = self.last.get()[0], expiredTimerInfo.getExpiryTimeInMs()
        severity = self._due(last)[due]
        if severity == "high":  # nothing more to say until the source publishes again
            self.last.clear()
        yield Row(source=key[0], last=datetime.fromtimestamp(last / 1000, UTC).replace(tzinfo=None), severity=severity)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, off the heap and as changes since the last batch, which timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def silences(articles: DataFrame, days: float = 14, delay: str = "1 day", expected: DataFrame | None = None) -> DataFrame:
    """Alerts for a source that has been silent for twice (medium) and for four times (high) the days expected of it: source, last publication, severity.

    `expected` (source, days) is the state that sources begin with, and `days` holds for others. A source's newest
    publication sets two timers of event time, in place of those before; late ones change nothing. Each fires once when
    the watermark passes it, whether the source has rows in that batch or not, and state and timers outlive a restart. Rows
    without a source or time are left out. Start the stream inside `keyed_state`.
    """
    rows = articles.withWatermark("ts", delay).select("source", "ts").filter("source is not null and ts is not null")
    begin = None if expected is None else expected.select("source", F.col("days").cast("double").alias("days")).groupBy("source")
    return rows.groupBy("source").transformWithState(Silence(float(days)), "source string, last timestamp, severity string", "append", "eventtime", begin)


def with_groups(analyses: DataFrame, groups: DataFrame) -> DataFrame:
    """A stream of analyses with their source's group, from a small static table."""
    return analyses.join(groups, "source", "left").withColumn("grp", F.coalesce("grp", F.lit("other")))


def reviewed(analyses: DataFrame, feedback: DataFrame, days: int = 30) -> DataFrame:
    """Two streams joined: feedback on an analysis within so many days of it."""
    a = analyses.select("id", "score", F.col("ts").alias("analysed")).withWatermark("analysed", "1 day")
    f = feedback.select("analysis_id", "feedback_type", F.col("ts").alias("given")).withWatermark("given", "1 day")
    return a.join(f, F.expr(f"id = analysis_id and given >= analysed and given <= analysed + interval {days} days"))
