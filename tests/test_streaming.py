from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeglass.streaming import jobs

START = datetime(2024, 1, 1)


@pytest.fixture
def streamed(spark, tmp_path):
    """A stream of rows, a file for each list of them; and what a finished stream gives."""
    def build(schema, *batches):
        folder = str(tmp_path / f"in{len(list(tmp_path.iterdir()))}")
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def finish(stream, mode="append"):
        out = []
        name = f"q{len(list(tmp_path.iterdir()))}"
        stream.writeStream.foreachBatch(lambda batch, _: out.extend(tuple(r) for r in batch.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return out

    return build, finish


def at(days, hours=0):
    return START + timedelta(days=days, hours=hours)


def test_copies_within_the_watermark_come_once(streamed):
    build, finish = streamed
    got = finish(jobs.new_articles(build("id int, content string, ts timestamp", [(1, "a", at(0)), (2, "a", at(0, 1))], [(3, "a", at(1)), (4, "b", at(1))])))
    assert sorted(r[1] for r in got) == ["a", "b"]


def test_weeks_begin_on_monday_and_equal_the_batch(spark, streamed):
    build, finish = streamed
    rows = [(i / 100, ["low", "critical"][i % 2], at(i % 20, i % 24)) for i in range(100)]
    schema = "score double, severity string, ts timestamp"
    stream = finish(jobs.windows(build(schema, rows, [(0.0, "low", at(60))]), "7 days", offset="4 days"))
    weeks = spark.createDataFrame(rows, schema).groupBy(F.date_trunc("week", "ts").alias("w")).agg(F.avg("score"), F.count("*"), F.count_if(F.col("severity") == "critical"))
    assert sorted((r[0], round(r[2], 9), r[5], r[6]) for r in stream if r[0] < at(50)) == sorted((r[0], round(r[1], 9), r[2], r[3]) for r in weeks.collect())


def test_sliding_windows(streamed):
    build, finish = streamed
    got = finish(jobs.windows(build("score double, severity string, ts timestamp", [(1.0, "low", at(3))], [(0.0, "low", at(40))]), "7 days", "1 day"))
    assert len([r for r in got if r[1] <= at(12)]) == 7


def test_bursts(streamed):
    build, finish = streamed
    got = finish(jobs.bursts(build("source string, ts timestamp", [("a", at(0)), ("a", at(5)), ("a", at(30)), ("b", at(1))], [("z", at(90))])))
    assert sorted((r[0], r[3]) for r in got) == [("a", 1), ("a", 2), ("b", 1)]


def in_turns(spark, tmp_path, job, *parts):
    """The rows that a job gives of each of several lists of rows, stopped and started again in between."""
    out = []
    for rows in parts:
        spark.createDataFrame(rows, "source string, ts timestamp").repartition(3).write.mode("append").parquet(str(tmp_path / "turns"))
        got = []
        with jobs.keyed_state(spark):
            stream = job(spark.readStream.schema("source string, ts timestamp").parquet(str(tmp_path / "turns")))
            query = stream.writeStream.foreachBatch(lambda batch, _, got=got: got.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        out.append(sorted((r.source, r["last"], r.severity) for r in got if r.source != "clock"))
    return out


def clock(days):
    return [("clock", at(days))]


def test_silences_of_twice_and_four_times_the_days(spark, tmp_path):
    parts = [[("a", at(0)), ("b", at(0)), ("b", at(9)), (None, at(1))], [("b", at(20)), *clock(30)], clock(50), clock(58), clock(90)]
    got = in_turns(spark, tmp_path, lambda s: jobs.silences(s, 14), *parts)
    assert got == [[], [("a", at(0), "medium")], [("b", at(20), "medium")], [("a", at(0), "high")], [("b", at(20), "high")]]


def test_silences_by_a_sources_own_days_and_each_alert_once(spark, tmp_path):
    expected = spark.createDataFrame([("b", 1), ("never", 3)], "source string, days int")
    parts = [[("a", at(0)), ("b", at(50)), ("c", at(40)), *clock(51)], clock(60), [("b", at(61)), ("b", at(10)), *clock(62)], clock(70), clock(80)]
    got = in_turns(spark, tmp_path, lambda s: jobs.silences(s, 14, expected=expected), *parts)
    assert [x for part in got for x in part if x[0] == "a"] == [("a", at(0), "medium"), ("a", at(0), "high")]
    assert [x for part in got for x in part if x[0] == "b"] == [("b", at(50), "high"), ("b", at(50), "medium"), ("b", at(61), "high"), ("b", at(61), "medium")]
    assert [x for part in got for x in part if x[0] == "c"] == [("c", at(40), "medium")]


def test_bursts_by_a_sources_own_gap(streamed):
    build, finish = streamed
    rows = [("a", at(0)), ("a", at(5)), ("b", at(0)), ("b", at(5))]
    got = finish(jobs.bursts(build("source string, ts timestamp", rows, [("z", at(90))]), "14 days", gaps={"b": "2 days"}))
    assert sorted((r[0], r[3]) for r in got) == [("a", 2), ("b", 1), ("b", 1)]


def test_copies_of_a_url_come_once(streamed):
    build, finish = streamed
    rows = [("u", "a", at(0)), ("u", "b", at(0, 1)), ("v", "c", at(0, 2))]
    assert sorted(r[0] for r in finish(jobs.new_articles(build("url string, content string, ts timestamp", rows)))) == ["u", "v"]


def test_each_batch_is_scored_once(spark, streamed, tmp_path):
    build, _ = streamed
    stream = build("id int, ts timestamp", [(1, at(0))], [(2, at(1))])
    for _ in range(2):
        jobs.append_scored(stream, lambda b: b.withColumn("score", F.lit(1.0)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_groups_and_reviews(spark, streamed):
    build, finish = streamed
    groups = spark.createDataFrame([("a", "news")], "source string, grp string")
    assert sorted(finish(jobs.with_groups(build("source string, id int", [("a", 1), ("b", 2)]), groups))) == [("a", 1, "news"), ("b", 2, "other")]
    a = build("id int, score double, ts timestamp", [(1, 0.5, at(0)), (2, 0.6, at(0))])
    f = build("analysis_id int, feedback_type string, ts timestamp", [(1, "noise", at(10)), (2, "noise", at(40))])
    assert [(r[0], r[4]) for r in finish(jobs.reviewed(a, f))] == [(1, "noise")]


def test_events_in_a_folder_of_files(spark, tmp_path):
    from lodeglass.plans import queries_streaming

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("x7_grouped", "x3_daily_windows"):
        whole, parts = (queries_streaming.QUERIES[name](spark, f).collect() for f in ("/root/testdata/sf0.001", str(tmp_path)))
        assert sorted(whole) == sorted(parts) != []
