"""Stored tables and rollups: what a change rewrites, and what a failed one leaves."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeglass.operators import rollups
from lodeglass.operators.stored import StoredTable

SCHEMA = "day string, name string, score double, created_at int"


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable(spark, str(tmp_path / "table"), SCHEMA, ["day", "name"], "day")


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def files(table):
    return {b: sorted(os.listdir(f"{table.folder}/data/{p}")) for b, p in table.pointer()["buckets"].items()}


def test_upserts_rewrite_only_what_they_touch(spark, table):
    assert table.read().count() == 0
    assert table.upsert(rows_of(spark, ("2024-01-01", "a", 1.0, 1), ("2024-01-02", "a", 2.0, 1), (None, "n", 0.0, 1))) == {"before": 0, "after": 3}
    before = files(table)
    assert table.upsert(rows_of(spark, ("2024-01-02", "a", 5.0, 9), ("2024-01-02", "b", 6.0, 9), ("a/b=c", "x", 7.0, 9))) == {"before": 1, "after": 3}
    assert {b: f for b, f in files(table).items() if b in ("2024-01-01", "none")} == {b: f for b, f in before.items() if b != "2024-01-02"}
    got = sorted(map(tuple, table.read().collect()), key=repr)
    assert got == sorted([("2024-01-01", "a", 1.0, 1), ("2024-01-02", "a", 5.0, 1), ("2024-01-02", "b", 6.0, 9), (None, "n", 0.0, 1), ("a/b=c", "x", 7.0, 9)], key=repr)
    assert table.upsert(rows_of(spark)) == {"before": 0, "after": 0}
    assert table.vacuum() == 0 and table.read().count() == 5
    table.upsert(rows_of(spark, ("2024-01-01", "a", 0.0, 1), ("2024-01-02", "a", 0.0, 1), (None, "n", 9.0, 1)))
    assert table.vacuum() == 1 and table.read().count() == 5


def test_a_failed_write_leaves_the_table_as_it_was(spark, table):
    table.upsert(rows_of(spark, ("2024-01-01", "a", 1.0, 1)))
    before = table.pointer()
    bad = rows_of(spark, ("2024-01-01", "a", 2.0, 1), ("2024-01-03", "a", 2.0, 1)).withColumn("score", F.when(F.col("day") < "2024-01-02", 2.0).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad)
    assert table.pointer() == before and [r.score for r in table.read().collect()] == [1.0]
    table.upsert(rows_of(spark, ("2024-01-01", "a", 3.0, 1)))
    assert [r.score for r in table.read().collect()] == [3.0]


def test_retention_counts_what_goes(spark, table):
    table.upsert(rows_of(spark, *((f"2024-01-0{d}", f"n{k}", float(k), d) for d in range(1, 6) for k in range(d))))
    before = files(table)
    assert table.retain("2024-01-04", F.col("score") >= 1) == 1 + 2 + 3 + 1
    assert sorted((r.day, r.name) for r in table.read().collect()) == [("2024-01-04", f"n{k}") for k in range(1, 4)] + [("2024-01-05", f"n{k}") for k in range(5)]
    assert files(table)["2024-01-05"] == before["2024-01-05"]
    assert table.retain("2023-01-01", F.lit(True)) == 0
    assert table.retain("2024-01-05", F.lit(False)) == 3 + 5 and table.read().count() == 0


def test_the_bucket_is_part_of_the_key(spark, tmp_path):
    with pytest.raises(ValueError, match="bucket"):
        StoredTable(spark, str(tmp_path), SCHEMA, ["name"], "day")


def test_rollups_equal_the_whole_after_late_rows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "score double, severity string, source string, ts timestamp"
    rows = [((i * 37 % 100) / 100 if i % 9 else None, ["low", "critical"][i % 2], f"s{i % 7}", start + timedelta(hours=i)) for i in range(40 * 24)]
    late = [r for i, r in enumerate(rows) if i % 11 == 0]
    parts = [[r for i, r in enumerate(rows[:500]) if i % 11], [r for i, r in enumerate(rows) if i >= 500 and i % 11], late + [(0.5, "low", "s", None)]]
    kept = rollups.TrendRollup(spark, str(tmp_path / "rollup"))
    as_of = F.lit(start + timedelta(days=39, hours=5))
    assert kept.window(as_of, 7).first().total == 0
    for number, part in enumerate(parts):
        assert kept.add(spark.createDataFrame(part, schema), number)
        assert not kept.add(spark.createDataFrame(part, schema), number)  # the same batch again changes nothing
    whole = spark.createDataFrame(rows, schema)
    for days in (1, 7, 30):
        inside = whole.filter(F.to_date("ts") > F.date_sub(F.to_date(as_of), days))
        want = inside.agg(F.round(F.avg("score"), 9), F.max("score"), F.min("score"), F.count("*"), F.count_if(F.col("severity") == "critical"), F.countDistinct("source")).first()
        got = kept.window(as_of, days).first()
        assert (round(got.avg_score, 9), *got[1:]) == tuple(want)
    weeks = {r.bucket: r.total for r in kept.series("week").collect()}
    assert weeks == {r.b: r.n for r in whole.groupBy(F.date_trunc("week", "ts").cast("date").alias("b")).agg(F.count("*").alias("n")).collect()}


def test_a_batch_reads_only_its_own_days(spark, tmp_path):
    kept = rollups.TrendRollup(spark, str(tmp_path / "rollup"))
    schema = "score double, severity string, source string, ts timestamp"
    kept.add(spark.createDataFrame([(0.5, "low", "a", datetime(2024, 1, d)) for d in range(1, 9)], schema), 0)
    before = kept.table.pointer()["buckets"]
    kept.add(spark.createDataFrame([(0.7, "low", "b", datetime(2024, 1, 3))], schema), 1)
    after = kept.table.pointer()["buckets"]
    assert {b for b in after if after[b] != before[b]} == {"2024-01-03"}
