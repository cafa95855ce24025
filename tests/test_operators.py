from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodeglass.operators import correlations, evidence, joins, secrecy, vectors

START = datetime(2024, 1, 1)


def test_long_chains_of_duplicates(spark):
    """Rows n and n + 1 share a URL or a content by turns: every second one is kept, after as many rounds as it takes."""
    n = 130
    found = spark.createDataFrame([(i, f"u{i // 2}", f"h{(i + 1) // 2}") for i in range(n)], "n int, url string, content_hash string").selectExpr("*", "1 as u", "2 as first")
    got = joins.first_of_each(found.filter("n < 12"), "n")
    assert sorted(r.n for r in got.collect()) == list(range(0, 12, 2)) and got.columns == found.columns
    assert joins.first_of_each(found.limit(0), "n").collect() == []
    near = spark.createDataFrame([(i, f"u{i % 3}", f"h{i % 5}") for i in range(n)], "n int, url string, content_hash string")
    urls, hashes, want = set(), set(), []
    for i in range(n):
        if f"u{i % 3}" not in urls and f"h{i % 5}" not in hashes:
            urls.add(f"u{i % 3}")
            hashes.add(f"h{i % 5}")
            want.append(i)
    assert sorted(r.n for r in joins.first_of_each(near, "n").collect()) == want


def test_many_query_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(700)], "id int, embedding array<float>")
    got = vectors.nearest_to_each(rows, rows.filter("id < 600"), 2, block=64).groupBy("query_id").count().collect()
    assert len(got) == 600 and {r["count"] for r in got} == {2}


def test_upserts_of_frames_of_one_table(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3)], "id int, old string, new int")
    got = joins.upsert(rows, rows.filter("id is null or id = 1").withColumn("new", F.col("new") * 10), ["id"], ("old",))
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(1, "a", 10), (2, "b", 2), (None, "c", 30)]


def test_findings_become_articles(spark):
    schema = "id int, source string, type string, term string, severity string, confidence double, evidence string"
    found = spark.createDataFrame([(1, "lab", "silence", "nda", "high", 0.7, "...x..."), (2, "lab", "safety_meeting", "staged release", "medium", 0.5, "y")], schema)
    gaps = spark.createDataFrame([("lab", False)], "source string, anomalous boolean")
    got = {r.kind: r for r in secrecy.finding_articles(found, secrecy.risk(found, gaps)).collect()}
    assert got["secrecy_analysis"].title == "Secrecy Pattern Analysis: MEDIUM Risk" and got["secrecy_analysis"].source == "Secrecy Pattern Detection"
    assert got["secrecy_indicator"].title == 'Secrecy Alert: Secrecy-related language detected: "nda"' and got["secrecy_indicator"].content == "SILENCE indicator detected at lab. Evidence: ...x.... Confidence: 70%"
    assert secrecy.finding_articles(found.limit(0), secrecy.risk(found.limit(0), gaps)).collect() == []


def test_stories_across_sources(spark):
    ids = list(range(1, 8))
    analyses = spark.createDataFrame([(i, i, 0.9 - i / 100, START + timedelta(days=i)) for i in ids] + [(9, 9, 0.1, START)], "id bigint, crawl_id bigint, score double, ts timestamp")
    articles = spark.createDataFrame([(i, f"s{i % 3}") for i in [*ids, 9]], "id bigint, source string")
    close, far = [1.0, 0.1], [-0.2, 1.0]
    embedded = spark.createDataFrame([(1, close), (2, close), (3, far), (4, far), (5, far), (7, None), (9, close)], "id bigint, embedding array<double>")
    got = sorted((r.cluster, r.n, r.ids, r.sources) for r in correlations.story_clusters(analyses, articles, embedded, F.lit(START + timedelta(days=8)), 30).collect())
    assert got == [(1, 2, [1, 2], ["s1", "s2"]), (3, 3, [3, 4, 5], ["s0", "s1", "s2"])]
    assert correlations.story_clusters(analyses.limit(0), articles, embedded, F.lit(START), 30).collect() == []


def test_triage_keeps_columns_of_any_name(spark):
    articles = spark.createDataFrame([(1, "t", "a new benchmark"), (2, "t", "hiring " * 200), (3, None, None)], "id int, title string, content string").selectExpr("*", "1 as capable", "2 as low", "3 as row", "4 as `a.b`", "5 as short")
    got = {r.id: r for r in evidence.triage(articles).collect()}
    assert [got[i].skip for i in (1, 2, 3)] == [False, True, True] and got[2].matches == ["hiring"] and got[2].reason == "Noise keywords: hiring"
    assert [got[1][c] for c in ("capable", "low", "row", "a.b", "short")] == [1, 2, 3, 4, 5]


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    for name, n in (("1", 3), ("2", 4), ("2", 5)):
        joins.append(spark.range(n), str(tmp_path / "table"), name)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 8


def test_signals_of_a_claim(spark):
    made = spark.createDataFrame([(1, "ARC", 30.0, 12.0, ["human-level"]), (2, "", None, 1.0, [])], "id int, benchmark string, value double, delta double, tags array<string>")
    assert [(r.id, r.name, r.value) for r in evidence.signals(made).collect()] == [(1, "benchmark", 0.03), (1, "benchmark_value", 0.15), (1, "benchmark_delta", 0.1), (1, "human_level", 0.06)]
