"""Validations and reference checks on a few rows."""

import pytest
from pyspark.sql import functions as F

from lodeglass.plans import validation

SOURCES = [("OpenAI Blog", 0), ("arXiv AI", 1), ("Google AI Blog", 2)]
ARTICLES = [(1, "arXiv AI", "A", "On AGI."), (2, "arXiv AI", "B", "nothing"), (3, "arXiv AI", "C", "superintelligence"), (4, "arXiv AI", "D", "agi"), (5, "arXiv AI", "E", "agi"), (6, "OpenAI Blog", "F", "weather"), (7, "x", "G", None)]


@pytest.fixture(scope="module")
def checked(spark):
    refs = spark.createDataFrame([(1, "ARXIV"), (1, "nobody"), (2, "ai blog"), (2, None), (3, "blog")], "id int, ref string")
    return validation.checked_references(refs, spark.createDataFrame(SOURCES, "source string, place int"), spark.createDataFrame(ARTICLES, "id int, source string, title string, content string"))


def test_references_in_list_order_with_counts_and_titles(checked):
    got = sorted((r.id, r.ref, r.source, r.found, r.article_count, r.titles) for r in checked.collect())
    assert got == [(1, "ARXIV", "arXiv AI", True, 4, ["A", "C", "D"]), (2, "ai blog", "OpenAI Blog", False, 0, []), (3, "blog", "OpenAI Blog", False, 0, [])]


def test_too_many_sources_are_an_error(spark, checked):
    with pytest.raises(ValueError, match="configured sources"):
        validation.checked_references(checked.select("id", "ref"), spark.createDataFrame(SOURCES, "source string, place int"), checked, most_sources=2)


def test_validations(spark, checked):
    columns = "id int, score double, model_score double, confidence double, severity string, indicators array<string>, refs array<string>, heuristic double, boost double, has_delta boolean"
    rows = [
        (1, 0.7, 0.7, 0.5, "high", ["a"], ["ARXIV"], 0.0, 0.0, False), (2, 0.7, 0.7, 0.5, "high", ["a"], ["ai blog"], 0.0, 0.0, False), (3, 0.9, 0.9, 0.95, "critical", ["a", "b"], ["blog"], 0.0, 0.0, True),
        (4, 0.4, None, 0.05, "medium", [], None, 0.0, 0.0, False), (5, 0.4, 0.4, 0.5, "medium", [], [], 0.0, 0.0, False), (6, 0.5, 0.5, 0.5, "medium", [], [], 0.0, 0.0, False),
    ]
    said = [(1, 0.9, "raise", True, ["b", "a"]), (2, 0.9, "hold", False, None), (3, 0.95, "dismiss", True, ["c"]), (4, None, "lower", None, []), (5, 0.9, None, False, ["x"])]
    found = validation.validated(spark.createDataFrame(rows, columns), spark.createDataFrame(said, "id int, validated_score double, recommendation string, agrees boolean, indicators array<string>"), checked)
    got = {r.id: (r.score, round(r.confidence, 6), r.severity, r.indicators, r.penalty, r.corroboration) for r in found.collect()}
    assert got == {
        1: (0.9, 0.7, "high", ["a", "b"], 0.0, "independent_source"),  # critical without a gain
        2: (0.5, 0.6, "medium", ["a"], 0.2, "same_source"),  # held less the penalty, so the severity falls
        3: (0.2, 0.85, "low", ["a", "b", "c"], 0.2, "same_source"),
        4: (0.3, 0.0, "medium", [], 0.0, "none"),
        5: (0.4, 0.6, "medium", ["x"], 0.0, "none"),  # investigated, as nothing was recommended
    }


def test_activity_rows(spark):
    talks = spark.createDataFrame([(f"t{i}", "b", "general", "ann", i, i) for i in range(7)], "title string, body string, category string, author string, comments bigint, place int")
    out = spark.createDataFrame([("v1", "1.0", "notes", "bo")], "name string, tag string, body string, author string")
    repos = spark.createDataFrame([(f"r{i:02}", "d", i, None) for i in range(12)], "name string, description string, stars bigint, language string")
    got = validation.activity_articles(talks, out, repos)
    assert {r.kind: r.n for r in got.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"discussion": 5, "release": 1, "implementation": 10}
    rows = [tuple(r) for r in got.collect()]
    assert ("ARC-AGI GitHub: t0", "Discussion by ann in ARC-AGI-2 repository: b. Category: general. 0 comments.", "ARC GitHub Discussions", "discussion") in rows
    assert not any(r[0].endswith("r00") for r in rows) and any("Language: Unknown. Stars: 11." in r[1] for r in rows)
