"""The whole scoring plan on a few articles, and that it reads contents once and shuffles no sentence."""

import io
from contextlib import redirect_stdout

import pytest

from lodeglass.operators import evidence
from lodeglass.plans import article_scoring

ARTICLES = [
    (1, "Lab", "Result", "The novel benchmark beats all others on ARC with 30% today. It is a breakthrough: improves by 12% on ARC."),
    (2, "Lab", "Note", "Funding round closed."),
    (3, "Gov", "Model", "The model is under a classified meeting about national security. The chief scientist resigned."),
    (4, None, None, None),
    (5, "Lab", "Model paper", ""),
]
REPLIES = [(1, 0.9, 0.8, None, ["a"], ["lab"]), (2, 0.9, 0.8, None, [], []), (3, 0.4, None, "critical", None, ["elsewhere"]), (4, 0.5, 0.5, None, None, None), (5, 0.5, 0.5, "odd", [], None)]


@pytest.fixture(scope="module")
def found(spark):
    articles = spark.createDataFrame(ARTICLES, "id bigint, source string, title string, content string")
    models = spark.createDataFrame(REPLIES, "id bigint, model_score double, confidence double, severity string, indicators array<string>, refs array<string>")
    return article_scoring.analysed(articles, models)


def test_analyses(found):
    rows = {r.id: r for r in article_scoring.analyses(found).collect()}
    assert (rows[1].filtered, rows[1].score, rows[1].severity) == (False, 0.9, "critical")  # a gain in a benchmark lets it be critical
    assert {"benchmark", "benchmark_value", "benchmark_delta"} <= {s.name for s in rows[1].signals}
    assert (rows[2].filtered, rows[2].score, rows[2].confidence, rows[2].severity) == (True, 0.05, 0.9, "low")
    assert rows[2].explanation == "Layer-0 noise filter: Short update without capability signals" and rows[2].assessment is None
    assert rows[3].score == pytest.approx(0.4 + 0.2 - 0.15) and rows[3].severity == "high"  # the model's critical, without a gain
    assert rows[3].requires_verification and rows[3].confidence == 0 and rows[3].indicators[-1] == "[SECRECY] Senior AI researcher departure detected"
    assert [s.name for s in rows[3].signals] == ["secrecy", "corroboration_penalty"] and rows[3].signals[0].detail == "critical"
    assert rows[4].filtered and rows[5].severity == "odd"  # an unknown prior word stays


def test_metric_and_secrecy_rows(found):
    metrics = {(r.id, r.metric): r.value for r in article_scoring.metric_rows(found).collect()}
    assert len(metrics) == 25 and metrics[3, "indicator_count"] == 4 and metrics[2, "model_score"] == 0
    signs = sorted((r.id, r.type, r.severity, r.source) for r in article_scoring.secrecy_rows(found).collect())
    assert signs == [(3, "departure", "high", "Gov"), (3, "government", "high", "Gov"), (3, "government", "high", "Gov"), (3, "silence", "critical", "Gov")]


def shown(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_snippets_are_found_without_a_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as id", "text as content", "'' as title", "source")
    assert "Exchange" not in shown(evidence.claims(evidence.snippets(docs)))
    models = docs.selectExpr("id", "0.5D as model_score", "0.5D as confidence")
    plan = shown(article_scoring.scored(docs, models))
    assert plan.count("text#") and plan.count("FileScan") == 2  # the contents, and the ids of the replies
    reads = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("text:string" in line for line in reads) == 1


def test_first_of_equal_sentences_and_order(spark):
    content = "A novel result was found here. a NOVEL result was found here. Novel benchmark of 50% found now. Too short. " + "x" * 310 + " novel."
    got = evidence.snippets(spark.createDataFrame([(1, content), (2, None), (3, ""), (4, "no " * 200)], "id int, content string")).collect()
    assert [(r.id, r.rank, r.pos, r.score, r.tags) for r in got] == [(1, 1, 2, 7, ["benchmark", "novel", "numbers", "percent"]), (1, 2, 0, 2, ["novel"])]
