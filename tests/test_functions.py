from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeglass.functions import assessment, scoring, text
from lodeglass.operators import aggregates, evidence, joins, secrecy, vectors
from lodeglass.plans.queries_text import responses


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    shown = ["2025-01-05T10:00:00Z", "2025年1月5日", "2025.1.5", "2025年1月", "Mon, 06 Jan 2025 10:00:00 GMT", "soon", "", None]
    want = [datetime(2025, 1, 5, 10), datetime(2025, 1, 5), datetime(2025, 1, 5), datetime(2025, 1, 1), datetime(2025, 1, 6, 10), None, None, None]
    got = column(spark, shown, lambda c: F.date_format(text.parsed_date(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == [w and w.strftime("%Y-%m-%d %H:%M:%S") for w in want]


def test_languages(spark):
    assert column(spark, ["plain", "漢字かな", "some 漢 words in between, and then many more of them", "", None], text.language) == ["en", "zh", "en", "en", "en"]


def test_urls(spark):
    got = column(spark, ["https://a.org/x?b=2&utm_source=q&a=1#top", "https://a.org/x?ref=1", "https://a.org/x#y", "nonsense"], text.canonical_url)
    assert got == ["https://a.org/x?a=1&b=2", "https://a.org/x", "https://a.org/x", "nonsense"]
    urls = ["http://localhost/", "http://127.0.0.1/", "http://10.0.0.1/", "http://192.168.1.2/", "http://[::1]/", "https://example.com/", "file:///etc", "http://169.254.169.254/", "http://metadata/"]
    assert [r is None for r in column(spark, urls, text.unsafe_reason)] == [False, False, False, False, False, True, False, False, False]


@pytest.mark.parametrize(("score", "delta", "word", "want"), [(0.9, False, "hold", "high"), (0.9, True, "hold", "critical"), (0.7, True, "dismiss", "medium"), (0.4, True, "dismiss", "medium"), (0.0, True, "hold", "none")])
def test_severities(spark, score, delta, word, want):
    s = scoring.gated_severity(scoring.severity(F.col("s")), F.col("d"))
    assert one(spark, scoring.overridden_severity(s, F.col("w")), s=score, d=delta, w=word) == want


def test_progress(spark):
    got = column(spark, [0.04, 0.52, 1.0, 1.5, -0.1], lambda c: F.round(scoring.progress(c), 6), "double")
    assert got == [0, 50, 100, 100, 0]
    assert column(spark, [0.09, 0.1, 0.25, 0.5, 0.75], scoring.progress_status, "double") == ["baseline", "watch", "notable", "strong", "exceptional"]


def test_claims_of_sentences(spark):
    said = "Our model achieves state of the art. It reaches 85.4% accuracy on MMLU, an improvement of 5.2% over others. We also improved by 3 points on GSM8K benchmark tests."
    rows = spark.createDataFrame([(1, said), (2, "Ethics matter."), (3, None)], "id bigint, content string")
    made = {r["rank"]: r for r in evidence.claims(evidence.snippets(rows)).collect()}
    assert {r.benchmark for r in made.values()} == {"MMLU", "GSM8K", None}
    first = next(r for r in made.values() if r.benchmark == "MMLU")
    assert (first.metric, first.value, first.delta, first.unit) == ("accuracy", 85.4, 5.2, "%")
    assert next(r for r in made.values() if r.benchmark == "GSM8K").delta == 3.0


def test_heuristic_score(spark):
    rows = spark.createDataFrame([(1, "ARC", 12.0, 6.0, [])], "id bigint, benchmark string, value double, delta double, tags array<string>")
    counts = spark.createDataFrame([(1, 3)], "id bigint, snippets bigint")
    r = evidence.heuristic_scores(rows, counts).first()
    assert (r.heuristic, r.has_delta) == (0.21, True)


def test_secrecy(spark):
    rows = spark.createDataFrame([(1, "This is classified and under NDA."), (2, "The chief scientist is leaving."), (3, "The junior left."), (4, None)], "id bigint, content string")
    got = {(r.id, r.term): r for r in secrecy.hits(rows).collect()}
    assert got[1, "classified"].severity == "critical" and got[1, "nda"].severity == "high" and got[1, "nda"].evidence.startswith("...")
    assert {i for i, _ in got} == {1} and [r.id for r in secrecy.departures(rows).collect()] == [2]


@pytest.mark.parametrize(("gone", "of", "want"), [(2, 10, "medium"), (3, 10, "high"), (4, 10, "critical"), (5, 100, None)])
def test_removals(spark, gone, of, want):
    rows = [("s", f"t{i}") for i in range(of)]
    got = secrecy.removals(spark.createDataFrame(rows, "source string, title string"), spark.createDataFrame(rows[gone:], "source string, title string")).collect()
    assert [r.severity for r in got] == ([want] if want else [])


def test_chained_duplicates(spark):
    rows = spark.createDataFrame([(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h2"), (4, "u3", "h2"), (5, "u4", "h5")], "n int, url string, content_hash string")
    assert sorted(r.n for r in joins.first_of_each(rows, "n").collect()) == [1, 3, 5]


def test_upsert_with_null_keys(spark):
    schema = "a string, b string, v int, created_at int"
    old, new = spark.createDataFrame([("x", None, 1, 1), ("y", "k", 2, 1)], schema), spark.createDataFrame([("x", None, 5, 9), ("z", "k", 6, 9)], schema)
    got = sorted(tuple(r) for r in joins.upsert(old, new, ["a", "b"]).collect())
    assert got == [("x", None, 5, 1), ("y", "k", 2, 1), ("z", "k", 6, 9)]


def test_confusion(spark):
    rows = spark.createDataFrame([("relevant", 0.9), ("critical", 0.7), ("noise", 0.1), ("false_positive", 0.2)], "feedback_type string, score double")
    r = aggregates.confusion(rows).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.precision, r.recall) == (2, 0, 2, 0, 1.0, 1.0)
    assert aggregates.confusion(rows.limit(0)).first().accuracy == 0.0


def test_replies(spark):
    raw = ['{"score": 0.5, "indicators": ["a"]}', '```json\n{"score": 0.5}\n```', "{", "", None, '{"indicators": ["é"]}']
    rows = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    got = [(r.score, r.indicators) for r in responses(rows).orderBy("id").collect()]
    assert got == [(0.5, ["a"]), (0.5, []), (0.0, []), (0.0, []), (0.0, []), (0.0, ["é"])]


def test_assessments(spark):
    def of(content, model, status, support, benchmark, delta=False):
        row = spark.range(1).select(assessment.assess(F.lit(content), F.lit(content), F.lit(model), F.lit(0.4), F.lit(0.0), F.lit(status), F.lit(support), F.lit(benchmark), F.lit(delta)).alias("a"))
        return row.select("a.*", assessment.may_conclude(F.col("a")).alias("may")).first()

    lone = of("a benchmark result", 0.6, "live", "none", True)
    assert lone.types == ["benchmark"] and lone.doubt == "single benchmark" and not lone.may
    assert of("text", 0.5, "manual_snapshot", "none", False).confidence in ("none", "weak")
    strong = of("Autonomous agents generalize and discover vulnerabilities in production.", 1.0, "live", "replicated", True, True)
    assert strong.may and strong.confidence == "extraordinary" and strong.vector.autonomy == 1.0
    assert of("superintelligence claims", 0.1, "live", "none", False).asi == "watch"


def test_percentiles_give_ties_the_highest_place(spark):
    rows = spark.createDataFrame([(0.1,), (0.2,), (0.2,), (0.9,)], "distance double")
    assert sorted(r.percentile for r in vectors.percentile(rows).collect()) == [0, 67, 67, 100]


def test_neighbours_of_more_vectors_than_a_block(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=(700, 6))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(e.tolist())] + [(700, None)], "id bigint, embedding array<double>").repartition(3)
    u = e / np.linalg.norm(e, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = vectors.nearest_to_each(rows, rows.filter("id >= 100"), 3).collect()
    assert {(r.query_id, r.id) for r in got} == {(q, int(i)) for q in range(100, 700) for i in np.argsort(-s[q])[:3]} and len(got) == 1800
    assert vectors.nearest_to_each(rows, rows.filter("id < 0"), 3).collect() == []


def test_reviewer_lines_are_numbered_in_parallel(spark):
    from lodeglass.plans import registry

    df = registry.queries()["n15_reviewer_lines"](spark, "/root/testdata/sf0.01")
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.line.split("]")[0] for r in df.orderBy("id").collect()] == [f"[{i}" for i in range(1, df.count() + 1)]


def test_numbers_as_texts(spark):
    got = column(spark, [[1.0005, 2.0625, 0.0, None], [909955422195631400000.0, 1e16, float("inf")], [], None], lambda c: text.three_places(c), "array<double>")
    assert got == [["1.000", "2.062", "0.000", None], ["909955422195631390720.000", "10000000000000000.000", "inf"], [], None]
