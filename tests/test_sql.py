"""SQL functions against the column functions that they stand beside."""

import pytest
from pyspark.sql import functions as F

from lodeglass.functions import lexicons, scoring, sql, text
from lodeglass.operators import evidence, vectors


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    assert set(sql.register(spark)) == {"severity", "cjk_ratio", "canonical_url", "cosine", "heuristic_score", "sentences_of", "secrecy_terms", "extract_claims"}
    sql.register(spark)  # again, in place of the first


def test_scalars_equal_the_columns(spark):
    rows = spark.createDataFrame([(x / 20, u, c) for x, u, c in zip(range(-2, 24), ["https://a.b/c?b=2&a=1&utm_source=x#f", "https://a.b/c?ref=1", "https://a.b/c", "nothing", None, "https://a.b/?#x"] * 5, ["模型 x", "abc", "", None, "あ" * 5000] * 6)], "x double, u string, c string")
    got = rows.selectExpr("severity(x) s", "canonical_url(u) u2", "cjk_ratio(c) r", "x", "u", "c")
    same = got.filter(got.s.eqNullSafe(scoring.severity(F.col("x"))) & got.u2.eqNullSafe(text.canonical_url(F.col("u"))) & got.r.eqNullSafe(text.cjk_ratio(F.col("c"))))
    assert same.count() == rows.count()


def test_vectors_and_scores(spark):
    a = spark.createDataFrame([([1.0, 2.0], [2.0, -1.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r.s, 9) for r in a.selectExpr("cosine(a, b) s").collect()] == [round(r.s, 9) for r in a.select(vectors.cosine(F.col("a"), F.col("b")).alias("s")).collect()] == [0.0, 1.0]
    claims = [("ARC", 30.0, 12.0, ["human-level"]), (None, 1.0, 6.0, ["generalization"]), ("", None, None, None)]
    for some in (claims, claims[:1], claims[1:], []):
        got = spark.createDataFrame([(some,)], "c array<struct<benchmark: string, value: double, delta: double, tags: array<string>>>")
        r = got.select(F.expr("heuristic_score(c, 3)").alias("s"), evidence.heuristic(F.col("c"), F.lit(3)).alias("t")).first()
        assert r.s == r.t


def test_tables_equal_the_frames(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as id", "concat(text, '. The novel benchmark beats all on ARC with 30%. It improves by 12% on ARC!') as content")
    docs.createOrReplaceTempView("docs_of_sql")
    got = spark.sql("SELECT id, s.pos, s.sentence FROM docs_of_sql d, LATERAL sentences_of(d.content) s")
    assert got.exceptAll(evidence.sentence_rows(docs)).count() == 0 == evidence.sentence_rows(docs).exceptAll(got).count()
    names = lambda x: "array(" + ", ".join(f"'{t}'" for t in x) + ")"
    marks = ", ".join(f"'{k}', '{v}'" for k, v in lexicons.BENCHMARKS.items())
    got = spark.sql(f"SELECT id, rank, claim, benchmark, value, delta, unit FROM extract_claims({names(lexicons.EVIDENCE)}, map({marks}), TABLE(docs_of_sql) PARTITION BY id)")
    want = evidence.claims(evidence.snippets(docs)).select("id", "rank", "claim", "benchmark", "value", "delta", "unit")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) != []


def test_odd_contents(spark):
    spark.createDataFrame([(1, None), (2, ""), (3, "short.")], "id bigint, content string").createOrReplaceTempView("odd_docs")
    assert spark.sql("SELECT * FROM extract_claims(array('novel'), map('arc', 'ARC'), TABLE(odd_docs) PARTITION BY id)").count() == 0
    assert spark.sql("SELECT * FROM odd_docs d, LATERAL secrecy_terms(d.content, array('sh')) s").count() == 1
