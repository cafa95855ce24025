import corpus_pipeline
import pytest

from lodeglass.llm import secret_scan
from tests.llm.test_near_duplicates import plain_classes
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small set of tables with a leak, copies, a secret and odd rows."""
    at = str(tmp_path_factory.mktemp("sf"))
    leak = "one two three four five six seven eight nine ten eleven"
    plain = [f"plain words of text {i} that say nothing {i * i} of note at all, number {i}." for i in range(40)]
    texts = [*plain, plain[3].upper(), f"so {leak} then", "key token = abcdefghijkl0123 end", None, "", "same " * 30, "same " * 30]
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_each_decision_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, sorted(docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert set(got) == {r.doc_id for r in rows}
        elif name == "near_duplicates":
            assert set(got) == {c for _, c, _ in plain_classes([(r.doc_id, r.text) for r in rows])} and 40 not in got
        elif name == "decontamination":
            assert 41 not in got and 42 in got
        else:
            assert got[42] == "key [REDACTED] end" and got[43] is None
            assert all(t == secret_scan.redact(rows[i].text, secret_scan.find_secrets(rows[i].text)) for i, t in got.items() if t)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
    check_packing(corpus_pipeline.run(spark, folder).collect(), docs.collect(), 4096)


def test_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    assert len(bad - left) > len(bad) / 2 and docs.count() - len(left) < 2 * len(bad)


def test_empty_tables_and_columns_of_any_name(spark, tmp_path, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.selectExpr("*", "1 as own0", "2 as `a.b`", "3 as _id", "4 as _own", "5 as _nth", "6 as passages", "7 as toxicity", "8 as node", "9 as comp", "10 as text_hash", "11 as _slot")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, folder)
        assert got.columns == odd.columns, name
        assert {(r["own0"], r["a.b"], r["_nth"], r["comp"]) for r in got.collect()} == {(1, 2, 5, 9)}
        assert stage(spark, docs.limit(0), folder).collect() == []
    at = str(tmp_path / "none")
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{at}/{table}.parquet")
    assert corpus_pipeline.run(spark, at).collect() == []
