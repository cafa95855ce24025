"""Terms as whole words, the longest first, of short and long lists."""

import pytest

from lodeglass.functions import lexicons
from lodeglass.operators import evidence

SENTENCES = [
    (1, "On ARC-AGI the novel model has 30%.", "ARC-AGI"), (2, "It searches SuperGLUE and GLUE.", "SuperGLUE"), (3, "Research in arcades.", None), (4, "An arc, and glue", "GLUE"), (5, "arc - agi", "ARC"),
    (6, "SWE-bench", "SWE-bench"), (7, "swe  bench", None), (8, "math", "MATH"), (9, "aftermath", None), (10, None, None), (11, "", None), (12, "Big-Bench!", "BIG-bench"), (13, "ARC", "ARC"), (14, "ARC-AGI", "ARC-AGI"), (14, "ARC-AGI", "ARC-AGI"),
]


def test_longest_whole_words(spark):
    rows = spark.createDataFrame([(i, s) for i, s, _ in SENTENCES], "id int, s string")
    got = evidence.word_terms(rows, "s", evidence.lexicon_of(rows, lexicons.BENCHMARKS)).collect()
    assert {r.id: r.label for r in got} == {i: want for i, _, want in SENTENCES if want} and len(got) == len({i for i, _, w in SENTENCES if w})


def test_a_hundred_thousand_terms(spark):
    terms = spark.range(100_000).selectExpr("concat('Term ', id, '-x') as term", "concat('L', id) as label", "int(id) as place")
    rows = spark.range(300).selectExpr("id", "concat('we saw term  ', id * 7, '-X, and term ', id) as s")
    got = {r.id: r.label for r in evidence.word_terms(rows, "s", terms).collect()}
    assert got == {i: f"L{i * 7}" for i in range(300)}


def test_both_modes_of_claims(spark):
    docs = spark.createDataFrame([(1, "The novel system beats all on ARC-AGI with an F1-score of 12%. A novel result on SuperGLUE by research.")], "id int, content string")
    found = evidence.snippets(docs)
    one, two = ([(r.benchmark, r.metric) for r in evidence.claims(found, mode=m).orderBy("rank").collect()] for m in ("reference", "word"))
    assert one == [("ARC", "score"), ("ARC", None)] and two == [("ARC-AGI", "f1-score"), ("SuperGLUE", None)]
    with pytest.raises(ValueError, match="mode"):
        evidence.claims(found, mode="other")
