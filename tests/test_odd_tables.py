"""Registered queries against their SQL on small tables of odd rows."""

import duckdb

from lodeglass.plans import registry
from lodeglass.sources.selectors import items


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over these tables (name -> (rows, schema)), sorted."""
    db = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(folder))
    found = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    return sorted(map(tuple, got.select(*names).collect()), key=repr), sorted(found.fetchall(), key=repr)


def documents(*texts):
    return [(2 * k + 1, x, "en", "s", len(x)) for k, x in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_numbers_of_claims_are_exact(spark, tmp_path):
    got, want = both(spark, tmp_path, "e4_e8_claims", documents=documents("Numbers like 909955422195631400000 and 1.0005, 2.0625 or 12345678901234567 in a row."))
    assert got == want and got[0][-1] == "909955422195631390720.000,1.000,2.062,12345678901234568.000"


def test_the_first_benchmark_of_the_list_counts(spark, tmp_path):
    got, want = both(spark, tmp_path, "sql_extracted_claims", documents=documents("A berth in a month, an arc of 30 percent stands.", "The month in a berth was a novel one then.", "A novel one.\u3000Unbroken at odd spaces.\u00a0As 7% of all are."))
    assert got == want and [r[3] for r in got] == ["ARC", "ERTH", None]


def test_character_references_of_listings(spark, tmp_path):
    found = "&lt;b&gt; &amp;lt; &amp;amp; &amp and &quot;x&quot; &#65; &copy &am & &; AT&T &amp"
    pages = [(1, "https://a.b/c", f"<body><article><h1>{found}</h1><p>x"), (2, "https://a.b/c", f'<nav><ul><li><a href="/x">{found}</a></li></ul></nav>')]
    got, want = both(spark, tmp_path, "s4_selected_listings", pages=(pages, "page_id bigint, url string, html string"))
    assert got == want and got[0][2].startswith("<b> &lt; &amp; &amp and &quot;x") and len(got) == 2
    assert items(pages[0][2], None, "article", "h1", "p", "a")[0]["title"] == '<b> &lt; &amp; & and "x" A © &am & &; AT&T &'
    assert items("<li><a>&amp;&lt;</a>", None, "li", "a", "a", "a", ()) == [{"title": "&amp;&lt;", "content": "&amp;&lt;", "url": ""}]
