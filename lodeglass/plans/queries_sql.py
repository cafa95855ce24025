"""Registered queries that are SQL text over the library's SQL functions, and their DuckDB SQL."""

from __future__ import annotations


from lodeglass.functions import lexicons
from lodeglass.functions.sql import register
from lodeglass.plans.queries_text import _CLAIMS, _SAID, _SENTENCES, MARKS, SECRET, _list, _with_gains
from lodeglass.sources.adapters import Tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function of Tables that returns views (name -> frame) and SQL text over them."""
    def add(f):
        def run(spark, folder: str):
            register(spark)
            views, said = f(Tables(spark, folder))
            return spark.sql(said, **views)  # each in braces in the text

        run.__doc__ = f.__doc__
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = run, sql
        return f

    return add


@query(
    """SELECT p_name AS name, CASE WHEN p_size / 50.0 >= 0.8 THEN 'critical' WHEN p_size / 50.0 >= 0.6 THEN 'high' WHEN p_size / 50.0 >= 0.3 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM (SELECT DISTINCT lang AS p_name FROM documents), (SELECT l_quantity AS p_size FROM lineitem) GROUP BY ALL"""
)
def sql_severities(t):
    """Quantities as severities, by language, through severity()."""
    views = {"documents": t.raw("documents"), "lineitem": t.raw("lineitem")}
    return views, "WITH l AS (SELECT severity(l_quantity / 50) AS severity, count(*) AS n FROM {lineitem} GROUP BY 1) SELECT lang AS name, severity, n FROM (SELECT DISTINCT lang FROM {documents}) CROSS JOIN l"


@query("SELECT id, len(regexp_extract_all(substr(c, 1, 4000), '[぀-ヿ㐀-䶿一-鿿豈-﫿]')) / greatest(1, length(substr(c, 1, 4000)))::DOUBLE AS ratio FROM (SELECT doc_id AS id, repeat('模型', (doc_id % 40)::INTEGER) || text AS c FROM documents)")
def sql_cjk_ratios(t):
    """Shares of CJK characters of texts begun with some, through cjk_ratio()."""
    return {"documents": t.raw("documents")}, "SELECT doc_id AS id, cjk_ratio(concat(repeat('模型', int(doc_id % 40)), text)) AS ratio FROM {documents}"


@query("""SELECT page_id, CASE WHEN q = '' THEN b ELSE CASE WHEN len(k) = 0 THEN split_part(b, '?', 1) ELSE split_part(b, '?', 1) || '?' || array_to_string(k, '&') END END AS url FROM (SELECT *, split_part(b, '?', 2) AS q, list_sort(list_filter(string_split(split_part(b, '?', 2), '&'), lambda p: p <> '' AND NOT list_contains(""" + _list(lexicons.TRACKING_PARAMETERS) + """, lower(split_part(p, '=', 1))))) AS k FROM (SELECT page_id, split_part(url || CASE WHEN contains(url, '?') THEN '&UTM_Source=x' ELSE '' END, '#', 1) AS b FROM pages))""")
def sql_canonical_urls(t):
    """URLs of pages, some with one more tracking parameter, through canonical_url()."""
    return {"pages": t.raw("pages")}, "SELECT page_id, canonical_url(if(contains(url, '?') AND NOT contains(url, '#'), concat(url, '&UTM_Source=x'), url)) AS url FROM {pages}"


@query("SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sql_cosines(t):
    """How alike each vector and the next are, through cosine()."""
    return {"v": t.raw("embeddings")}, "SELECT a.vec_id AS id, round(cosine(cast(a.embedding AS ARRAY<DOUBLE>), cast(b.embedding AS ARRAY<DOUBLE>)), 6) AS similarity FROM {v} a JOIN {v} b ON b.vec_id = a.vec_id + 1"


@query("""SELECT l_orderkey AS id, round(least(0.4, sum(0.03 + CASE WHEN l_discount * 100 >= 10 THEN 0.1 WHEN l_discount * 100 >= 5 THEN 0.05 ELSE 0 END + CASE WHEN l_returnflag = 'R' AND l_quantity >= 25 THEN 0.15 WHEN l_returnflag = 'R' AND l_quantity >= 10 THEN 0.1 ELSE 0 END) + CASE WHEN count(*) >= 3 THEN 0.03 ELSE 0 END), 6)::DOUBLE AS score FROM lineitem GROUP BY l_orderkey""")
def sql_heuristic_scores(t):
    """Orders' lines as claims, scored through heuristic_score()."""
    return {"lineitem": t.raw("lineitem")}, """SELECT l_orderkey AS id, heuristic_score(collect_list(named_struct('benchmark', if(l_returnflag = 'R', 'ARC', l_returnflag), 'value', double(l_quantity), 'delta', double(l_discount * 100), 'tags', array('x'))), int(count(*))) AS score FROM {lineitem} GROUP BY l_orderkey"""


@query(
    _SAID + ", " + _SENTENCES + ", " + _CLAIMS
    + " SELECT id, rank::INTEGER AS rank, sha256(claim) AS claim, benchmark, coalesce(pct, plain) AS value, coalesce(dpct, dplain) AS delta, CASE WHEN dpct IS NOT NULL OR pct IS NOT NULL THEN '%' END AS unit FROM cl"
)
def sql_extracted_claims(t):
    """The claims of articles, through the table function extract_claims, partitioned by article."""
    marks = ", ".join(f"'{k}', '{v}'" for k, v in MARKS.items())
    return {"articles": _with_gains(t).select("id", "content")}, f"SELECT id, rank, sha2(claim, 256) AS claim, benchmark, value, delta, unit FROM extract_claims({_list(lexicons.EVIDENCE).replace('[', 'array(').replace(']', ')')}, map({marks}), TABLE(SELECT id, content FROM {{articles}}) PARTITION BY id)"


@query(f"SELECT id, term, CASE WHEN contains(term, 'nda') THEN 'high' ELSE 'medium' END AS severity FROM (SELECT doc_id AS id, unnest(list_filter({_list(SECRET)}, lambda x: contains(lower(text), x))) AS term FROM documents)")
def sql_secrecy_terms(t):
    """Terms of secrecy in documents, through the table function secrecy_terms."""
    return {"documents": t.raw("documents")}, f"SELECT d.doc_id AS id, s.term, s.severity FROM {{documents}} d, LATERAL secrecy_terms(d.text, {_list(SECRET).replace('[', 'array(').replace(']', ')')}) s"
