"""Registered queries of normalisation, filters, evidence, secrecy and scoring, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeglass.functions import assessment, lexicons, scoring, text
from lodeglass.operators import evidence, secrecy
from lodeglass.plans import article_scoring
from lodeglass.sources.adapters import SEVERITY_SQL, Tables, with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Terms that occur in the test tables, in the roles of the library's own lists.
CAPABILITY, NOISE, MARKS, METRICS, SECRET = ("arc", "nda"), ("em", "ation"), {"arc": "ARC", "erth": "ERTH", "onth": "ONTH"}, ("em", "tion"), ("nda", "thand")

#: Sentences with gains as the library reads them.
GAIN_SENTENCES = (
    "This outperforms the novel benchmark and improves by 12.5% now.", "A breakthrough benchmark shows an improvement of 7 points, emergent and novel.", "The novel benchmark beats all and is up 3.25% today.",
    "An increase of 40% on the benchmark achieves a novel breakthrough.", "The benchmark delta 8 surpasses what was a novel breakthrough.", "The benchmark gain of 2.5 outperforms the novel sota of 90%.",
)


def query(sql: str | None = None, *tables: str):
    """Registers a function of Tables under its name, with its SQL after the named logical tables."""
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return add


def _list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _in(column: str, terms) -> str:
    return f"list_filter({_list(terms)}, lambda t: contains(lower({column}), t))"


_SPACES = r"regexp_replace({0}, '\s+', ' ', 'g')"


@query(f"SELECT DISTINCT trim({_SPACES.format('source')}) AS source FROM articles", "articles")
def n1_source_names(t):
    """Source names with single spaces."""
    return t.articles().select(text.collapsed(F.col("source")).alias("source")).distinct()


_RATIO = "len(regexp_extract_all(substr(content, 1, 4000), '[぀-ヿ㐀-䶿一-鿿豈-﫿]')) / greatest(1, length(substr(content, 1, 4000)))::DOUBLE"


@query(f"SELECT id, {_RATIO} AS ratio, CASE WHEN {_RATIO} > 0.15 THEN 'zh' WHEN {_RATIO} > 0.03 THEN 'mixed' ELSE 'en' END AS language, {_RATIO} >= 0.08 AS translate FROM (SELECT id, repeat('模型', (id % 40)::INTEGER) || substr(content, 1, 400) AS content FROM articles)", "articles")
def n2_n4_language(t):
    """CJK ratio, language class and whether to translate, of articles begun with so many CJK characters."""
    c = F.col("content")
    rows = t.articles().select("id", F.concat(F.repeat(F.lit("模型"), (F.col("id") % 40).cast("int")), F.substring("content", 1, 400)).alias("content"))
    return rows.select("id", text.cjk_ratio(c).cast("double").alias("ratio"), text.language(c).alias("language"), text.needs_translation(c).alias("translate"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE strftime(CASE event_id % 5 WHEN 3 THEN date_trunc('month', ts) WHEN 0 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') END AS normalised FROM events""")
def n5_dates(t):
    """Dates read back from four ways of writing them, and from none."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    shown = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy年M月d日")).when(k == 2, F.date_format(ts, "yyyy.M.d")).when(k == 3, F.date_format(ts, "yyyy年M月")).otherwise("no date")
    return t.raw("events").select(F.col("event_id").alias("id"), F.date_format(text.parsed_date(shown), "yyyy-MM-dd HH:mm:ss").alias("normalised"))


_STRIP = _list(lexicons.TRACKING_PARAMETERS)


@query(f"""WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages),
q AS (SELECT *, regexp_replace(bare, '\\?.*$', '') AS path, CASE WHEN contains(bare, '?') THEN list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT list_contains({_STRIP}, lower(split_part(x, '=', 1))))) END AS kept FROM p)
SELECT page_id, CASE WHEN kept IS NULL OR len(kept) = 0 THEN path ELSE path || '?' || array_to_string(kept, '&') END AS canonical FROM q""")
def n6_canonical_urls(t):
    """URLs without fragments and tracking parameters, parameters sorted."""
    return t.raw("pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT id, sha256(content) AS content_hash FROM articles", "articles")
def n7_content_hashes(t):
    """The SHA-256 of every article."""
    return t.articles().select("id", F.sha2("content", 256).alias("content_hash"))


@query(f"SELECT id, trim({_SPACES.format('source')}) AS source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published, url AS canonical_url, sha256(content) AS content_hash, title, CASE WHEN {_RATIO} > 0.15 THEN 'zh' WHEN {_RATIO} > 0.03 THEN 'mixed' ELSE 'en' END AS language FROM articles", "articles")
def n8_metadata(t):
    """The metadata record of every article."""
    c = F.col("content")
    return t.articles().select("id", text.collapsed(F.col("source")).alias("source"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("published"), text.canonical_url(F.col("url")).alias("canonical_url"), F.sha2(c, 256).alias("content_hash"), "title", text.language(c).alias("language"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'http://localhost/a' WHEN 1 THEN 'http://127.0.0.5/' WHEN 2 THEN 'https://10.0.0.' || page_id || '/x' WHEN 3 THEN 'ftp://example.com/' WHEN 4 THEN 'http://[fd00::1]/' WHEN 5 THEN 'not a url' ELSE url END AS url FROM pages)
SELECT page_id, CASE WHEN h = '' THEN 'invalid' WHEN sc NOT IN ('http', 'https') THEN 'scheme' WHEN h IN ('localhost', '127.0.0.1', '[::1]') THEN 'localhost' WHEN starts_with(h, '127.') THEN 'loopback' WHEN starts_with(h, '169.254.') THEN 'link-local' WHEN starts_with(h, '10.') OR starts_with(h, '192.168.') OR starts_with(h, '0.') OR regexp_matches(h, '^172[.](1[6-9]|2[0-9]|3[01])[.]') OR regexp_matches(h, '^100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])[.]') OR regexp_matches(h, '^.?f[cd]') AND h[1] IN ('[', 'f') THEN 'private address' WHEN h IN ('metadata', 'metadata.google.internal') THEN 'metadata host' END AS reason
FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN lower(split_part(url, '://', 1)) ELSE '' END AS sc, CASE WHEN contains(url, '://') THEN lower(CASE WHEN starts_with(split_part(url, '://', 2), '[') THEN split_part(split_part(url, '://', 2), ']', 1) || ']' ELSE regexp_extract(split_part(url, '://', 2), '^[^/?#:]*') END) ELSE '' END AS h FROM u)""")
def n9_unsafe_urls(t):
    """Why a link of each page must not be followed."""
    k = F.col("page_id") % 7
    url = F.when(k == 0, "http://localhost/a").when(k == 1, "http://127.0.0.5/").when(k == 2, F.concat(F.lit("https://10.0.0."), "page_id", F.lit("/x"))).when(k == 3, "ftp://example.com/").when(k == 4, "http://[fd00::1]/").when(k == 5, "not a url").otherwise(F.col("url"))
    return t.raw("pages").select("page_id", text.unsafe_reason(url).alias("reason"))


@query("""WITH n AS (SELECT id, (CASE id % 3 WHEN 0 THEN 'see arXiv:' || lpad((id % 9999)::VARCHAR, 4, '1') || '.' || lpad((id % 99999)::VARCHAR, 5, '0') || 'v2 now' WHEN 1 THEN 'math.GT/' || lpad((id % 9999999)::VARCHAR, 7, '0') ELSE title END) AS t FROM articles)
SELECT id, coalesce(nullif(regexp_extract(t, '\\b([0-9]{4}\\.[0-9]{4,5}(v[0-9]+)?)\\b', 1), ''), nullif(regexp_extract(t, '(?i)\\b([a-z\\-]+(\\.[a-z\\-]+)?/[0-9]{7}(v[0-9]+)?)\\b', 1), '')) AS arxiv FROM n""", "articles")
def n10_arxiv_ids(t):
    """Preprint numbers found in titles, new style before old."""
    k = F.col("id") % 3
    title = F.when(k == 0, F.concat(F.lit("see arXiv:"), F.lpad((F.col("id") % 9999).cast("string"), 4, "1"), F.lit("."), F.lpad((F.col("id") % 99999).cast("string"), 5, "0"), F.lit("v2 now"))).when(k == 1, F.concat(F.lit("math.GT/"), F.lpad((F.col("id") % 9999999).cast("string"), 7, "0"))).otherwise(F.col("title"))
    return t.articles().select("id", text.arxiv_id(title).alias("arxiv"))


@query("SELECT page_id, CASE WHEN seg = '' THEN url ELSE array_to_string(list_transform(string_split(regexp_replace(replace(replace(seg, '-', ' '), '_', ' '), '[.]\\w+$', ''), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') END AS slug FROM (SELECT page_id, url, regexp_extract(rtrim(split_part(split_part(split_part(url, '#', 1), '?', 1), '://', 2), '/'), '/([^/]+)$', 1) AS seg FROM (SELECT page_id, replace(url, '/en/', '/en/new-study_') AS url FROM pages))")
def n11_slug_titles(t):
    """Titles made of the last path segment of each page's URL."""
    rows = t.raw("pages").select("page_id", F.replace("url", F.lit("/en/"), F.lit("/en/new-study_")).alias("url"))
    return rows.select("page_id", text.slug_title(F.col("url")).alias("slug"))


@query("SELECT id, length(substr(title || chr(10) || chr(10) || content, 1, 8000)) AS n, sha256(substr(title || chr(10) || chr(10) || content, 1, 8000)) AS digest FROM articles", "articles")
def n12_embedding_inputs(t):
    """What is embedded of each article, as a digest."""
    joined = F.substring(F.concat("title", F.lit("\n\n"), "content"), 1, 8000)
    return t.articles().select("id", F.length(joined).alias("n"), F.sha2(joined, 256).alias("digest"))


@query("""SELECT crawl_id, benchmark || CASE WHEN metric IS NULL THEN '' ELSE ' · ' || metric END || ' · ' || value::INTEGER || '%' || CASE WHEN delta IS NULL THEN '' ELSE ' · Δ ' || round(delta)::INTEGER || '%' END AS label, count(*) AS n FROM claims GROUP BY ALL""", "claims")
def n13_claim_labels(t):
    """Claims by their labels."""
    c = t.claims()
    label = text.claim_label(F.col("benchmark"), F.col("metric"), F.col("value").cast("int"), F.round("delta").cast("int"), F.col("unit"), F.lit(""))
    return c.groupBy("crawl_id", label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN score < 0.1 THEN 'No clear signal' WHEN score < 0.3 THEN 'Low-watch signal' WHEN score < 0.5 THEN 'Needs review' WHEN score < 0.7 THEN 'High-watch signal' ELSE 'Critical watch signal' END AS label, severity, count(*) AS n FROM analyses GROUP BY ALL", "analyses")
def n14_score_labels(t):
    """Analyses by score label and severity."""
    return t.analyses().groupBy(scoring.score_label(F.col("score")).alias("label"), "severity").agg(F.count("*").alias("n"))


@query("""SELECT a.id, '[' || row_number() OVER (ORDER BY a.id) || '] ' || source || ' | ' || title || ' | ' || round(a.score * 100)::INTEGER || ' | ' || array_to_string(indicators[1:3], ', ') || ' | ' || substr(content, 1, 200) AS line FROM analyses a JOIN articles r ON r.id = a.crawl_id WHERE a.score >= 0.9""", "articles", "analyses")
def n15_reviewer_lines(t):
    """One line for a reviewer on each high-scored article."""
    from pyspark.sql import Window

    rows = t.analyses().filter("score >= 0.9").alias("a").join(t.articles().select(F.col("id").alias("crawl_id"), "source", "title", F.substring("content", 1, 200).alias("start")), "crawl_id")
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(t.analyses().filter("score >= 0.9").approxQuantile("id", [i / parts for i in range(1, parts)], 0.002))) if parts > 1 else []
    rows = rows.withColumn("part", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col("id"))))
    counts, before, at = dict(rows.groupBy("part").count().collect()), [], 0
    for part in sorted(counts):
        before.append((part, at))
        at += counts[part]
    rows = rows.join(F.broadcast(t.spark.createDataFrame(before, "part int, before bigint")), "part")
    n = F.row_number().over(Window.partitionBy("part").orderBy("id")) + F.col("before")
    return rows.select("id", F.format_string("[%d] %s | %s | %d | %s | %s", n, "source", "title", F.round(F.col("score") * 100).cast("int"), F.array_join(F.slice("indicators", 1, 3), ", "), "start").alias("line"))


_TEXT = "coalesce(title, '') || ' ' || coalesce(content, '')"


@query(f"""SELECT id, skip, CASE WHEN skip AND words < 120 THEN 'Short update without capability signals' WHEN skip THEN 'Noise keywords: ' || array_to_string(m[1:3], ', ') END AS reason FROM (
SELECT *, NOT capable AND (words < 120 OR len(m) > 0) AS skip FROM (
SELECT id, len({_in(_TEXT, CAPABILITY)}) > 0 AS capable, {_in(_TEXT, NOISE)} AS m, len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS words FROM articles))""", "articles")
def f1_triage(t):
    """Which articles are noise, with terms that occur in the test tables."""
    return evidence.triage(t.articles(), CAPABILITY, NOISE).select("id", "skip", "reason")


@query(f"""SELECT id, skip FROM (SELECT id, len({_in(_TEXT, lexicons.CAPABILITY)}) = 0 AND (len({_in(_TEXT, lexicons.NOISE)}) > 0 OR len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) < 120) AS skip FROM articles)""", "articles")
def f1_triage_own_terms(t):
    """Which articles are noise, with the library's own terms."""
    return evidence.triage(t.articles()).select("id", "skip")


@query("SELECT count(*) AS n, round(avg(score), 6) AS mean FROM analyses WHERE ts >= (SELECT t FROM as_of) - INTERVAL 7 DAY AND score >= 0.25", "analyses", "as_of")
def f2_f3_recent_high(t):
    """Analyses of the last seven days over a score floor."""
    return t.analyses().filter((F.col("ts") >= t.as_of() - F.expr("interval 7 days")) & (F.col("score") >= 0.25)).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"""WITH n AS (SELECT id, string_split(regexp_replace(trim({_SPACES.format('content')}), '([.!?。！？；])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM articles)
SELECT id, len(list_filter(s, lambda x: x <> '')) AS n, sha256(array_to_string(list_filter(s, lambda x: x <> ''), chr(10))) AS digest FROM n""".replace("WITH n AS", "SELECT * FROM (WITH n AS") + ")", "articles")
def e1_sentences(t):
    """How many sentences an article has, and their digest."""
    return t.articles().select("id", text.sentences(F.col("content")).alias("s")).select("id", F.size("s").cast("bigint").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("digest"))


_SENTENCES = f"""s1 AS (SELECT id, unnest(list_filter(string_split(regexp_replace(trim({_SPACES.format('content')}), '([.!?。！？；])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS s, generate_subscripts(list_filter(string_split(regexp_replace(trim({_SPACES.format('content')}), '([.!?。！？；])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), 1) - 1 AS pos FROM articles),
s2 AS (SELECT id, pos, s, 2 * len({_in('s', (*lexicons.EVIDENCE, *MARKS))}) + CASE WHEN regexp_matches(s, '[0-9]') THEN 2 ELSE 0 END + CASE WHEN contains(s, '%') THEN 1 ELSE 0 END AS score, {_in('s', (*lexicons.EVIDENCE, *MARKS))} AS tags FROM s1 WHERE length(s) BETWEEN 20 AND 300),
s3 AS (SELECT * FROM s2 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id, lower(s) ORDER BY pos) = 1),
sn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank FROM s3 QUALIFY rank <= 6)"""


def _snippets(t):
    return evidence.snippets(t.articles(), benchmarks=tuple(MARKS))


@query("SELECT * FROM (SELECT 1)", "articles")
def e3_snippets(t):
    """The best six sentences of each article."""
    return _snippets(t).select("id", "rank", F.col("pos").cast("bigint").alias("pos"), F.col("score").cast("bigint").alias("score"), F.sha2("snippet", 256).alias("digest"))


ORACLE_SQL["e3_snippets"] = with_tables("", "articles") + ", " + _SENTENCES + " SELECT id, rank::INTEGER AS rank, pos::BIGINT AS pos, score::BIGINT AS score, sha256(s) AS digest FROM sn"

_NUM = r"(\d+\.?\d*)"
_GAIN = lambda shape: "coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract(s, '(?i){g}\\s+{_NUM}{shape}', 1), '') AS DOUBLE)" for g in (*evidence.GAINS, "up" if shape else "delta")) + ")"
_CLAIMS = f"""cl AS (SELECT id, rank, s AS claim, tags, CASE WHEN contains(lower(s), 'arc') THEN 'ARC' WHEN contains(lower(s), 'erth') THEN 'ERTH' WHEN contains(lower(s), 'onth') THEN 'ONTH' END AS benchmark,
CASE WHEN contains(lower(s), 'em') THEN 'em' WHEN contains(lower(s), 'tion') THEN 'tion' END AS metric, try_cast(nullif(regexp_extract(s, '{_NUM}\\s*%', 1), '') AS DOUBLE) AS pct, try_cast(nullif(regexp_extract(s, '{_NUM}', 1), '') AS DOUBLE) AS plain, len(regexp_extract_all(s, '{_NUM}')) AS numbers, {_GAIN(chr(92) + 's*%')} AS dpct, {_GAIN('')} AS dplain FROM sn WHERE rank <= 4)"""


@query("SELECT 1", "articles")
def e4_e8_claims(t):
    """Claims with benchmark, metric, value, delta and unit of the best four sentences of each article; to every second article, a sentence of gains is added."""
    made = evidence.claims(evidence.snippets(_with_gains(t), benchmarks=tuple(MARKS)), MARKS, METRICS)
    return made.select("id", "rank", "benchmark", "metric", "value", "delta", "unit", F.array_join(text.three_places("numbers"), ",").alias("numbers"))


_SAID = with_tables("", "articles").replace("WITH articles AS", "WITH plain AS", 1) + f", articles AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN content || chr(10) || '. ' || ({_list(GAIN_SENTENCES)})[(id // 2) % {len(GAIN_SENTENCES)} + 1] ELSE content END AS content) FROM plain)"
ORACLE_SQL["e4_e8_claims"] = _SAID + ", " + _SENTENCES + ", " + _CLAIMS + " SELECT id, rank::INTEGER AS rank, benchmark, metric, coalesce(pct, plain) AS value, coalesce(dpct, dplain) AS delta, CASE WHEN dpct IS NOT NULL OR pct IS NOT NULL THEN '%' END AS unit, array_to_string(list_transform(regexp_extract_all(claim, '" + _NUM + "'), lambda x: printf('%.3f', x::DOUBLE)), ',') AS numbers FROM cl"


#: Lists in which a shorter term stands inside a longer one, and sentences with them.
WORD_MARKS, WORD_METRICS = {"arc": "ARC", "arc-agi": "ARC-AGI", "glue": "GLUE", "superglue": "SuperGLUE", "the novel": "NOVEL"}, ("em", "f1", "f1-score", "pass@1", "score")
WORD_SENTENCES = (
    "The novel benchmark ARC-AGI has an F1-score of 12.5% at most now.", "A novel result of 7 on SuperGLUE by pass@1 and others.", "The novel research in searching glue gave an em of 3 points.", "Novel arc results, arc - agi ones too, of 30 each, by f1 alone.",
)


def _with_words(t):
    said = F.array(*map(F.lit, WORD_SENTENCES))[(F.floor(F.col("id") / 2) % len(WORD_SENTENCES)).cast("int")]
    return t.articles().withColumn("content", F.when(F.col("id") % 2 == 0, F.concat("content", F.lit("\n. "), said)).otherwise(F.col("content")))


@query("SELECT 1", "articles")
def e4_e5_words(t):
    """Benchmark and metric of the best four sentences of each article, as whole words and the longest first."""
    made = evidence.claims(evidence.snippets(_with_words(t), benchmarks=tuple(WORD_MARKS)), WORD_MARKS, WORD_METRICS, mode="word")
    return made.select("id", "rank", F.sha2("claim", 256).alias("claim"), "benchmark", "metric", "value", "delta", "unit")


_LONGEST = lambda terms: "(SELECT arg_min(l, (-length(t), i)) FROM (SELECT unnest(" + _list(terms) + ") AS t, unnest(" + _list(terms.values()) + ") AS l, unnest(range(" + str(len(terms)) + ")) AS i) WHERE regexp_matches(lower(claim), '(^|[^\\pL\\pN])' || t || '($|[^\\pL\\pN])'))"
ORACLE_SQL["e4_e5_words"] = (
    with_tables("", "articles").replace("WITH articles AS", "WITH plain AS", 1)
    + f", articles AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN content || chr(10) || '. ' || ({_list(WORD_SENTENCES)})[(id // 2) % {len(WORD_SENTENCES)} + 1] ELSE content END AS content) FROM plain), "
    + _SENTENCES.replace(_list((*lexicons.EVIDENCE, *MARKS)), _list((*lexicons.EVIDENCE, *WORD_MARKS))) + ", " + _CLAIMS
    + f" SELECT id, rank::INTEGER AS rank, sha256(claim) AS claim, {_LONGEST(WORD_MARKS)} AS benchmark, {_LONGEST({m: m for m in WORD_METRICS})} AS metric, coalesce(pct, plain) AS value, coalesce(dpct, dplain) AS delta, CASE WHEN dpct IS NOT NULL OR pct IS NOT NULL THEN '%' END AS unit FROM cl"
)


@query("SELECT 1", "articles")
def e9_bundles(t):
    """The evidence of each article: digests of its snippets and claims."""
    found = _snippets(t)
    out = evidence.bundles(found, evidence.claims(found, MARKS, METRICS))
    return out.select("id", F.sha2(F.array_join("snippets", "|"), 256).alias("snippets"), F.size("claims").alias("claims"))


ORACLE_SQL["e9_bundles"] = with_tables("", "articles") + ", " + _SENTENCES + " SELECT id, sha256(string_agg(s, '|' ORDER BY rank)) AS snippets, count(*) FILTER (rank <= 4)::INTEGER AS claims FROM sn GROUP BY id"


@query("""SELECT id, hit AS term, CASE WHEN contains(hit, 'nda') THEN 'high' ELSE 'medium' END AS severity, '...' || substr(content, greatest(1, instr(lower(content), hit) - 50), instr(lower(content), hit) + length(hit) + 50 - greatest(1, instr(lower(content), hit) - 50)) || '...' AS evidence FROM (SELECT id, content, unnest(""" + _in("content", SECRET) + ") AS hit FROM articles)", "articles")
def d1_d3_secrecy_hits(t):
    """Terms of secrecy in articles, with severity and surroundings."""
    return secrecy.hits(t.articles(), SECRET, (), ()).select("id", "term", "severity", "evidence")


@query(f"SELECT id, substr(content, 1, 200) AS evidence FROM articles WHERE len({_in('content', ('nda',))}) > 0 AND len({_in('content', ('thand',))}) > 0", "articles")
def d4_departures(t):
    """Articles with a term of each of two lists."""
    return secrecy.departures(t.articles(), ("nda",), ("thand",)).select("id", "evidence")


_GAPS = "SELECT source, floor((epoch((SELECT t FROM as_of) + INTERVAL 30 DAY) - epoch(max(ts))) / 86400)::BIGINT AS gap_days, CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 21 ELSE 14 END::BIGINT AS expected_days FROM articles GROUP BY source"


@query(f"SELECT *, gap_days > 2 * expected_days AS anomalous, CASE WHEN gap_days > 4 * expected_days THEN 'high' WHEN gap_days > 2 * expected_days THEN 'medium' END AS severity FROM ({_GAPS})", "articles", "as_of")
def d5_publication_gaps(t):
    """Days since each source last published, against what is expected of it."""
    return secrecy.publication_gaps(t.articles(), t.as_of() + F.expr("interval 30 days"), {"src0": 1, "src1": 21})


@query("""SELECT source, removed, total, removed / total::DOUBLE AS rate, CASE WHEN removed / total::DOUBLE > 0.3 THEN 'critical' WHEN removed / total::DOUBLE > 0.2 THEN 'high' ELSE 'medium' END AS severity FROM (
SELECT source, count(*) AS total, count(*) FILTER ((source, title) NOT IN (SELECT (source, title) FROM snapshot_curr)) AS removed FROM snapshot_prev GROUP BY source) WHERE removed / total::DOUBLE > 0.1""", "snapshot_prev", "snapshot_curr")
def d6_removals(t):
    """Sources more than a tenth of whose titles are gone."""
    return secrecy.removals(t.snapshot(False), t.snapshot(True)).drop("titles")


_HITS = "h AS (SELECT id, unnest(" + _in("content", SECRET) + ") AS term FROM articles), i AS (SELECT id, CASE WHEN contains(term, 'nda') THEN 'high' ELSE 'medium' END AS severity FROM h UNION ALL SELECT id, 'high' FROM articles WHERE contains(lower(content), 'nda') AND contains(lower(content), 'thand'))"


def _indicators(t):
    return secrecy.hits(t.articles(), SECRET, (), ()).unionByName(secrecy.departures(t.articles(), ("nda",), ("thand",)))


@query("SELECT 1", "articles")
def d7_risk(t):
    """The risk that all indicators and gaps add up to."""
    return secrecy.risk(_indicators(t), secrecy.publication_gaps(t.articles(), t.as_of() + F.expr("interval 30 days"), {"src0": 1, "src1": 21}))


ORACLE_SQL["d7_risk"] = with_tables("", "articles", "as_of") + ", " + _HITS + f", g AS ({_GAPS}), a AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) AS total, (SELECT count(*) FILTER (gap_days > 2 * expected_days) FROM g) AS gaps FROM i) SELECT *, CASE WHEN critical > 0 OR (high >= 3 AND gaps >= 2) THEN 'critical' WHEN high >= 2 OR (high >= 1 AND gaps >= 2) THEN 'high' WHEN high >= 1 OR gaps >= 2 OR total >= 5 THEN 'medium' ELSE 'low' END AS risk FROM a"


@query("SELECT 1", "articles")
def d8_boosts(t):
    """What indicators of secrecy add to each article's score."""
    return secrecy.boosts(_indicators(t))


ORACLE_SQL["d8_boosts"] = with_tables("", "articles") + ", " + _HITS + " SELECT id, CASE WHEN bool_or(severity = 'critical') THEN 0.2 WHEN bool_or(severity = 'high') THEN 0.1 ELSE 0.0 END::DOUBLE AS boost FROM i GROUP BY id"

_POINTS = "(CASE WHEN benchmark <> '' THEN 0.03 ELSE 0 END + CASE WHEN delta >= 10 THEN 0.1 WHEN delta >= 5 THEN 0.05 ELSE 0 END)::DOUBLE"


@query(f"SELECT crawl_id AS id, round(least(0.4, sum({_POINTS})), 6)::DOUBLE AS heuristic, bool_or(benchmark <> '' AND delta IS NOT NULL) AS has_delta FROM claims GROUP BY crawl_id", "claims")
def p1_p3_heuristic_scores(t):
    """Heuristic scores of claims, and whether any has a benchmark and a delta."""
    return evidence.heuristic_scores(t.claims().withColumn("tags", F.array().cast("array<string>")).withColumnRenamed("crawl_id", "id"))


_COMBINED = "round(greatest(0, least(1, greatest(a.score, a.score * 0.85 + coalesce(h.heuristic, 0) * 0.15))), 6)"


@query(f"""SELECT id, score, CASE WHEN s = 'critical' AND NOT d THEN 'high' ELSE s END AS severity FROM (SELECT a.id, {_COMBINED}::DOUBLE AS score, {SEVERITY_SQL.format(_COMBINED)} AS s, coalesce(has_delta, false) AS d FROM analyses_wide a LEFT JOIN (SELECT crawl_id, least(0.4, sum({_POINTS})) AS heuristic, bool_or(delta IS NOT NULL) AS has_delta FROM claims GROUP BY crawl_id) h USING (crawl_id))""", "claims", "analyses_wide")
def p4_p7_combined_scores(t):
    """Combined scores of analyses, with severities gated by evidence."""
    scored = evidence.heuristic_scores(t.claims().withColumn("tags", F.array().cast("array<string>")).withColumnRenamed("crawl_id", "id")).withColumnRenamed("id", "crawl_id")
    rows = t.analyses_wide().join(scored, "crawl_id", "left")
    score = F.round(scoring.combined_score(F.col("score"), F.coalesce("heuristic", F.lit(0.0)), F.lit(0.0), F.lit(0.0)), 6)
    return rows.select("id", score.alias("score"), scoring.gated_severity(scoring.severity(score), F.coalesce("has_delta", F.lit(False))).alias("severity"))


@query(f"SELECT id, CASE WHEN rank_new >= rank_old THEN now ELSE prior END AS kept, CASE WHEN id % 3 = 0 AND severity IN ('high', 'critical') THEN 'medium' ELSE severity END AS overridden FROM (SELECT id, severity, {SEVERITY_SQL.format('confidence')} AS now, severity AS prior, list_position({_list(lexicons.SEVERITIES)}, {SEVERITY_SQL.format('confidence')}) AS rank_new, list_position({_list(lexicons.SEVERITIES)}, severity) AS rank_old FROM analyses)", "analyses")
def p6_p8_severities(t):
    """Severities that never fall, and those that a dismissal caps."""
    dismissed = F.when(F.col("id") % 3 == 0, "dismiss").otherwise("hold")
    return t.analyses().select("id", scoring.raised_severity(F.col("confidence"), F.col("severity")).alias("kept"), scoring.overridden_severity(F.col("severity"), dismissed).alias("overridden"))


@query("""SELECT id, round(greatest(0, least(1, CASE id % 5 WHEN 0 THEN least(greatest(s, c), greatest(0.35, s)) WHEN 1 THEN least(greatest(0, s - 0.1 - p), c) WHEN 2 THEN least(0.2, c) WHEN 3 THEN greatest(0, s - p) ELSE c END)), 6)::DOUBLE AS score FROM (SELECT id, score AS s, confidence AS c, CASE WHEN severity IN ('high', 'critical') THEN 0.2 ELSE 0 END AS p FROM analyses)""", "analyses")
def p14_validated_scores(t):
    """Scores after a validation of each kind."""
    k = F.col("id") % 5
    said = F.when(k == 0, "investigate").when(k == 1, "lower").when(k == 2, "dismiss").when(k == 3, "hold").otherwise("raise")
    penalty = F.when(F.col("severity").isin("high", "critical"), 0.2).otherwise(0.0)
    return t.analyses().select("id", F.round(scoring.validated_score(said, F.col("score"), F.col("confidence"), penalty), 6).alias("score"))


@query("SELECT analysis_id, feedback_type, round(CASE feedback_type WHEN 'critical' THEN least(1, score * 1.2) WHEN 'noise' THEN score * 0.5 WHEN 'false_positive' THEN score * 0.3 ELSE score END, 6)::DOUBLE AS score FROM feedback", "feedback")
def p15_feedback_impact(t):
    """Scores that feedback asks for."""
    return t.feedback().select("analysis_id", "feedback_type", F.round(scoring.feedback_impact(F.col("feedback_type"), F.col("score")), 6).alias("score"))


@query("""SELECT id, CASE WHEN id % 17 = 0 OR id % 19 = 0 THEN 0.0 ELSE score END AS score, CASE WHEN id % 17 = 0 OR id % 19 = 0 THEN 0 ELSE 2 END::BIGINT AS n FROM analyses""", "analyses")
def p16_model_responses(t):
    """Model replies read as JSON; cut-off and empty ones give defaults."""
    whole = F.to_json(F.struct("score", "indicators"))
    raw = F.when(F.col("id") % 17 == 0, F.substring(whole, 1, 12)).when(F.col("id") % 19 == 0, "").otherwise(F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
    return responses(t.analyses().select("id", raw.alias("raw"))).select("id", "score", F.size("indicators").cast("bigint").alias("n"))


def responses(rows):
    """id, score and indicators of raw replies: fences are stripped; what isn't a JSON object gives score 0 and no indicators."""
    bare = F.coalesce(F.nullif(F.regexp_extract("raw", r"(?is)```(?:json)?\s*(.*?)```", 1), F.lit("")), F.trim("raw"))
    read = F.from_json(F.when(F.try_parse_json(bare).isNotNull(), bare), "score double, indicators array<string>")
    return rows.select("id", F.coalesce(read["score"], F.lit(0.0)).alias("score"), F.coalesce(read["indicators"], F.array().cast("array<string>")).alias("indicators"))


@query(f"SELECT count(*) AS scanned, count(*) FILTER (list_position({_list(lexicons.SEVERITIES)}, {SEVERITY_SQL.format('confidence')}) > list_position({_list(lexicons.SEVERITIES)}, severity)) AS updated FROM analyses", "analyses")
def p17_severity_backfill(t):
    """How many severities a backfill raises."""
    higher = scoring.severity_rank(scoring.severity(F.col("confidence"))) > scoring.severity_rank(F.col("severity"))
    return t.analyses().agg(F.count("*").alias("scanned"), F.count_if(higher).alias("updated"))


@query("SELECT team, round(least(100, greatest(0, (score - 0.04) / 0.96 * 100)), 6)::DOUBLE AS progress, CASE WHEN score >= 0.75 THEN 'exceptional' WHEN score >= 0.5 THEN 'strong' WHEN score >= 0.25 THEN 'notable' WHEN score >= 0.1 THEN 'watch' ELSE 'baseline' END AS status FROM leaderboard_curr", "leaderboard_curr")
def p18_progress(t):
    """How far each team is from the baseline."""
    return t.leaderboard(True).select("team", F.round(scoring.progress(F.col("score")), 6).alias("progress"), scoring.progress_status(F.col("score")).alias("status"))


@query("SELECT 1", "articles")
def p13_article_scoring(t):
    """The whole scoring plan, with terms that occur in the test tables and a model's scores made from ids."""
    models = t.articles().select("id", ((F.col("id") % 101) / 100).alias("model_score"), F.lit(0.5).alias("confidence"))
    return article_scoring.scored(t.articles(), models, CAPABILITY, NOISE, MARKS, METRICS, SECRET)


_P13 = "round(greatest(0, least(1, greatest(m, m * 0.85 + coalesce(h, 0) * 0.15) + coalesce(b, 0))), 6)::DOUBLE"
ORACLE_SQL["p13_article_scoring"] = (
    with_tables("", "articles")
    + f""", tr AS (SELECT *, NOT capable AND (words < 120 OR noisy) AS skip FROM (SELECT *, len({_in(_TEXT, CAPABILITY)}) > 0 AS capable, len({_in(_TEXT, NOISE)}) > 0 AS noisy, len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS words FROM articles)),
{_SENTENCES}, {_CLAIMS},
hh AS (SELECT id, round(least(0.4, sum(CASE WHEN benchmark IS NOT NULL THEN 0.03 ELSE 0 END + CASE WHEN benchmark = 'ARC' AND coalesce(pct, plain) >= 25 THEN 0.15 WHEN benchmark = 'ARC' AND coalesce(pct, plain) >= 10 THEN 0.1 ELSE 0 END) + CASE WHEN (SELECT count(*) FROM sn WHERE sn.id = cl.id) >= 3 THEN 0.03 ELSE 0 END), 6)::DOUBLE AS h FROM cl GROUP BY id),
bb AS (SELECT id, CASE WHEN contains(lower(content), 'nda') THEN 0.1 ELSE 0.0 END::DOUBLE AS b FROM tr WHERE NOT skip),
aa AS (SELECT tr.id, skip, (tr.id % 101) / 100.0::DOUBLE AS m, h, b FROM tr LEFT JOIN hh ON hh.id = tr.id AND NOT skip LEFT JOIN bb ON bb.id = tr.id)
SELECT id, skip AS filtered, CASE WHEN skip THEN 0.05 ELSE {_P13} END AS score, CASE WHEN skip THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN skip THEN 'low' WHEN {_P13} >= 0.6 THEN 'high' WHEN {_P13} >= 0.3 THEN 'medium' WHEN {_P13} > 0 THEN 'low' ELSE 'none' END AS severity FROM aa"""
)

def _replies(t):
    """A model's replies made from ids: a score, its own severity, indicators, and references of which a third name a known source."""
    i = F.col("id")
    refs = F.when(i % 3 == 0, F.array(F.concat(F.lit("SRC"), i % 30), F.lit("nobody"))).when(i % 3 == 1, F.array(F.lit("nobody"))).otherwise(F.array().cast("array<string>"))
    return t.articles().select("id", ((i % 101) / 100).alias("model_score"), ((i % 10) / 10).alias("confidence"), F.when(i % 7 == 0, "high").when(i % 7 == 1, "medium").alias("severity"), F.array_repeat(F.lit("x"), (i % 4).cast("int")).alias("indicators"), refs.alias("refs"))


def _with_gains(t):
    """The articles, every second with a sentence of gains added."""
    gains = F.array(*map(F.lit, GAIN_SENTENCES))[(F.floor(F.col("id") / 2) % len(GAIN_SENTENCES)).cast("int")]
    return t.articles().withColumn("content", F.when(F.col("id") % 2 == 0, F.concat("content", F.lit("\n. "), gains)).otherwise(F.col("content")))


#: Terms of caution and of government that occur in the test tables.
CAUTIOUS, STATE = ("erth", "onth"), ("arc",)


def _analysed(t):
    terms = article_scoring.Terms(CAPABILITY, NOISE, benchmarks=tuple(MARKS.items()), metrics=METRICS, secrecy=SECRET, caution=CAUTIOUS, government=STATE, leaving=("nda",), senior=("thand",))
    return article_scoring.analysed(_with_gains(t), _replies(t), terms)


@query("SELECT 1", "articles")
def p13_analyses(t):
    """The analyses of the whole plan: replies, claims, signs of secrecy, corroboration, prior severities and assessments."""
    a = article_scoring.analyses(_analysed(t))
    return a.select(
        "id", "filtered", "score", "confidence", "severity", "heuristic", F.size("indicators").cast("bigint").alias("indicators"), "requires_verification", F.array_join(F.transform("signals", lambda s: s["name"]), ",").alias("signals"),
        F.col("assessment.priority").alias("priority"), F.col("assessment.ladder").alias("ladder"), F.array_join("assessment.types", ",").alias("types"),
    )


@query("SELECT 1", "articles")
def p13_metric_rows(t):
    """The metric rows of the whole plan."""
    return article_scoring.metric_rows(_analysed(t)).withColumn("value", F.round("value", 6))


@query("SELECT 1", "articles")
def p13_secrecy_rows(t):
    """The secrecy rows of the whole plan."""
    return article_scoring.secrecy_rows(_analysed(t)).withColumn("evidence", F.sha2("evidence", 256))


_FULL = (
    _SAID
    + f""", tr AS (SELECT *, NOT capable AND (words < 120 OR noisy) AS skip FROM (SELECT *, len({_in(_TEXT, CAPABILITY)}) > 0 AS capable, len({_in(_TEXT, NOISE)}) > 0 AS noisy, len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS words FROM articles)),
{_SENTENCES}, {_CLAIMS},
c2 AS (SELECT cl.*, coalesce(pct, plain) AS v, coalesce(dpct, dplain) AS d FROM cl JOIN tr USING (id) WHERE NOT skip),
ns AS (SELECT id, count(*) AS snippets FROM sn GROUP BY id),
hh AS (SELECT id, round(least(0.4, sum(CASE WHEN benchmark IS NOT NULL THEN 0.03 ELSE 0 END + CASE WHEN benchmark = 'ARC' AND v >= 25 THEN 0.15 WHEN benchmark = 'ARC' AND v >= 10 THEN 0.1 ELSE 0 END + CASE WHEN d >= 10 THEN 0.1 WHEN d >= 5 THEN 0.05 ELSE 0 END) + CASE WHEN any_value(snippets) >= 3 THEN 0.03 ELSE 0 END), 6)::DOUBLE AS h,
bool_or(benchmark IS NOT NULL) AS hb, bool_or(benchmark IS NOT NULL AND d IS NOT NULL) AS hd, any_value(snippets) >= 3 AS dense, string_agg(claim, ' ' ORDER BY rank) AS said,
array_to_string(flatten(list([CASE WHEN benchmark IS NOT NULL THEN 'benchmark' END, CASE WHEN benchmark = 'ARC' AND v >= 10 THEN 'benchmark_value' END, CASE WHEN d >= 5 THEN 'benchmark_delta' END] ORDER BY rank)), ',') AS parts FROM c2 JOIN ns USING (id) GROUP BY id),
si AS (SELECT id, source, content, 'silence' AS type, unnest({_in('content', SECRET)}) AS term, 0.7 AS confidence FROM tr WHERE NOT skip UNION ALL SELECT id, source, content, 'safety_meeting', unnest({_in('content', CAUTIOUS)}), 0.5 FROM tr WHERE NOT skip UNION ALL SELECT id, source, content, 'government', unnest({_in('content', STATE)}), 0.8 FROM tr WHERE NOT skip
UNION ALL SELECT id, source, content, 'departure', NULL, 0.6 FROM tr WHERE NOT skip AND contains(lower(content), 'nda') AND contains(lower(content), 'thand')),
sv AS (SELECT *, CASE WHEN type IN ('government', 'departure') OR (type = 'silence' AND contains(term, 'nda')) THEN 'high' ELSE 'medium' END AS severity, CASE type WHEN 'silence' THEN 'Secrecy-related language detected: "' || term || '"' WHEN 'safety_meeting' THEN 'Unusual caution detected: "' || term || '"' WHEN 'government' THEN 'Government involvement detected: "' || term || '"' ELSE 'Senior AI researcher departure detected' END AS description FROM si),
sg AS (SELECT id, count(*) AS signs, CASE WHEN bool_or(severity = 'high') THEN 0.1 ELSE 0.0 END AS b FROM sv GROUP BY id),
aa AS (SELECT tr.id, skip, tr.content || ' ' || coalesce(said, '') AS c, (tr.id % 101) / 100.0::DOUBLE AS m, (tr.id % 10) / 10.0::DOUBLE AS conf, CASE tr.id % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS prior, tr.id % 4 AS own, coalesce(h, 0) AS h, coalesce(hb, false) AS hb, coalesce(hd, false) AS hd, coalesce(dense, false) AS dense, coalesce(parts, '') AS parts, coalesce(b, 0) AS b, coalesce(signs, 0) AS signs,
tr.id % 3 <> 2 AS asked, tr.id % 3 = 0 AND EXISTS (SELECT 1 FROM articles r WHERE lower(r.source) = 'src' || (tr.id % 30)) AS known FROM tr LEFT JOIN hh USING (id) LEFT JOIN sg USING (id)),
ab AS (SELECT *, CASE WHEN asked AND NOT known THEN 0.15 ELSE 0 END AS p, CASE WHEN asked AND known THEN 'same_source' ELSE 'none' END AS support, list_filter([CASE WHEN hb THEN 'benchmark' END, {", ".join(f"CASE WHEN regexp_matches(c, '(?i){'|'.join(p)}') THEN '{k}' END" for k, p in assessment.CLAIM_TYPES.items())}], lambda x: x IS NOT NULL) AS ty FROM aa),
ac AS (SELECT *, round(greatest(0, least(1, greatest(m, m * 0.85 + h * 0.15) + b - p)), 6)::DOUBLE AS s, round(least(1, greatest(0, m * 0.35 + h * 0.25 + b + least(0.2, greatest(0, len(ty) - 1) * 0.04) + CASE WHEN list_contains(ty, 'security') THEN 0.08 ELSE 0 END + CASE WHEN list_contains(ty, 'asi') THEN 0.1 ELSE 0 END)), 9) AS w FROM ab),
ad AS (SELECT *, {SEVERITY_SQL.format('s')} AS now FROM ac),
ae AS (SELECT *, CASE WHEN prior IS NULL OR list_position({_list(lexicons.SEVERITIES)}, now) >= list_position({_list(lexicons.SEVERITIES)}, prior) THEN now ELSE prior END AS raised FROM ad),
an AS (SELECT id, skip AS filtered, CASE WHEN skip THEN 0.05 ELSE s END::DOUBLE AS score, CASE WHEN skip THEN 0.9 ELSE conf END::DOUBLE AS confidence, CASE WHEN skip THEN 'low' WHEN raised = 'critical' AND NOT hd THEN 'high' ELSE raised END AS severity, CASE WHEN skip THEN 0 ELSE h END::DOUBLE AS heuristic, CASE WHEN skip THEN 0 ELSE m END::DOUBLE AS model, CASE WHEN skip THEN 0 ELSE own + signs END::BIGINT AS indicators, false AS requires_verification,
CASE WHEN skip THEN '' ELSE concat_ws(',', nullif(parts, ''), CASE WHEN dense THEN 'multiple_evidence' END, CASE WHEN b > 0 THEN 'secrecy' END, CASE WHEN p > 0 THEN 'corroboration_penalty' END) END AS signals,
CASE WHEN skip THEN NULL WHEN w >= 0.75 THEN 'critical' WHEN w >= 0.5 THEN 'high' WHEN w >= 0.25 THEN 'medium' ELSE 'low' END AS priority,
CASE WHEN skip THEN NULL WHEN regexp_matches(c, '(?i)sustained|in production|deployed across|enterprise rollout') THEN 'sustained_in_deployment' WHEN hd OR regexp_matches(c, '(?i)demo|demonstrat|paper|code|open[- ]source|verified') THEN 'demonstrated' WHEN regexp_matches(c, '(?i)claim|announce|report|says|states') THEN 'claimed' ELSE 'mentioned' END AS ladder,
CASE WHEN skip THEN NULL ELSE array_to_string(CASE WHEN len(ty) > 0 THEN ty ELSE ['benchmark'] END, ',') END AS types FROM ae)"""
)
ORACLE_SQL["p13_analyses"] = _FULL + " SELECT * EXCLUDE (model) FROM an"
ORACLE_SQL["p13_metric_rows"] = _FULL + " SELECT id, unnest(['score', 'model_score', 'heuristic_score', 'confidence', 'indicator_count']) AS metric, round(unnest([score, model, heuristic, confidence, indicators::DOUBLE]), 6) AS value FROM an"
ORACLE_SQL["p13_secrecy_rows"] = _FULL + """ SELECT id, source, type, severity, confidence::DOUBLE AS confidence, sha256(CASE WHEN type = 'departure' THEN substr(content, 1, 200) ELSE '...' || substr(content, greatest(1, instr(lower(content), term) - 50), instr(lower(content), term) + length(term) + 50 - greatest(1, instr(lower(content), term) - 50)) || '...' END) AS evidence, description FROM sv"""

#: Phrases of each kind of claim, which the texts of the tables lack.
PHRASES = ("autonomous agent", "zero-shot transfer", "recursive self-improving", "a new experiment", "enterprise workflow", "classified briefing", "export control policy", "phishing exploit", "beyond human", "nothing")
_KINDS = ", ".join(["CASE WHEN id % 2 = 0 THEN 'benchmark' END"] + [f"CASE WHEN regexp_matches(c, '(?i){'|'.join(p)}') THEN '{k}' END" for k, p in assessment.CLAIM_TYPES.items()])
STATUSES, SUPPORTS = tuple(assessment.SOURCE_STATUS), (*assessment.CORROBORATION, "none")
_ASSESSED = f"""(SELECT *, round(least(1, greatest(0, m * 0.35 + h * 0.25 + source_w * 0.15 + support_w * 0.2 + several - CASE WHEN status IN {assessment.STALE} THEN 0.2 ELSE 0 END - CASE WHEN len(ty) = 1 AND ty[1] = 'benchmark' AND support_w < 0.7 THEN 0.15 ELSE 0 END)), 9) AS e,
round(least(1, greatest(0, m * 0.35 + h * 0.25 + 0.1 + several + CASE WHEN list_contains(ty, 'security') THEN 0.08 ELSE 0 END + CASE WHEN list_contains(ty, 'asi') THEN 0.1 ELSE 0 END)), 9) AS w FROM (
SELECT *, least(0.2, greatest(0, len(ty) - 1) * 0.04) AS several, {_list(STATUSES)}[(id // 7) % {len(STATUSES)} + 1] AS status, {_list(SUPPORTS)}[(id // 3) % {len(SUPPORTS)} + 1] AS support, ({list(assessment.SOURCE_STATUS.values())}::DOUBLE[])[(id // 7) % {len(STATUSES)} + 1] AS source_w, ({[*assessment.CORROBORATION.values(), 0.0]}::DOUBLE[])[(id // 3) % {len(SUPPORTS)} + 1] AS support_w FROM (
SELECT id, (id % 101) / 100.0::DOUBLE AS m, (id % 5) / 10.0::DOUBLE AS h, list_filter([{_KINDS}], lambda x: x IS NOT NULL) AS ty FROM (SELECT id, content || ' ' || {_list(PHRASES)}[id % 10 + 1] || ' ' || {_list(PHRASES)}[(id // 10) % 10 + 1] AS c FROM articles))))"""


def _assessed(t):
    """Articles with phrases of two kinds of claims added, assessed with the scores, states of sources and support that their ids give."""
    pick = lambda values, n: F.array(*map(F.lit, values))[(n % len(values)).cast("int")]
    i = F.col("id")
    c = F.concat_ws(" ", "content", pick(PHRASES, i), pick(PHRASES, F.floor(i / 10)))
    rows = t.articles().select("id", c.alias("c")).select("id", "c", assessment.claim_types(F.col("c"), i % 2 == 0).alias("types"))
    c = F.col("c")
    a = assessment.assess(c, c, (i % 101) / 100, (i % 5) / 10, F.lit(0.1), pick(STATUSES, F.floor(i / 7)), pick(SUPPORTS, F.floor(i / 3)), i % 2 == 0, F.lit(False), F.col("types"))
    return rows.select("id", a.alias("a"))


@query(f"SELECT id, CASE WHEN w >= 0.75 THEN 'critical' WHEN w >= 0.5 THEN 'high' WHEN w >= 0.25 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN e >= 0.85 THEN 'extraordinary' WHEN e >= 0.65 THEN 'strong' WHEN e >= 0.4 THEN 'moderate' WHEN e > 0 THEN 'weak' ELSE 'none' END AS confidence, array_to_string(CASE WHEN len(ty) > 0 THEN ty ELSE ['benchmark'] END, ',') AS types FROM {_ASSESSED}", "articles")
def p10_assessments(t):
    """Priority, confidence and claim types of every article."""
    return _assessed(t).select("id", "a.priority", "a.confidence", F.array_join("a.types", ",").alias("types"))


@query(f"SELECT id, e >= 0.65 AND len(list_filter(ty, lambda x: x <> 'benchmark')) >= 2 AND support IN ('independent_source', 'primary_source', 'replicated') AND status IN ('live', 'cached_fresh') AS allowed FROM {_ASSESSED}", "articles")
def p12_conclusions(t):
    """Whether strong words are allowed about each article."""
    return _assessed(t).select("id", assessment.may_conclude(F.col("a")).alias("allowed"))


@query("SELECT team, CASE WHEN score >= 0.75 THEN 'critical' WHEN score >= 0.25 THEN 'high' WHEN score >= 0.1 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN team % 2 = 0 THEN 'strong' ELSE 'weak' END AS confidence, CASE WHEN team % 2 = 0 THEN 2 ELSE 3 END::INTEGER AS limits FROM leaderboard_curr", "leaderboard_curr")
def p19_benchmark_evidence(t):
    """How much each team's result shows, by whether it is live."""
    e = assessment.benchmark_evidence(F.col("score"), F.when(F.col("team") % 2 == 0, "live").otherwise("manual_snapshot"))
    return t.leaderboard(True).select("team", e.alias("e")).select("team", "e.priority", "e.confidence", "e.limits")
