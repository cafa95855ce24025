"""More registered queries: reports over stored findings, feedback and leaderboards, claims on load, batch neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeglass.operators import aggregates as agg
from lodeglass.operators import correlations, evidence, joins, secrecy, vectors
from lodeglass.plans import validation
from lodeglass.plans.queries_relational import _r
from lodeglass.plans.queries_text import _CLAIMS, _GAPS, _SENTENCES, MARKS, METRICS, SECRET, _in
from lodeglass.sources.adapters import Tables, with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, *tables: str):
    """Registers a function of Tables under its name, with its SQL after the named logical tables."""
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        QUERIES[f.__name__].__doc__ = f.__doc__
        ORACLE_SQL[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return add


_RIGHT = "feedback_type IN ('relevant', 'critical')"


@query("SELECT benchmark, metric, round(avg(delta), 6) AS avg_delta, count(*) AS n FROM claims GROUP BY ALL ORDER BY avg_delta DESC NULLS LAST, n DESC, benchmark, metric LIMIT 10", "claims")
def a9_stored_findings(t):
    """Stored findings in their order: mean gain, then number, nulls last."""
    rows = t.claims().groupBy("benchmark", "metric").agg(_r(F.avg("delta"), "avg_delta"), F.count("*").alias("n"))
    return rows.orderBy(F.desc_nulls_last("avg_delta"), F.desc("n"), "benchmark", F.asc_nulls_last("metric")).limit(10)


@query(f"""WITH w AS (SELECT source FROM feedback GROUP BY source HAVING count(*) > 5 AND avg(({_RIGHT})::INTEGER) < 0.85 ORDER BY avg(({_RIGHT})::INTEGER), source LIMIT 1),
k AS (SELECT lower(i) AS i, count(*) AS n FROM (SELECT unnest(indicators) AS i FROM feedback JOIN analyses ON id = analysis_id WHERE feedback_type IN ('noise', 'false_positive')) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10),
c AS (SELECT avg(({_RIGHT})::INTEGER) AS c FROM feedback JOIN analyses ON id = analysis_id WHERE severity = 'critical'),
f AS (SELECT count(*) AS n, avg(({_RIGHT})::INTEGER) AS a FROM feedback)
SELECT unnest(list_filter([CASE WHEN n < 10 THEN 'Collect more feedback' END, CASE WHEN a < 0.7 THEN 'Overall accuracy is low' END, CASE WHEN (SELECT count(*) FROM k) > 0 THEN 'Terms in false alarms: ' || (SELECT string_agg(i, ', ' ORDER BY n DESC, i) FROM (SELECT * FROM k ORDER BY n DESC, i LIMIT 3)) END, CASE WHEN (SELECT source FROM w) IS NOT NULL THEN 'Source to review: ' || (SELECT source FROM w) END, CASE WHEN (SELECT c FROM c) < 0.8 THEN 'Critical alerts are too often wrong' END], lambda s: s IS NOT NULL)) AS advice FROM f""".replace("WITH w AS", "SELECT * FROM (WITH w AS", 1) + ")", "feedback", "analyses")
def a16_recommendations(t):
    """What to tune, from feedback: its accuracy, the terms of false alarms, sources, and critical alerts."""
    f, known = t.feedback(), t.analyses().select(F.col("id").alias("analysis_id"), "indicators", "severity")
    right = F.avg(F.col("feedback_type").isin("relevant", "critical").cast("double"))
    whole = f.agg(F.count("*").alias("n"), right.alias("a"))
    worst = agg.accuracy_by(f, "source", 5).filter("accuracy < 0.85").orderBy("accuracy", "source").limit(1).agg(F.max("source").alias("worst"))
    terms = f.filter(F.col("feedback_type").isin("noise", "false_positive")).join(known, "analysis_id").select(F.explode("indicators").alias("i")).groupBy(F.lower("i").alias("i")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "i").limit(10)
    terms = terms.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "i"))), lambda x: x["i"]).alias("terms"))
    critical = f.join(known.filter("severity = 'critical'"), "analysis_id").agg(right.alias("c"))
    one = whole.crossJoin(worst).crossJoin(terms).crossJoin(critical)
    return one.select(F.explode(agg.recommendations(F.col("n"), F.col("a"), F.col("terms"), F.col("worst"), F.col("c"))).alias("advice"))


@query("SELECT id, query_text, result_id FROM trajectories WHERE created_at > (SELECT t FROM as_of) - INTERVAL 24 HOUR", "trajectories", "as_of")
def a19_recent_trajectories(t):
    """The trajectories of the last day."""
    return t.trajectories().filter(F.col("created_at") > t.as_of() - F.expr("interval 24 hours")).select("id", "query_text", "result_id")


@query("SELECT round(avg(s), 6) AS mean, round(max(s), 6) AS highest, count(*) AS n, sum(c)::BIGINT AS critical, round(avg(s) FILTER (k <= 7), 6) AS recent FROM (SELECT avg(score) AS s, count(*) FILTER (severity = 'critical') AS c, row_number() OVER (ORDER BY date_trunc('day', ts) DESC) AS k FROM analyses GROUP BY date_trunc('day', ts) ORDER BY date_trunc('day', ts) DESC LIMIT 20)", "analyses")
def a23_trend_statistics(t):
    """Statistics of the twenty newest days and of the newest seven."""
    days = t.analyses().groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.avg("score").alias("s"), F.count_if(F.col("severity") == "critical").alias("c")).orderBy(F.desc("d")).limit(20)
    rows = days.withColumn("k", F.row_number().over(Window.orderBy(F.desc("d"))))
    return rows.agg(_r(F.avg("s"), "mean"), _r(F.max("s"), "highest"), F.count("*").alias("n"), F.sum("c").alias("critical"), _r(F.avg(F.when(F.col("k") <= 7, F.col("s"))), "recent"))


@query("SELECT round(max(score), 6) AS top, round(0.85 - max(score), 6)::DOUBLE AS gap, greatest(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS teams, CASE WHEN count(*) FILTER (side = 1) > 0 THEN 'live' ELSE 'unavailable' END AS status FROM (SELECT score, 0 AS side FROM leaderboard_prev UNION ALL SELECT score, 1 FROM leaderboard_curr)", "leaderboard_prev", "leaderboard_curr")
def a24_benchmark_summary(t):
    """Top score, gap and teams over two leaderboards."""
    both = t.leaderboard(False).withColumn("side", F.lit(0)).unionByName(t.leaderboard(True).withColumn("side", F.lit(1)))
    n = lambda k: F.count_if(F.col("side") == k)
    return both.agg(_r(F.max("score"), "top"), _r(0.85 - F.max("score"), "gap"), F.greatest(n(0), n(1)).alias("teams"), F.when(n(1) > 0, "live").otherwise("unavailable").alias("status"))


@query("""SELECT kind, severity, subject FROM (SELECT 'breakthrough' AS kind, CASE WHEN c.score - p.score > 0.1 THEN 'high' ELSE 'medium' END AS severity, c.team::VARCHAR AS subject FROM leaderboard_curr c JOIN leaderboard_prev p USING (team) WHERE c.score - p.score > 0.05
UNION ALL SELECT 'top', CASE WHEN max(score) >= 0.25 THEN 'critical' WHEN max(score) >= 0.1 THEN 'high' END, 'all' FROM leaderboard_curr HAVING max(score) >= 0.1
UNION ALL SELECT 'activity', 'medium', conv_id || '/' || turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'nda'))""", "leaderboard_curr", "leaderboard_prev")
def a25_events(t):
    """Significant events of leaderboards and discussions."""
    risen = joins.score_changes(t.leaderboard(True), t.leaderboard(False)).select(F.lit("breakthrough").alias("kind"), F.when(F.col("delta") > 0.1, "high").otherwise("medium").alias("severity"), F.col("team").cast("string").alias("subject"))
    top = t.leaderboard(True).agg(F.max("score").alias("m")).filter("m >= 0.1").select(F.lit("top").alias("kind"), F.when(F.col("m") >= 0.25, "critical").otherwise("high").alias("severity"), F.lit("all").alias("subject"))
    said = t.raw("conversations").filter((F.col("role") == "user") & F.contains(F.lower("text"), F.lit("nda"))).select(F.lit("activity").alias("kind"), F.lit("medium").alias("severity"), F.concat_ws("/", "conv_id", "turn").alias("subject"))
    return risen.unionByName(top).unionByName(said)


@query("SELECT 1", "articles")
def a26_monitoring(t):
    """Sources by class, and how many of each publish as expected, late, or not at all."""
    gaps = secrecy.publication_gaps(t.articles(), t.as_of() + F.expr("interval 3 days"), {"src0": 1, "src1": 21}, 2)
    return agg.monitoring(gaps, {"src0": "labs", "src1": "labs", "src2": "arc"})


ORACLE_SQL["a26_monitoring"] = with_tables("", "articles", "as_of") + """, g AS (SELECT source, floor((epoch((SELECT t FROM as_of) + INTERVAL 3 DAY) - epoch(max(ts))) / 86400)::BIGINT AS gap, CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 21 ELSE 2 END AS usual FROM articles GROUP BY source)
SELECT CASE WHEN source IN ('src0', 'src1') THEN 'labs' WHEN source = 'src2' THEN 'arc' ELSE 'other' END AS class, count(*) AS n, count(*) FILTER (gap <= 2 * usual) AS active, count(*) FILTER (gap > 2 * usual AND gap <= 4 * usual) AS late, count(*) FILTER (gap > 4 * usual) AS silent FROM g GROUP BY 1"""


@query("SELECT id, metric, round(value, 6)::DOUBLE AS value FROM (SELECT id, ts, unnest(['score', 'confidence']) AS metric, unnest([score, confidence]) AS value FROM analyses ORDER BY ts DESC, id, metric LIMIT 100)", "analyses")
def j7_history(t):
    """The newest hundred metric rows of analyses."""
    wide = joins.metric_rows(t.analyses(), {"score": F.col("score"), "confidence": F.col("confidence")})
    return wide.join(t.analyses().select("id"), "id").orderBy(F.desc("ts"), "id", "metric").limit(100).select("id", "metric", _r("value", "value"))


@query("SELECT 1", "articles")
def k3_claims_on_load(t):
    """Claims of articles that have none yet: those that came with them (here: titles that have a number), else those extracted."""
    rows = t.articles()
    stored = rows.filter(F.col("title").rlike("[0-9]")).select("id", F.col("title").alias("claim"))
    known = t.claims().filter("value > 45").select(F.col("crawl_id").alias("id"))
    made = evidence.claims_on_load(rows, stored, known, benchmarks=MARKS, metrics=METRICS)
    return made.select("id", "origin", F.sha2("claim", 256).alias("claim"))


ORACLE_SQL["k3_claims_on_load"] = with_tables("", "articles", "claims") + f""", {_SENTENCES}, nw AS (SELECT id, title FROM articles WHERE id NOT IN (SELECT crawl_id FROM claims WHERE value > 45))
SELECT id, 'stored' AS origin, sha256(title) AS claim FROM nw WHERE regexp_matches(title, '[0-9]') UNION ALL SELECT sn.id, 'extracted', sha256(s) FROM sn JOIN nw USING (id) WHERE rank <= 4 AND NOT regexp_matches(title, '[0-9]')"""


@query("SELECT 1", "articles")
def e10_evidence_backfill(t):
    """How many of the newest two hundred articles without a strong claim are processed, and how many claims that inserts."""
    known = t.claims().filter("value > 45").select(F.col("crawl_id").alias("id"))
    return evidence.backfill(t.articles(), known, 200, benchmarks=MARKS, metrics=METRICS)[1]


ORACLE_SQL["e10_evidence_backfill"] = with_tables("", "articles", "claims") + f""", {_SENTENCES}, nw AS (SELECT id FROM articles WHERE id NOT IN (SELECT crawl_id FROM claims WHERE value > 45) ORDER BY ts DESC, id LIMIT 200)
SELECT (SELECT count(*) FROM nw) AS processed, (SELECT count(*) FROM sn JOIN nw USING (id) WHERE rank <= 4) AS inserted"""


@query("SELECT 1", "articles")
def e11_merged_claims(t):
    """Claims of articles, and of translated snippets (here: made of their titles) after them, by benchmark, metric and unit."""
    rows = t.articles()
    native = evidence.claims(evidence.snippets(rows, benchmarks=tuple(MARKS)), MARKS, METRICS)
    translated = rows.select("id", F.lit(1).alias("rank"), F.concat(F.lit("gain of "), F.col("id") % 40, F.lit("% in "), "title").alias("snippet"))
    made = evidence.merged_claims(native, translated, MARKS, METRICS)
    return made.groupBy("benchmark", "metric", "unit").agg(F.count("*").alias("n"), F.round(F.sum("delta"), 6).alias("delta"), F.count_if(F.size("tags") == 0).alias("without_tags"))


ORACLE_SQL["e11_merged_claims"] = with_tables("", "articles") + f""", {_SENTENCES}, {_CLAIMS}, tr AS (SELECT id, 'gain of ' || (id % 40) || '% in ' || title AS s FROM articles),
al AS (SELECT benchmark, metric, CASE WHEN dpct IS NOT NULL OR pct IS NOT NULL THEN '%' END AS unit, coalesce(dpct, dplain) AS delta, len(tags) + CASE WHEN regexp_matches(claim, '[0-9%]') THEN 1 ELSE 0 END AS tags FROM cl UNION ALL SELECT CASE WHEN contains(lower(s), 'arc') THEN 'ARC' WHEN contains(lower(s), 'erth') THEN 'ERTH' WHEN contains(lower(s), 'onth') THEN 'ONTH' END, CASE WHEN contains(lower(s), 'em') THEN 'em' WHEN contains(lower(s), 'tion') THEN 'tion' END, '%', (id % 40)::DOUBLE, 0 FROM tr)
SELECT benchmark, metric, unit, count(*) AS n, round(sum(delta), 6) AS delta, count(*) FILTER (tags = 0) AS without_tags FROM al GROUP BY ALL"""


@query("SELECT 1", "articles")
def k7_secrecy_articles(t):
    """Signs of secrecy as article rows: a summary, and an alert for each grave one."""
    rows = t.articles()
    found = secrecy.hits(rows, SECRET, (), ()).unionByName(secrecy.departures(rows, ("nda",), ("thand",)))
    risks = secrecy.risk(found, secrecy.publication_gaps(rows, t.as_of() + F.expr("interval 30 days"), {"src0": 1, "src1": 21}))
    return secrecy.finding_articles(found.join(rows.select("id", "source"), "id"), risks)


ORACLE_SQL["k7_secrecy_articles"] = with_tables("", "articles", "as_of") + f""", x AS (SELECT id, source, 'silence' AS type, term, CASE WHEN contains(term, 'nda') THEN 'high' ELSE 'medium' END AS severity, 70 AS c, 'Secrecy-related language detected: "' || term || '"' AS d, '...' || substr(content, greatest(1, instr(lower(content), term) - 50), instr(lower(content), term) + length(term) + 50 - greatest(1, instr(lower(content), term) - 50)) || '...' AS e FROM (SELECT *, unnest({_in('content', SECRET)}) AS term FROM articles)
UNION ALL SELECT id, source, 'departure', NULL, 'high', 60, 'Senior AI researcher departure detected', substr(content, 1, 200) FROM articles WHERE contains(lower(content), 'nda') AND contains(lower(content), 'thand')),
g AS ({_GAPS}), a AS (SELECT count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) AS n, (SELECT count(*) FILTER (gap_days > 2 * expected_days) FROM g) AS late FROM x)
SELECT 'Secrecy Pattern Analysis: ' || CASE WHEN c > 0 OR (h >= 3 AND late >= 2) THEN 'CRITICAL' WHEN h >= 2 OR (h >= 1 AND late >= 2) THEN 'HIGH' WHEN h >= 1 OR late >= 2 OR n >= 5 THEN 'MEDIUM' ELSE 'LOW' END || ' Risk' AS title, 'Secrecy analysis: ' || n || ' indicators, ' || late || ' late sources. ' || coalesce((SELECT string_agg(type || ': ' || d, '. ' ORDER BY id, type, term) FROM (SELECT * FROM x ORDER BY id, type, term LIMIT 5)), '') AS content, 'Secrecy Pattern Detection' AS source, 'secrecy_analysis' AS kind FROM a WHERE n > 0 OR late > 0
UNION ALL SELECT 'Secrecy Alert: ' || d, upper(type) || ' indicator detected at ' || source || '. Evidence: ' || e || '. Confidence: ' || c || '%', 'Secrecy Pattern Detection', 'secrecy_indicator' FROM x WHERE severity IN ('critical', 'high')"""


@query("SELECT id, CASE WHEN severity NOT IN ('high', 'critical') THEN 0 WHEN EXISTS (SELECT 1 FROM articles r WHERE lower(r.source) = lower('SRC' || (a.id % 30))) THEN 0 ELSE 0.15 END::DOUBLE AS penalty FROM analyses a", "analyses", "articles")
def p9_corroboration_penalty(t):
    """The penalty of analyses none of whose references is a known source; those without references (here: lesser ones) have none."""
    ref = F.when(F.col("severity").isin("high", "critical"), F.concat(F.lit("SRC"), F.col("id") % 30))
    found = joins.corroborated(t.analyses().select("id", ref.alias("ref")), t.articles()).groupBy("id").agg(F.bool_or("found").alias("any"), F.count("ref").alias("refs"))
    return found.select("id", F.when((F.col("refs") == 0) | F.col("any"), 0.0).otherwise(0.15).alias("penalty"))


@query("""WITH m AS (SELECT id, list_sort(list('[SECRECY] ' || d)) AS more FROM (SELECT id, 'Secrecy-related language detected: "' || unnest(""" + _in("content", SECRET) + """) || '"' AS d FROM articles UNION ALL SELECT id, 'Senior AI researcher departure detected' FROM articles WHERE contains(lower(content), 'nda') AND contains(lower(content), 'thand')) GROUP BY id)
SELECT a.id, array_to_string(list_concat(indicators, coalesce(more, [])), ',') AS merged FROM analyses a LEFT JOIN m ON m.id = a.crawl_id""", "articles", "analyses")
def d9_merged_indicators(t):
    """Indicators of analyses, with those of secrecy in their articles after them."""
    found = secrecy.hits(t.articles(), SECRET, (), ()).unionByName(secrecy.departures(t.articles(), ("nda",), ("thand",)))
    return secrecy.merged_indicators(t.analyses(), found).select("id", F.array_join("indicators", ",").alias("merged"))


@query("SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, term FROM (SELECT id, ts, unnest(" + _in("content", SECRET) + ") AS term FROM articles) WHERE ts >= (SELECT t FROM as_of) - INTERVAL 7 DAY", "articles", "as_of")
def d10_recent_patterns(t):
    """Signs of secrecy in articles of the last seven days."""
    found = secrecy.recent(secrecy.hits(t.articles(), SECRET, (), ()), t.articles(), t.as_of())
    return found.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "term")


@query("SELECT id, CASE WHEN regexp_matches(content, '(?i)sustained|in production|deployed across|enterprise rollout') THEN 'sustained_in_deployment' WHEN id % 3 = 0 THEN 'independently_corroborated' WHEN regexp_matches(content, '(?i)demo|demonstrat|paper|code|open[- ]source|verified') THEN 'demonstrated' WHEN regexp_matches(content, '(?i)claim|announce|report|says|states') THEN 'claimed' ELSE 'mentioned' END AS ladder FROM articles", "articles")
def p11_ladders(t):
    """How far each article's claim has come."""
    from lodeglass.functions.assessment import ladder

    return t.articles().select("id", ladder(F.col("content"), F.when(F.col("id") % 3 == 0, "primary_source").otherwise("none"), F.lit(False)).alias("ladder"))


_UNITS = "q AS (SELECT id, embedding::DOUBLE[] AS e FROM vectors WHERE id % 100 = 0)"


@query("SELECT 1", "vectors")
def v2_batch_neighbours(t):
    """The three nearest to each vector whose id is divisible by 100."""
    return vectors.nearest_to_each(t.vectors(), t.vectors().filter("id % 100 = 0"), 3).withColumn("similarity", F.round("similarity", 6))


ORACLE_SQL["v2_batch_neighbours"] = with_tables("", "vectors") + f", {_UNITS} SELECT q.id AS query_id, v.id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 6) AS similarity FROM vectors v JOIN q ON v.id <> q.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.e) DESC, v.id) <= 3"


@query("SELECT source, count(DISTINCT lower(title)) AS titles FROM articles GROUP BY source", "articles")
def w4_u4_first_titles(t):
    """Titles of each source, each once whatever its case."""
    n = F.row_number().over(Window.partitionBy("source", F.lower("title")).orderBy("ts", "id"))
    return t.articles().select("source", "title", "ts", "id").withColumn("n", n).filter("n = 1").groupBy("source").agg(F.count("*").alias("titles"))


@query("SELECT severity, count(*) AS n FROM (SELECT severity FROM analyses UNION ALL SELECT CASE WHEN score >= 0.6 THEN 'high' ELSE 'low' END FROM feedback) GROUP BY severity", "analyses", "feedback")
def u3_bag_union(t):
    """Severities of two tables together."""
    more = t.feedback().select(F.when(F.col("score") >= 0.6, "high").otherwise("low").alias("severity"))
    return t.analyses().select("severity").unionByName(more).groupBy("severity").agg(F.count("*").alias("n"))


@query("""SELECT name, detail, round(value, 6)::DOUBLE AS value, count(*) AS n FROM (SELECT 'benchmark' AS name, benchmark AS detail, 0.03 AS value FROM claims WHERE benchmark <> '' UNION ALL SELECT 'benchmark_delta', (round(delta)::INTEGER)::VARCHAR, CASE WHEN delta >= 10 THEN 0.1 ELSE 0.05 END FROM claims WHERE delta >= 5
UNION ALL SELECT 'generalization', 'generalization', 0.04 FROM claims WHERE unit = '%' AND value > 49) GROUP BY ALL""", "claims")
def p2_signals(t):
    """The named parts of claims' points, by name and detail."""
    rows = t.claims().select(F.col("crawl_id").alias("id"), "benchmark", "value", "delta", F.when(F.col("value") > 49, F.array(F.lit("generalization"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    found = evidence.signals(rows)
    detail = F.when(F.col("name") == "benchmark_delta", F.round(F.col("detail").try_cast("double")).cast("int").cast("string")).otherwise(F.col("detail"))
    return found.groupBy("name", detail.alias("detail"), F.round("value", 6).alias("value")).agg(F.count("*").alias("n"))


_ANCHOR, _BARE = """'(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'""", "trim(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_CHROME = "regexp_replace(html, '(?is)<nav\\b.*?</nav>|<footer\\b.*?</footer>|<header\\b.*?</header>', ' ', 'g')"
_LINKS = f"SELECT page_id, url AS page, unnest(regexp_extract_all({{0}}, {_ANCHOR}, 1)) AS href, unnest(list_transform(regexp_extract_all({{0}}, {_ANCHOR}, 2), lambda x: {_BARE.format('x')})) AS title, unnest(range(len(regexp_extract_all({{0}}, {_ANCHOR}, 1)))) AS pos FROM pages"


@query(
    f"""WITH a AS ({_LINKS.format(_CHROME)}), b AS ({_LINKS.format('html')}),
c AS (SELECT page_id, url AS page, unnest(regexp_extract_all(html, '(?is)<(?:article|li)\\b[^>]*>(.*?)</(?:article|li)>', 1)) AS blk, unnest(range(len(regexp_extract_all(html, '(?is)<(?:article|li)\\b[^>]*>(.*?)</(?:article|li)>', 1)))) AS pos FROM pages),
r AS (SELECT 1 AS p, page_id, page, regexp_extract(blk, {_ANCHOR}, 1) AS href, {_BARE.format(f'regexp_extract(blk, {_ANCHOR}, 2)')} AS title, pos, {_BARE.format('blk')} AS txt FROM c
UNION ALL SELECT 2, page_id, page, href, title, pos, NULL FROM a UNION ALL SELECT 3, page_id, page, href, title, pos, NULL FROM b UNION ALL SELECT 4, page_id, page, href, title, pos, NULL FROM a),
u AS (SELECT *, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN regexp_extract(page, '^([a-z]+://[^/?#]+)', 1) || href ELSE regexp_extract(page, '^([a-z]+://[^/?#]+)', 1) || '/' || href END AS link FROM r WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:)')),
v AS (SELECT *, regexp_extract(link, '^[a-z]+://([^/?#]+)', 1) = regexp_extract(page, '^[a-z]+://([^/?#]+)', 1) AS mine, regexp_matches(lower(title || ' ' || link), 'th') AS named, regexp_extract(link, '^[a-z]+://[^/?#]+/*([^?#]*)', 1) <> '' AS deep FROM u),
w AS (SELECT * FROM v WHERE (p = 1 AND length(txt) >= 40 AND length(title) >= 6) OR (p IN (2, 3) AND mine AND named) OR (p = 4 AND mine AND deep) QUALIFY row_number() OVER (PARTITION BY page_id, p, link ORDER BY pos) = 1),
x AS (SELECT * FROM w QUALIFY p = min(p) OVER (PARTITION BY page_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, link) AS n FROM x)
SELECT page_id, p::INTEGER AS pass, pos::INTEGER AS pos, link AS url FROM y WHERE n <= CASE WHEN p = 4 THEN 10 ELSE 20 END"""
)
def s6_discovered_links(t):
    """Links that look like articles, by the first pass that finds any."""
    from lodeglass.sources.landed import discovered

    return discovered(t.raw("pages"), "th").drop("title")


@query("SELECT 1", "articles")
def v5_story_clusters(t):
    """Groups of the best twenty articles of thirty days that are close across sources."""
    found = correlations.story_clusters(t.analyses(), t.articles(), t.vectors(), t.as_of(), 30, 0.15)
    return found.select("cluster", "n", F.array_join("ids", ",").alias("ids"), F.array_join("sources", ",").alias("sources"), _r("similarity", "similarity"), "type")


ORACLE_SQL["v5_story_clusters"] = with_tables("", "articles", "analyses", "vectors", "as_of").replace("WITH articles", "WITH RECURSIVE articles", 1) + """, tp AS (SELECT r.id, source, embedding::DOUBLE[] AS e FROM analyses a JOIN articles r ON r.id = a.crawl_id JOIN vectors v ON v.id = r.id WHERE a.ts >= (SELECT t FROM as_of) - INTERVAL 30 DAY AND a.score >= 0.25 AND embedding IS NOT NULL ORDER BY a.score DESC, a.ts DESC, r.id LIMIT 20),
lk AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS c FROM tp x JOIN tp y ON x.id < y.id AND x.source <> y.source WHERE list_cosine_similarity(x.e, y.e) >= 0.15),
ed AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), re AS (SELECT a, a AS b FROM ed UNION SELECT re.a, ed.b FROM re JOIN ed ON ed.a = re.b),
cl AS (SELECT a AS id, min(b) AS cluster FROM re GROUP BY a)
SELECT cluster, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, (SELECT round(avg(c), 6) FROM lk JOIN cl k ON k.id = lk.a WHERE k.cluster = z.cluster) AS similarity, 'thematic_cluster' AS type FROM cl z JOIN tp USING (id) GROUP BY cluster"""


def _window_articles(t):
    return correlations.candidates(t.analyses_wide(), t.articles(), t.vectors(), t.as_of(), 20)


_NODES = """, tp AS (SELECT r.id, any_value(source) AS source, any_value(embedding)::DOUBLE[] AS e FROM analyses_wide a JOIN articles r ON r.id = a.crawl_id JOIN vectors v ON v.id = r.id WHERE a.ts >= (SELECT t FROM as_of) - INTERVAL 20 DAY AND a.score >= 0.25 AND embedding IS NOT NULL GROUP BY r.id),
nd AS (SELECT e, min(id) AS id, min(source) AS lo, max(source) AS hi FROM tp GROUP BY e),
lk AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS c FROM nd x JOIN nd y ON x.id < y.id AND (x.lo <> x.hi OR x.lo <> y.lo OR y.lo <> y.hi) WHERE list_cosine_similarity(x.e, y.e) >= {least})"""


@query("SELECT 1", "articles")
def v5_similar_pairs(t):
    """All pairs of vectors of twenty days' articles that are close across sources."""
    return correlations.links(_window_articles(t), 0.3).select("a", "b", _r("cosine", "similarity"))


ORACLE_SQL["v5_similar_pairs"] = with_tables("", "articles", "analyses_wide", "vectors", "as_of") + _NODES.format(least=0.3) + " SELECT a, b, round(c, 6) AS similarity FROM lk"


@query("SELECT 1", "articles")
def v5_stories(t):
    """The stories of all articles of twenty days, by a threshold at which most are of two or three articles."""
    return correlations.stories(_window_articles(t), 0.36)[0].withColumn("similarity", F.round("similarity", 6))


@query("SELECT 1", "articles")
def v5_story_members(t):
    """Which articles the stories of twenty days have."""
    return correlations.stories(_window_articles(t), 0.36)[1]


_STORIES = with_tables("", "articles", "analyses_wide", "vectors", "as_of").replace("WITH articles", "WITH RECURSIVE articles", 1) + _NODES.format(least=0.36) + """,
ed AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk UNION SELECT id, id FROM nd WHERE lo <> hi), re AS (SELECT a, a AS b FROM ed UNION SELECT re.a, ed.b FROM re JOIN ed ON ed.a = re.b),
cl AS (SELECT a AS id, min(b) AS cluster FROM re GROUP BY a), mb AS (SELECT cluster, tp.id, source FROM tp JOIN nd USING (e) JOIN cl ON cl.id = nd.id)"""
ORACLE_SQL["v5_story_members"] = _STORIES + " SELECT * FROM mb"
ORACLE_SQL["v5_stories"] = _STORIES + """, s AS (SELECT cluster, count(*) AS links, avg(c) AS m FROM lk JOIN cl ON cl.id = lk.a GROUP BY cluster)
SELECT cluster, count(*) AS n, count(DISTINCT source) AS n_sources, coalesce(any_value(links), 0)::BIGINT AS links, coalesce(round(any_value(m), 6), 1) AS similarity, 'thematic_cluster' AS type FROM mb LEFT JOIN s USING (cluster) GROUP BY cluster"""


@query("SELECT id, CASE WHEN grp < 5 THEN 'stored' ELSE 'computed' END AS origin, round(CASE WHEN grp < 5 THEN embedding[1] ELSE embedding[2] END::DOUBLE, 6) AS first FROM vectors", "vectors")
def v4_merged_embeddings(t):
    """Stored embeddings with those computed for what lacks one: here, vectors of groups from five on, whose computed embedding begins with their second component."""
    rows = t.vectors()
    stored = rows.filter("grp < 5").select("id", "embedding", F.lit("stored").alias("origin"))
    missing = rows.select("id", "embedding").join(stored.select("id"), "id", "left_anti")
    computed = missing.select("id", F.slice("embedding", 2, 63).alias("embedding"), F.lit("computed").alias("origin"))
    return joins.upsert(stored, computed, ["id"], ()).select("id", "origin", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


def _to_check(t):
    """Analyses with the references that their ids give, and a part of a validation's reply."""
    i = F.col("id")
    refs = F.when(i % 3 == 0, F.array(F.lit("SRC1"), F.lit("nobody"))).when(i % 3 == 1, F.array(F.concat(F.lit("rc"), i % 40))).otherwise(F.array().cast("array<string>"))
    rows = t.analyses().withColumns({"refs": refs, "model_score": F.col("confidence"), "heuristic": F.lit(0.1), "boost": F.when(i % 5 == 0, 0.1).otherwise(0.0), "has_delta": i % 2 == 0})
    said = F.when(i % 6 == 0, "investigate").when(i % 6 == 1, "lower").when(i % 6 == 2, "dismiss").when(i % 6 == 3, "hold").when(i % 6 == 4, "raise")
    return rows, t.analyses().select("id", F.when(i % 4 != 0, F.col("confidence")).alias("validated_score"), said.alias("recommendation"), (i % 2 == 0).alias("agrees"), F.array(F.lit("k1"), F.lit("new"), F.lit("new")).alias("indicators"))


def _checked(t, rows):
    sources = t.articles().select("source").distinct().withColumn("place", F.row_number().over(Window.orderBy("source")))
    return validation.checked_references(rows.select("id", F.explode("refs").alias("ref")), sources, t.articles(), ("nda", "erth"))


_REFS = "CASE id % 3 WHEN 0 THEN ['SRC1', 'nobody'] WHEN 1 THEN ['rc' || (id % 40)] ELSE [] END"
_CHECKED = f"""rf AS (SELECT id, unnest({_REFS}) AS ref FROM analyses), rr AS (SELECT DISTINCT ref FROM rf), so AS (SELECT DISTINCT source FROM articles), ma AS (SELECT ref, (SELECT min(source) FROM so WHERE contains(lower(so.source), lower(ref))) AS source FROM rr),
ab AS (SELECT id, source, title FROM articles WHERE contains(lower(content), 'nda') OR contains(lower(content), 'erth')), ct AS (SELECT source, count(*) AS n, array_to_string(list(title ORDER BY id)[1:3], '|') AS titles FROM ab GROUP BY source),
ck AS (SELECT rf.id, rf.ref, ma.source, coalesce(n, 0) > 0 AS found, coalesce(n, 0) AS article_count, coalesce(titles, '') AS titles FROM rf JOIN ma USING (ref) LEFT JOIN ct ON ct.source = ma.source WHERE ma.source IS NOT NULL)"""


@query("SELECT 1", "articles")
def j11_checked_references(t):
    """The references of analyses: the first source whose name contains each, how many of its articles mention a topic, and three titles."""
    found = _checked(t, _to_check(t)[0])
    return found.select("id", "ref", "source", "found", "article_count", F.array_join("titles", "|").alias("titles"))


ORACLE_SQL["j11_checked_references"] = with_tables("", "articles", "analyses") + ", " + _CHECKED + " SELECT * FROM ck"


@query("SELECT 1", "articles")
def p14_validations(t):
    """Analyses after validations of every kind: scores, confidences, severities, indicators and corroboration."""
    rows, said = _to_check(t)
    found = validation.validated(rows, said, _checked(t, rows))
    return found.select("id", "score", _r("confidence", "confidence"), "severity", F.array_join("indicators", ",").alias("indicators"), "penalty", "corroboration", "requires_verification")


ORACLE_SQL["p14_validations"] = with_tables("", "articles", "analyses") + ", " + _CHECKED + """, bo AS (SELECT id, bool_or(found) AS b FROM ck GROUP BY id),
v AS (SELECT a.id, a.score AS s, confidence AS conf, indicators, severity IN ('high', 'critical') AS grave, a.id % 3 <> 2 AS refs, coalesce(b, false) AND severity IN ('high', 'critical') AS borne, CASE a.id % 6 WHEN 0 THEN 'investigate' WHEN 1 THEN 'lower' WHEN 2 THEN 'dismiss' WHEN 3 THEN 'hold' WHEN 4 THEN 'raise' ELSE 'investigate' END AS rec, a.id % 2 = 0 AS agrees, CASE WHEN a.id % 5 = 0 THEN 0.1 ELSE 0 END AS boost FROM analyses a LEFT JOIN bo USING (id)),
w AS (SELECT *, CASE WHEN grave AND refs AND NOT borne THEN 0.2 ELSE 0 END::DOUBLE AS p, greatest(0, least(1, conf)) AS m FROM v),
x AS (SELECT *, greatest(0, least(1, greatest(m, m * 0.85 + 0.1 * 0.15) + boost - p)) AS c FROM w),
y AS (SELECT *, round(greatest(0, least(1, CASE rec WHEN 'investigate' THEN least(greatest(s, c), greatest(0.35, s)) WHEN 'lower' THEN least(greatest(0, s - 0.1 - p), c) WHEN 'dismiss' THEN least(0.2, c) WHEN 'hold' THEN greatest(0, s - p) ELSE c END)), 6)::DOUBLE AS ns FROM x),
z AS (SELECT *, CASE WHEN ns >= 0.8 AND NOT agrees THEN 'high' WHEN ns >= 0.8 THEN 'critical' WHEN ns >= 0.6 THEN 'high' WHEN ns >= 0.3 THEN 'medium' WHEN ns > 0 THEN 'low' ELSE 'none' END AS sv FROM y)
SELECT id, ns AS score, round(CASE WHEN rec IN ('dismiss', 'lower') THEN greatest(0, conf - 0.1) ELSE least(1, conf + CASE WHEN agrees THEN 0.2 ELSE 0.1 END) END, 6)::DOUBLE AS confidence, CASE WHEN rec = 'dismiss' AND sv IN ('high', 'critical') THEN 'medium' ELSE sv END AS severity,
array_to_string(list_concat(indicators, list_filter(['k1', 'new'], lambda k: NOT list_contains(indicators, k))), ',') AS indicators, p AS penalty, CASE WHEN borne THEN 'independent_source' WHEN refs THEN 'same_source' ELSE 'none' END AS corroboration, false AS requires_verification FROM z"""


@query("""WITH d AS (SELECT 'ARC-AGI GitHub: ' || l_shipmode AS title, 'Discussion by u' || l_suppkey || ' in ARC-AGI-2 repository: ' || l_comment2 || '. Category: general. ' || l_linenumber || ' comments.' AS content, 'ARC GitHub Discussions' AS source, 'discussion' AS kind FROM (SELECT *, l_returnflag AS l_shipmode, l_linestatus AS l_comment2 FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5)),
r AS (SELECT 'ARC-AGI Release: v' || o_orderkey, 'New release t' || o_orderkey || ' published by c' || o_custkey || ': ' || o_orderpriority, 'ARC GitHub Releases', 'release' FROM orders),
p AS (SELECT 'ARC Implementation: ' || p_name, 'Community ARC-AGI implementation: ' || p_brand || '. Language: ' || CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE 'L' || (p_partkey % 3) END || '. Stars: ' || p_partkey || '. This repository may contain novel approaches to the ARC-AGI challenge.', 'ARC GitHub Implementations', 'implementation' FROM part ORDER BY p_partkey DESC LIMIT 10)
SELECT * FROM d UNION ALL SELECT * FROM r UNION ALL SELECT * FROM p""")
def k7_activity_articles(t):
    """Lines, orders and parts read as discussions, releases and repositories, as article rows."""
    lines = t.raw("lineitem").select(F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("body"), F.lit("general").alias("category"), F.concat(F.lit("u"), "l_suppkey").alias("author"), F.col("l_linenumber").cast("bigint").alias("comments"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("place"))
    orders = t.raw("orders").select(F.concat(F.lit("v"), "o_orderkey").alias("name"), F.concat(F.lit("t"), "o_orderkey").alias("tag"), F.col("o_orderpriority").alias("body"), F.concat(F.lit("c"), "o_custkey").alias("author"))
    parts = t.raw("part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("description"), F.col("p_partkey").cast("bigint").alias("stars"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("L"), F.col("p_partkey") % 3)).alias("language"))
    return validation.activity_articles(lines, orders, parts)
