"""Registered queries of sources, sinks, joins, aggregates, windows, sorts and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeglass.functions import scoring
from lodeglass.operators import aggregates as agg
from lodeglass.operators import joins, vectors
from lodeglass.sources.adapters import Tables, with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Registers a function of Tables under its name, with its SQL after the named logical tables."""
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return add


def _r(c, name: str):
    return F.round(c, 6).alias(name)


def _day(c: str, name: str):
    return F.date_format(c, "yyyy-MM-dd").alias(name)


# Sources.


@query("SELECT id, source, title, url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM articles ORDER BY ts DESC, id LIMIT 100", "articles")
def s1_newest_articles(t):
    """The newest hundred articles, without their content."""
    return t.articles().orderBy(F.desc("ts"), "id").limit(100).select("id", "source", "title", "url", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


_CANDIDATES = "SELECT 'src' || (page_id % 20) AS source, (page_id // 20) % 3 AS strategy_rank, page_id FROM pages"


@query(f"SELECT source, strategy_rank, page_id FROM ({_CANDIDATES}) QUALIFY strategy_rank = min(strategy_rank) OVER (PARTITION BY source)")
def s11_strategy_cascade(t):
    """Each source's rows of the first strategy that found any."""
    rows = t.raw("pages").select(F.concat(F.lit("src"), F.col("page_id") % 20).alias("source"), (F.floor(F.col("page_id") / 20) % 3).alias("strategy_rank"), "page_id")
    return joins.first_strategy(rows)


@query("SELECT source, count(*) AS n FROM (SELECT source, title, content FROM articles UNION ALL SELECT 'pages', url, CASE WHEN page_id % 2 = 0 THEN html END FROM pages) WHERE title <> '' AND content IS NOT NULL GROUP BY source", "articles")
def s12_union_of_sources(t):
    """Articles and pages as one table, without rows that lack title or content, by source."""
    pages = t.raw("pages").select(F.lit("pages").alias("source"), F.col("url").alias("title"), F.when(F.col("page_id") % 2 == 0, F.col("html")).alias("content"))
    both = t.articles().select("source", "title", "content").unionByName(pages, allowMissingColumns=True)
    return both.filter("title <> '' and content is not null").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT CASE source WHEN 'src0' THEN 'research' WHEN 'src1' THEN 'news' ELSE 'other' END AS grp, count(*) AS n FROM articles GROUP BY 1", "articles")
def s13_source_groups(t):
    """Articles by the group of their source."""
    groups = t.spark.createDataFrame([("src0", "research"), ("src1", "news")], "source string, grp string")
    return t.articles().join(groups, "source", "left").groupBy(F.coalesce("grp", F.lit("other")).alias("grp")).agg(F.count("*").alias("n"))


_ANCHORS = r"""SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>', 1), 1) - 1 AS pos FROM pages"""


@query(f"SELECT page_id, pos::INTEGER AS pos, href FROM ({_ANCHORS}) QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1")
def s6_links(t):
    """The distinct links of every page, by first occurrence."""
    rows = t.raw("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a[^>]*href="([^"]*)"[^>]*>'), F.lit(1))).alias("pos", "href"))
    return rows.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))


# Sinks.


@query("""SELECT coalesce(u.bucket, o.bucket) AS bucket, round(coalesce(u.avg_score, o.avg_score), 6)::DOUBLE AS avg_score, coalesce(o.created, u.created) AS created FROM
(SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, avg(score) AS avg_score, 'old' AS created FROM analyses WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1) o
FULL JOIN (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, avg(score) + 1 AS avg_score, 'new' AS created FROM analyses WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1) u ON o.bucket = u.bucket""", "analyses")
def k1_upsert(t):
    """Daily means, some of them replaced by newer ones."""
    days = lambda rows, extra, created: rows.groupBy(_day("ts", "bucket")).agg((F.avg("score") + extra).alias("avg_score")).withColumn("created", F.lit(created))
    old, new = days(t.analyses().filter("ts < '2024-01-20'"), 0, "old"), days(t.analyses().filter("ts >= '2024-01-10'"), 1, "new")
    return joins.upsert(old, new, ["bucket"], kept=("created",)).withColumn("avg_score", F.round("avg_score", 6))


@query("SELECT crawl_id, benchmark, min(value) AS value FROM claims WHERE value >= 25 AND (crawl_id, benchmark) NOT IN (SELECT (crawl_id, benchmark) FROM claims WHERE value < 5) GROUP BY crawl_id, benchmark", "claims")
def k2_insert_absent(t):
    """New claims whose article and benchmark are unknown, the lowest value of each."""
    c = t.claims()
    return joins.insert_absent(c.filter("value < 5"), c.filter("value >= 25").select("crawl_id", "benchmark", "value"), ["crawl_id", "benchmark"], ["value"])


@query("SELECT id, metric, round(value, 6)::DOUBLE AS value FROM (SELECT id, unnest(['score', 'confidence', 'indicator_count']) AS metric, unnest([score, confidence, len(indicators)]) AS value FROM analyses)", "analyses")
def k5_metric_rows(t):
    """A row for each of three metrics of every analysis."""
    wide = joins.metric_rows(t.analyses(), {"score": F.col("score"), "confidence": F.col("confidence"), "indicator_count": F.size("indicators")})
    return wide.select("id", "metric", _r("value", "value"))


@query("SELECT count(*) AS kept FROM trajectories WHERE created_at >= (SELECT t FROM as_of) - INTERVAL 10 DAY", "trajectories", "as_of")
def k6_retention(t):
    """How many trajectories a retention of ten days keeps."""
    return joins.retained(t.trajectories(), t.as_of(), 10).agg(F.count("*").alias("kept"))


@query("SELECT rank, team, 'Team ' || team || ' at rank ' || rank AS title FROM (SELECT team, row_number() OVER (ORDER BY score DESC, team)::INTEGER AS rank FROM leaderboard_curr) WHERE rank <= 10", "leaderboard_curr")
def k7_leaderboard_articles(t):
    """The ten best teams as article rows."""
    top = t.leaderboard(True).orderBy(F.desc("score"), "team").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "team")))
    return top.select("rank", "team", F.format_string("Team %d at rank %d", "team", "rank").alias("title"))


# Joins.


@query("SELECT a.id, r.title, round(a.score, 6) AS score FROM analyses a JOIN articles r ON r.id = a.crawl_id WHERE a.score >= 0.25", "articles", "analyses")
def j1_candidates(t):
    """Analyses over a floor with their articles."""
    return t.analyses().filter("score >= 0.25").join(t.articles().select(F.col("id").alias("crawl_id"), "title"), "crawl_id").select("id", "title", _r("score", "score"))


@query("SELECT a.id, r.url, r.url IS NOT NULL AS known FROM analyses a LEFT JOIN articles r ON r.id = a.crawl_id", "articles", "analyses")
def j2_with_articles(t):
    """All analyses, with their article where there is one."""
    rows = t.analyses().join(t.articles().select(F.col("id").alias("crawl_id"), "url"), "crawl_id", "left")
    return rows.select("id", "url", F.col("url").isNotNull().alias("known"))


@query("SELECT id FROM articles WHERE id NOT IN (SELECT crawl_id FROM analyses)", "articles", "analyses")
def j3_unanalysed(t):
    """Articles without an analysis."""
    return t.articles().select("id").join(t.analyses().select(F.col("crawl_id").alias("id")), "id", "left_anti")


@query("SELECT id FROM articles WHERE id NOT IN (SELECT crawl_id FROM claims WHERE value > 49) ORDER BY ts DESC, id LIMIT 200", "articles", "claims")
def j4_without_claims(t):
    """The newest two hundred articles without a strong claim."""
    rows = t.articles().select("id", "ts").join(t.claims().filter("value > 49").select(F.col("crawl_id").alias("id")), "id", "left_anti")
    return rows.orderBy(F.desc("ts"), "id").limit(200).select("id")


@query("SELECT a.id, length(r.title) AS n FROM analyses a JOIN articles r ON r.id = a.crawl_id WHERE a.id NOT IN (SELECT id FROM vectors WHERE id % 2 = 0)", "articles", "analyses", "vectors")
def j5_without_embeddings(t):
    """Analyses that lack an embedding, with their text's length."""
    missing = t.analyses().select("id", "crawl_id").join(t.vectors().filter("id % 2 = 0").select("id"), "id", "left_anti")
    return missing.join(t.articles().select(F.col("id").alias("crawl_id"), F.length("title").cast("bigint").alias("n")), "crawl_id").select("id", "n")


@query("SELECT source, benchmark, count(*) AS n, round(avg(delta), 6) AS mean FROM analyses a JOIN articles r ON r.id = a.crawl_id JOIN claims c ON c.crawl_id = a.crawl_id WHERE delta IS NOT NULL GROUP BY ALL", "articles", "analyses", "claims")
def j6_three_way(t):
    """Analyses, articles and claims joined, by source and benchmark."""
    rows = t.analyses().select("crawl_id").join(t.articles().select(F.col("id").alias("crawl_id"), "source"), "crawl_id").join(t.claims().filter("delta is not null"), "crawl_id")
    return rows.groupBy("source", "benchmark").agg(F.count("*").alias("n"), _r(F.avg("delta"), "mean"))


@query("SELECT analysis_id, feedback_type, round(a.score, 6) AS score, title FROM feedback f JOIN analyses a ON a.id = f.analysis_id JOIN articles r ON r.id = f.analysis_id ORDER BY f.ts DESC, analysis_id LIMIT 10", "articles", "analyses", "feedback")
def j8_recent_feedback(t):
    """The ten newest pieces of feedback with analysis and article."""
    rows = t.feedback().select("analysis_id", "feedback_type", F.col("ts").alias("at")).join(t.analyses().select(F.col("id").alias("analysis_id"), "score"), "analysis_id").join(t.articles().select(F.col("id").alias("analysis_id"), "title"), "analysis_id")
    return rows.orderBy(F.desc("at"), "analysis_id").limit(10).select("analysis_id", "feedback_type", _r("score", "score"), "title")


@query("SELECT id FROM articles WHERE id >= 500 AND url NOT IN (SELECT url FROM articles WHERE id < 500) AND sha256(content) NOT IN (SELECT sha256(content) FROM articles WHERE id < 500)", "articles")
def j9_new_articles(t):
    """Articles whose URL and content the store doesn't have."""
    rows = t.articles().select("id", "url", F.sha2("content", 256).alias("content_hash"))
    return joins.new_articles(rows.filter("id >= 500"), rows.filter("id < 500")).select("id")


@query("SELECT id, 'SRC' || (id % 30) AS ref, lower('SRC' || (id % 30)) IN (SELECT lower(source) FROM articles) AS found FROM analyses", "analyses", "articles")
def j10_corroboration(t):
    """Whether each analysis' reference is a known source."""
    return joins.corroborated(t.analyses().select("id", F.concat(F.lit("SRC"), F.col("id") % 30).alias("ref")), t.articles())


@query("SELECT ref, min(source) AS source, count(*) AS n FROM (SELECT unnest(['SRC1', 'src0', 'none']) AS ref) JOIN (SELECT DISTINCT source FROM articles) ON contains(lower(source), lower(ref)) GROUP BY ref", "articles")
def j11_substring_references(t):
    """Sources whose name contains a reference: three references against the distinct sources."""
    refs = t.spark.createDataFrame([("SRC1",), ("src0",), ("none",)], "ref string")
    rows = t.articles().select("source").distinct().join(refs, F.contains(F.lower("source"), F.lower("ref")))
    return rows.groupBy("ref").agg(F.min("source").alias("source"), F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM analyses WHERE id NOT IN (SELECT id FROM analyses WHERE score > 0.5)", "analyses")
def j13_without_metrics(t):
    """How many analyses have no metric rows yet."""
    a = t.analyses()
    return a.join(a.filter("score > 0.5").select("id"), "id", "left_anti").agg(F.count("*").alias("n"))


@query("SELECT c.team, round(c.score - p.score, 6) AS delta FROM leaderboard_curr c JOIN leaderboard_prev p USING (team) WHERE c.score - p.score > 0.05", "leaderboard_curr", "leaderboard_prev")
def j14_breakthroughs(t):
    """Teams whose score has risen by more than 0.05."""
    return joins.score_changes(t.leaderboard(True), t.leaderboard(False)).select("team", _r("delta", "delta"))


@query("SELECT r IN (SELECT id FROM articles) AS accepted, count(*) AS n FROM (SELECT CASE WHEN was_useful THEN result_id ELSE -1 - result_id END AS r FROM trajectories) GROUP BY 1", "trajectories", "articles")
def j15_guarded_insert(t):
    """Trajectories accepted and rejected by whether their result exists; useless ones name one that doesn't."""
    rows = t.trajectories().withColumn("result_id", F.when(F.col("was_useful"), F.col("result_id")).otherwise(-1 - F.col("result_id")))
    known = t.articles().select(F.col("id").alias("result_id"))
    sides = [rows.join(known, "result_id", kind).agg(F.count("*").alias("n")).select(F.lit(ok).alias("accepted"), "n") for kind, ok in (("left_semi", True), ("left_anti", False))]
    return sides[0].unionByName(sides[1]).filter("n > 0")


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS n, id, 'k' || (id % 3) AS source FROM analyses ORDER BY score DESC, id LIMIT 20), f AS (SELECT 1 AS finding, [1, 5, 9, 99] AS ix UNION ALL SELECT 2, [3, 70] UNION ALL SELECT 3, [20, 2])
SELECT finding, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT finding, unnest(ix) AS n, generate_subscripts(ix, 1) AS pos FROM f) JOIN n USING (n) GROUP BY finding HAVING count(*) >= 2""".replace("WITH n AS", "SELECT * FROM (WITH n AS", 1) + ")", "analyses")
def j16_resolved_findings(t):
    """Findings that name articles by number, with their ids and sources."""
    top = t.analyses().orderBy(F.desc("score"), "id").limit(20).withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("n", "id", F.concat(F.lit("k"), F.col("id") % 3).alias("source"))
    found = t.spark.createDataFrame([(1, [1, 5, 9, 99]), (2, [3, 70]), (3, [20, 2])], "finding int, indexes array<int>")
    return joins.resolved_findings(found, top).select("finding", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("sources", ",").alias("sources"))


@query("SELECT feedback_type IN ('relevant', 'critical') AS was_useful, count(*) AS n FROM feedback JOIN analyses ON id = analysis_id GROUP BY 1", "feedback", "analyses")
def j17_feedback_trajectories(t):
    """Feedback as trajectory rows, by usefulness."""
    rows = t.feedback().join(t.analyses().select(F.col("id").alias("analysis_id")), "analysis_id")
    return rows.groupBy(F.col("feedback_type").isin("relevant", "critical").alias("was_useful")).agg(F.count("*").alias("n"))


# Aggregates.


@query("SELECT round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical FROM analyses WHERE ts >= (SELECT t FROM as_of) - INTERVAL 7 DAY", "analyses", "as_of")
def a1_snapshot(t):
    """The last seven days in one row."""
    out = agg.snapshot(t.analyses(), t.as_of(), 7)
    return out.select(*(_r(c, c) for c in ("avg_score", "max_score", "min_score")), "total", "critical")


@query("SELECT p AS period, strftime(date_trunc(u, ts), '%Y-%m-%d') AS bucket, round(avg(score), 6) AS avg_score, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical FROM analyses, (VALUES ('daily', 'day'), ('weekly', 'week'), ('monthly', 'month')) v(p, u) GROUP BY ALL", "analyses")
def a2_a3_trend(t):
    """Daily, weekly and monthly trends in one pass."""
    out = agg.trend(t.analyses(), {"daily": "day", "weekly": "week", "monthly": "month"})
    return out.select("period", _day("bucket", "bucket"), _r("avg_score", "avg_score"), "total", "critical")


@query("SELECT coalesce(source, 'Unknown') AS source, count(*) AS n FROM (SELECT CASE WHEN id % 50 = 0 THEN NULL ELSE source END AS source FROM articles) GROUP BY 1", "articles")
def a4_by_source(t):
    """Articles by source, those without one as Unknown."""
    source = F.when(F.col("id") % 50 != 0, F.col("source"))
    return t.articles().groupBy(F.coalesce(source, F.lit("Unknown")).alias("source")).agg(F.count("*").alias("n"))


_EXPLODED = "x AS (SELECT a.ts, unnest(indicators) AS indicator, source FROM analyses_wide a JOIN articles r ON r.id = a.crawl_id)"
_COUNTS = ", ".join(f"count(*) FILTER (ts >= (SELECT t FROM as_of) - INTERVAL {d} DAY) AS cnt_{d}" for d in (5, 10, 20))


def _by_source(t):
    rows = t.analyses_wide().join(t.articles().select(F.col("id").alias("crawl_id"), "source"), "crawl_id")
    return agg.indicator_counts(rows, t.as_of(), ("source",), (5, 10, 20))


@query("SELECT 1", "articles", "analyses_wide", "as_of")
def a5_indicators_by_source(t):
    """Indicators by source in three windows, the eighty most frequent."""
    return _by_source(t).orderBy(F.desc("cnt_20"), F.desc("cnt_10"), F.desc("cnt_5"), "indicator", "source").limit(80)


ORACLE_SQL["a5_indicators_by_source"] = with_tables("", "articles", "analyses_wide", "as_of") + f", {_EXPLODED} SELECT lower(indicator) AS indicator, source, {_COUNTS} FROM x WHERE ts >= (SELECT t FROM as_of) - INTERVAL 20 DAY GROUP BY 1, 2 ORDER BY cnt_20 DESC, cnt_10 DESC, cnt_5 DESC, 1, 2 LIMIT 80"


@query(f"SELECT lower(indicator) AS indicator, {_COUNTS} FROM (SELECT ts, unnest(indicators) AS indicator FROM analyses) WHERE ts >= (SELECT t FROM as_of) - INTERVAL 20 DAY GROUP BY 1", "analyses", "as_of")
def a6_indicators(t):
    """Indicators in three windows."""
    return agg.indicator_counts(t.analyses(), t.as_of(), days=(5, 10, 20))


@query(f"SELECT {_COUNTS} FROM analyses", "analyses", "as_of")
def a7_totals(t):
    """Analyses in three windows."""
    now = t.as_of()
    return t.analyses().agg(*(F.count_if(agg.within(now, d)).alias(f"cnt_{d}") for d in (5, 10, 20)))


@query("""SELECT lower(indicator) AS indicator, benchmark, metric, count(DISTINCT analysis) AS analyses, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, round(avg(delta), 6) AS avg_delta, round(max(delta), 6) AS max_delta FROM (
SELECT a.id AS analysis, unnest(a.indicators) AS indicator, source, benchmark, metric, delta FROM analyses a JOIN articles r ON r.id = a.crawl_id JOIN claims c ON c.crawl_id = a.crawl_id WHERE delta IS NOT NULL AND a.ts >= (SELECT t FROM as_of) - INTERVAL 30 DAY) GROUP BY ALL HAVING n_sources >= 2""", "articles", "analyses", "claims", "as_of")
def a8_co_occurrence(t):
    """Indicators and benchmarks that occur together in two sources or more."""
    out = agg.co_occurrence(t.analyses(), t.articles(), t.claims(), t.as_of(), 30)
    return out.select("indicator", "benchmark", "metric", "analyses", "n_sources", F.array_join("sources", ",").alias("sources"), _r("avg_delta", "avg_delta"), _r("max_delta", "max_delta"))


@query("SELECT 1", "articles", "analyses_wide", "as_of")
def a10_fallback_insights(t):
    """Rules' insights from the indicators by source."""
    rows = _by_source(t).withColumnsRenamed({"cnt_5": "cnt_30", "cnt_10": "cnt_90", "cnt_20": "cnt_180"})
    return agg.fallback_insights(rows, 30, 6).withColumn("total", F.col("total").cast("bigint"))


ORACLE_SQL["a10_fallback_insights"] = with_tables("", "articles", "analyses_wide", "as_of") + f""", {_EXPLODED}, c AS (SELECT lower(indicator) AS indicator, source, count(*) AS n FROM x WHERE ts >= (SELECT t FROM as_of) - INTERVAL 5 DAY GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY n DESC, source) AS k FROM c)
SELECT indicator, sum(n)::BIGINT AS total, count(*) AS n_sources, string_agg(source, ', ' ORDER BY k) FILTER (k <= 3) AS sources, CASE WHEN count(*) >= 3 THEN 0.6 WHEN count(*) = 2 THEN 0.5 ELSE 0.35 END::DOUBLE AS confidence FROM r GROUP BY indicator ORDER BY total DESC, indicator LIMIT 6"""

_RIGHT = "feedback_type IN ('relevant', 'critical')"


@query(f"""SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) ELSE 0 END::DOUBLE AS f1 FROM (SELECT tp, fp, tn, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 12) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 12) AS recall, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy FROM (
SELECT count(*) FILTER ({_RIGHT} AND score >= 0.5) AS tp, count(*) FILTER (NOT {_RIGHT} AND score >= 0.5) AS fp, count(*) FILTER (NOT {_RIGHT} AND score < 0.5) AS tn, count(*) FILTER ({_RIGHT} AND score < 0.5) AS fn FROM feedback))""", "feedback")
def a11_confusion(t):
    """Counts and rates of feedback against scores at 0.5."""
    out = agg.confusion(t.feedback())
    return out.select("tp", "fp", "tn", "fn", F.round("precision", 12).alias("precision"), F.round("recall", 12).alias("recall"), "accuracy", _r("f1", "f1"))


@query("SELECT feedback_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM feedback GROUP BY feedback_type", "feedback")
def a12_feedback_shares(t):
    """Feedback by kind."""
    rows = t.feedback().groupBy("feedback_type").agg(F.count("*").alias("n"))
    return rows.crossJoin(rows.agg(F.sum("n").alias("all"))).select("feedback_type", "n", _r(100.0 * F.col("n") / F.col("all"), "percent"))


@query("SELECT lower(indicator) AS indicator, count(*) AS n FROM (SELECT unnest(indicators) AS indicator FROM feedback JOIN analyses ON id = analysis_id WHERE feedback_type IN ('noise', 'false_positive')) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10", "feedback", "analyses")
def a13_false_indicators(t):
    """The ten most frequent indicators of noise and false alarms."""
    rows = t.feedback().filter(F.col("feedback_type").isin("noise", "false_positive")).join(t.analyses().select(F.col("id").alias("analysis_id"), "indicators"), "analysis_id")
    return rows.select(F.explode("indicators").alias("i")).groupBy(F.lower("i").alias("indicator")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "indicator").limit(10)


@query(f"SELECT source, round(avg(({_RIGHT})::INTEGER), 6) AS accuracy, count(*) AS total FROM feedback GROUP BY source HAVING count(*) > 5", "feedback")
def a14_accuracy_by_source(t):
    """Accuracy of sources with more than five pieces of feedback."""
    return agg.accuracy_by(t.feedback(), "source", 5).withColumn("accuracy", F.round("accuracy", 6))


@query(f"SELECT severity, round(avg(({_RIGHT})::INTEGER), 6) AS accuracy, count(*) AS total FROM feedback JOIN (SELECT id, severity FROM analyses) ON id = analysis_id GROUP BY severity", "feedback", "analyses")
def a15_accuracy_by_severity(t):
    """Accuracy by severity."""
    rows = t.feedback().join(t.analyses().select(F.col("id").alias("analysis_id"), "severity"), "analysis_id")
    return agg.accuracy_by(rows, "severity").withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT source, count(*) AS useful FROM trajectories WHERE was_useful AND created_at > (SELECT t FROM as_of) - INTERVAL 20 DAY GROUP BY source ORDER BY useful DESC, source LIMIT 5", "trajectories", "as_of")
def a17_useful_sources(t):
    """The five sources that were most often useful."""
    rows = t.trajectories().filter(F.col("was_useful") & (F.col("created_at") > t.as_of() - F.expr("interval 20 days")))
    return rows.groupBy("source").agg(F.count("*").alias("useful")).orderBy(F.desc("useful"), "source").limit(5)


@query("""SELECT round(r, 6) AS recent, round(b, 6) AS before, CASE WHEN r - b > 0.05 THEN 'improving' WHEN r - b < -0.05 THEN 'declining' ELSE 'stable' END AS direction FROM (SELECT avg(was_useful::INTEGER) FILTER (created_at >= (SELECT t FROM as_of) - INTERVAL 7 DAY) AS r, avg(was_useful::INTEGER) FILTER (created_at < (SELECT t FROM as_of) - INTERVAL 7 DAY) AS b FROM trajectories WHERE created_at >= (SELECT t FROM as_of) - INTERVAL 14 DAY)""", "trajectories", "as_of")
def a18_direction(t):
    """Useful shares of the last two weeks."""
    return agg.direction(t.trajectories(), t.as_of()).select(_r("recent", "recent"), _r("before", "before"), "direction")


@query("SELECT name, n, strftime(a, '%Y-%m-%d') AS first, strftime(b, '%Y-%m-%d') AS last FROM (SELECT 'analyses' AS name, count(*) AS n, min(ts) AS a, max(ts) AS b FROM analyses UNION ALL SELECT 'articles', count(*), min(ts), max(ts) FROM articles UNION ALL SELECT 'jobs', count(*), min(started_at), max(started_at) FROM jobs)", "analyses", "articles", "jobs")
def a20_table_health(t):
    """Rows and time spans of three tables."""
    out = agg.table_health({"analyses": (t.analyses(), "ts"), "articles": (t.articles(), "ts"), "jobs": (t.jobs(), "started_at")})
    return out.select("name", "n", _day("first", "first"), _day("last", "last"))


@query("SELECT count(v.id) AS present, count(*) - count(v.id) AS absent, round(100.0 * count(v.id) / count(*), 6)::DOUBLE AS percent FROM analyses a LEFT JOIN vectors v USING (id)", "analyses", "vectors")
def a21_embedding_coverage(t):
    """How many analyses have an embedding."""
    rows = t.analyses().select("id").join(t.vectors().select("id", F.lit(1).alias("v")), "id", "left")
    return rows.agg(F.count("v").alias("present"), (F.count("*") - F.count("v")).alias("absent"), _r(100.0 * F.count("v") / F.count("*"), "percent"))


@query("SELECT grp, i::INTEGER AS i, round(avg(x), 9) AS m FROM (SELECT grp, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM vectors) GROUP BY grp, i", "vectors")
def a22_centroids(t):
    """The mean vector of each group, component by component."""
    return vectors.centroids(t.vectors()).select("grp", F.posexplode("centroid").alias("i", "m")).withColumn("m", F.round("m", 9))


@query("SELECT job, batch, round(avg(batch_ms) OVER (PARTITION BY job ORDER BY batch), 6) AS mean_ms, round(greatest(0, 10 - batch) * avg(batch_ms) OVER (PARTITION BY job ORDER BY batch), 6) AS eta_ms FROM job_batches", "job_batches")
def a27_w7_job_progress(t):
    """Running means of batch times and the time left."""
    out = agg.job_progress(t.jobs(), t.job_batches(), 10)
    return out.select("job", F.col("batch").cast("bigint").alias("batch"), _r("mean_ms", "mean_ms"), _r("eta_ms", "eta_ms"))


@query("SELECT CASE WHEN b > 0 THEN true ELSE false END AS verified, n, CASE WHEN n = 0 THEN 'LOW' WHEN c > 0 THEN 'HIGH' WHEN h >= 5 THEN 'MEDIUM' WHEN m < 0.3 THEN 'LOW' WHEN m < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM (SELECT count(*) AS b, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, avg(score) AS m FROM analyses WHERE id % 7 = 0 AND ts >= (SELECT t FROM as_of) - INTERVAL 30 DAY)", "analyses", "as_of")
def p20_portfolio_risk(t):
    """The risk level of the last thirty days."""
    return agg.portfolio_risk(t.analyses().withColumn("has_delta", F.col("id") % 7 == 0), t.as_of())


# Windows, sorts, sets.


@query("SELECT CASE WHEN a - b > 0.1 THEN 'increasing' WHEN a - b < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT avg(s) FILTER (k <= 5) AS a, avg(s) FILTER (k BETWEEN 6 AND 10) AS b FROM (SELECT avg(score) AS s, row_number() OVER (ORDER BY date_trunc('day', ts) DESC) AS k FROM analyses GROUP BY date_trunc('day', ts)))", "analyses")
def w1_trend_direction(t):
    """The newest five days against the five before."""
    days = t.analyses().groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.avg("score").alias("s")).orderBy(F.desc("d")).limit(10)
    k = F.row_number().over(Window.orderBy(F.desc("d")))
    both = days.withColumn("k", k).agg(F.avg(F.when(F.col("k") <= 5, F.col("s"))).alias("a"), F.avg(F.when(F.col("k") > 5, F.col("s"))).alias("b"))
    gap = F.col("a") - F.col("b")
    return both.select(F.when(gap > 0.1, "increasing").when(gap < -0.1, "decreasing").otherwise("stable").alias("trend"))


@query("SELECT strftime(d, '%Y-%m-%d') AS day, round(s - lag(s) OVER (ORDER BY d), 6) AS change FROM (SELECT date_trunc('day', ts) AS d, avg(score) AS s FROM analyses GROUP BY 1)", "analyses")
def w2_changes(t):
    """Each day's change against the one before."""
    days = t.analyses().groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.avg("score").alias("s"))
    return days.select(_day("d", "day"), _r(F.col("s") - F.lag("s").over(Window.orderBy("d")), "change"))


_COSINE = "list_cosine_similarity(v.embedding::DOUBLE[], {0})"
_OUTLIERS = "SELECT v.id, v.grp, 1 - list_cosine_similarity(v.embedding::DOUBLE[], c.c) AS distance FROM vectors v JOIN (SELECT grp, list(m ORDER BY i) AS c FROM (SELECT grp, i, avg(x) AS m FROM (SELECT grp, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM vectors WHERE score >= 0.2) GROUP BY grp, i) GROUP BY grp) c USING (grp) WHERE score >= 0.2 ORDER BY distance DESC, id LIMIT 10"


@query(f"SELECT id, grp, round(distance, 6) AS distance, CASE WHEN distance >= 0.8 THEN 'highly unusual' WHEN distance >= 0.6 THEN 'notable' WHEN distance >= 0.4 THEN 'moderate' ELSE 'minor' END AS band, round((count(*) OVER (ORDER BY distance RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) / 9.0 * 100)::INTEGER AS percentile FROM ({_OUTLIERS})", "vectors")
def v3_w3_p21_outliers(t):
    """The ten farthest vectors from their groups' centroids, with band and percentile."""
    out = vectors.percentile(vectors.outliers(t.vectors()))
    return out.select("id", "grp", _r("distance", "distance"), scoring.outlier_band(F.col("distance")).alias("band"), "percentile")


@query("SELECT source, id FROM articles QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, id) <= 3", "articles")
def w5_newest_by_source(t):
    """The three newest articles of each source."""
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("ts"), "id"))
    return t.articles().select("source", "id", "ts").withColumn("n", n).filter("n <= 3").select("source", "id")


@query("SELECT source, max_by(id, ts * 1) AS id FROM (SELECT source, id, epoch(ts) * 100000 - id AS ts FROM articles) GROUP BY source", "articles")
def w6_newest_example(t):
    """The newest article of each source."""
    return t.articles().groupBy("source").agg(F.max_by("id", F.struct("ts", -F.col("id"))).alias("id"))


@query("SELECT team, row_number() OVER (ORDER BY score DESC, team)::INTEGER AS rank FROM leaderboard_curr ORDER BY score DESC, team LIMIT 50", "leaderboard_curr")
def w8_ranks(t):
    """The fifty best teams with their ranks."""
    return t.leaderboard(True).orderBy(F.desc("score"), "team").limit(50).select("team", F.row_number().over(Window.orderBy(F.desc("score"), "team")).alias("rank"))


@query("SELECT crawl_id, metric, round(delta, 6) AS delta FROM claims ORDER BY delta DESC NULLS LAST, metric ASC NULLS LAST, crawl_id LIMIT 50", "claims")
def t1_nulls_last(t):
    """The fifty largest gains, nulls last."""
    return t.claims().select("crawl_id", "metric", "delta").orderBy(F.desc_nulls_last("delta"), F.asc_nulls_last("metric"), "crawl_id").limit(50).withColumn("delta", F.round("delta", 6))


@query(f"SELECT id, severity FROM analyses ORDER BY list_position(['none', 'low', 'medium', 'high', 'critical'], severity) DESC, ts DESC, id LIMIT 50", "analyses")  # noqa: F541
def t2_t3_most_severe(t):
    """The fifty most severe analyses, newest first."""
    return t.analyses().orderBy(F.desc(scoring.severity_rank(F.col("severity"))), F.desc("ts"), "id").limit(50).select("id", "severity")


@query("SELECT id, status FROM jobs ORDER BY status <> 'running', started_at DESC, id LIMIT 1", "jobs")
def t4_latest_job(t):
    """The newest running job, or else the newest."""
    return t.jobs().orderBy(F.col("status") != "running", F.desc("started_at"), "id").limit(1).select("id", "status")


@query("SELECT a.id, round(a.score, 6) AS score, substr(content, 1, 200) AS start FROM analyses a JOIN articles r ON r.id = a.crawl_id WHERE a.score >= 0.25 ORDER BY a.score DESC, a.ts DESC, a.id LIMIT 20", "articles", "analyses")
def t5_candidates(t):
    """The twenty best candidates with the start of their content."""
    rows = t.analyses().filter("score >= 0.25").join(t.articles().select(F.col("id").alias("crawl_id"), F.substring("content", 1, 200).alias("start")), "crawl_id")
    return rows.orderBy(F.desc("score"), F.desc("ts"), "id").limit(20).select("id", _r("score", "score"), "start")


@query("SELECT source, title, count(*) AS n FROM snapshot_prev WHERE (source, title) NOT IN (SELECT (source, title) FROM snapshot_curr) GROUP BY ALL", "snapshot_prev", "snapshot_curr")
def u1_removed_titles(t):
    """Titles that are gone, as often as they were there."""
    return t.snapshot(False).join(t.snapshot(True), ["source", "title"], "left_anti").groupBy("source", "title").agg(F.count("*").alias("n"))


@query("SELECT id, array_to_string(CASE WHEN indicators[1] = 'view' THEN ['view', indicators[2], 'x'] ELSE [indicators[1], indicators[2], 'view', 'x'] END, ',') AS merged FROM analyses", "analyses")
def u2_array_union(t):
    """Indicators with more of them, each once, in order."""
    return t.analyses().select("id", F.array_join(F.array_union("indicators", F.array(F.lit("view"), F.lit("x"))), ",").alias("merged"))


_Q0 = "(SELECT embedding::DOUBLE[] FROM vectors WHERE id = 0)"


@query(f"SELECT id, round({_COSINE.format(_Q0)}, 6) AS similarity FROM vectors v WHERE id <> 0 ORDER BY {_COSINE.format(_Q0)} DESC, id LIMIT 5", "vectors")
def v1_similar(t):
    """The five nearest to one vector."""
    one = t.vectors().filter("id = 0").select("embedding").first()
    return vectors.similar(t.vectors(), one[0] if one else [], 5, 0).withColumn("similarity", F.round("similarity", 6))


@query("SELECT a.id, substr(title || ' ' || content, 1, 50) AS start FROM analyses a JOIN articles r ON r.id = a.crawl_id WHERE a.id NOT IN (SELECT id FROM vectors WHERE grp < 5) ORDER BY a.ts DESC, a.id LIMIT 50", "articles", "analyses", "vectors")
def v4_embedding_worklist(t):
    """The newest fifty analyses that lack an embedding; those of half the groups count as stored."""
    stored = t.vectors().filter("grp < 5").select("id")
    rows = t.analyses().select("id", "crawl_id", "ts").join(stored, "id", "left_anti").join(t.articles().select(F.col("id").alias("crawl_id"), F.substring(F.concat_ws(" ", "title", "content"), 1, 50).alias("start")), "crawl_id")
    return rows.orderBy(F.desc("ts"), "id").limit(50).select("id", "start")


@query("SELECT a.id, title FROM analyses a JOIN articles r ON r.id = a.crawl_id WHERE a.severity = 'critical' ORDER BY a.ts DESC, a.id LIMIT 5", "articles", "analyses")
def f7_critical_alerts(t):
    """The five newest critical analyses with their articles."""
    rows = t.analyses().filter("severity = 'critical'").join(t.articles().select(F.col("id").alias("crawl_id"), "title"), "crawl_id")
    return rows.orderBy(F.desc("ts"), "id").limit(5).select("id", "title")


@query("SELECT count(*) AS n FROM analyses WHERE severity IN ('medium', 'high', 'critical') OR id % 10 = 0", "analyses")
def f8_review_worklist(t):
    """How many analyses need a review."""
    return t.analyses().filter((scoring.severity_rank(F.col("severity")) >= 2) | (F.col("id") % 10 == 0)).agg(F.count("*").alias("n"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(max(score), 6) AS max_score FROM analyses GROUP BY 1 HAVING max(score) > 0.7 OR count(*) FILTER (severity = 'critical') > 0 ORDER BY 1 LIMIT 5", "analyses")
def f4_milestones(t):
    """The first five days with a high score or a critical alert."""
    days = t.analyses().groupBy(_day("ts", "day")).agg(F.max("score").alias("m"), F.count_if(F.col("severity") == "critical").alias("c"))
    return days.filter("m > 0.7 or c > 0").orderBy("day").limit(5).select("day", _r("m", "max_score"))


@query("SELECT h AS hours, max(ts) >= (SELECT t FROM as_of) + to_minutes(60 * h::INTEGER) - INTERVAL 90 MINUTE AS fresh FROM analyses, (SELECT unnest([0, 1, 2]) AS h) GROUP BY h", "analyses", "as_of")
def f5_freshness(t):
    """Whether anything is younger than an hour and a half, as seen now, an hour and two hours later."""
    newest = t.analyses().agg(F.max("ts").alias("newest")).select("newest", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("hours"))
    return newest.select("hours", (F.col("newest") >= t.as_of() + F.make_dt_interval(hours="hours") - F.expr("interval 90 minutes")).alias("fresh"))


@query("SELECT id FROM articles WHERE contains(lower(content), 'nda') OR contains(lower(content), 'arc')", "articles")
def f6_topic_mentions(t):
    """Articles that mention a topic."""
    low = F.lower("content")
    return t.articles().filter(F.contains(low, F.lit("nda")) | F.contains(low, F.lit("arc"))).select("id")


@query("SELECT strftime(greatest((SELECT max(ts) FROM articles), (SELECT max(ts) FROM analyses), (SELECT max(started_at) FROM jobs)), '%Y-%m-%d %H:%M:%S') AS latest", "articles", "analyses", "jobs")
def f10_latest_activity(t):
    """The newest time of three tables."""
    one = lambda rows, c: rows.agg(F.max(c).alias("m"))
    return one(one(t.articles(), "ts").unionByName(one(t.analyses(), "ts")).unionByName(one(t.jobs(), "started_at")), "m").select(F.date_format("m", "yyyy-MM-dd HH:mm:ss").alias("latest"))




@query("SELECT indicator, count(*) AS n FROM (SELECT unnest(indicators) AS indicator, ts FROM analyses WHERE score > 0.99) WHERE ts >= (SELECT t FROM as_of) - INTERVAL 1 DAY * (CASE WHEN EXISTS (SELECT 1 FROM analyses WHERE score > 0.99 AND ts >= (SELECT t FROM as_of) - INTERVAL 1 DAY) THEN 1 ELSE 30 END) GROUP BY 1", "analyses", "as_of")
def f9_adaptive_window(t):
    """Indicators of one day, or of thirty where a day has none."""
    now = t.as_of()
    rows = t.analyses().filter((F.col("score") > 0.99) & agg.within(now, 30)).select(F.explode("indicators").alias("indicator"), agg.within(now, 1).alias("near"))
    both = rows.groupBy("indicator").agg(F.count_if("near").alias("narrow"), F.count("*").alias("wide"))
    some = F.max(F.col("narrow") > 0).over(Window.partitionBy())
    return both.withColumn("n", F.when(some, F.col("narrow")).otherwise(F.col("wide"))).filter("n > 0").select("indicator", "n")
