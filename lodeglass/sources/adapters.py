"""The logical tables (articles, analyses, claims, feedback, ...) over the star-schema test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.functions.scoring import severity

SEVERITY_SQL = "CASE WHEN {0} >= 0.8 THEN 'critical' WHEN {0} >= 0.6 THEN 'high' WHEN {0} >= 0.3 THEN 'medium' WHEN {0} > 0 THEN 'low' ELSE 'none' END"
_SCORE = "least(1.0::DOUBLE, value / 100)"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

#: The same tables as DuckDB expressions.
SQL = {
    "articles": "SELECT doc_id AS id, source, lang, text AS content, substr(split_part(text, chr(10), 1), 1, 80) AS title, 'https://' || source || '.example.org/d/' || (doc_id % 900) AS url, TIMESTAMP '2024-01-01' + to_hours((doc_id % 720)::INTEGER) AS ts FROM documents",
    "analyses": f"SELECT event_id AS id, 2 * event_id AS crawl_id, {_SCORE} AS score, {_K} / 100.0::DOUBLE AS confidence, {SEVERITY_SQL.format(_SCORE)} AS severity, [event_type, 'k' || ({_K} % 10)] AS indicators, ts::TIMESTAMP AS ts FROM events",
    "analyses_wide": f"SELECT event_id AS id, event_id % (SELECT count(*) FROM documents) AS crawl_id, {_SCORE} AS score, {_K} / 100.0::DOUBLE AS confidence, {SEVERITY_SQL.format(_SCORE)} AS severity, [event_type, 'k' || ({_K} % 10)] AS indicators, ts::TIMESTAMP AS ts FROM events",
    "claims": "SELECT l_orderkey % (SELECT count(*) FROM documents) AS crawl_id, l_returnflag AS benchmark, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END AS metric, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount * 100 END AS delta, l_quantity AS value, '%' AS unit FROM lineitem",
    "feedback": "SELECT doc_id AS analysis_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'relevant' WHEN quality = 1 THEN 'critical' WHEN toxic = 0 THEN 'noise' ELSE 'false_positive' END AS feedback_type, (doc_id % 100) / 100.0::DOUBLE AS score, source, TIMESTAMP '2024-01-01' + to_hours((doc_id % 720)::INTEGER) AS ts FROM labels JOIN documents USING (doc_id)",
    "vectors": "SELECT vec_id AS id, embedding, label AS grp, (vec_id % 100) / 100.0::DOUBLE AS score FROM embeddings",
    "trajectories": f"SELECT event_id AS id, event_type AS query_text, user_id AS result_id, event_type IN ('click', 'purchase') AS was_useful, 'src' || ({_K} % 20) AS source, ts::TIMESTAMP AS created_at FROM events",
    "leaderboard_prev": "SELECT user_id AS team, max(value) / 500 AS score FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id",
    "leaderboard_curr": "SELECT user_id AS team, max(value) / 500 AS score FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id",
    "snapshot_prev": "SELECT source, substr(split_part(text, chr(10), 1), 1, 80) AS title FROM documents",
    "snapshot_curr": "SELECT source, substr(split_part(text, chr(10), 1), 1, 80) AS title FROM documents WHERE doc_id % 7 <> 0",
    "jobs": "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderdate::TIMESTAMP AS started_at FROM orders",
    "job_batches": "SELECT l_orderkey AS job, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS batch, l_quantity AS batch_ms FROM lineitem",
    "as_of": "SELECT max(ts)::TIMESTAMP AS t FROM events",
}


def with_tables(sql: str, *names: str) -> str:
    """The SQL, and what it names by WITH itself, with these tables before it."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt out over all cores where it is read in fewer parts, as texts of one row group would be worked on by one core; larger tables stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


class Tables:
    """The logical tables of one folder, each read with only the columns it needs."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def articles(self) -> DataFrame:
        hours = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, int(doc_id % 720))")
        url = F.format_string("https://%s.example.org/d/%d", "source", F.col("doc_id") % 900)
        return spread(self.raw("documents")).select(F.col("doc_id").alias("id"), "source", "lang", F.col("text").alias("content"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), url.alias("url"), hours.alias("ts"))

    def _events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))

    def analyses(self, crawl_id=None) -> DataFrame:
        score = F.least(F.lit(1.0), F.col("value") / 100)
        return self._events().select(
            F.col("event_id").alias("id"), (F.col("event_id") * 2 if crawl_id is None else crawl_id).alias("crawl_id"), score.alias("score"), (F.col("k") / 100).alias("confidence"),
            severity(score).alias("severity"), F.array("event_type", F.concat(F.lit("k"), F.col("k") % 10)).alias("indicators"), "ts",
        )

    def analyses_wide(self) -> DataFrame:
        return self.analyses(F.col("event_id") % F.lit(self.raw("documents").count()))

    def claims(self) -> DataFrame:
        n = self.raw("documents").count()
        return self.raw("lineitem").select(
            (F.col("l_orderkey") % F.lit(n)).alias("crawl_id"), F.col("l_returnflag").alias("benchmark"), F.when(F.col("l_linenumber") != 7, F.col("l_linestatus")).alias("metric"),
            F.when(F.col("l_discount") != 0, F.col("l_discount") * 100).alias("delta"), F.col("l_quantity").alias("value"), F.lit("%").alias("unit"),
        )

    def feedback(self) -> DataFrame:
        kind = F.expr("case when quality = 1 and toxic = 0 then 'relevant' when quality = 1 then 'critical' when toxic = 0 then 'noise' else 'false_positive' end")
        docs = self.articles().select(F.col("id").alias("doc_id"), "source", "ts")
        return self.raw("labels").join(docs, "doc_id").select(F.col("doc_id").alias("analysis_id"), kind.alias("feedback_type"), ((F.col("doc_id") % 100) / 100).alias("score"), "source", "ts")

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("grp"), ((F.col("vec_id") % 100) / 100).alias("score"))

    def trajectories(self) -> DataFrame:
        return self._events().select(
            F.col("event_id").alias("id"), F.col("event_type").alias("query_text"), F.col("user_id").alias("result_id"), F.col("event_type").isin("click", "purchase").alias("was_useful"),
            F.concat(F.lit("src"), F.col("k") % 20).alias("source"), F.col("ts").alias("created_at"),
        )

    def leaderboard(self, current: bool) -> DataFrame:
        side = F.col("ts") >= "2024-01-16" if current else F.col("ts") < "2024-01-16"
        return self._events().filter(side).groupBy(F.col("user_id").alias("team")).agg((F.max("value") / 500).alias("score"))

    def snapshot(self, current: bool) -> DataFrame:
        rows = self.articles().filter(F.col("id") % 7 != 0) if current else self.articles()
        return rows.select("source", "title")

    def jobs(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"))

    def job_batches(self) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.raw("lineitem").select(F.col("l_orderkey").alias("job"), F.row_number().over(order).alias("batch"), F.col("l_quantity").alias("batch_ms"))

    def as_of(self):
        """The newest analysis time, as a literal."""
        return F.lit(self._events().agg(F.max("ts")).first()[0])
