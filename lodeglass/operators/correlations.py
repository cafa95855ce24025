"""Stories: articles of different sources that say the same, by a similarity join of their vectors and its connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeglass.operators.aggregates import within
from lodeglass.operators.cells import link_sums, similar_pairs
from lodeglass.operators.components import components
from lodeglass.operators.storage import cut


def candidates(analyses: DataFrame, articles: DataFrame, vectors: DataFrame, as_of: Column, days: int, floor: float = 0.25) -> DataFrame:
    """id, source, embedding, score and ts of all articles of the last days with a score from `floor` on and a vector, each once: its best, then newest analysis (id, crawl_id, score, ts)."""
    best = analyses.filter(within(as_of, days) & (F.col("score") >= floor)).groupBy(F.col("crawl_id").alias("id")).agg(F.max(F.struct("score", "ts")).alias("best"))
    named = best.join(articles.select("id", "source"), "id")
    return named.join(vectors.filter(F.col("embedding").isNotNull()).select("id", "embedding"), "id").select("id", "source", "embedding", "best.score", "best.ts")


def copies(rows: DataFrame) -> DataFrame:
    """One row for each distinct vector: id (the least), embedding, lowest and highest source, n. So copies, however many, are one row in what follows."""
    return rows.groupBy("embedding").agg(F.min("id").alias("id"), F.min("source").alias("lowest"), F.max("source").alias("highest"), F.count("*").alias("n"))


def links(rows: DataFrame, least: float) -> DataFrame:
    """a < b and cosine of all distinct vectors, each named by its least article, that are `least` or more alike and not all of one source."""
    return similar_pairs(copies(rows), least, "lowest", "highest")


def stories(rows: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The stories of articles (id, source, embedding), and which articles they have.

    Two articles of different sources whose vectors' cosine is `least` or more tell one story, and so do those that
    chains of such pairs connect. The first frame has cluster (the least id of its vectors' names), n (articles), n_sources,
    links (pairs of distinct vectors), similarity (their mean; 1 where the story has only copies of one vector) and type;
    the second cluster, id and source.

    All articles take part; copies of a vector count as one in links and meet no other copy, yet each is a member. Articles
    without a source or a usable vector, or that nothing of another source is close to, are in no story.
    """
    named = cut(rows.filter("source is not null").select("id", "source", "embedding"))
    nodes = cut(copies(named))
    found = cut(link_sums(nodes, least, "lowest", "highest"))  # links may be many times as many as articles; a row each would fill the disks
    alone = nodes.filter("lowest <> highest").select(F.col("id").alias("a"), F.col("id").alias("b"))
    of = cut(components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(alone)))
    vector = nodes.join(of, "id").select("embedding", F.col("component").alias("cluster"))
    members = named.join(vector, "embedding").select("cluster", "id", "source")
    counted = found.filter("links > 0").groupBy("id").agg(F.sum("links").alias("links"), F.sum("total").alias("total"))
    by_link = counted.join(of, "id").groupBy(F.col("component").alias("cluster")).agg(F.sum("links").alias("links"), (F.sum("total") / F.sum("links")).alias("similarity"))
    sources = members.groupBy("cluster", "source").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.sum("n").alias("n"), F.count("*").alias("n_sources"))
    told = sources.join(by_link, "cluster", "left")
    return told.select("cluster", "n", "n_sources", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"), F.lit("thematic_cluster").alias("type")), members


def report(told: DataFrame, members: DataFrame, most: int = 20, listed: int = 20) -> DataFrame:
    """The `most` largest stories with the first `listed` ids and sources of each: cluster, n, similarity, type, ids, sources."""
    top = told.orderBy(F.desc("n"), "cluster").limit(most)
    first = lambda c: members.select("cluster", c).distinct().withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(c))).filter(F.col("place") <= listed).groupBy("cluster").agg(F.array_sort(F.collect_list(c)).alias(f"{c}s"))
    return top.join(first("id"), "cluster").join(first("source"), "cluster").select("cluster", "n", "ids", "sources", "similarity", "type")


def story_clusters(analyses: DataFrame, articles: DataFrame, vectors: DataFrame, as_of: Column, days: int, least: float = 0.8, floor: float = 0.25, most: int = 20) -> DataFrame:
    """cluster, n, ids, sources, similarity and type of the stories among the `most` articles of the highest scores of the last days."""
    best = candidates(analyses, articles, vectors, as_of, days, floor).orderBy(F.desc("score"), F.desc("ts"), "id").limit(most)
    return report(*stories(cut(best), least), most, most)
