"""Similarity, batch neighbours and centroid outliers over dense vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector over its norm, so that a cosine of two is one dot product."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def similar(vectors: DataFrame, query: list[float], k: int = 5, exclude: int | None = None) -> DataFrame:
    """The k nearest by cosine to one given vector; a top-k, without a full sort."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.filter(F.col("embedding").isNotNull())
    rows = rows if exclude is None else rows.filter(F.col("id") != exclude)
    return rows.select("id", cosine(F.col("embedding"), wanted).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def centroids(vectors: DataFrame, group: str = "grp") -> DataFrame:
    """The mean vector of each group, component by component, with partial sums before the shuffle."""
    parts = vectors.filter(F.col("embedding").isNotNull()).select(group, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def outliers(vectors: DataFrame, k: int = 10, least: float = 0.2, group: str = "grp") -> DataFrame:
    """The k vectors over a score floor that lie farthest, by cosine distance, from the centroid of their group."""
    rows = vectors.filter((F.col("score") >= least) & F.col("embedding").isNotNull())
    far = rows.join(centroids(rows, group), group).select("id", group, (1 - cosine(F.col("embedding"), F.col("centroid"))).alias("distance"))
    return far.orderBy(F.desc("distance"), "id").limit(k)


def percentile(rows: DataFrame, column: str = "distance") -> DataFrame:
    """Each row's place from 0 to 100, ties having the highest place; 100 for a single row. For small results: it ranks over all rows."""
    n, upto = F.count("*").over(Window.partitionBy()), F.count("*").over(Window.orderBy(column).rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("percentile", F.when(n <= 1, 100).otherwise(F.round((upto - 1) / (n - 1) * 100)).cast("int"))


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """query_id, id, similarity: the k nearest by cosine to each of any number of vectors; see cells.nearest."""
    from lodeglass.operators.cells import nearest  # which is built on this module

    return nearest(vectors, queries, k, block)
