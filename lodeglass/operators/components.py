"""Connected components of any number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.operators.storage import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and component (the least id that it is connected with) of every end of the links (a, b).

    Large and small star steps take turns until nothing changes, which takes a number of rounds that grows with the
    logarithm of the ids, not with the longest path. In a large step all larger neighbours of a node are tied to the
    least of it and its neighbours, in a small step the smaller ones and the node itself. A node's least neighbour is a
    grouped minimum with partial minima in each task, joined back, so a node of a third of all links is neither sorted
    nor held as one group: Spark splits its side of the join. Rows in which an end is null, and links of a node to itself,
    tie nothing; the latter's node is its own component.
    """
    both = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a is not null and b is not null")
    ids = both.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    tied = cut(both.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        ends = tied.unionByName(tied.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ends.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = ends.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("x")).select("x.*").filter("u <> v")
        tied = cut(small.distinct())
        state = tied.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return ids.join(tied.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
        before = state
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
