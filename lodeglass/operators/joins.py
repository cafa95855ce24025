"""Joins and sinks over articles, analyses, claims and feedback."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeglass.operators.components import components
from lodeglass.operators.storage import cut


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], kept: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The target with the updates' rows in place of those of equal keys, nulls being equal; columns in `kept` keep the target's value.

    Of several updates with one key the last by all its other columns wins. Both sides are shuffled once, on the keys.
    """
    rest, names = [c for c in updates.columns if c not in keys], [f"k{i}" for i in range(len(keys))]
    named = lambda rows, side: rows.select(*(F.col(k).alias(f"{side}{n}") for k, n in zip(keys, names, strict=True)), F.struct(F.lit(True).alias("is"), *(c for c in rows.columns if c not in keys)).alias(side))
    old, new = named(target, "old"), named(updates, "new")
    last = new.groupBy(*(f"new{n}" for n in names)).agg(F.max("new").alias("new")) if rest else new.distinct()
    both = old.join(last, reduce(lambda a, b: a & b, (F.col(f"old{n}").eqNullSafe(F.col(f"new{n}")) for n in names)), "full")
    fresh = F.col("new").isNotNull()
    value = lambda c: F.coalesce(F.col("old")[c], F.col("new")[c]) if c in kept else F.when(fresh, F.col("new")[c]).otherwise(F.col("old")[c])
    return both.select(*(F.when(fresh, F.col(f"new{names[keys.index(c)]}")).otherwise(F.col(f"old{names[keys.index(c)]}")).alias(c) if c in keys else value(c).alias(c) for c in target.columns))


def insert_absent(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The updates to append: the first of each key by `order`, where the target has no such key."""
    first = updates.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return first.join(target.select(*keys).distinct(), keys, "left_anti")


def metric_rows(analyses: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """id, metric, value, ts: a row for every metric of an analysis."""
    wide = analyses.select("id", "ts", *(c.cast("double").alias(m) for m, c in metrics.items()))
    return wide.unpivot(["id", "ts"], list(metrics), "metric", "value")


def retained(rows: DataFrame, as_of: Column, days: int, column: str = "created_at") -> DataFrame:
    """Rows no older than so many days."""
    return rows.filter(F.col(column) >= as_of - F.make_interval(days=F.lit(days)))


def new_articles(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found articles whose URL and content hash are both unknown to the store: two anti-joins in place of a disjunction."""
    return found.join(stored.select("url").distinct(), "url", "left_anti").join(stored.select("content_hash").distinct(), "content_hash", "left_anti")


def first_of_each(found: DataFrame, order: str, small: int = 200_000) -> DataFrame:
    """Of rows in order, those whose url and content_hash both differ from those of every earlier row that is itself kept.

    Whether a row is kept depends on earlier ones that share its url or hash, and theirs on others. Of rows with both alike
    only the first can be kept, so copies go first. Then a round keeps what is first by both its url and its hash, and drops
    what shares either with it; rows that share nothing are done. What is left is decided in row order at once where it
    is no more than `small` rows (three numbers each). Otherwise it falls into components that share nothing with one
    another: each of up to `small` rows is decided in row order in a group of its own, and rounds go on only inside larger ones.

    Least rows are grouped minima joined back, so an url of half the rows is neither sorted nor held in one task. Only keys
    travel. Nulls are alike.
    """
    even = lambda c, bit: F.xxhash64(c).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit))
    left = cut(found.groupBy(even("url", 0).alias("u"), even("content_hash", 1).alias("h")).agg(F.min(order).alias("n")))
    kept, left = _round(left)
    if left.count() > small:
        part = components(left.select(F.col("u").alias("a"), F.col("h").alias("b"))).select(F.col("id").alias("u"), "component")
        left = cut(left.join(part, "u"))
        sizes = left.groupBy("component").agg(F.count("*").alias("size"))
        large = sizes.filter(F.col("size") > small).select("component")
        rest = cut(left.join(large, "component", "left_semi").select("u", "h", "n"))
        left = left.join(large, "component", "left_anti")
        while not rest.isEmpty():
            more, rest = _round(rest)
            kept = kept.unionByName(more)
    else:
        left = left.withColumn("component", F.lit(0))
    kept = kept.unionByName(left.groupBy("component").applyInPandas(_in_order, "n bigint"))
    return found.join(kept.select(F.col("n").alias(order)), order, "left_semi")


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """n of the rows (u, h, n) that are first by u and by h, and the rows that share neither with them."""
    by_u, by_h = left.groupBy("u").agg(F.min("n").alias("n")), left.groupBy("h").agg(F.min("n").alias("n"))
    first = cut(left.join(by_u, ["u", "n"], "left_semi").join(by_h, ["h", "n"], "left_semi"))
    rest = left.join(first.select("u"), "u", "left_anti").join(first.select("h"), "h", "left_anti")
    return first.select("n"), cut(rest)


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one component, one after another."""
    seen: set[int] = set()
    kept = []
    for n, u, h in rows[["n", "u", "h"]].sort_values("n").itertuples(index=False):
        if u not in seen and h not in seen:
            seen |= {u, h}
            kept.append(n)
    return pd.DataFrame({"n": kept}, dtype="int64")


def first_strategy(candidates: DataFrame) -> DataFrame:
    """The candidates of each source's first strategy that has any: a grouped minimum joined back, so a source of many candidates is not sorted in one task."""
    first = candidates.groupBy("source").agg(F.min("strategy_rank").alias("_m"))
    kept = candidates.join(first.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("strategy_rank") == F.col("_m")))
    return kept.select(*candidates.columns)


def corroborated(references: DataFrame, articles: DataFrame) -> DataFrame:
    """references (id, ref) with found: whether any stored article's source is that, whatever the case."""
    known = articles.select(F.lower("source").alias("_s")).distinct()
    return references.join(known.withColumn("found", F.lit(True)), F.lower("ref") == F.col("_s"), "left").select("id", "ref", F.coalesce("found", F.lit(False)).alias("found"))


def score_changes(now: DataFrame, before: DataFrame, least: float = 0.05) -> DataFrame:
    """Teams whose score has risen by more than `least`."""
    both = now.join(before.select("team", F.col("score").alias("previous")), "team")
    return both.withColumn("delta", F.col("score") - F.col("previous")).filter(F.col("delta") > least)


def resolved_findings(findings: DataFrame, numbered: DataFrame) -> DataFrame:
    """Findings (finding, indexes[]) with ids and distinct sources of the articles (n, id, source) they name; those with fewer than two are dropped."""
    named = findings.select("finding", F.posexplode("indexes").alias("pos", "n")).join(numbered, "n")
    listed = named.groupBy("finding").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "source"))).alias("a"))
    return listed.filter(F.size("a") >= 2).select("finding", F.transform("a", lambda x: x["id"]).alias("ids"), F.array_sort(F.array_distinct(F.transform("a", lambda x: x["source"]))).alias("sources"))


def append(rows: DataFrame, folder: str, batch: str) -> None:
    """Appends rows to a table kept as a folder, under their batch's name: a batch that is written again replaces itself and no other."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
