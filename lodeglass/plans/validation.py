"""A second look at analyses: references checked against stored articles, and scores, confidences, severities and indicators after a validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeglass.functions import scoring, text

# What an article must mention to bear a reference out.
TOPICS = ("agi", "artificial general intelligence", "superintelligence")
# End of fixed values.


def checked_references(references: DataFrame, sources: DataFrame, articles: DataFrame, topics=TOPICS, shown: int = 3, most_sources: int = 10_000) -> DataFrame:
    """id, ref, source, found, article_count and titles of references (id, ref): the first source in list order whose name contains the reference, whatever the case, and how many of its articles mention a topic.

    `sources` (source, place) is the list of configured sources; it is sent to all tasks as one array and met by each
    different reference once, so it is an error if it has more than `most_sources` rows. Articles (id, source, title, content) are counted by source first, with the
    titles of the first `shown` by id. References that no source's name contains are left out; null ones too.
    """
    if sources.limit(most_sources + 1).count() > most_sources:
        raise ValueError(f"more than {most_sources} configured sources")
    names = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda s: s["source"]).alias("names"))
    met = references.select("ref").filter("ref is not null").distinct().crossJoin(F.broadcast(names)).select("ref", F.posexplode("names").alias("place", "source"))
    first = met.filter(F.contains(F.lower("source"), F.lower("ref"))).groupBy("ref").agg(F.min_by("source", "place").alias("source"))
    named = references.select("id", "ref").join(first, "ref")
    about = articles.filter(text.any_term(F.lower("content"), topics)).select("id", "source", "title")
    counts = about.groupBy("source").agg(F.count("*").alias("article_count"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("id"))
    titles = about.withColumn("place", place).filter(F.col("place") <= shown).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda s: s["title"]).alias("titles"))
    rows = named.join(counts.join(titles, "source"), "source", "left")
    n = F.coalesce("article_count", F.lit(0).cast("bigint"))
    return rows.select("id", "ref", "source", (n > 0).alias("found"), n.alias("article_count"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))


def confidence_after(recommendation: Column, before: Column, agrees: Column) -> Column:
    """The confidence of an analysis after a validation."""
    up = F.when(F.coalesce(agrees, F.lit(False)), 0.2).otherwise(0.1)
    return F.when(recommendation.isin("dismiss", "lower"), F.greatest(F.lit(0.0), before - 0.1)).otherwise(F.least(F.lit(1.0), before + up))


def validated(analyses: DataFrame, validations: DataFrame, checked: DataFrame) -> DataFrame:
    """Analyses after their validation: id, score, confidence, severity, indicators, penalty, corroboration, requires_verification.

    An analysis (id, score, model_score, confidence, severity, indicators, refs, heuristic, boost, has_delta) with a
    validation (id, validated_score, recommendation, agrees, indicators) is scored anew from the validated score, or the model's,
    or its own, and moved as the recommendation says: by default it is investigated. References count only for high and
    critical ones: if all fail, the score loses 0.2. The severity is that of the new score, so it may fall; critical needs a gain in a
    benchmark, and a dismissal caps it. New indicators follow the old ones, each once. `checked` is what
    `checked_references` gives for the analyses' refs. Those without a validation are left out.
    """
    borne = checked.groupBy("id").agg(F.bool_or("found").alias("borne_out"))
    said = validations.select("id", "validated_score", F.coalesce("recommendation", F.lit("investigate")).alias("recommendation"), "agrees", F.coalesce("indicators", F.array().cast("array<string>")).alias("more"))
    rows = analyses.join(said, "id").join(borne, "id", "left")
    grave, refs = F.col("severity").isin("high", "critical"), F.size(F.coalesce("refs", F.array().cast("array<string>"))) > 0
    borne_out = grave & F.coalesce("borne_out", F.lit(False))
    penalty = F.when(grave & refs & ~borne_out, 0.2).otherwise(0.0)
    model = scoring.clamp(F.coalesce("validated_score", "model_score", "score"))
    rows = rows.withColumns({"penalty": penalty, "corroboration": F.when(borne_out, "independent_source").when(refs, "same_source").otherwise("none")})
    combined = scoring.combined_score(model, F.col("heuristic"), F.col("boost"), F.col("penalty"))
    rows = rows.withColumn("new_score", F.round(scoring.validated_score(F.col("recommendation"), F.col("score"), combined, F.col("penalty")), 6))
    severity = scoring.overridden_severity(scoring.gated_severity(scoring.severity(F.col("new_score")), F.col("has_delta")), F.col("recommendation"))
    return rows.select(
        "id", F.col("new_score").alias("score"), confidence_after(F.col("recommendation"), F.col("confidence"), F.col("agrees")).alias("confidence"), severity.alias("severity"),
        F.array_union("indicators", "more").alias("indicators"), "penalty", "corroboration", F.lit(False).alias("requires_verification"),
    )


def activity_articles(discussions: DataFrame, releases: DataFrame, repositories: DataFrame, most_discussions: int = 5, most_repositories: int = 10) -> DataFrame:
    """title, content, source, kind: article rows of the first discussions (title, body, category, author, comments, place), all releases (name, tag, body, author), and the repositories (name, description, stars, language) of most stars."""
    row = lambda title, content, source, kind: (title.alias("title"), content.alias("content"), F.lit(source).alias("source"), F.lit(kind).alias("kind"))
    said = discussions.orderBy("place").limit(most_discussions).select(*row(
        F.concat(F.lit("ARC-AGI GitHub: "), "title"), F.format_string("Discussion by %s in ARC-AGI-2 repository: %s. Category: %s. %d comments.", "author", "body", "category", "comments"), "ARC GitHub Discussions", "discussion",
    ))
    out = releases.select(*row(F.concat(F.lit("ARC-AGI Release: "), "name"), F.format_string("New release %s published by %s: %s", "tag", "author", "body"), "ARC GitHub Releases", "release"))
    top = repositories.orderBy(F.desc("stars"), "name", "description").limit(most_repositories).select(*row(
        F.concat(F.lit("ARC Implementation: "), "name"),
        F.format_string("Community ARC-AGI implementation: %s. Language: %s. Stars: %d. This repository may contain novel approaches to the ARC-AGI challenge.", "description", F.coalesce("language", F.lit("Unknown")), "stars"), "ARC GitHub Implementations", "implementation",
    ))
    return said.unionByName(out).unionByName(top)
