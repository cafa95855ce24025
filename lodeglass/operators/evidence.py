"""Evidence in articles: triage, scored sentences, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions import lexicons, text
from lodeglass.functions.patterns import GAINS, NUMBER
from lodeglass.functions.scoring import claim_points, clamp


def triage(articles: DataFrame, capability=lexicons.CAPABILITY, noise=lexicons.NOISE, least_words: int = 120) -> DataFrame:
    """The articles with skip, reason and matches: no capability term and few words, or none and any noise term.

    Only articles without a capability term are split into words and searched for noise. Columns of these three names
    are replaced; all others, whatever their names, stay.
    """
    whole = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    rows = articles.select(F.struct("*").alias("row"), F.lower(whole).alias("low")).withColumn("capable", text.any_term(F.col("low"), capability))
    n = F.size(F.filter(F.split(F.coalesce("row.content", F.lit("")), r"\s+"), lambda w: w != ""))
    rows = rows.select("row", "capable", (~F.col("capable") & (n < least_words)).alias("short"), F.when(~F.col("capable"), text.terms_in(F.col("low"), noise)).alias("matches"))
    noisy = ~F.col("capable") & ~F.col("short") & (F.size("matches") > 0)
    reason = F.when(F.col("short"), "Short update without capability signals").when(noisy, F.concat(F.lit("Noise keywords: "), F.array_join(F.slice("matches", 1, 3), ", ")))
    kept = [F.col("row")[c].alias(c) for c in articles.columns if c.lower() not in ("skip", "reason", "matches")]
    return rows.select(*kept, (F.col("short") | noisy).alias("skip"), reason.alias("reason"), F.when(noisy, F.col("matches")).alias("matches"))


def sentence_rows(articles: DataFrame) -> DataFrame:
    """id, pos, sentence."""
    return articles.select("id", F.posexplode(text.sentences(F.col("content"))).alias("pos", "sentence"))


def _number(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("double")


def delta_percent(c: Column) -> Column:
    return F.coalesce(*(_number(c, rf"(?i){g}\s+{NUMBER}\s*%") for g in GAINS), _number(c, rf"(?i)up\s+{NUMBER}\s*%"))


def delta_plain(c: Column) -> Column:
    return F.coalesce(*(_number(c, rf"(?i){g}\s+{NUMBER}") for g in GAINS), _number(c, rf"(?i)delta\s+{NUMBER}"))


def with_snippets(rows: DataFrame, column: str, keywords=lexicons.EVIDENCE, benchmarks=tuple(lexicons.BENCHMARKS), most: int = 6, wanted: Column | None = None) -> DataFrame:
    """The rows (content, ...) with an array of structs of their content's best sentences of 20 to 300 characters: pos, snippet, score, tags.

    Of equal sentences, whatever their case, the first counts, and ties go to the earlier. All is done inside the row, and
    nothing is shuffled: terms are searched in the whole content first, in compiled code, and only those that occur there
    in its sentences. Equal sentences have equal scores, so in order of score and place the first `most` different ones are
    the best. Where `wanted` is false the array is empty, at no cost.
    """
    own = flat, terms, scored = [f"{column}_{x}" for x in ("flat", "terms", "all")]
    wanted = F.lit(True) if wanted is None else wanted
    rows = rows.withColumn(flat, F.when(wanted, text.collapsed(F.col("content"))))
    rows = rows.withColumn(terms, text.terms_in(F.lower(F.col(flat)), (*keywords, *benchmarks)))
    some = (F.size(terms) > 0) | F.col(flat).rlike(r"[\d%]")
    parts = F.filter(F.split(F.col(flat), r"(?<=[.!?。！？；])\s+"), lambda s: s != "")
    placed = F.filter(F.transform(parts, lambda s, i: F.struct(i.alias("pos"), s.alias("snippet"))), lambda x: F.length(x["snippet"]).between(20, 300))
    lowered = F.transform(placed, lambda x: F.struct(x["pos"].alias("pos"), x["snippet"].alias("snippet"), F.lower(x["snippet"]).alias("low")))
    found = F.transform(lowered, lambda x: F.struct(
        x["pos"].alias("pos"), x["snippet"].alias("snippet"), x["low"].alias("low"), F.filter(F.col(terms), lambda t: F.contains(x["low"], t)).alias("terms"),
        x["low"].rlike(r"\d").alias("numbers"), F.contains(x["low"], F.lit("%")).alias("percent"),
    ))
    weigh = lambda x: 2 * F.size(x["terms"]) + F.when(x["numbers"], 2).otherwise(0) + F.when(x["percent"], 1).otherwise(0)
    more = lambda x: F.array_compact(F.array(F.when(x["numbers"], F.lit("numbers")), F.when(x["percent"], F.lit("percent"))))
    ranked = F.transform(found, lambda x: F.struct((-weigh(x)).alias("less"), x["pos"].alias("pos"), x["snippet"].alias("snippet"), x["low"].alias("low"), F.array_distinct(F.concat(x["terms"], more(x))).alias("tags")))
    kind = "array<struct<less: int, pos: int, snippet: string, low: string, tags: array<string>>>"
    rows = rows.withColumn(scored, F.when(some, F.array_sort(F.filter(ranked, lambda x: x["less"] < 0))).otherwise(F.array().cast(kind)))
    first = F.aggregate(scored, F.array().cast(kind), lambda got, x: F.when((F.size(got) < most) & ~F.exists(got, lambda y: y["low"] == x["low"]), F.concat(got, F.array(x))).otherwise(got))
    shown = F.transform(first, lambda x: F.struct(x["pos"].alias("pos"), x["snippet"].alias("snippet"), (-x["less"]).alias("score"), x["tags"].alias("tags")))
    return rows.withColumn(column, F.coalesce(shown, F.array().cast("array<struct<pos: int, snippet: string, score: int, tags: array<string>>>"))).drop(*own)


def snippets(articles: DataFrame, keywords=lexicons.EVIDENCE, benchmarks=tuple(lexicons.BENCHMARKS), most: int = 6) -> DataFrame:
    """id, rank, pos, snippet, score, tags: an article's best sentences, a row each, without a shuffle; see with_snippets."""
    rows = with_snippets(articles.select("id", "content"), "best", keywords, benchmarks, most)
    # an outer one, as from others Spark infers a filter that works out all snippets again under the projections
    best = rows.select("id", F.posexplode_outer("best").alias("place", "x")).filter("x is not null")
    return best.select("id", "x.pos", "x.snippet", "x.score", "x.tags", (F.col("place") + 1).alias("rank"))


def claim(s: Column, tags: Column, benchmarks=lexicons.BENCHMARKS, metrics=lexicons.METRICS) -> Column:
    """A struct of what a sentence claims: claim, tags, numbers, benchmark, metric, value, delta, unit."""
    percent, plain = _number(s, NUMBER + r"\s*%"), _number(s, NUMBER)
    dp, da = delta_percent(s), delta_plain(s)
    unit = F.when(dp.isNotNull(), "%").when(percent.isNotNull(), "%")
    numbers = F.transform(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(1)), lambda x: x.try_cast("double"))
    return F.struct(
        s.alias("claim"), tags.alias("tags"), numbers.alias("numbers"), text.first_term(s, benchmarks).alias("benchmark"), text.first_term(s, {m: m for m in metrics}).alias("metric"),
        F.coalesce(percent, plain).alias("value"), F.coalesce(dp, da).alias("delta"), unit.alias("unit"),
    )


def claims(found: DataFrame, benchmarks=lexicons.BENCHMARKS, metrics=lexicons.METRICS, most: int = 4, mode: str = "reference") -> DataFrame:
    """The first snippets of an article as claims: benchmark, metric, value, delta, unit, numbers, tags.

    In the mode `reference` benchmark and metric are the first in list order that the sentence contains, inside words too;
    in the mode `word` they are the longest that stand there as words, of lists of any length (see word_terms).
    """
    if mode == "reference":
        made = found.filter(F.col("rank") <= most).select("id", "rank", claim(F.col("snippet"), F.col("tags"), benchmarks, metrics).alias("c"))
        return made.select("id", "rank", "c.claim", "c.tags", "c.numbers", "c.benchmark", "c.metric", "c.value", "c.delta", "c.unit")
    if mode != "word":
        raise ValueError(f"no such mode: {mode!r}")
    best = found.filter(F.col("rank") <= most)
    bare = best.select("id", "rank", claim(F.col("snippet"), F.col("tags"), {"": None}, ()).alias("c")).select("id", "rank", "c.claim", "c.tags", "c.numbers", "c.value", "c.delta", "c.unit")
    for column, terms in (("benchmark", benchmarks), ("metric", metrics)):
        lexicon = terms if isinstance(terms, DataFrame) else lexicon_of(best, terms if isinstance(terms, dict) else {m: m for m in terms})
        bare = bare.join(word_terms(best.select("id", "rank", "snippet"), "snippet", lexicon).select("id", "rank", F.col("label").alias(column)), ["id", "rank"], "left")
    return bare.select("id", "rank", "claim", "tags", "numbers", "benchmark", "metric", "value", "delta", "unit")


def lexicon_of(near: DataFrame, terms: dict[str, str]) -> DataFrame:
    """A lexicon (term, label, place) of a dictionary, in its order."""
    return near.sparkSession.createDataFrame([(t, label, k) for k, (t, label) in enumerate(terms.items())], "term string, label string, place int")


def _tokens(low: Column) -> Column:
    """Words (runs of letters and digits) and single other characters, each with the white space before it as one space."""
    return F.regexp_extract_all(text.collapsed(low), F.lit(r"(\s?(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}]))"), F.lit(1))


def word_terms(rows: DataFrame, column: str, lexicon: DataFrame) -> DataFrame:
    """The rows' other columns (their key) with term and label of the longest term of a lexicon (term, label, place) that stands in their text as words; rows without one are left out.

    Whatever the case and the white space between words. Of equally long terms the first by place counts. Text and terms
    are cut into the same tokens, and runs of as many tokens as any term has are joined with the terms, so a list of a hundred thousand
    terms costs no more a sentence than a short one; Spark sends a small list to all tasks and shuffles by term
    otherwise. Terms without a token match nothing. The key must tell rows apart.
    """
    keys = [c for c in rows.columns if c != column]
    term = F.array_join(_tokens(F.lower("term")), "")
    known = lexicon.select(F.ltrim(term).alias("words"), F.size(_tokens(F.lower("term"))).alias("size"), "term", "label", "place").filter("size > 0")
    known = known.groupBy("words").agg(F.min(F.struct("place", "term", "label")).alias("t"), F.first("size").alias("size"))
    sizes = known.agg(F.collect_set("size").alias("sizes"))  # as few numbers as the longest term has tokens
    cut = rows.select(*keys, _tokens(F.lower(column)).alias("tokens")).crossJoin(F.broadcast(sizes))
    starts = cut.select(*keys, "tokens", F.explode("sizes").alias("size")).filter(F.size("tokens") >= F.col("size"))
    runs = starts.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens") - F.col("size") + 1), lambda i: F.ltrim(F.array_join(F.slice("tokens", i, F.col("size")), "")))).alias("words")).distinct()
    best = runs.join(known, "words").groupBy(*keys).agg(F.min(F.struct((-F.length("t.term")).alias("less"), F.col("t.place").alias("place"), F.col("t.term").alias("term"), F.col("t.label").alias("label"))).alias("x"))
    return best.select(*keys, "x.term", "x.label")


def has_gain(c: Column) -> Column:
    """Whether a claim has a benchmark and a delta."""
    return c["benchmark"].isNotNull() & (c["benchmark"] != "") & c["delta"].isNotNull() & ~F.isnan(c["delta"])


def heuristic(made: Column, snippets: Column, most: float = 0.4) -> Column:
    """The heuristic score of an array of claims, with a bonus for three snippets (their number) or more; 0 without a claim."""
    points = F.aggregate(made, F.lit(0.0), lambda p, c: p + claim_points(c["benchmark"], c["value"], c["delta"], c["tags"]))
    return F.when(F.size(made) > 0, F.round(clamp(points + F.when(snippets >= 3, 0.03).otherwise(0.0), 0.0, most), 6)).otherwise(0.0)


def bundles(found: DataFrame, made: DataFrame) -> DataFrame:
    """id, snippets[], claims[] in order of rank."""
    listed = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda x: x["snippet"]).alias("snippets"))
    said = made.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "claim"))), lambda x: x["claim"]).alias("claims"))
    return listed.join(said, "id", "left")


def merged_claims(native: DataFrame, translated: DataFrame, benchmarks=lexicons.BENCHMARKS, metrics=lexicons.METRICS) -> DataFrame:
    """Claims, and those of translated snippets (id, rank, snippet), which have no tags."""
    return native.unionByName(claims(translated.withColumn("tags", F.array().cast("array<string>")), benchmarks, metrics))


def heuristic_scores(made: DataFrame, counts: DataFrame | None = None, most: float = 0.4) -> DataFrame:
    """id, heuristic, has_delta from claims (id, benchmark, value, delta, tags) and, with `counts` (id, snippets), a bonus for three snippets or more."""
    points = made.withColumn("p", claim_points(F.col("benchmark"), F.col("value"), F.col("delta"), F.col("tags")))
    with_delta = F.col("benchmark").isNotNull() & (F.col("benchmark") != "") & F.col("delta").isNotNull() & ~F.isnan("delta")
    out = points.groupBy("id").agg(F.sum("p").alias("p"), F.coalesce(F.bool_or(with_delta), F.lit(False)).alias("has_delta"))
    if counts is not None:
        out = out.join(counts, "id", "left").withColumn("p", F.col("p") + F.when(F.col("snippets") >= 3, 0.03).otherwise(0.0))
    return out.select("id", F.round(clamp(F.col("p"), 0.0, most), 6).alias("heuristic"), "has_delta")


def _said(name: str, value: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.coalesce(value, F.lit(0.0)).alias("value"), detail.cast("string").alias("detail"))


def signal_parts(c: Column) -> Column:
    """An array of name, value and detail of each part that a claim adds to its article's score; parts of nothing are left out."""
    arc, delta, value = c["benchmark"].isin("ARC", "ARC-AGI", "ARC-AGI-2"), c["delta"], c["value"]
    parts = F.array(
        _said("benchmark", F.when(c["benchmark"] != "", 0.03), c["benchmark"]),
        _said("benchmark_value", F.when(arc & (value >= 25), 0.15).when(arc & (value >= 10), 0.1), value),
        _said("benchmark_delta", F.when(delta >= 10, 0.1).when(delta >= 5, 0.05), delta),
        _said("human_level", F.when(F.array_contains(c["tags"], "human-level"), 0.06), F.lit("human-level")),
        _said("generalization", F.when(F.array_contains(c["tags"], "generalization"), 0.04), F.lit("generalization")),
    )
    return F.filter(parts, lambda p: p["value"] != 0)


def article_signals(made: Column, snippets: Column, boost: Column, critical: Column, penalty: Column) -> Column:
    """All signals of an article: those of its claims in order, that of three snippets or more, that of secrecy and that of a lack of corroboration."""
    own = F.array(
        _said("multiple_evidence", F.when((F.size(made) > 0) & (snippets >= 3), 0.03), snippets),
        _said("secrecy", boost, F.when(critical, "critical").otherwise("high")),
        _said("corroboration_penalty", -penalty, F.lit("no corroboration")),
    )
    return F.concat(F.flatten(F.transform(made, signal_parts)), F.filter(own, lambda p: p["value"] != 0))


def signals(made: DataFrame) -> DataFrame:
    """name, value, detail of each part that a claim (id, benchmark, value, delta, tags) adds to its article's score."""
    return made.select("id", F.inline(signal_parts(F.struct("benchmark", "value", "delta", "tags"))))


def claims_on_load(articles: DataFrame, stored: DataFrame, known: DataFrame, keywords=lexicons.EVIDENCE, benchmarks=lexicons.BENCHMARKS, metrics=lexicons.METRICS) -> DataFrame:
    """id, origin, claim of the articles (id, content) of which nothing is known (id) yet: claims stored with them (id, claim), else those extracted from their text."""
    new = articles.join(known.select("id").distinct(), "id", "left_anti")
    kept = stored.join(new.select("id"), "id", "left_semi").select("id", F.lit("stored").alias("origin"), "claim")
    bare = new.join(stored.select("id").distinct(), "id", "left_anti")
    made = claims(snippets(bare, keywords, tuple(benchmarks)), benchmarks, metrics)
    return kept.unionByName(made.select("id", F.lit("extracted").alias("origin"), "claim"))


def backfill(articles: DataFrame, known: DataFrame, newest: int = 200, keywords=lexicons.EVIDENCE, benchmarks=lexicons.BENCHMARKS, metrics=lexicons.METRICS) -> tuple[DataFrame, DataFrame]:
    """The claims to insert of the newest articles (id, content, ts) of which none is known (id), and one row of how many articles were processed and claims inserted."""
    new = articles.join(known.select("id").distinct(), "id", "left_anti").orderBy(F.desc("ts"), "id").limit(newest)
    made = claims(snippets(new, keywords, tuple(benchmarks)), benchmarks, metrics)
    counts = new.agg(F.count("*").alias("processed")).crossJoin(made.agg(F.count("*").alias("inserted")))
    return made, counts
