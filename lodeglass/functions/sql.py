"""The library's functions under names that SQL text can call: scalar functions, table functions, and one partitioned table function in Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from lodeglass.functions import lexicons, text
from lodeglass.functions.patterns import GAINS, NUMBER

_CLAIM = "benchmark STRING, value DOUBLE, delta DOUBLE, tags ARRAY<STRING>"


def _strings(values) -> str:
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


#: name -> what stands between CREATE TEMPORARY FUNCTION and the end.
SCALAR = {
    "severity": "severity(score DOUBLE) RETURNS STRING RETURN CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END",
    "cjk_ratio": f"cjk_ratio(content STRING) RETURNS DOUBLE RETURN regexp_count(substring(content, 1, {text.CJK_SAMPLE}), '{text.CJK}') / greatest(1, length(substring(content, 1, {text.CJK_SAMPLE})))",
    "canonical_url": f"""canonical_url(url STRING) RETURNS STRING RETURN CASE WHEN try_parse_url(url, 'HOST') IS NULL THEN url
        WHEN try_parse_url(regexp_replace(url, '#.*$', ''), 'QUERY') IS NULL THEN regexp_replace(url, '#.*$', '')
        ELSE concat_ws('?', regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', ''), nullif(array_join(array_sort(filter(split(try_parse_url(regexp_replace(url, '#.*$', ''), 'QUERY'), '&'),
            p -> p <> '' AND NOT array_contains({_strings(lexicons.TRACKING_PARAMETERS)}, lower(substring_index(p, '=', 1))))), '&'), '')) END""",
    "cosine": """cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
        / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))""",
    "heuristic_score": f"""heuristic_score(claims ARRAY<STRUCT<{_CLAIM.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE').replace(' ARRAY', ': ARRAY')}>>, snippets INT) RETURNS DOUBLE RETURN CASE WHEN coalesce(size(claims), 0) = 0 THEN 0D ELSE
        round(least(0.4D, greatest(0D, CASE WHEN snippets >= 3 THEN 0.03D ELSE 0D END + aggregate(claims, 0D, (s, c) -> s + CASE WHEN c.benchmark <> '' THEN 0.03D ELSE 0D END
            + CASE WHEN c.benchmark IN ('ARC', 'ARC-AGI', 'ARC-AGI-2') AND c.value >= 25 THEN 0.15D WHEN c.benchmark IN ('ARC', 'ARC-AGI', 'ARC-AGI-2') AND c.value >= 10 THEN 0.1D ELSE 0D END
            + CASE WHEN c.delta >= 10 THEN 0.1D WHEN c.delta >= 5 THEN 0.05D ELSE 0D END
            + CASE WHEN array_contains(c.tags, 'human-level') THEN 0.06D ELSE 0D END + CASE WHEN array_contains(c.tags, 'generalization') THEN 0.04D ELSE 0D END))), 6) END""",
}
TABLE = {
    "sentences_of": r"""sentences_of(content STRING) RETURNS TABLE (pos INT, sentence STRING) RETURN SELECT t.pos, t.col FROM posexplode(filter(split(trim(regexp_replace(content, '\\s+', ' ')), '(?<=[.!?。！？；])\\s+'), s -> s <> '')) AS t""",
    "secrecy_terms": f"""secrecy_terms(content STRING, terms ARRAY<STRING>) RETURNS TABLE (term STRING, severity STRING) RETURN SELECT t.col, CASE WHEN exists({_strings(lexicons.CRITICAL_TERMS)}, x -> contains(lower(t.col), x)) THEN 'critical'
        WHEN exists({_strings(lexicons.HIGH_TERMS)}, x -> contains(lower(t.col), x)) THEN 'high' ELSE 'medium' END FROM explode(filter(terms, x -> contains(lower(content), x))) AS t""",
}
_END, _SPACE = re.compile(r"(?<=[.!?。！？；])\s+", re.ASCII), re.compile(r"\s+", re.ASCII)
_DELTAS = [(re.compile(rf"{g}\s+{NUMBER}\s*%", re.I | re.ASCII), "%") for g in (*GAINS, "up")] + [(re.compile(rf"{g}\s+{NUMBER}", re.I | re.ASCII), None) for g in (*GAINS, "delta")]
_PERCENT, _NUMBER = re.compile(NUMBER + r"\s*%", re.ASCII), re.compile(NUMBER, re.ASCII)


def best_sentences(content: str | None, terms: list[str], most: int = 4) -> list[str]:
    """The best sentences of one content, as evidence.with_snippets scores them."""
    found: dict[str, tuple[int, str]] = {}
    for s in _END.split(_SPACE.sub(" ", content or "").strip(" ")):
        low = s.lower()
        score = 2 * sum(t in low for t in terms) + 2 * bool(re.search(r"[0-9]", low)) + ("%" in low)
        if 20 <= len(s) <= 300 and score:
            found.setdefault(low, (score, s))
    return [s for _, s in sorted(found.values(), key=lambda x: -x[0])[:most]]


@udtf(returnType="id: bigint, rank: int, claim: string, benchmark: string, value: double, delta: double, unit: string", useArrow=True)  # else a map comes in the order of its keys' hashes
class ExtractClaims:
    """extract_claims(terms, benchmarks, TABLE(id, content, ...) PARTITION BY id): the claims of each article; of several benchmarks in a sentence the first in the map's order counts.

    A partition is one article's rows, so no key gathers more than a task can stream; of repeated rows of an id each gives its claims.
    """

    def eval(self, terms: list[str], benchmarks: dict[str, str], row: Row) -> Iterator[tuple]:
        for rank, s in enumerate(best_sentences(row["content"], [*terms, *benchmarks]), 1):
            low = s.lower()
            percent, plain = _PERCENT.search(s), _NUMBER.search(s)
            gain = next(((float(m[1]), unit) for p, unit in _DELTAS if (m := p.search(s))), (None, None))
            value = percent or plain
            yield row["id"], rank, s, next((v for k, v in benchmarks.items() if k in low), None), float(value[1]) if value else None, gain[0], gain[1] or ("%" if percent else None)


def register(spark: SparkSession) -> list[str]:
    """Makes all of these callable from spark.sql in this session, in place of temporary functions of the same names; returns the names."""
    for text_of in (*SCALAR.values(), *TABLE.values()):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text_of}")
    spark.udtf.register("extract_claims", ExtractClaims)
    return [*SCALAR, *TABLE, "extract_claims"]
