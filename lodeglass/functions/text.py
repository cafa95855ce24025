"""Text, language, date and URL normalisation as column expressions; all of them but `three_places` stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from lodeglass.functions import lexicons

# Characters counted as CJK, and the characters looked at.
CJK, CJK_SAMPLE = r"[぀-ヿ㐀-䶿一-鿿豈-﫿]", 4000


def collapsed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def cjk_ratio(c: Column) -> Column:
    part = F.substring(c, 1, CJK_SAMPLE)
    return F.regexp_count(part, F.lit(CJK)) / F.greatest(F.lit(1), F.length(part))


def language(c: Column) -> Column:
    return F.when(cjk_ratio(c) > 0.15, "zh").when(cjk_ratio(c) > 0.03, "mixed").otherwise("en")


def needs_translation(c: Column) -> Column:
    return cjk_ratio(c) >= 0.08


def parsed_date(c: Column) -> Column:
    """ISO and RFC 822 dates, then year-month-day in Chinese or with . / -, then a Chinese year and month (its first day); else null."""
    t = F.trim(c)
    part = lambda pattern, i: F.try_to_number(F.nullif(F.regexp_extract(t, pattern, i), F.lit("")), F.lit("9999")).cast("int")
    built = lambda pattern, day: F.try_to_timestamp(F.format_string("%04d-%02d-%02d", part(pattern, 1), part(pattern, 2), F.lit(1) if day is None else part(pattern, 3)), F.lit("yyyy-MM-dd"))
    full, dotted, month = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})", r"(\d{4})[./-](\d{1,2})[./-](\d{1,2})", r"(\d{4})\s*年\s*(\d{1,2})\s*月"
    known = [t.try_cast("timestamp"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), "GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))]
    return F.coalesce(*known, *(F.when(t.rlike(p), built(p, d)) for p, d in ((full, 3), (dotted, 3), (month, None))))


def canonical_url(url: Column) -> Column:
    """The URL without fragment and tracking parameters, its other parameters sorted; what can't be parsed stays as it is."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.try_parse_url(bare, F.lit("QUERY"))
    stripped = F.array(*map(F.lit, lexicons.TRACKING_PARAMETERS))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(stripped, F.lower(F.substring_index(p, "=", 1)))))
    path = F.regexp_replace(bare, r"\?.*$", "")
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNull(), url).when(query.isNull(), bare).when(F.size(kept) == 0, path).otherwise(F.concat(path, F.lit("?"), F.array_join(kept, "&")))


def unsafe_reason(url: Column) -> Column:
    """Why a URL must not be fetched, or null."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    out = F.when(url.isNull() | (host == ""), "invalid").when(~scheme.isin("http", "https"), "scheme").when(host.isin("localhost", "127.0.0.1", "[::1]"), "localhost")
    out = out.when(host.rlike(r"^127\."), "loopback").when(host.rlike(r"^169\.254\."), "link-local")
    out = out.when(host.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|0\.)"), "private address")
    return out.when(host.rlike(r"^\[?f[cd]"), "private address").when(host.isin("metadata.google.internal", "metadata"), "metadata host")


def arxiv_id(c: Column) -> Column:
    """A preprint number, new style (dddd.ddddd) before old style (area/ddddddd), with its version; null if there is none."""
    found = lambda p: F.nullif(F.concat(F.regexp_extract(c, p, 1), F.coalesce(F.regexp_extract(c, p, 2), F.lit(""))), F.lit(""))
    return F.coalesce(found(r"\b(\d{4}\.\d{4,5})(v\d+)?\b"), found(r"(?i)\b([a-z\-]+(?:\.[a-z\-]+)?/\d{7})(v\d+)?\b"))


def slug_title(url: Column) -> Column:
    """The last path segment as words with capitals; the whole URL if it has no path."""
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")
    slug = F.regexp_replace(F.translate(F.element_at(parts, -1), "-_", "  "), r"\.\w+$", "")
    words = F.transform(F.split(slug, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.when(F.size(parts) > 0, F.array_join(words, " ")).otherwise(url)


def sentences(c: Column) -> Column:
    """An array of sentences: split after full stops, question and exclamation marks that white space follows."""
    return F.filter(F.split(collapsed(c), r"(?<=[.!?。！？；])\s+"), lambda s: s != "")


def any_term(low: Column, terms) -> Column:
    """Whether text that is in lower case contains one of the terms: a dozen at a time, as the JVM does not compile long methods, and done at the first dozen with a hit."""
    dozens = [terms[i : i + 12] for i in range(0, len(terms), 12)]
    return reduce(lambda a, b: a | b, (F.array_contains(F.array(*(F.contains(low, F.lit(t)) for t in dozen)), True) for dozen in dozens), F.lit(False))


def terms_in(low: Column, terms) -> Column:
    """The terms that text in lower case contains, in list order. One comparison a term, all compiled."""
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms))) if terms else F.array().cast("array<string>")


def first_term(text: Column, terms: dict[str, str]) -> Column:
    """The label of the first term that lower-cased text contains."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.contains(low, F.lit(t)), F.lit(label)) for t, label in terms.items()), F.lit(None).cast("string"))


def claim_label(benchmark: Column, metric: Column, value: Column, delta: Column, unit: Column, claim: Column) -> Column:
    """benchmark · metric · value · Δ delta, of what there is; else the claim."""
    u = F.coalesce(unit, F.lit(""))
    parts = F.concat_ws(" · ", F.nullif(benchmark, F.lit("")), F.nullif(metric, F.lit("")), F.concat(value.cast("string"), u), F.concat(F.lit("Δ "), delta.cast("string"), u))
    return F.coalesce(F.nullif(parts, F.lit("")), claim)


@arrow_udf(ArrayType(StringType()))
def three_places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """An array of numbers as texts with three decimal places, of the exact values of the doubles; halves go to the even digit.

    The JVM's format_string starts from the shortest digits that tell a double from others: it has zeros after the 17th
    digit, and makes 1.001 of 1.0005, which is a little less than that.
    """
    for lists in batches:
        yield pa.array([x and [None if v is None else f"{v:.3f}" for v in x] for x in lists.to_pylist()], pa.list_(pa.string()))
