"""Personal data in texts: fixed shapes, and more candidates chosen by boosted trees."""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lodeglass.llm.boosting import BoostedTrees, threshold

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Generators: what may be an address, with an @ or one written out, and runs of digits with any separators.
_AT = re.compile(r"@|[\[({]\x20?at\x20?[\])}]", re.IGNORECASE)
_RIGHT = re.compile(r"\x20?[\w-]+(?:\x20?(?:\.|[\[({]\x20?dot\x20?[\])}])\x20?[\w-]+)+", re.IGNORECASE)
_LOCAL = re.compile(r"[\w.%+-]")
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().,/:-]{0,2}[0-9]){6,}")
_GROUP = re.compile(r"[+(]{0,2}[0-9]+")

FOUND = "struct<base:array<struct<kind:string,start:int,end:int>>,spans:array<struct<kind:string,start:int,end:int,score:double>>>"
_SPAN = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
_FOUND = pa.struct([("base", pa.list_(pa.struct(_SPAN))), ("spans", pa.list_(pa.struct([*_SPAN, ("score", pa.float64())])))])


def luhn(digits: str) -> bool:
    """Whether the digits end in their check digit."""
    twice = "0246813579"
    return sum(int(twice[int(d)]) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at)):
            yield a, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed shapes in a whole text, in code points, by kind as in KINDS, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 15 < m.end() - m.start() < 40 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


class Intervals:
    """Spans sorted by their starts, with the furthest end so far, so that what meets a span is found by binary search."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            self.starts.append(a)
            self.ends.append(max(b, self.ends[-1]) if self.ends else b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that could be personal data, each with the kind it would be; of any length, in whatever case.

    Addresses are what stands on either side of an @ or a bracketed at. Numbers are all runs of consecutive groups of digits
    inside a run of digits and separators that have as many digits as a kind can have.
    """
    out = set()
    for m in _AT.finditer(text):
        a = end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        while a > 0 and _LOCAL.match(text[a - 1]):
            a -= 1
        if 0 <= a < end and (right := _RIGHT.match(text, m.end())):
            out.add(("email", a, right.end()))
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            groups = [(g.start(), g.end(), sum(c.isdigit() for c in g[0])) for g in _GROUP.finditer(text, m.start(), m.end())]
            for i, (a, _, _) in enumerate(groups):
                n = 0
                for _, b, size in groups[i:]:
                    n += size
                    if n > 19:
                        break
                    if 13 <= n:
                        out.add(("card", a, b))
                    if 7 <= n <= 15:
                        out.add(("phone", a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


#: How look-alikes and right spans are written in training, besides as they stand.
_NOISE_GAPS = (" ", "-", ".", ", ", ",", "/", ":", " (", ") ", "")
_ISSUERS = ("3", "4")  #: first digits of cards of fewer than 16 digits
_STYLES = ("({}) {}-{}", "{}-{}-{}", "{} {} {}")
_DOT = re.compile(r"\x20?(?:\.|[\[({]\x20?dot\x20?[\])}])\x20?", re.IGNORECASE)


def _check(body: str) -> str:
    """The digits with a last one that makes them pass."""
    return body + next(c for c in "0123456789" if luhn(body + c))


def examples(text: str, span: tuple[str, int, int]) -> list[tuple[str, tuple[str, int, int], bool]]:
    """(text, candidate, label) that a fixed shape gives: itself, its parts and digits written in other ways (right), and noise in its place (wrong).

    Labels come from the fixed match alone, by what `features` do not see: the @, the + and the country's digits behind it,
    and how many digits over 13. Noise is drawn, not ruled: random digits in random groups with random gaps, sometimes
    joined to a letter, and words of the surroundings around a bracketed at. It is the same each time for a place.
    """
    kind, a, b = span
    s, near, rng = text[a:b], text[max(0, a - 80) : a], random.Random(zlib.crc32(f"{kind}:{a}:{text[max(0, a - 80):b]}".encode("utf-8", "replace")))
    out = [(text[max(0, a - 80) : b + 80], (kind, min(a, 80), min(a, 80) + b - a), True)]

    def put(shown: str, label: bool, glued: str = "") -> None:
        at = len(near) + len(glued)
        out.append((near + glued + shown + text[b : b + 80], (kind, at, at + len(shown)), label))

    if kind == "email":
        words = re.findall(r"[^\W\d_]{2,}", text[max(0, a - 200) : a] + " " + text[b : b + 200]) or ["and", "then"]
        own, domain = s.split("@", 1)
        put(f"{rng.choice(words)}@{domain}", True)
        put(f"{rng.choice((own, rng.choice(words)))}@{rng.choice(words)}.{domain}", True)
        for tail in (". {}", ".{}", " . {}", ".{}{}"):
            at, w = rng.choice(("(at)", " (at) ", " [at] ", "{at}")), [rng.choice(words) for _ in range(4)]
            end = w[2].capitalize() if rng.random() < 0.5 else w[2]
            put(rng.choice((own, w[0])) + at + w[1] + (tail.format(rng.randrange(1000), rng.choice(("", w[3]))) if tail == ".{}{}" else tail.format(end if len(end) > 4 or " " in tail else end + w[3])), False)
    elif kind in ("card", "phone"):
        d = digits_of(_bare(kind, s))
        if kind == "card":
            for n in (13, 14, 15):
                put(_check(rng.choice((d[0], *_ISSUERS)) + d[1 : n - 1]), True)
        elif len(groups := re.findall(r"[0-9]+", _bare(kind, s))) == 3:
            put(rng.choice(_STYLES).format(*groups), True)
        for _ in range(4):
            n, shown = rng.randrange(13, 20) if kind == "card" else rng.randrange(7, 13), ""
            whole, gap = rng.random() < (0.7 if kind == "card" else 0.2), rng.choice(_NOISE_GAPS)
            while n:
                k = n if whole else min(n, rng.randrange(1, 7))
                shown += "".join(rng.choice("0123456789") for _ in range(k))
                n -= k
                shown += (gap if rng.random() < 0.6 else rng.choice(_NOISE_GAPS)) if n else ""
            put(shown, False, rng.choice(("", "", "v", "No.", "$", "x")))
    return out


def _bare(kind: str, s: str) -> str:
    """A number without what shows a fixed shape: a + in front, and the country's group of digits behind it."""
    return re.sub(r"^\+[0-9]{1,3}(?![0-9])[\x20.-]*|^\+", "", s) if kind == "phone" else s


_CUES = [re.compile(p, re.IGNORECASE) for p in (r"mail|contact|write", r"tel|phone|call|fax|mobile", r"card|visa|credit|iban|account|pay")]


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format of the span and of what stands around it, masked: as if an @ were written out, without a + and the country's digits, and with 13 digits for any more."""
    kind, a, b = span
    s, before, after = _bare(kind, text[a:b]), text[max(0, a - 40) : a], text[b : b + 40]
    around = before + after
    local, labels, spaced = "", [], False
    if kind == "email":
        m = _AT.search(s)
        local, domain = s[: m.start()].strip(), s[m.end() :].strip()
        labels, spaced = _DOT.split(domain), bool(re.search(r"\x20\.|\.\x20", domain))
    d, groups = digits_of(s) if kind != "email" else "", re.findall(r"[0-9]+", s) if kind != "email" else []
    gaps = [g for g in re.split(r"[0-9]+", s)[1:-1]] if groups else []
    last = labels[-1] if labels else ""
    size = [len(g) for g in groups]
    return [
        *(kind == k for k in KINDS), len(local), sum(c.isdigit() for c in local), local[:1].isalnum(), len(labels), len(last), last.isalpha(), last[1:].islower() != last[:1].islower() if len(last) > 1 else False, spaced,
        max(map(len, labels), default=0), min(len(d), 13), len(groups), *(size[k] if k < len(size) else 0 for k in range(3)), size[-1] if size else 0, max(size, default=0), min(size, default=0),
        any(set(g) & set(",:/") for g in gaps), len({g for g in gaps}), max(map(len, gaps), default=0), len(d) >= 13 and luhn(d), int(d[0]) if len(d) >= 13 else 0, bool(groups) and groups[0][:2] in ("19", "20") and size[0] == 4,
        before[-1:].isalnum() or after[:1].isalnum(), before[-1:] in "$€£#=-./,:" and bool(before), sum(c.isdigit() for c in around) / (len(around) + 1), *(bool(c.search(before)) for c in _CUES),
    ]


def train(docs: DataFrame, sample: int = 20_000, rows: int = 50_000, precision: float = 0.95) -> tuple[BoostedTrees, dict[str, float]] | None:
    """Trees and a threshold by kind, fitted on a bounded sample: the `sample` different (doc_id, text) whose hashes are smallest, and at most `rows` examples of them.

    There are no labels of personal data. What is known is where fixed shapes stand: each gives right and wrong spans
    (`examples`) whose labels rest on the fixed match, which the features are blind to. Candidates that cut a fixed shape, or are of
    another kind than the one that they lie in, are wrong too. What touches no fixed shape is unknown, and not learnt from. Documents of
    two thirds of the hashes grow the trees; on the others the threshold of each kind is the lowest score at and above
    which `precision` of the spans are right, 0.5 at least. A kind without right spans there is never added, as ip always.
    None where the sample doesn't hold both classes.
    """
    rows_of = docs.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "text")
    last = rows_of.select("h", "t").distinct().orderBy("h", "t").limit(sample).agg(F.max(F.struct("h", "t")).alias("last")).first()["last"]
    if last is None:
        return None
    chosen = rows_of.filter((F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("t") <= last.t))).groupBy("h", "t").agg(F.first("text").alias("text"))

    @arrow_udf("array<array<double>>")
    def rated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([learnt(t) for t in batch.to_pylist()], pa.list_(pa.list_(pa.float64())))

    def learnt(text: str | None) -> list[list[float]]:
        base = [s for s in base_spans(text) if s[0] != "ip"]
        every, inside = Intervals([x[1:] for x in base]), {k: sorted(x[1:] for x in base if x[0] == k) for k in KINDS}
        found = [(near, s, label) for b in base for near, s, label in examples(text, b)]
        for s in candidates(text) if base else []:
            k = bisect_left(inside[s[0]], (s[1], 0))
            if every.meets(*s[1:]) and not (k < len(inside[s[0]]) and inside[s[0]][k][1] <= s[2]) and not (s[0] == "phone" and _inside(inside["phone"], s)):
                found.append((text, s, False))
        return [[float(label), *map(float, features(near, s))] for near, s, label in found]

    got = chosen.select("h", "t", F.posexplode(rated("text")).alias("i", "row")).orderBy("h", "t", "i").limit(rows).select((F.pmod("h", F.lit(3)) == 2).alias("third"), "row").collect()
    if not got:
        return None
    x = np.array([r.row for r in got])
    y, x, third = x[:, 0], x[:, 1:], np.array([r.third for r in got])
    if not 0 < y[~third].sum() < (~third).sum():
        return None
    trees = BoostedTrees(rounds=60, depth=4).fit(x[~third], y[~third])
    x, y = x[third], y[third]
    p = trees.score(x)
    return trees, {k: 2.0 if k == "ip" else max(0.5, threshold(p[m], y[m], precision)) for j, k in enumerate(KINDS) for m in [x[:, j] == 1]}


def _inside(spans: list[tuple[int, int]], s: tuple[str, int, int]) -> bool:
    """Whether a span lies in one of some sorted ones, as a phone number without its country's digits does."""
    k = bisect_left(spans, (s[1] + 1, 0))
    return k > 0 and spans[k - 1][1] >= s[2]


def personal_data(text: Column | str, model: tuple[BoostedTrees, dict[str, float]] | None) -> Column:
    """A column of the fixed shapes (`base`) and of all spans: these, and the candidates that the model selects.

    A candidate counts where its score reaches its kind's threshold and it meets no span taken before: fixed shapes
    first, then higher scores, then earlier starts. Null and empty texts have none.
    """
    @arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([one(t) for t in batch.to_pylist()], _FOUND)

    def one(t: str | None) -> dict:
        base = base_spans(t)
        spans = [(*s, 1.0) for s in base]
        fixed, taken = Intervals([s[1:] for s in base]), []
        if t and model and (found := [c for c in candidates(t) if not fixed.meets(*c[1:])]):
            scores = model[0].score(np.array([features(t, c) for c in found], float))
            for score, c in sorted(zip(scores.tolist(), found, strict=True), key=lambda x: (-x[0], x[1][1], x[1][2], x[1][0])):
                if score < model[1][c[0]]:
                    continue
                k = bisect_left(taken, (c[2], 0))  # those taken so far are apart from one another, so the last that begins before the end tells
                if not k or taken[k - 1][1] <= c[1]:
                    insort(taken, c[1:])
                    spans.append((*c, score))
        spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
        return {"base": [dict(zip(("kind", "start", "end"), s, strict=True)) for s in base], "spans": [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans]}

    return find(text)


def with_personal_data(docs: DataFrame, column: str = "personal", **options) -> DataFrame:
    """The documents with what is found in each, fixed shapes by kind and start, all spans likewise.

    A column of that name is replaced; all other columns, whatever their names, and all rows, repeated ones too, stay.
    Null and empty texts have no spans; an empty table stays empty. Time is in proportion to a text's length, but for
    the logarithm of its number of spans.
    """
    return docs.withColumn(column, personal_data("text", train(docs, **options)))
