"""Secrets in texts: fixed shapes, and weaker parts of credentials that only count beside their complement."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

#: In the order in which spans are listed; the first three are the fixed shapes.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}", re.IGNORECASE | re.ASCII)
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:pwd|pass|key|auth|bearer|credentials?|private_?key|client_?secret)[\"']?\x20*[:=]\x20*[\"']?[^\s\"']{6,}", re.IGNORECASE | re.ASCII)
#: What a loose name before a colon and a mere word is: a sentence, not a secret.
_PROSE = re.compile(r"(?:pass|key|auth|bearer|credentials?)\x20*:\x20+[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?)]*", re.IGNORECASE)
_ENDPOINT = re.compile(r"\b(?:https?|ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{3,}|(?<![A-Za-z0-9])(?:host|server|endpoint)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}(?::[0-9]+)?", re.IGNORECASE | re.ASCII)
#: A name and a password in front of a URL's host.
_IN_URL = re.compile(r"://([^\s:/@\"'<>]+):([^\s:/@\"'<>]+)@")
_ASSIGN_CUES = ("passw", "secret", "token", "apikey", "api_key")
_CUES = ("user", "login", "account", "client", "access", "pwd", "pass", "key", "auth", "bearer", "credential", "://", "host", "server", "endpoint")

FOUND = "array<struct<kind:string,start:int,end:int>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def link(parts: list[tuple[str, int, int, bool]], reach: int, overlap: bool = False) -> list[tuple[str, int, int]]:
    """The weak parts, of (role, start, end, weak), that have a complement: a secret an identifier or endpoint, these a secret.

    A part's scope is its own interval and `reach` characters around it. A complement must begin in it or, with
    `overlap`, meet it with any of its own interval, however long that is. Parts are sorted by their starts once, and
    each looks up its scope by binary search (with `overlap`, then the furthest end so far), so that no pairs are formed.
    """
    starts: dict[bool, list[int]] = {True: [], False: []}
    ends: dict[bool, list[int]] = {True: [], False: []}
    for role, a, b, _ in sorted(parts, key=lambda p: p[1]):
        secret = role == "secret"
        starts[secret].append(a)
        ends[secret].append(max(b, ends[secret][-1]) if ends[secret] else b)
    out = []
    for role, a, b, weak in parts:
        other, last = starts[role != "secret"], ends[role != "secret"]
        k = bisect_right(other, b + reach)
        if weak and k and (last if overlap else other)[k - 1] >= a - reach:
            out.append((role, a, b))
    return out


def _outermost(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that lie in no other of their kind."""
    out, last = [], dict.fromkeys(KINDS, -1)
    for kind, a, b in sorted(set(spans), key=lambda s: (s[1], -s[2])):
        if b > last[kind]:
            out.append((kind, a, b))
            last[kind] = b
    return out


def find_secrets(text: str | None, reach: int = 200) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of a whole text in code points, by start, then kind as in KINDS."""
    if not text:
        return []
    low, found, parts = text.lower(), [], []
    if any(c in low for c in _ASSIGN_CUES):
        for m in _ASSIGN.finditer(text):
            strong = len(m[2]) >= 12
            parts.append(("secret", *m.span(), not strong))
            if strong:
                found.append(("assign", *m.span()))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                found.append(("access", *m.span()))
                parts.append(("identifier", *m.span(), False))
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if (":" in text or "=" in text) and any(c in low for c in _CUES):
        for role, pattern in (("identifier", _IDENTIFIER), ("secret", _SECRET), ("endpoint", _ENDPOINT)):
            parts += [(role, *m.span(), True) for m in pattern.finditer(text) if role != "secret" or not _prose(text, m)]
        for m in _IN_URL.finditer(text) if "://" in text else ():
            parts += [("identifier", *m.span(1), True), ("secret", *m.span(2), True)]
        found += _outermost(link(parts, reach, overlap=True))
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _prose(text: str, m: re.Match) -> bool:
    """Whether a loose part reads as a sentence, such as `the key: important people`; not behind another name's part, as in db_pass."""
    return bool(_PROSE.fullmatch(m[0])) and text[m.start() - 1 : m.start()] not in ("_", "-", ".")


def secrets(text: Column | str, reach: int = 200) -> Column:
    """A column of the spans (kind, start, end) in each whole text.

    Fixed shapes: `assign`, a named value of 12 characters or more; `access`, an access key id of 18 or more; `hex`, a
    run of 16 hexadecimal digits or more. Weak parts (account names, short or loosely named secrets, endpoints) are
    reported as `identifier`, `secret` and `endpoint` only where some of a complementary part lies within `reach`
    characters. Spans are whole, however long a value is and however many spaces stand around its sign. A loose name
    with a colon, a space and a word of letters alone is prose, and no part.
    Null and empty texts have none.
    """
    @arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t, reach)] for t in batch.to_pylist()], _FOUND)

    return find(text)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by [REDACTED]."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redacted(text: Column | str, reach: int = 200) -> Column:
    """A column of the texts without what `secrets` finds in them; null stays null."""
    @arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([t and redact(t, find_secrets(t, reach)) for t in batch.to_pylist()], pa.string())

    return clean(text)


def with_secrets(docs: DataFrame, column: str = "secrets", reach: int = 200) -> DataFrame:
    """The documents with the spans found in each, by start, then kind as in KINDS, then end.

    A column of that name is replaced; all other columns, whatever their names, and all rows, repeated ones too, stay.
    Null and empty texts have no spans; an empty table stays empty. Time is in proportion to a text's length, but for
    the logarithm of its number of parts.
    """
    return docs.withColumn(column, secrets("text", reach))
