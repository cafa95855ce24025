"""Listing pages read by CSS selectors that are data: nested elements, a row for each item."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# How HTML elements end.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element that another one's start ends, if no element of the third set is open in between.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), **{t: ({"p"}, {"button", "td", "th", "li", "article", "section", "div"}) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
}
# End of fixed values.

_STEP = re.compile(r"""\s*(?P<how>[>\s])?\s*(?P<tag>\*|[A-Za-z][\w-]*)?(?P<rest>(?:[.#][\w-]+|\[[^\]]*\]|:first-child)*)""")
_PART = re.compile(r"""(?P<kind>[.#])(?P<name>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$~|]?=)\s*["']?(?P<value>[^"'\]]*)["']?)?\s*\]|(?P<first>:first-child)""")
_TESTS = {
    None: lambda have, want: True, "=": lambda have, want: have == want, "*=": lambda have, want: want in have and want != "", "^=": lambda have, want: have.startswith(want) and want != "",
    "$=": lambda have, want: have.endswith(want) and want != "", "~=": lambda have, want: want in have.split(), "|=": lambda have, want: have == want or have.startswith(want + "-"),
}
_ROWS = ArrayType(StructType([StructField(c, StringType()) for c in ("title", "content", "url")]))


class Element:
    """tag, attributes, parent, number among its parent's elements, and which of the page's texts and elements are inside."""

    __slots__ = ("tag", "attrs", "parent", "nth", "children", "low", "high", "own", "last")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, low: int, own: int) -> None:
        self.tag, self.attrs, self.parent, self.children, self.low, self.high, self.own, self.last = tag, attrs, parent, 0, low, low, own, own
        self.nth = 0
        if parent is not None:
            parent.children += 1
            self.nth = parent.children


class Page(HTMLParser):
    """The elements of a page, in order, by a stack of open tags; what is never closed ends with its parent, or where the next of its kind begins.

    Character references are read as HTML has it, also some without a semicolon; with `references` (names) only these, with theirs.
    """

    def __init__(self, html: str, references: tuple[str, ...] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self.open: list[Element] = []
        self.feed(html if references is None else re.sub(rf"&(?!(?:{'|'.join(map(re.escape, references)) or '(?!)'});)", "&amp;", html))
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        while len(self.open) > depth:
            done = self.open.pop()
            done.high, done.last = len(self.texts), len(self.elements)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends, fences = CLOSED_BY.get(tag, ((), ()))
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag in ends:
                self._end(depth)
                break
            if self.open[depth].tag in fences:
                break
        found = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None, len(self.texts), len(self.elements))
        self.elements.append(found)
        found.last = len(self.elements)
        if tag not in VOID:
            self.open.append(found)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                self._end(depth)
                return

    def handle_data(self, data: str) -> None:
        if not self.open or self.open[-1].tag not in ("script", "style"):
            self.texts.append(data)

    def text(self, element: Element) -> str:
        return "".join(self.texts[element.low : element.high])

    def inside(self, element: Element) -> list[Element]:
        return self.elements[element.own + 1 : element.last]


@lru_cache(maxsize=1024)
def compiled(selector: str) -> tuple[tuple, ...]:
    """Alternatives, each a tuple of (how it follows the one before, tag or None, tests); ValueError for what isn't in the subset: tags, classes, ids, attributes, :first-child, descendants and children."""
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        steps, at, one = [], 0, one.strip()
        while at < len(one):
            m = _STEP.match(one, at)
            if m.end() == at or not (m["tag"] or m["rest"]):
                raise ValueError(f"not a selector that is understood: {selector!r}")
            parts = tuple((p["kind"], p["name"], p["attr"], p["op"], p["value"], p["first"]) for p in _PART.finditer(m["rest"]))
            if sum(len(p[0]) for p in _PART.finditer(m["rest"])) != len(m["rest"]):
                raise ValueError(f"not a selector that is understood: {selector!r}")
            gap = one[at : m.start("tag") if m["tag"] else m.start("rest")]
            steps.append((">" if ">" in gap else " ", None if m["tag"] in (None, "*") else m["tag"].lower(), parts))
            at = m.end()
        if steps:
            out.append(tuple(steps))
    return tuple(out)


def _is(element: Element, tag: str | None, parts: tuple) -> bool:
    if tag is not None and element.tag != tag:
        return False
    for kind, name, attr, op, value, first in parts:
        if first:
            if element.nth != 1:
                return False
        elif kind:
            if name not in element.attrs.get("class" if kind == "." else "id", "").split():
                return False
        elif attr not in element.attrs or not _TESTS[op](element.attrs[attr], value):
            return False
    return True


def _follows(element: Element, steps: tuple, k: int) -> bool:
    if not _is(element, *steps[k][1:]):
        return False
    if k == 0:
        return True
    above = element.parent
    while above is not None:
        if _follows(above, steps, k - 1):
            return True
        if steps[k][0] == ">":
            return False
        above = above.parent
    return False


def matches(element: Element, selector: str) -> bool:
    """Whether the element is one that the selector names in its page."""
    return any(_follows(element, steps, len(steps) - 1) for steps in compiled(selector))


def items(html: str | None, base: str | None, item: str, title: str, content: str, link: str, references: tuple[str, ...] | None = None) -> list[dict[str, str]]:
    """title, content and url of every element that `item` names, nested ones too, from the texts of what the others name inside it; without a `link` selector the item is its own link. Rows without title or content are left out."""
    page, out = Page(html or "", references), []
    for element in page.elements:
        if not matches(element, item):
            continue
        inside = page.inside(element)
        said = lambda selector: " ".join("".join(page.text(e) for e in inside if matches(e, selector)).split())  # noqa: B023, E731
        href = element.attrs.get("href", "") if not link else next((e.attrs["href"] for e in inside if matches(e, link) and "href" in e.attrs), "")
        row = {"title": re.sub(r"^Title:\s+", "", said(title)), "content": said(content), "url": urljoin(base or "", href) if href else ""}
        if row["title"] and row["content"]:
            out.append(row)
    return out


def _selected(references: tuple[str, ...] | None):
    @arrow_udf(_ROWS)
    def selected(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(c, pa.string()) for c in ("title", "content", "url")]))
        for columns in batches:
            yield pa.array([items(*(x.as_py() for x in row), references) for row in zip(*columns, strict=True)], kind)

    return selected


def listings_by_selector(pages: DataFrame, selectors: DataFrame, references: tuple[str, ...] | None = None) -> DataFrame:
    """page_id, pos, title, content, url of pages (page_id, source, url, html) by their source's selectors (source, item, title, content, link; one row a source).

    Pages are parsed where they stand, an Arrow batch at a time; a page is read once and nothing of it is shuffled but for
    the join with its source's selectors. Pages of other sources, null and empty ones give nothing. Unclosed and
    misnested tags end as HTML has it for lists, paragraphs, tables and definition lists. Character references are all
    that HTML knows, as a browser reads them, or only those named in `references`.
    """
    rows = pages.select("page_id", "source", "url", "html").join(selectors.select("source", *(F.coalesce(c, F.lit("")).alias(f"by_{c}") for c in ("item", "title", "content", "link"))), "source")
    found = _selected(references)("html", "url", "by_item", "by_title", "by_content", "by_link")
    return rows.select("page_id", F.posexplode(found).alias("pos", "x")).select("page_id", "pos", "x.title", "x.content", "x.url")
