"""Listing pages by selectors: nested elements, the subset of CSS, and a golden page for each kind of source."""

import pytest

from lodeglass.sources.selectors import Page, compiled, items, listings_by_selector, matches

#: source -> (selectors, page, rows); the selectors as they are configured for such sources.
GOLDEN = {
    "list items by class": ((".ui-list__item", ".ui-title-text", ".prose", "a"), '<ul><li class="x ui-list__item"><a href="/b/1"><span class="ui-title-text">One</span></a><div class="prose">First <b>body</b></div></li><li class="ui-list__item-no"><span class="ui-title-text">No</span></li></ul>', [("One", "First body", "https://s.org/b/1")]),
    "cards": (("article.card-blog", "h3.card__title", ".meta", "a"), '<article class="card-blog"><h3 class="card__title">Two</h3><p class="meta">On Monday</p><a href="https://o.org/2">x</a></article><article><h3 class="card__title">no</h3></article>', [("Two", "On Monday", "https://o.org/2")]),
    "links that are items": (('a[href*="/news/"][class*="FeaturedGrid"], a[href*="/news/"][class*="PublicationList"]', "h2, .headline-4", "p.body-3, p", ""), '<a href="/news/x" class="FeaturedGrid_a"><h2>Three</h2><p class="body-3">Body</p></a><a href="/about" class="FeaturedGrid_a"><h2>No</h2><p>x</p></a><a class="m PublicationList_b" href="/news/y"><span class="headline-4">Four</span><p>Text</p></a>', [("Three", "Body", "https://s.org/news/x"), ("Four", "Text", "https://s.org/news/y")]),
    "entries": (("article", ".entry-title", ".entry-content", "a.entry-title"), '<article><a class="entry-title" href="e/5">Five</a><div class="entry-content"><p>A</p><p>B</p></div></article>', [("Five", "AB", "https://s.org/list/e/5")]),
    "posts": (("article.post", "h2.post-title", ".post-content", "a.post-link"), '<article class="post"><h2 class="post-title">Six</h2><a class="other" href="/no"></a><a class="post-link" href="/6?a=1&amp;b=2">go</a><div class="post-content">Text &amp; more</div></article>', [("Six", "Text & more", "https://s.org/6?a=1&b=2")]),
    "definition lists": (("dd", ".list-title", ".list-authors, .list-comments, .list-subjects", "dt a:first-child"), '<dl><dt><a href="/abs/1">[1]</a><dd><div class="list-title">Title: Seven</div><div class="list-authors">Ann\nBob</div><div class="list-subjects">cs</div></dl>', [("Seven", "Ann Bobcs", "")]),
    "links in main": (("main a", "h3, h2, .title", "p, .summary, .desc", ""), '<a href="/no"><h3>no</h3><p>x</p></a><main><div><a href="/8"><h3>Eight</h3><p class="desc">D</p></a></div></main>', [("Eight", "D", "https://s.org/8")]),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_pages(name):
    selectors, html, want = GOLDEN[name]
    assert [(r["title"], r["content"], r["url"]) for r in items(html, "https://s.org/list/", *selectors)] == want


def names(html, selector):
    page = Page(html)
    return [e.attrs.get("id") for e in page.elements if matches(e, selector)]


def test_nested_lists_and_articles():
    html = '<ul id="u"><li id="a">A<ul><li id="b">B<li id="c">C</ul><li id="d">D</ul><article id="e">x<article id="f">y</article>z</article>'
    page = Page(html)
    text = {e.attrs.get("id"): page.text(e) for e in page.elements}
    assert text == {"u": "ABCD", "a": "ABC", None: "BC", "b": "B", "c": "C", "d": "D", "e": "xyz", "f": "y"}
    assert names(html, "li li") == ["b", "c"] and names(html, "ul > li") == ["a", "b", "c", "d"] and names(html, "#u > li") == ["a", "d"]
    assert names(html, "article article, #a") == ["a", "f"] and names(html, "li:first-child") == ["a", "b"]


def test_attribute_operators():
    html = '<a id="1" href="/x/news/y" rel="no follow"><a id="2" href="/news" lang="en-GB"><a id="3">'
    assert names(html, 'a[href*="/news"]') == ["1", "2"] and names(html, "[href^='/news']") == ["2"] and names(html, "a[href$=y]") == ["1"]
    assert names(html, "a[rel~=follow]") == ["1"] and names(html, "[lang|=en]") == ["2"] and names(html, "a[href]") == ["1", "2"] and names(html, '[href="/news"]') == ["2"] and names(html, '[href*=""]') == []


@pytest.mark.parametrize("odd", ["a + b", "a:hover", "[", "a >", "::x"])
def test_what_is_not_understood_is_an_error(odd):
    with pytest.raises(ValueError, match="selector"):
        compiled(odd)


def test_broken_pages():
    assert Page("<p>a<p>b<div>c</p>d").elements[1].tag == "p"
    assert items("<li><h2>a</h2>b</b></i><script>var x='<h2>no</h2>'</script><p>c", None, "li", "h2", "p", "a") == [{"title": "a", "content": "c", "url": ""}]
    assert items(None, None, "li", "a", "a", "a") == items("", None, "li", "a", "a", "a") == items("<", None, "li", "a", "a", "a") == []
    deep = "<div>" * 5000 + "<li><a>x</a></li>"
    assert len(items(deep, None, "div li", "a", "a", "a")) == 1


def test_pages_by_their_sources(spark):
    pages = spark.createDataFrame([(k, name, "https://s.org/list/", html) for k, (name, (_, html, _)) in enumerate(GOLDEN.items())] + [(90, "cards", None, None), (91, "unknown", "u", "<article>x</article>")], "page_id int, source string, url string, html string")
    selectors = spark.createDataFrame([(name, *s[0]) for name, s in GOLDEN.items()], "source string, item string, title string, content string, link string")
    got = listings_by_selector(pages, selectors).orderBy("page_id", "pos").collect()
    assert [(r.title, r.content, r.url) for r in got] == [x for _, _, want in GOLDEN.values() for x in want]
    assert listings_by_selector(pages.filter("false"), selectors).count() == 0
