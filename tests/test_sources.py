from lodeglass.operators import joins
from lodeglass.sources import landed


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>T</title><description>D</description><link>https://a.org/1</link><pubDate>x</pubDate></item><item><title></title></item><item><title>Only</title><guid>g</guid></item></channel></rss>")
    (tmp_path / "b.xml").write_text('<feed><entry><title>E</title><summary>S</summary><link href="https://a.org/2"/><updated>2025-01-05</updated><id>i</id></entry></feed>')
    got = {r.title: (r.content, r.url) for r in landed.feed_items(spark, str(tmp_path / "a.xml"), "s").collect()}
    assert got == {"T": ("D", "https://a.org/1"), "Only": ("Only", "g")}
    assert [(r.title, r.content, r.url, r.published) for r in landed.feed_items(spark, str(tmp_path / "b.xml"), "s", atom=True).collect()] == [("E", "S", "https://a.org/2", "2025-01-05")]


def test_sitemaps(spark):
    urls = spark.createDataFrame([("s", "https://a.org/research/1", 0), ("s", "https://b.org/research/2", 1), ("s", "https://a.org/jobs", 2), ("s", "https://a.org/research/1", 3), ("s", "https://a.org/research/0", 4)], "source string, loc string, pos int")
    hosts = spark.createDataFrame([("s", "a.org")], "source string, host string")
    assert sorted(rows(landed.sitemap_urls(urls, hosts, "research"))) == [("s", "https://a.org/research/0"), ("s", "https://a.org/research/1")]
    assert rows(landed.sitemap_urls(urls, hosts, "research", 1)) == [("s", "https://a.org/research/1")]


def test_listings(spark):
    html = '<article><h2>One</h2><p>Body <b>x</b></p><a href="/1">go</a></article><article><h2></h2><p>none</p></article>'
    pages = spark.createDataFrame([(1, "https://a.org/list", html)], "page_id int, url string, html string")
    assert rows(landed.listings(pages, "(?is)<article>(.*?)</article>", "(?is)<h2>(.*?)</h2>", "(?is)<p>(.*?)</p>", 'href="([^"]*)"')) == [(1, 0, "One", "Body x", "https://a.org/1")]
    html = '<dl><dt><a href="/abs/1">1</a></dt><dd><div class="list-title">Title: A study</div>text</dd><dt><a href="/abs/2">2</a></dt></dl>'
    got = rows(landed.paired_listing(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string"), "https://x.org"))
    assert got == [(1, 0, "A study", "Title: A study text", "https://x.org/abs/1")]


def test_json_sources(spark):
    raw = lambda s: spark.createDataFrame([(s,)], "raw string")
    assert rows(landed.leaderboard(raw('[{"teamName":"A","score":0.5,"rank":1},{"publicScore":0.4},{"displayName":"C","position":7}]'))) == [(1, "A", 0.5), (2, "Team 2", 0.4), (7, "C", 0.0)]
    got = rows(landed.discussions(raw('[{"title":"t","body":null,"labels":[{"name":"a"},{"name":"b"}]},{"title":"u","body":"%s","user":{"login":"me"}}]' % ("x" * 600))))
    assert got[0] == ("t", "", "general", "unknown", "a, b") and len(got[1][1]) == 500 and got[1][3] == "me"
    assert rows(landed.search_results(raw('{"web":{"results":[{"title":"t","url":"u","description":"d"},{"title":"x"}]}}'))) == [("t", "u", "d")]
    assert rows(landed.search_results(raw("broken"))) == []


def test_leaderboard_tables(spark):
    live = spark.createDataFrame([("a", "x", "12.5%"), ("a", "y", "0"), ("b", "z", "n/a")], "source string, team string, shown string")
    live = live.select("source", "team", landed.score_of(live.shown).alias("score"))
    snapshot = spark.createDataFrame([("a", "old", 0.1), ("b", "old", 0.2)], "source string, team string, score double")
    assert sorted(rows(landed.with_snapshot(live, snapshot))) == [("a", "x", 0.125, "live"), ("b", "old", 0.2, "manual_snapshot")]


def test_cascade(spark):
    found = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 99, "seed")], "source string, strategy_rank int, title string")
    assert sorted(rows(joins.first_strategy(found).select("source", "title"))) == [("a", "y"), ("a", "z"), ("b", "seed")]


def test_sitemap_files(spark):
    locs = lambda tag, *urls: "".join(f"<{tag}><loc> {u} </loc></{tag}>" for u in urls)
    files = [
        ("s", 1, "https://a.org/sitemap.xml", f"<sitemapindex>{locs('sitemap', *(f'https://a.org/sitemap-{k}.xml' for k in range(3)))}</sitemapindex>"),
        ("s", None, "https://a.org/sitemap-0.xml", f"<urlset>{locs('url', 'https://a.org/news/the-first_one.html?a=1&amp;b=2', 'https://b.org/news/x')}</urlset>"),
        ("s", None, "https://a.org/sitemap-1.xml", f"<urlset>{locs('url', 'https://a.org/paper/10', 'https://a.org/news/the-first_one.html?a=1&amp;b=2')}</urlset>"),
        ("s", None, "https://a.org/sitemap-2.xml", f"<urlset>{locs('url', 'https://a.org/news/never')}</urlset>"),
        ("t", 1, "https://t.org/sitemap.xml", f"<urlset>{locs('url', 'https://t.org/jobs')}</urlset>"),
        ("t", 2, "https://t.org/sitemap_index.xml", f"<urlset>{locs('url', 'https://t.org/news/2')}</urlset>"),
        ("u", 1, "https://u.org/sitemap.xml", "not xml"),
    ]
    table = spark.createDataFrame(files, "source string, rank int, url string, xml string")
    hosts = spark.createDataFrame([(x, f"{'a' if x == 's' else x}.org") for x in "stu"], "source string, host string")
    got = sorted((r.source, r.title, r.url) for r in landed.sitemap_articles(table, hosts, "news|paper").collect())
    assert got == [("s", "10", "https://a.org/paper/10"), ("s", "The First One", "https://a.org/news/the-first_one.html?a=1&b=2"), ("t", "2", "https://t.org/news/2")]
    assert [r.url for r in landed.sitemap_articles(table, hosts, "news|paper", 1).filter("source = 's'").collect()] == ["https://a.org/news/the-first_one.html?a=1&b=2"]


def test_leaderboards_shown_as_tables_points_and_lines(spark):
    table = "<table><thead><tr><td>Team</td><td>90%</td></tr></thead><tr><td><b>A</b></td><td>12.5%</td></tr><tr><td>B</td><td>-</td></tr><tr><td></td><td>3</td></tr><tr><td>one</td></tr></table>"
    points = '<svg><circle data-score="40" data-team="P"/><circle data-score="0"/><circle data-score="20"/></svg>'
    pages = spark.createDataFrame([("t", table), ("p", points), ("both", table + points), ("none", "<p>")], "source string, html string")
    got = sorted(rows(landed.table_entries(pages)))
    assert got == [("both", 1, "A", 0.125), ("both", 3, "Team 3", 0.03), ("p", 1, "P", 0.4), ("p", 3, "Entry 3", 0.2), ("t", 1, "A", 0.125), ("t", 3, "Team 3", 0.03)]
    lines = spark.createDataFrame([("c", 0, "A,12.5%"), ("c", 1, "B,"), ("c", 2, '"C, too",0.25')], "source string, pos int, line string")
    assert rows(landed.csv_entries(lines)) == [("c", 1, "A", 0.125), ("c", 3, "C, too", 0.25)]
    live = spark.createDataFrame([("a", 0.5), ("f", 0.5)], "source string, score double")
    snapshot = spark.createDataFrame([(x, 0.24) for x in "abf"], "source string, score double")
    failed = spark.createDataFrame([("f",), ("g",)], "source string")
    assert sorted(rows(landed.with_snapshot(live, snapshot, failed))) == [("a", 0.5, "live"), ("b", 0.24, "manual_snapshot"), ("f", 0.0, "unavailable"), ("g", 0.0, "unavailable")]


def test_repository_replies(spark):
    raw = lambda s: spark.createDataFrame([(s,)], "raw string")
    assert rows(landed.releases(raw('[{"name":"","tag_name":"v1","body":"%s","author":{"login":"me"},"published_at":"2025"},{"tag_name":"v2"}]' % ("x" * 600)))) == [("v1", "v1", "x" * 500, "me", "2025"), ("v2", "v2", "", "unknown", None)]
    assert rows(landed.commits(raw('[{"sha":"1","commit":{"message":"m","author":{"name":"n","date":"d"}},"author":{"login":"l"}},{"sha":"2","commit":{"author":{"name":""}},"author":{"login":"l"}},{"sha":"3"}]'))) == [("1", "m", "n", "d"), ("2", "", "l", None), ("3", "", "unknown", None)]
    assert rows(landed.repositories(raw('{"items":[{"full_name":"a/b","description":null,"language":"C"},{"full_name":"c/d","stargazers_count":7}]}'))) == [("a/b", "", 0, "C"), ("c/d", "", 7, None)]
    assert rows(landed.releases(raw("broken"))) == []
