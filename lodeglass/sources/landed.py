"""Readers of landed files: feeds, sitemaps, listing pages, leaderboards, repository activity and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeglass.functions.text import slug_title

ITEM = "title string, description string, link string, guid string, pubDate string, author string"
ENTRY = "title string, summary string, content string, id string, updated string, link struct<_href:string>, author struct<name:string>"


def feed_items(spark: SparkSession, path: str, source: str, atom: bool = False) -> DataFrame:
    """source, title, content, url, published, author, item_id of RSS items or Atom entries; those without title or content are left out."""
    rows = spark.read.format("xml").option("rowTag", "entry" if atom else "item").schema(ENTRY if atom else ITEM).load(path)
    if atom:
        rows = rows.select("title", F.coalesce("summary", "content", "title").alias("content"), F.coalesce("link._href", "id").alias("url"), F.col("updated").alias("published"), F.col("author.name").alias("author"), F.col("id").alias("item_id"))
    else:
        rows = rows.select("title", F.coalesce("description", "title").alias("content"), F.coalesce("link", "guid").alias("url"), F.col("pubDate").alias("published"), "author", F.coalesce("guid", "link").alias("item_id"))
    return rows.filter("title <> '' and content <> ''").select(F.lit(source).alias("source"), "*")


def sitemap_urls(urls: DataFrame, hosts: DataFrame, sections: str, most: int = 8) -> DataFrame:
    """source and url of sitemap locations (source, loc) on the source's host (source, host) whose text meets the sections' pattern: the first `most` distinct ones of each source in the order of `pos`."""
    rows = urls.join(hosts, "source").filter(F.try_parse_url("loc", F.lit("HOST")) == F.col("host"))
    rows = rows.filter(F.col("loc").rlike("^https?://") & F.lower("loc").rlike(sections)).groupBy("source", "loc").agg(F.min("pos").alias("pos"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("pos", "loc"))).filter(F.col("n") <= most).select("source", F.col("loc").alias("url"))


def sitemap_locations(files: DataFrame, most: int = 8, children: int = 2) -> DataFrame:
    """source, rank, pos, loc of landed sitemaps (source, rank, url, xml): `rank` orders a source's own files, others have none and are only read as children.

    A file lists pages (urlset) or files (sitemapindex). Where it has locations that name a sitemap, the first
    `children` of these are read in its place, the second only if those before it list fewer than twice `most`.
    """
    tree = F.from_xml("xml", "url array<struct<loc:string>>, sitemap array<struct<loc:string>>")
    none = F.array().cast("array<string>")
    locs = F.concat(F.coalesce(F.transform(tree["url"], lambda x: x["loc"]), none), F.coalesce(F.transform(tree["sitemap"], lambda x: x["loc"]), none))
    rows = files.select("source", "rank", "url", F.posexplode(F.filter(F.transform(locs, lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "loc"))
    roots = rows.filter("rank is not null")
    nth = F.row_number().over(Window.partitionBy("source", "rank").orderBy("pos"))
    kids = roots.filter(F.contains("loc", F.lit("sitemap"))).withColumn("child", nth).filter(F.col("child") <= children).select("source", "rank", "child", F.col("loc").alias("url"))
    listed = kids.join(rows.select("source", "url", "pos", "loc"), ["source", "url"])
    counts = listed.groupBy("source", "rank", "child").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source", "rank").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    followed = listed.join(before, ["source", "rank", "child"]).filter(F.col("before") < 2 * most).select("source", "rank", (F.col("before") + F.col("pos")).cast("int").alias("pos"), "loc")
    own = roots.join(kids.select("source", "rank").distinct(), ["source", "rank"], "left_anti").select("source", "rank", "pos", "loc")
    return followed.unionByName(own)


def sitemap_articles(files: DataFrame, hosts: DataFrame, sections: str, most: int = 8) -> DataFrame:
    """source, title, url, content of what a source's sitemaps (source, rank, url, xml) list: of its first file that lists any wanted page."""
    rows = sitemap_locations(files, most).join(hosts, "source").filter(F.try_parse_url("loc", F.lit("HOST")) == F.col("host"))
    rows = rows.filter(F.col("loc").rlike("^https?://") & F.lower("loc").rlike(sections))
    first = rows.withColumn("first", F.min("rank").over(Window.partitionBy("source"))).filter("rank = first")
    found = sitemap_urls(first.select("source", "pos", "loc"), hosts, sections, most)
    return found.select("source", slug_title(F.col("url")).alias("title"), "url", F.concat(F.lit("Discovered via sitemap for "), "source", F.lit(".")).alias("content"))


def _bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def listings(pages: DataFrame, item: str | Column, title: str | Column, body: str | Column, link: str | Column) -> DataFrame:
    """page_id, pos, title, content, url of the blocks that the pattern `item` (one group) finds in a page's html, each read by three more patterns; links are made absolute.

    A pattern is one for all pages, or a column of the pages.
    """
    item, title, body, link = (F.lit(p) if isinstance(p, str) else p for p in (item, title, body, link))
    rows = pages.select("page_id", "url", title.alias("by_title"), body.alias("by_body"), link.alias("by_link"), F.posexplode(F.regexp_extract_all("html", item, F.lit(1))).alias("pos", "block"))
    found = lambda by: F.coalesce(F.get(F.regexp_extract_all("block", F.col(by), F.lit(1)), F.lit(0)), F.lit(""))
    href = found("by_link")
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    whole = F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("/"), F.concat(base, href)).when(href != "", F.concat(base, F.lit("/"), href))
    return rows.select("page_id", "pos", _bare(found("by_title")).alias("title"), _bare(found("by_body")).alias("content"), whole.alias("url")).filter("title <> '' and content <> ''")


def listings_by_source(pages: DataFrame, selectors: DataFrame) -> DataFrame:
    """The same of pages (source, ...) by their source's own patterns (source, item, title, body, link); pages of other sources give nothing."""
    rows = pages.join(selectors, "source")
    return listings(rows, F.col("item"), F.col("title"), F.col("body"), F.col("link"))


def paired_listing(pages: DataFrame, base: str) -> DataFrame:
    """page_id, pos, title, content, url of a definition list in which the n-th dt (link) belongs to the n-th dd (title and content)."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(r"(?is)<dt[^>]*>(.*?)</dt>"), F.lit(1)).alias("dt"), F.regexp_extract_all("html", F.lit(r"(?is)<dd[^>]*>(.*?)</dd>"), F.lit(1)).alias("dd"))
    rows = pages.select("page_id", F.posexplode(both).alias("pos", "p")).select("page_id", "pos", "p.dt", "p.dd").filter("dt is not null and dd is not null")
    href = F.regexp_extract("dt", r'href="([^"]*)"', 1)
    title = F.regexp_replace(_bare(F.regexp_extract("dd", r"(?is)<div[^>]*title[^>]*>(.*?)</div>", 1)), r"^Title:\s*", "")
    return rows.select("page_id", "pos", title.alias("title"), _bare(F.col("dd")).alias("content"), F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href).alias("url")).filter("title <> ''")


def leaderboard(raw: DataFrame, most: int = 50) -> DataFrame:
    """rank, team, score of a JSON array of entries (column raw), whichever names their fields have."""
    entry = "array<struct<teamName:string,displayName:string,teamId:string,score:double,publicScore:double,rank:int,position:int>>"
    rows = raw.select(F.posexplode(F.from_json("raw", entry)).alias("pos", "e"))
    team = F.coalesce("e.teamName", "e.displayName", F.concat(F.lit("Team "), F.col("pos") + 1))
    return rows.select(F.coalesce("e.rank", "e.position", F.col("pos") + 1).alias("rank"), team.alias("team"), F.coalesce("e.score", "e.publicScore", F.lit(0.0)).alias("score")).filter(F.col("pos") < most)


def score_of(shown: Column) -> Column:
    """12.5% as 0.125, and plain numbers as they are; null if it is neither."""
    n = F.regexp_replace(shown, r"[%\s,]", "").try_cast("double")
    return F.when(F.contains(shown, F.lit("%")), n / 100).otherwise(n)


ROW, CELL = r"(?is)<tr\b[^>]*>(.*?)</tr>", r"(?is)<td\b[^>]*>(.*?)</td>"
POINT, POINT_SCORE, POINT_TEAM = r"(?is)<circle\b([^>]*\bdata-score=[^>]*)>", r'data-score="([^"]*)"', r'data-team="([^"]*)"'


def table_entries(pages: DataFrame) -> DataFrame:
    """source, rank, team, score of leaderboard pages (source, html): table rows of two cells or more, else points with a data-score.

    Scores are percentages; those that are no number or not over zero are left out, but count in the ranks.
    """
    body = F.regexp_replace("html", r"(?is)<thead\b.*?</thead>", " ")
    rows = pages.select("source", F.posexplode(F.regexp_extract_all(body, F.lit(ROW), F.lit(1))).alias("pos", "row")).select("source", "pos", F.regexp_extract_all("row", F.lit(CELL), F.lit(1)).alias("cells"))
    shown = rows.filter(F.size("cells") >= 2).select("source", F.lit(1).alias("way"), (F.col("pos") + 1).alias("rank"), F.coalesce(F.nullif(_bare(F.col("cells")[0]), F.lit("")), F.concat(F.lit("Team "), F.col("pos") + 1)).alias("team"), _bare(F.col("cells")[1]).alias("shown"))
    points = pages.select("source", F.posexplode(F.regexp_extract_all("html", F.lit(POINT), F.lit(1))).alias("pos", "point"))
    points = points.select("source", F.lit(2).alias("way"), (F.col("pos") + 1).alias("rank"), F.coalesce(F.nullif(F.regexp_extract("point", POINT_TEAM, 1), F.lit("")), F.concat(F.lit("Entry "), F.col("pos") + 1)).alias("team"), F.regexp_extract("point", POINT_SCORE, 1).alias("shown"))
    good = shown.unionByName(points).withColumn("score", F.regexp_replace("shown", r"[%\s,]", "").try_cast("double") / 100).filter("score > 0")
    return good.withColumn("first", F.min("way").over(Window.partitionBy("source"))).filter("way = first").select("source", "rank", "team", "score")


def csv_entries(lines: DataFrame) -> DataFrame:
    """source, rank, team, score of leaderboard lines (source, pos, line) of comma-separated team and shown score."""
    row = F.from_csv("line", F.lit("team string, shown string"))
    rows = lines.select("source", (F.col("pos") + 1).alias("rank"), row["team"].alias("team"), score_of(row["shown"]).alias("score"))
    return rows.filter("score > 0")


def with_snapshot(live: DataFrame, snapshot: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Live rows with a score over zero, the snapshot's for sources that have none; source_status says which.

    Sources in `failed` (source) could not be read: they get one row without team, of score zero, marked `unavailable`,
    and no snapshot takes their place.
    """
    good = live.filter("score > 0").withColumn("source_status", F.lit("live"))
    rest = snapshot.join(good.select("source").distinct(), "source", "left_anti").withColumn("source_status", F.lit("manual_snapshot"))
    if failed is None:
        return good.unionByName(rest)
    gone = failed.select("source").distinct()
    marks = gone.withColumns({"score": F.lit(0.0), "source_status": F.lit("unavailable")})
    return good.unionByName(rest).join(gone, "source", "left_anti").unionByName(marks, allowMissingColumns=True)


_LABELS = "labels:array<struct<name:string>>"


def discussions(raw: DataFrame) -> DataFrame:
    """title, body (500 characters), category, author, labels of a JSON array of issues."""
    issue = f"array<struct<title:string,body:string,category:string,user:struct<login:string>,{_LABELS}>>"
    rows = raw.select(F.inline(F.from_json("raw", issue)))
    return rows.select("title", F.substring(F.coalesce("body", F.lit("")), 1, 500).alias("body"), F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("user.login", F.lit("unknown")).alias("author"), F.array_join(F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]), ", ").alias("labels"))


def releases(raw: DataFrame) -> DataFrame:
    """name (its tag, if it has none), tag, body (500 characters), author, published of a JSON array of releases."""
    rows = raw.select(F.inline(F.from_json("raw", "array<struct<name:string,tag_name:string,body:string,published_at:string,author:struct<login:string>>>")))
    return rows.select(F.coalesce(F.nullif("name", F.lit("")), "tag_name").alias("name"), F.col("tag_name").alias("tag"), F.substring(F.coalesce("body", F.lit("")), 1, 500).alias("body"), F.coalesce("author.login", F.lit("unknown")).alias("author"), F.col("published_at").alias("published"))


def commits(raw: DataFrame) -> DataFrame:
    """sha, message (200 characters), author, date of a JSON array of commits."""
    rows = raw.select(F.inline(F.from_json("raw", "array<struct<sha:string,commit:struct<message:string,author:struct<name:string,date:string>>,author:struct<login:string>>>")))
    return rows.select("sha", F.substring(F.coalesce("commit.message", F.lit("")), 1, 200).alias("message"), F.coalesce(F.nullif("commit.author.name", F.lit("")), F.nullif("author.login", F.lit("")), F.lit("unknown")).alias("author"), F.col("commit.author.date").alias("date"))


def repositories(raw: DataFrame) -> DataFrame:
    """name, description (200 characters), stars, language of a JSON reply of found repositories."""
    rows = raw.select(F.inline(F.from_json("raw", "items array<struct<full_name:string,description:string,stargazers_count:bigint,language:string>>")["items"]))
    return rows.select(F.col("full_name").alias("name"), F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("description"), F.coalesce("stargazers_count", F.lit(0)).alias("stars"), "language")


def search_results(raw: DataFrame) -> DataFrame:
    """title, url, snippet of search replies that have title and URL."""
    reply = "web struct<results:array<struct<title:string,url:string,description:string>>>"
    return raw.select(F.inline(F.from_json("raw", reply)["web"]["results"])).filter("title <> '' and url <> ''").select("title", "url", F.coalesce("description", F.lit("")).alias("snippet"))


ANCHOR, BLOCK, CHROME = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"(?is)<(?:article|li)\b[^>]*>(.*?)</(?:article|li)>", r"(?is)<nav\b.*?</nav>|<footer\b.*?</footer>|<header\b.*?</header>"


def discovered(pages: DataFrame, keywords: str, most: int = 20, most_last: int = 10) -> DataFrame:
    """page_id, pass, pos, url, title: the links of a page that look like articles, by the first of four passes that finds any.

    1: blocks (article, li) of 40 characters or more whose first link has a text of six or more; 2: links on the page's
    own host outside nav, footer and header that meet the pattern `keywords`; 3: all such links; 4: any link on the host
    outside those with a path. Of equal URLs the first counts; a page gives `most` at most, in pass 4 `most_last`.
    """
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    bare = F.regexp_replace("html", CHROME, " ")

    def links(html: Column) -> DataFrame:
        both = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("label"))
        return pages.select("page_id", host.alias("host"), base.alias("base"), F.posexplode(both).alias("pos", "a")).select("page_id", "host", "base", "pos", "a.href", _bare(F.col("a.label")).alias("title"), F.lit(None).cast("string").alias("text"))

    found = pages.select("page_id", host.alias("host"), base.alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))).alias("pos", "b"))
    found = found.select("page_id", "host", "base", "pos", F.regexp_extract("b", ANCHOR, 1).alias("href"), _bare(F.regexp_extract("b", ANCHOR, 2)).alias("title"), _bare(F.col("b")).alias("text"))
    absolute = F.when(F.col("href").startswith("http"), F.col("href")).when(F.col("href").startswith("/"), F.concat("base", "href")).otherwise(F.concat("base", F.lit("/"), "href"))
    good = (F.col("href") != "") & ~F.col("href").rlike("^(#|javascript:|mailto:)")

    def ready(rows: DataFrame, number: int) -> DataFrame:
        rows = rows.filter(good).withColumn("link", absolute).withColumn("pass", F.lit(number))
        mine = F.regexp_extract("link", r"^[a-z]+://([^/?#]+)", 1) == F.col("host")
        named = F.lower(F.concat_ws(" ", "title", "link")).rlike(keywords)
        deep = F.regexp_extract("link", r"^[a-z]+://[^/?#]+/*([^?#]*)", 1) != ""
        wanted = {1: (F.length("text") >= 40) & (F.length("title") >= 6), 2: mine & named, 3: mine & named, 4: mine & deep}[number]
        return rows.filter(wanted).groupBy("page_id", "pass", F.col("link").alias("url")).agg(F.min(F.struct("pos", "title")).alias("first"))

    every = ready(found, 1).unionByName(ready(links(bare), 2)).unionByName(ready(links(F.col("html")), 3)).unionByName(ready(links(bare), 4))
    page = Window.partitionBy("page_id")
    best = every.withColumn("_m", F.min("pass").over(page)).filter("pass = _m").withColumn("_n", F.row_number().over(page.orderBy("first.pos", "url")))
    return best.filter(F.col("_n") <= F.when(F.col("pass") == 4, most_last).otherwise(most)).select("page_id", "pass", "first.pos", "url", "first.title")
