"""Parsers of sitemaps, feeds, sections, JSON and article pages."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from newsloom.sources import catalogue, feeds, html

INDEX = b"<sitemapindex xmlns='urn:any'><sitemap><loc> https://n.ua/a.xml </loc></sitemap> <sitemap> <loc/> </sitemap></sitemapindex>"
URLSET = b"<urlset><url><loc>https://n.ua/1</loc><lastmod>2024-01-05</lastmod> </url> <url><loc>https://n.ua/2</loc> </url></urlset>"
RSS = b"<rss><channel><item><link>https://n.ua/3</link><pubDate>Tue, 02 Jun 2026 09:35:00 +0300</pubDate></item><item><guid>https://n.ua/4</guid></item><item><title>x</title></item></channel></rss>"
ATOM = b"<feed xmlns='http://www.w3.org/2005/Atom'><entry><link rel='self' href='https://n.ua/api/5'/><link href='https://n.ua/5'/><updated>2024-01-01T00:00:00Z</updated></entry><entry><link rel='edit' href='https://n.ua/6'/><published>2024-02-01</published></entry></feed>"


def test_sitemaps_and_feeds():
    assert feeds.sitemap(INDEX) == (["https://n.ua/a.xml"], [])
    assert feeds.sitemap(gzip.compress(URLSET)) == ([], [("https://n.ua/1", "2024-01-05"), ("https://n.ua/2", None)])
    assert feeds.sitemap(b"<broken") == ([], []) and feeds.sitemap(b"\x1f\x8bno") == ([], []) and feeds.feed(b"") == []
    assert feeds.feed(RSS) == [("https://n.ua/3", "Tue, 02 Jun 2026 09:35:00 +0300"), ("https://n.ua/4", None)]
    assert feeds.feed(ATOM) == [("https://n.ua/5", "2024-01-01T00:00:00Z"), ("https://n.ua/6", "2024-02-01")]


def test_sections_and_json():
    page = "<a href='/a#x'>1</a><a href='https://www.n.ua/b'>2</a><a href='/a'>3</a><a href='https://other.ua/c'>4</a><a href='mailto:x'>5</a><a>6</a>"
    assert feeds.section(page, "https://n.ua/list") == ["https://n.ua/a", "https://www.n.ua/b"]
    assert feeds.json_links('{"x": ["/p/1", {"y": "https://n.ua/2"}, "https://z.ua/3", "text", 5, null]}', "https://n.ua/") == ["https://n.ua/p/1", "https://n.ua/2"]
    assert feeds.json_links("{", "https://n.ua/") == []


def test_traversal_and_discovery(spark):
    pages = spark.createDataFrame([("https://n.ua/s.xml", "sitemap", INDEX), ("https://n.ua/a.xml", "sitemap", URLSET), ("https://n.ua/other.xml", "sitemap", URLSET.replace(b"/1", b"/9")), ("https://n.ua/rss", "feed", RSS)], "url string, method string, content binary")
    reached = feeds.traverse(spark.createDataFrame([("https://n.ua/s.xml",)], "url string"), pages)
    assert {r.href for r in reached.collect()} == {"https://n.ua/1", "https://n.ua/2"}
    found = feeds.links(pages).withColumn("source", F.lit("n"))
    got = feeds.discovered(found, 3).orderBy("place").collect()
    assert [r.identity_url for r in got] == ["https://n.ua/3", "https://n.ua/4", "https://n.ua/1"]
    fetched = spark.createDataFrame([(200, None), (204, None), (200, "x"), (0, "timeout"), (404, None)], "status int, error string")
    assert feeds.fetched(fetched).count() == 2


def test_traversal_is_deep_pruned_ordered_and_limited(spark):
    index = lambda *names: ("<sitemapindex>" + "".join(f"<sitemap><loc>https://n.ua/{n}</loc></sitemap>" for n in names) + "</sitemapindex>").encode()
    urlset = lambda *rows: ("<urlset>" + "".join(f"<url><loc>https://n.ua/{n}</loc>" + (f"<lastmod>{d}</lastmod>" if d else "") + "</url>" for n, d in rows) + "</urlset>").encode()
    chain = [(f"https://n.ua/{k}", "sitemap", index(f"{k + 1}", "0")) for k in range(9)]  # a circle back to the first, nine levels down
    pages = [*chain, ("https://n.ua/9", "sitemap", index("map-2024-01.xml", "map-2024-03.xml", "map-2023-12.xml", "tags.xml")),
             ("https://n.ua/map-2024-01.xml", "sitemap", urlset(("a", "2024-01-05"), ("b", None))), ("https://n.ua/map-2024-03.xml", "sitemap", urlset(("c", "2024-03-01"), ("a", "2024-03-02"))),
             ("https://n.ua/map-2023-12.xml", "sitemap", urlset(("d", "2023-12-31"),)), ("https://n.ua/tags.xml", "sitemap", urlset(("tag/e", None)))]
    table = spark.createDataFrame(pages, "url string, method string, content binary")
    start = spark.createDataFrame([("https://n.ua/0",), ("https://n.ua/0",), ("https://n.ua/gone",)], "url string")
    go = lambda **k: [r.href[13:] for r in feeds.traverse(start, table, **k).collect()]
    assert set(go()) == {"a", "b", "c", "d", "tag/e"}
    assert feeds.traverse(start, table).where("href like '%/a'").first().discovery_url.endswith("03.xml")
    assert set(go(patterns=["/[0-9]$", "map-"])) == {"a", "b", "c", "d"}
    assert set(go(since="2024-01-01", until="2024-02-28")) == {"a", "b", "tag/e"}
    assert set(go(exclude=["/tag/"], since="2024-02-01")) == {"a", "c"}
    assert set(go(limit=2)) == {"c", "a"} and go(limit=0) == []
    assert feeds.traverse(start.limit(0), table).count() == 0


ARTICLE = """<html lang="uk-UA"><head><title>Head</title><meta property="og:title" content=" A  title "><link href="/texte/stueck/?utm_source=x" rel="canonical">
<script type=application/ld+json>{"@graph": [{"author": {"datePublished": "2020-01-01"}}, {"datePublished": "2026-07-03"}]}</script>
<link rel="icon" href="/i.svg" type="image/svg+xml"><link href="t.png" rel="apple-touch-icon"></head><body><article><h1>H</h1><p>One &amp; two.</p><p> </p><p>Three<script>var x;</script>.</p></article><time datetime="2019-01-01"></time></body></html>"""


def test_extraction():
    title, language, canonical, published, body, n, image = html.extract(ARTICLE, "http://www.n.ua/x")
    assert (title, language, canonical, n, image) == ("A title", "uk", "https://n.ua/texte/stueck", 2, None)
    assert published == "2020-01-01"  # depth first, in document order
    assert body == "H One & two. Three."  # under 120 characters of paragraphs the article's text is taken
    assert html.extract(None)[:2] == (None, None) and html.extract("<p>")[5] == 0
    assert html.extract("<meta name='date' content='2024'><time datetime='2023'>")[3] == "2024"
    assert html.icons(ARTICLE, "https://n.ua/x/") == ["https://n.ua/x/t.png", "https://n.ua/favicon.ico"]


def test_icons_and_catalogue(spark):
    rows = spark.createDataFrame([("a", 0, "x", 16, 16), ("a", 1, "y", 32, 32), ("a", 2, "z", 64, 16)], "source string, position int, href string, width int, height int")
    assert html.largest_icon(rows).first().href == "y"
    assert catalogue.catalogue(spark).count() == 33
    sizes = {k: v.count() for k, v in catalogue.demo(spark).items()}
    assert (sizes["articles"], sizes["cases"], sizes["events"], sizes["entities"], sizes["sources"]) == (496, 164, 237, 88, 12)


def test_titles_agree_whatever_the_entities(spark, tmp_path):
    from newsloom.plans.registry import QUERIES

    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>x</p></article></body></html>".format
    titles = ["token = &quot;2abc3ff2ca8fb1e4c565&quot;", "Fish &amp; chips&#39; &eacute;t&eacute;", "two  spaces\nand a break in it", "&lt;b&gt; is a tag", ""]
    rows = [(k, "https://n.ua/", page(t)) for k, t in enumerate(titles)] + [(0, "https://n.ua/", page("again")), (9, "https://n.ua/", page("other").replace("<h1>other", "<h1>one"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in QUERIES["html_title_matches"](spark, str(tmp_path)).collect())
    assert got == [(0, True), (0, True), (1, True), (2, True), (3, True), (4, True), (9, False)]


def _reaches_worker(frame):
    """The physical operator that hands rows to Python: Arrow ones hand over 10,000 at a time."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [name for name in ("MapInPandas", "MapInArrow", "ArrowEvalPython", "BatchEvalPython") if name in plan]


def test_links_hold_few_bodies(spark):
    body = b"<urlset><url><loc>https://n.ua/%d</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://n.ua/x</loc></url></urlset>"
    pages = spark.createDataFrame([(f"https://n.ua/{k}.xml", "sitemap", body % k) for k in range(250)] + [("https://n.ua/bad", "sitemap", b"<"), ("https://n.ua/none", "json", None)], "url string, method string, content binary")
    found = feeds.links(pages)
    assert _reaches_worker(found) == ["BatchEvalPython"]
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(row for k in range(250) for row in ((f"https://n.ua/{k}.xml", "sitemap", 0, f"https://n.ua/{k}", "2024-01-02", False), (f"https://n.ua/{k}.xml", "sitemap", 1, "https://n.ua/x", None, False)))


def test_pages_are_extracted_once_and_few_at_a_time(spark):
    html_pages = spark.createDataFrame([(k, None, f"<html lang='uk'><h1>Title {k}</h1></html>") for k in range(250)] + [(250, None, None)], "page_id int, url string, html string")
    found = html.extract_pages(html_pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert _reaches_worker(found) == ["BatchEvalPython"] and plan.count("BatchEvalPython") == 1 and dict(found.dtypes)["page_id"] == "bigint"
    assert sorted((r.page_id, r.title, r.language) for r in found.collect()) == [(k, f"Title {k}", "uk") for k in range(250)] + [(250, None, None)]
