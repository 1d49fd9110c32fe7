"""Sitemaps, feeds, section pages and JSON endpoints as tables of article links.

Fetching is not done here: the input is a table of fetched bodies (url, status, content, ...).
Each parser is a pure function of one body; `links` applies them batch by batch.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import dates, urls
from newsloom.session import drop_stored, store

#: A link and the date stated for it.
Entry = tuple[str, "str | None"]
_ADDRESS = re.compile("https?://|/")


def inflate(content: bytes | None) -> bytes:
    """The body, unpacked where it is gzip; b'' where it can't be."""
    content = content or b""
    if content[:2] != b"\x1f\x8b":
        return content
    try:
        return gzip.decompress(content)
    except (OSError, EOFError):
        return b""


def _root(content: bytes):
    try:
        return ElementTree.fromstring(inflate(content))
    except ElementTree.ParseError:
        return None


def _name(element) -> str:
    return element.tag.rpartition("}")[2].lower() if isinstance(element.tag, str) else ""


def _child(element, *names: str) -> str | None:
    for name in names:
        for c in element:
            if _name(c) == name and (text := (c.text or "").strip()):
                return text
    return None


def sitemap(content: bytes) -> tuple[list[str], list[Entry]]:
    """(nested sitemaps, [(address, lastmod)]); an invalid body is empty."""
    root = _root(content)
    if root is None:
        return [], []
    found = [(_child(e, "loc"), _child(e, "lastmod")) for e in root if _name(e) in ("sitemap", "url")]
    entries = [(loc, mod) for loc, mod in found if loc]
    return ([loc for loc, _ in entries], []) if _name(root) == "sitemapindex" else ([], entries)


def feed(content: bytes) -> list[Entry]:
    """[(link, date)] of RSS items (link, else guid) and Atom entries (updated, else published)."""
    root = _root(content)
    out = []
    for e in root.iter() if root is not None else ():
        if _name(e) == "item":
            link, stamp = _child(e, "link", "guid"), _child(e, "pubdate", "date")
        elif _name(e) == "entry":
            rels = [(c.get("rel") or "alternate", (c.get("href") or "").strip()) for c in e if _name(c) == "link"]
            named = [h for r, h in rels if h and r == "alternate"] or [h for _, h in rels if h]
            link, stamp = (named[0] if named else None), _child(e, "updated", "published")
        else:
            continue
        if link:
            out.append((link, stamp))
    return out


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            self.hrefs.append(href)


def _same_host(candidates: list[str], base: str) -> list[str]:
    host = (urlsplit(base).hostname or "").removeprefix("www.")
    out: dict[str, None] = {}
    for c in candidates:
        try:
            address = urldefrag(urljoin(base, c.strip()))[0]
            parts = urlsplit(address)
            if parts.scheme in ("http", "https") and (parts.hostname or "").removeprefix("www.") == host:
                out[address] = None
        except ValueError:
            continue
    return list(out)


def section(html: str, base: str) -> list[str]:
    """Distinct links of a page to its own host, in order, without fragments."""
    parser = _Links()
    parser.feed(html or "")
    return _same_host(parser.hrefs, base)


def json_links(text: str, base: str) -> list[str]:
    """Distinct addresses of the page's own host among all strings of a JSON document."""
    def strings(value) -> Iterator[str]:
        if isinstance(value, str):
            yield value
        elif isinstance(value, dict):
            for v in value.values():
                yield from strings(v)
        elif isinstance(value, list):
            for v in value:
                yield from strings(v)

    try:
        found = [s for s in strings(json.loads(text or "")) if _ADDRESS.match(s)]
    except (ValueError, RecursionError):
        return []
    return _same_host(found, base)


def fetched(pages: DataFrame) -> DataFrame:
    """Pages fetched well: a 2xx status and no error."""
    return pages.where(F.col("status").between(200, 299) & F.col("error").isNull())


def _found(url: str, method: str, content: bytes | None) -> list[tuple]:
    body = inflate(bytes(content or b""))
    if method == "sitemap":
        nested, entries = sitemap(body)
        return [(n, None, True) for n in nested] + [(h, s, False) for h, s in entries]
    if method == "feed":
        return [(h, s, False) for h, s in feed(body)]
    parse = section if method == "section" else json_links
    return [(h, None, False) for h in parse(body.decode("utf-8", "replace"), url)]


def links(pages: DataFrame) -> DataFrame:
    """Links of pages (url, method, content binary); method is sitemap, feed, section or json.

    The workers hold a hundred bodies and their links at a time (an Arrow batch would be 10,000).
    """
    found = F.udf(_found, "array<struct<href: string, stamp: string, nested: boolean>>", useArrow=False).asNondeterministic()  # evaluated once a page
    held = pages.select(F.col("url").alias("page_url"), "method", found("url", "method", "content").alias("found"))
    return held.select("page_url", "method", F.posexplode("found").alias("position", "x")).select("page_url", "method", "position", "x.*")


def traverse(start: DataFrame, pages: DataFrame, patterns: list[str] | None = None, since: str | None = None, until: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Article links (href, stamp, discovery_url) of sitemaps reached from start (url) through indexes among pages.

    Level by level to any depth, until no sitemap is new; each is read once however often (or in
    a circle) it is named. Nested sitemaps must match a pattern, if there are any, and their URL's
    month may not lie outside [since, until] (yyyy-MM-dd); links must be allowed() and their date,
    where known, inside. Order is that of a queue: start by URL, nested ones newest month first,
    links as they stand; a link found twice counts once, at its first place. limit: the first so
    many. Start URLs without a page give nothing. Each level is a table of the shared folder.
    """
    spark = pages.sparkSession
    parsed, p_parsed = store(links(pages.where("method = 'sitemap'")), "sitemaps")
    month = F.coalesce(urls.year_month(F.col("href")), F.lit(""))
    open_ = F.col("nested") & urls.allowed(F.col("href"), patterns or [], []) & urls.may_overlap(F.col("href"), since, until)
    order = Window.partitionBy("page_url").orderBy(month.desc(), F.desc("href"))
    nested = parsed.where(open_).select("page_url", "href").distinct().withColumn("turn", F.row_number().over(order))
    roots = start.select("url").distinct()
    frontier, path = store(roots.select("url", F.array(F.row_number().over(Window.orderBy("url"))).alias("place")), "frontier")
    seen, paths = frontier, [path]
    while frontier.limit(1).count():
        reached = nested.join(frontier.select(F.col("url").alias("page_url"), "place"), "page_url")
        first = reached.groupBy(F.col("href").alias("url")).agg(F.min(F.concat("place", F.array("turn"))).alias("place"))
        frontier, path = store(first.join(seen, "url", "left_anti"), "frontier")
        seen, paths = seen.unionByName(frontier), [*paths, path]
    moment = stamps(F.col("stamp"))
    closed = None if until is None else F.to_timestamp_ntz(F.lit(until)) + F.expr("interval 1 day") - F.expr("interval 1 microsecond")
    fits = dates.in_window(moment, None if since is None else F.to_timestamp_ntz(F.lit(since)), closed)
    found = parsed.where(~F.col("nested") & fits & urls.allowed(F.col("href"), include or [], exclude or [])).join(seen.withColumnRenamed("url", "page_url"), "page_url")
    where = F.struct(F.size("place"), "place", "position")
    one = found.groupBy("href").agg(F.min_by(F.struct("stamp", "page_url", where.alias("at")), where).alias("x"))
    out = one.select("href", "x.stamp", F.col("x.page_url").alias("discovery_url"), "x.at").orderBy("at")
    result, _ = store((out if limit is None else out.limit(limit)).drop("at"), "links")
    drop_stored(spark, p_parsed, *paths)
    return result


METHOD_RANK = {"feed": 0, "sitemap": 1, "section": 2, "json": 3}


def discovered(found: DataFrame, limit: int) -> DataFrame:
    """Distinct article identities of each source, feeds before sitemaps before sections, the first `limit`."""
    rank = F.create_map(*[F.lit(x) for pair in METHOD_RANK.items() for x in pair])[F.col("method")]
    named = found.where("not nested").withColumns({"identity_url": urls.normalize_udf("href"), "method_rank": rank}).where("identity_url is not null")
    first = Window.partitionBy("source", "identity_url").orderBy("method_rank", "page_url", "position")
    one = named.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    order = Window.partitionBy("source").orderBy("method_rank", "page_url", "position")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def stamps(column: Column) -> Column:
    """UTC instants of sitemap and feed dates; times without an offset are UTC here."""
    return F.coalesce(dates.iso_utc(column, "UTC"), dates.rfc2822_utc(column))
