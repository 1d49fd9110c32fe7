"""Article pages: title, language, canonical address, date, body; and site icons."""

from __future__ import annotations

import json
import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import urls

LEAST_BODY = 120
SCHEMA = "page_id long, title string, language string, canonical string, published string, body string, paragraphs int, image string"
_DATE_METAS = ("article:published_time", "og:published_time", "publishdate", "date", "dc.date", "datepublished")
_LD_DATES = "datePublished dateCreated uploadDate".split()
_HEAD_TITLE = re.compile("<title>([^<]*)</title>")
_SKIP = {"script", "style", "noscript", "template"}
_BLOCKS = {"p", "h1", "h2", "h3", "li", "div", "td", "blockquote"}
_VOID = {"br", "img", "meta", "link", "hr", "input", "source", "wbr"}


class Page(HTMLParser):
    """What one pass over a page collects."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lang = self.canonical = self.time = None
        self.title, self.h1 = "", ""
        self.metas: dict[str, str] = {}
        self.icons: list[tuple[str, str]] = []
        self.paragraphs: list[list[str]] = []
        self.in_article: list[str] = []
        self.ld: list[str] = []
        self._open: list[str] = []
        self._p: list[str] | None = None
        self._kind: str | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html" and self.lang is None:
            self.lang = a.get("lang") or None
        elif tag == "meta":
            key = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if key and a.get("content"):
                self.metas.setdefault(key, a["content"].strip())
        elif tag == "link":
            rel = a.get("rel", "").lower().split()
            if "canonical" in rel and self.canonical is None:
                self.canonical = a.get("href") or None
            if any("icon" in r for r in rel) and a.get("href"):
                self.icons.append((a["href"], a.get("type", "")))
        elif tag == "time" and self.time is None:
            self.time = a.get("datetime") or None
        if tag == "script":
            self._kind = a.get("type", "").lower()
        if tag == "p":
            self._p = []
            self.paragraphs.append(self._p)
        if tag not in _VOID:
            self._open.append(tag)

    def handle_endtag(self, tag):
        if tag == "p":
            self._p = None
        if tag in _BLOCKS and "article" in self._open:
            self.in_article.append("\n")
        if tag in self._open:
            while self._open and self._open.pop() != tag:
                pass

    def handle_data(self, data):
        if "script" in self._open:
            if self._kind == "application/ld+json":
                self.ld.append(data)
            return
        if _SKIP.intersection(self._open):
            return
        top = self._open[-1] if self._open else ""
        if "title" in self._open and "svg" not in self._open:
            self.title += data
        elif top == "h1" or "h1" in self._open:
            self.h1 += data
        if self._p is not None:
            self._p.append(data)
        if "article" in self._open:
            self.in_article.append(data)


def _ld_date(value) -> str | None:
    """Depth-first search of JSON-LD; an object's own dates come before those inside it."""
    if isinstance(value, dict):
        for key in _LD_DATES:
            if isinstance(value.get(key), str) and value[key].strip():
                return value[key].strip()
        value = list(value.values())
    if isinstance(value, list):
        for v in value:
            if (found := _ld_date(v)) is not None:
                return found
    return None


def clean(text: str) -> str:
    return " ".join(text.split())


def extract(html: str | None, url: str = "") -> tuple:
    """(title, language, canonical, published text, body, paragraphs, image) of a page."""
    page = Page()
    page.feed(html or "")
    published = next((page.metas[m] for m in _DATE_METAS if m in page.metas), None)
    if published is None:
        for block in page.ld:
            try:
                published = _ld_date(json.loads(block))
            except (ValueError, RecursionError):
                continue
            if published:
                break
    published = published or page.time
    texts = [t for t in (clean("".join(p)) for p in page.paragraphs) if t]
    body = "\n".join(texts)
    if len(body) < LEAST_BODY:
        body = clean("".join(page.in_article)) or body
    title = clean(page.metas.get("og:title") or page.h1 or page.title) or None
    language = (page.lang or page.metas.get("og:locale") or "").lower().replace("_", "-").split("-")[0] or None
    canonical = urls.normalize(page.canonical, url) if page.canonical else None
    return title, language, canonical, published, body or None, len(texts), page.metas.get("og:image")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """extract() of every page; the workers hold a hundred pages at a time (an Arrow batch would be 10,000)."""
    parts = F.udf(lambda html, url: extract(html, url or ""), SCHEMA.partition(", ")[2], useArrow=False).asNondeterministic()  # evaluated once a page
    return pages.select(F.col(id_col).cast("long").alias("page_id"), parts(html_col, url_col).alias("x")).select("page_id", "x.*")


def titles_agree(html: str | None) -> bool:
    """Whether the extracted title begins as the head's title does (its first 20 characters), entities resolved in both."""
    head = _HEAD_TITLE.search(html or "")
    return (extract(html)[0] or "").startswith(clean(unescape(head[1] if head else ""))[:20].rstrip())


def icons(html: str | None, url: str) -> list[str]:
    """Raster icon addresses of a page, in order, ending with the favicon at the root."""
    page = Page()
    page.feed(html or "")
    found = [urljoin(url, h) for h, kind in page.icons if "svg" not in kind and not h.lower().split("?")[0].endswith(".svg")]
    return list(dict.fromkeys([*found, urljoin(url, "/favicon.ico")]))


def largest_icon(candidates: DataFrame) -> DataFrame:
    """Of (source, position, href, width, height), each source's icon of the largest area, the first of equals."""
    best = F.max_by(F.struct("href", "width", "height"), F.struct(F.col("width") * F.col("height"), -F.col("position")))
    return candidates.groupBy("source").agg(best.alias("icon")).select("source", "icon.*")
