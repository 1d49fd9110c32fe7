"""URL filters: all glob rules at once over each canonical URL.

The rules are packed into the words of one Shift-And automaton. A bit stands for a
literal or `?` of a rule; it is set while the rule has matched up to there. A step
shifts all words (bits carry over), lets in the first bits of rules at the URL's start,
keeps the bits whose item accepts the next byte, and keeps bits that stand before a `*`
in any case. A rule matches a URL if its last bit is set at the URL's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.textarrays import U64, lean, string_buffers
from newsloom.session import ship

#: (rule, glob over the canonical URL, whether it blocks); `*` any bytes, `?` one byte.
RULES: tuple[tuple[str, str, bool], ...] = (
    ("spam-host", "spam-farm.*", True),
    ("spam-subdomain", "*.spam-farm.*", True),
    ("casino", "*casino*", True),
    ("adult-tld", "*.xxx*", True),
    ("login", "*/login*", True),
    ("signup", "*/sign?up*", True),
    ("cart", "*/cart/*", True),
    ("search-page", "*/search?q=*", True),
    ("calendar", "*/calendar/????-??-??*", True),
    ("session-id", "*sessionid=*", True),
    ("page-param", "*page=??*", True),
    ("archive-file", "*.zip", True),
    ("binary", "*.exe", True),
    ("feed", "*/feed", True),
    ("tracker", "track?.*", True),
    ("mobile-mirror", "m.*.example.net/*", True),
    ("blog-org", "blog.*.example.org/*", True),
    ("government", "*.gov/*", False),
    ("education", "*.edu/*", False),
    ("terms", "*/terms*", False),
)
_TRACKING = "utm_[^=&]*|gclid|fbclid|msclkid|mc_eid|ref"


def canonical(url: Column) -> Column:
    """Host (lower case, without user, www. and default port), path without doubled or
    final slashes, and query without tracking parameters; no scheme, no fragment."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(plain, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), "/+", "/"), "/$", "")
    query = F.regexp_extract(plain, r"^[^?]*\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), f"&({_TRACKING})(=[^&]*)?(?=&|$)", ""), "^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


class ShiftAnd:
    """Multiword Shift-And masks of globs."""

    def __init__(self, globs: list[str]):
        firsts, lasts, loops, always, accept = [], [], [], [], []
        self.total = np.zeros(len(globs), bool)  # globs that match any URL
        self.empty = np.zeros(len(globs), bool)  # globs that match the empty URL
        self.owner: list[int] = []
        for g, glob in enumerate(globs):
            raw = glob.encode()
            items = [b for b in raw if b != 42]
            self.empty[g] = not items
            if not items:
                self.total[g] = bool(raw)
                continue
            start = len(accept)
            at = 0
            star_before = False
            for b in raw:
                if b == 42:
                    star_before = True
                    if at:
                        loops.append(start + at - 1)
                    continue
                if at == 0:
                    (always if star_before else firsts).append(start)
                accept.append(b)
                at += 1
            lasts.append(start + at - 1)
            self.owner.append(g)
        self.bits = len(accept)
        self.words = max(1, -(-self.bits // 64))
        mask = lambda places: self._mask(np.array(places, np.int64))
        self.first, self.always, self.loop = mask(firsts), mask(always), mask(loops)
        self.starts = ~(self.first | self.always)
        self.last = np.array(lasts, np.int64)
        items = np.array(accept, np.int64)
        self.table = np.zeros((256, self.words), U64)
        for byte in range(256):
            self.table[byte] = mask(np.flatnonzero((items == byte) | (items == 63)))
        self.globs = len(globs)

    def _mask(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words, U64)
        np.bitwise_or.at(out, places >> 6, U64(1) << (places & 63).astype(U64))
        return out

    def match(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which globs match which of the strings (rows x globs)."""
        size = np.diff(ends)
        order = np.argsort(-size, kind="stable")
        start, length = ends[:-1][order], size[order]
        state = np.zeros((len(size), self.words), U64)
        for step in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -step, "left"))
            d = state[:live]
            moved = d << U64(1)
            moved[:, 1:] |= d[:, :-1] >> U64(63)
            moved &= self.starts
            moved |= self.always if step else self.always | self.first
            moved &= self.table[raw[start[:live] + step]]
            d &= self.loop
            d |= moved
        found = np.zeros((len(size), self.globs), bool)
        if len(self.last):
            hit = (state[:, self.last >> 6] >> (self.last & 63).astype(U64)) & U64(1)
            found[order[:, None], np.array(self.owner)[None, :]] = hit.astype(bool)
        found |= self.total
        found[size == 0] |= self.empty
        return found


def _filter(rules: tuple[tuple[str, str, bool], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd([glob for _, glob, _ in rules])
        names = sorted(range(len(rules)), key=lambda k: rules[k][0])
        blocks = np.array([b for _, _, b in rules], bool)
        chunk = max(64, 4_000_000 // (8 * automaton.words))
        for batch in batches:
            for lo in range(0, batch.num_rows, chunk):
                part = batch.slice(lo, chunk)
                column = part.column("canonical")
                found = automaton.match(*string_buffers(column))
                valid = pa.compute.is_valid(column).to_numpy(zero_copy_only=False)
                found &= valid[:, None]
                text = [",".join(rules[k][0] for k in names if row[k]) if row.any() else "" for row in found]
                blocked = found[:, blocks].any(axis=1) & ~found[:, ~blocks].any(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), column, pa.array(text, pa.string()), pa.array(blocked)], ["id", "canonical", "rules", "blocked"])

    return run


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, bool], ...] = RULES) -> DataFrame:
    """(page_id, canonical_url, rules, blocked) of every row.

    rules: names of the rules that match, in alphabetical order, joined by commas. A URL is
    blocked if a blocking rule matches and no allowing one does. Null URLs match nothing, an
    empty one what an empty string matches. Rows are judged one by one: repeats, null ids and
    very long URLs are treated like others; no rows give no rows.
    """
    ship(pages.sparkSession)
    picked = pages.select(F.col(id_col).alias("id"), canonical(F.col(url_col)).alias("canonical"))
    out = picked.mapInArrow(lean(_filter(tuple(rules))), f"id {picked.dtypes[0][1]}, canonical string, rules string, blocked boolean")
    return out.withColumnsRenamed({"id": id_col, "canonical": "canonical_url"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    def regex(glob: str) -> str:
        return "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in glob)

    rules = ", ".join(f"('{n}', '{regex(g)}', {str(b).lower()})" for n, g, b in RULES)
    return rf"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
q AS (SELECT page_id,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '') AS host,
  regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
  array_to_string(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'), lambda x: NOT regexp_full_match(x, '({_TRACKING})(=.*)?')), '&') AS query FROM p),
c AS (SELECT page_id, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM q),
r(rule, pattern, blocks) AS (VALUES {rules}),
m AS (SELECT page_id, string_agg(rule, ',' ORDER BY rule) AS rules, bool_or(blocks) AND NOT bool_or(NOT blocks) AS blocked FROM c JOIN r ON regexp_full_match(canonical_url, pattern) GROUP BY page_id)
SELECT c.page_id, canonical_url, coalesce(rules, '') AS rules, coalesce(blocked, false) AS blocked FROM c LEFT JOIN m USING (page_id)
"""


SQL = _sql()
