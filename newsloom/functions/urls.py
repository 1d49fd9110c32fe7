"""Article identity: URL normalisation, months in URLs, pattern filters, address safety."""

from __future__ import annotations

import ipaddress
import posixpath
from urllib import parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

TRACKING = frozenset("fbclid gclid igshid mc_cid mc_eid ref utm_campaign utm_content utm_medium utm_source utm_term".split())


def normalize(url: str | None, base: str | None = None) -> str | None:
    """The identity of an article URL: https, no www., no default port, clean path, no tracking, no fragment."""
    if not url or not url.strip():
        return None
    try:
        parts = parse.urlsplit(parse.urljoin(base or "", url.strip()))
        host = (parts.hostname or "").lower().removeprefix("www.")
        port = parts.port
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not host:
        return None
    if port and port not in (80, 443):
        host = f"{host}:{port}"
    path = parse.unquote(parts.path or "/")
    while "//" in path:
        path = path.replace("//", "/")
    path = posixpath.normpath(path)
    path = "" if path in (".", "/") else parse.quote(path, safe="/:@!$&'()*+,;=~-._")
    query = parse.urlencode([(k, v) for k, v in parse.parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in TRACKING])
    return parse.urlunsplit(("https", host, path, query, ""))


@F.pandas_udf(StringType())
def normalize_udf(url: pd.Series) -> pd.Series:
    return url.map(normalize, na_action="ignore")


def normalize_simple(url: Column) -> Column:
    """normalize() for URLs without escapes and dot segments, inside the JVM."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, "^https?://([^/?]+)", 1)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, "^https?://[^/?]+([^?]*)", 1), "/+", "/"), "/$", "")
    names = "|".join(sorted(TRACKING))
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(plain, "[?](.*)$", 1)), f"&(?i:{names})=[^&]*(?=&|$)", "")
    query = F.regexp_replace(query, "^&+", "")
    out = F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", out)


def year_month(url: Column) -> Column:
    """yyyy-MM of a year and a month in a URL, else null."""
    found = F.regexp_extract(url, r"(?:^|[^0-9])((?:19|20)[0-9]{2})[-_/]?(0[1-9]|1[0-2])(?:[^0-9]|$)", 1)
    month = F.regexp_extract(url, r"(?:^|[^0-9])((?:19|20)[0-9]{2})[-_/]?(0[1-9]|1[0-2])(?:[^0-9]|$)", 2)
    return F.when(found != "", F.concat(found, F.lit("-"), month))


def may_overlap(url: Column, since: str | None, until: str | None) -> Column:
    """Whether a month in the URL overlaps [since, until] (yyyy-MM-dd); URLs without one pass."""
    month = year_month(url)
    fits = F.lit(True)
    if since:
        fits = fits & (month >= since[:7])
    if until:
        fits = fits & (month <= until[:7])
    return month.isNull() | fits


def allowed(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Matches a pattern of include (or there is none) and none of exclude."""
    any_of = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: F.rlike(url, p))
    ok = any_of(include) if include else F.lit(True)
    return ok & ~any_of(exclude) if exclude else ok


def safe_remote(url: str | None) -> bool:
    """http(s), not localhost, and no address outside the public range."""
    try:
        parts = parse.urlsplit(url or "")
        host = parts.hostname
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or host == "localhost" or host.endswith(".localhost"):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return True


@F.pandas_udf(BooleanType())
def safe_remote_udf(url: pd.Series) -> pd.Series:
    return url.map(safe_remote).astype(bool)
