"""The ranked case feed: public predicate, daily views, recent links, orderings, search, pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.trigram import similarity

PAGE = 20
SEARCH_THRESHOLD = 0.15
_LATEST = (("last_updated_at", "desc"), ("id", "asc"))
ORDERINGS: dict[str, tuple[tuple[str, str], ...]] = {
    "latest": _LATEST,
    "newest": (("created_at", "desc"), *_LATEST),
    "popular": (("views", "desc"), *_LATEST),
    "biggest": (("article_count", "desc"), *_LATEST),
    "trending": (("trending", "desc"), *_LATEST),
    "search": (("score", "desc"), *_LATEST),
}


def order_by(keys: tuple[tuple[str, str], ...]) -> list[Column]:
    """Nulls last in either direction, as the store sorts."""
    return [F.col(k).desc_nulls_last() if way == "desc" else F.col(k).asc_nulls_last() for k, way in keys]


def public_cases(cases: DataFrame, case_articles: DataFrame) -> DataFrame:
    """Active cases with a summary that isn't blank and at least one article."""
    shown = cases.where((F.col("status") == "active") & F.col("summary").isNotNull() & (F.length(F.trim("summary")) > 0))
    linked = case_articles.select("case_id").distinct()  # one row a case is shuffled and sorted, not one a link
    return shown.join(linked, shown.id == linked.case_id, "left_semi")


def view_totals(views: DataFrame) -> DataFrame:
    return views.groupBy("case_id").agg(F.coalesce(F.sum("view_count"), F.lit(0)).alias("views"))


def recent_links(case_articles: DataFrame, articles: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Links of each case to articles published since as_of - days (no upper bound)."""
    since = as_of - F.make_dt_interval(F.lit(days))
    fresh = articles.where(F.col("published_at") >= since).select(F.col("id").alias("article_id"))
    return case_articles.join(fresh, "article_id").groupBy("case_id").agg(F.count("*").alias("trending"))


def ranked(cases: DataFrame, case_articles: DataFrame, articles: DataFrame, views: DataFrame, as_of: Column) -> DataFrame:
    """Public cases with their view and trending counts (0 where there are none)."""
    shown = public_cases(cases, case_articles)
    counted = shown.join(view_totals(views), shown.id == F.col("case_id"), "left").drop("case_id")
    counted = counted.join(recent_links(case_articles, articles, as_of), counted.id == F.col("case_id"), "left").drop("case_id")
    return counted.withColumns({"views": F.coalesce("views", F.lit(0)), "trending": F.coalesce("trending", F.lit(0))})


def page(rows: DataFrame, sort: str, number: int = 1, size: int = PAGE) -> DataFrame:
    """The given page (from 1) in one of ORDERINGS; every ordering ends in the id, so pages are disjoint."""
    return rows.orderBy(*order_by(ORDERINGS[sort])).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int = PAGE) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


@dataclass
class Evidence:
    """Entities and events of cases, for search."""

    entities: DataFrame
    case_entities: DataFrame
    events: DataFrame
    case_events: DataFrame


def _best(items: DataFrame, links: DataFrame, item: str, fields: list[Column], query: str) -> DataFrame:
    """For each case: whether an item's field contains the query, and the best similarity to one.

    Fields are compared once an item, before items are spread over their cases.
    """
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(f.ilike(f"%{query}%"), F.lit(False))
    best = F.greatest(*[F.coalesce(similarity(f, F.lit(query)), F.lit(0.0)) for f in fields], F.lit(0.0))
    scored = items.select(F.col("id").alias(item), hit.alias("hit"), best.alias("best"))
    return links.join(scored, item).groupBy("case_id").agg(F.max("hit").alias("hit"), F.max("best").alias("best"))


def searched(rows: DataFrame, evidence: Evidence, query: str) -> DataFrame:
    """rows that match the query (substring in any field of the case, its entities or its events,
    or a trigram score over the threshold), with their score. `%` and `_` act as wildcards."""
    query = query.strip()
    like = f"%{query}%"
    ent = _best(evidence.entities, evidence.case_entities, "entity_id", [F.col("name"), F.col("description"), F.to_json("aliases")], query).toDF("ent_case", "ent_hit", "ent_best")
    evt = _best(evidence.events, evidence.case_events, "event_id", [F.col("title")], query).toDF("evt_case", "evt_hit", "evt_best")
    joined = rows.join(ent, rows.id == ent.ent_case, "left").join(evt, rows.id == evt.evt_case, "left")
    own = F.greatest(similarity(F.col("title"), F.lit(query)), F.coalesce(similarity(F.col("summary"), F.lit(query)), F.lit(0.0)))
    score = F.greatest(own, F.coalesce("ent_best", F.lit(0.0)), F.coalesce("evt_best", F.lit(0.0)))
    hit = F.coalesce(F.col("title").ilike(like), F.lit(False)) | F.coalesce(F.col("summary").ilike(like), F.lit(False)) | F.coalesce("ent_hit", F.lit(False)) | F.coalesce("evt_hit", F.lit(False))
    return joined.withColumn("score", F.round(score, 6)).where(hit | (F.col("score") > SEARCH_THRESHOLD)).select(*rows.columns, "score")


def image_candidates(case_articles: DataFrame, articles: DataFrame) -> DataFrame:
    """Image addresses of each case's articles, oldest article first, empty ones left out."""
    pictured = articles.where(F.col("image_url").isNotNull() & (F.col("image_url") != "")).select(F.col("id").alias("article_id"), "created_at", "image_url")
    held = F.array_sort(F.collect_list(F.struct("created_at", "article_id", "image_url")))
    return case_articles.join(pictured, "article_id").groupBy("case_id").agg(F.transform(held, lambda x: x["image_url"]).alias("image_urls"))
