"""Materialised links and counters of cases, and the split and merge of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_entities(article_entity_cases: DataFrame, articles: DataFrame) -> DataFrame:
    """Mentions and the first article (published nulls last, created, id) of each case and entity."""
    dated = article_entity_cases.join(articles.select(F.col("id").alias("article_id"), "published_at", "created_at"), "article_id")
    first = F.struct(F.col("published_at").isNull(), "published_at", "created_at", "article_id")
    return dated.groupBy("case_id", "entity_id").agg(F.countDistinct("article_id").alias("mention_count"), F.min_by("article_id", first).alias("first_article_id"))


def case_events(article_event_cases: DataFrame, events: DataFrame) -> DataFrame:
    """Supporting articles of each case and event, with the event's date parts."""
    counted = article_event_cases.groupBy("case_id", "event_id").agg(F.countDistinct("article_id").alias("supporting_article_count"))
    return counted.join(events.select(F.col("id").alias("event_id"), "year", "month", "day", "precision"), "event_id")


def event_counts(materialized: DataFrame) -> DataFrame:
    return materialized.groupBy("case_id").agg(F.count("*").alias("event_count"))


def case_counts(case_articles: DataFrame, articles: DataFrame) -> DataFrame:
    """Article count and first and last publication of each case."""
    dated = case_articles.join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id")
    return dated.groupBy("case_id").agg(F.count("*").alias("article_count"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


def create_cases(cases: DataFrame, cards: DataFrame, articles: DataFrame, now: Column) -> DataFrame:
    """cases and a new active one for each card (id, article_id, title): titled by the card, without
    a summary, of one article and revision 1, last updated when the article was published. Cards
    whose case id is taken are left out, a repeated id counts once (the least article)."""
    one = cards.groupBy("id").agg(F.min_by(F.struct("article_id", "title"), "article_id").alias("card")).select("id", "card.*")
    dated = one.join(cases.select("id"), "id", "left_anti").join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id", "left")
    values = {"title": F.col("title"), "status": F.lit("active"), "article_count": F.lit(1), "revision": F.lit(1), "created_at": now, "last_updated_at": F.coalesce("published_at", now)}
    new = dated.select(*[(F.col("id") if c == "id" else values.get(c, F.lit(None))).cast(t).alias(c) for c, t in cases.dtypes])
    return cases.unionByName(new)


def add_links(cases: DataFrame, links: DataFrame, new: DataFrame, articles: DataFrame) -> DataFrame:
    """Counters of cases after new links: each link not there before adds one article and one
    revision, and moves last_updated_at forward, never back."""
    fresh = new.distinct().join(links, ["case_id", "article_id"], "left_anti").join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id")
    delta = fresh.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("d"), F.max("published_at").alias("p"))
    more = F.coalesce("d", F.lit(0))
    return cases.join(delta, "id", "left").withColumns({"article_count": F.col("article_count") + more, "revision": (F.col("revision") + more).cast("int"), "last_updated_at": F.greatest("last_updated_at", "p")}).drop("d", "p")


def split(links: DataFrame, case_id: Column, assignments: DataFrame) -> DataFrame:
    """Links after a case is split: all of its links go, assignments (case_id, article_id) come."""
    return links.where(F.col("case_id") != case_id).unionByName(assignments.select(links.columns)).distinct()


def survivor(a: DataFrame) -> DataFrame:
    """Of pairs with counts and dates of both cases, which survives: more articles, older, smaller id."""
    left = F.struct((-F.col("count_a")).alias("n"), F.col("created_a").alias("c"), F.col("case_a").cast("string").alias("k"))
    right = F.struct((-F.col("count_b")).alias("n"), F.col("created_b").alias("c"), F.col("case_b").cast("string").alias("k"))
    first = left <= right
    return a.withColumns({"survivor": F.when(first, F.col("case_a")).otherwise(F.col("case_b")), "absorbed": F.when(first, F.col("case_b")).otherwise(F.col("case_a"))})


def merge_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Links after cases are absorbed (absorbed -> survivor), without repeats."""
    moved = links.join(mapping, links.case_id == mapping.absorbed, "left")
    return moved.select(F.coalesce("survivor", "case_id").alias("case_id"), *[c for c in links.columns if c != "case_id"]).distinct()


def merge_cases(cases: DataFrame, mapping: DataFrame) -> DataFrame:
    """Absorbed cases become `merged` and point to their survivor, whose revision grows by one."""
    kept = mapping.select(F.col("survivor").alias("__kept")).distinct()
    joined = cases.join(mapping.select(F.col("absorbed").alias("id"), F.col("survivor").alias("__into")), "id", "left").join(kept, cases.id == F.col("__kept"), "left")
    return joined.withColumns({
        "status": F.when(F.col("__into").isNotNull(), "merged").otherwise(F.col("status")), "merged_into": F.coalesce("__into", "merged_into"),
        "revision": (F.col("revision") + F.when(F.col("__kept").isNotNull(), 1).otherwise(0)).cast("int"),
    }).drop("__into", "__kept")
