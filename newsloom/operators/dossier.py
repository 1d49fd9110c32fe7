"""Sections of case, entity and sitemap pages, and evidence overlap between cases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.feed import order_by, public_cases
from newsloom.session import ship


def latest_events(events: DataFrame, case_events: DataFrame, public: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct events of public cases, the latest first (unknown months and days last)."""
    linked = case_events.join(public.select(F.col("id").alias("case_id")), "case_id", "left_semi").select(F.col("event_id").alias("id")).distinct()
    keys = (("year", "desc"), ("month", "desc"), ("day", "desc"), ("id", "desc"))
    return events.join(linked, "id", "left_semi").orderBy(*order_by(keys)).limit(limit)


def timeline(events: DataFrame, case_events: DataFrame) -> DataFrame:
    """Events of each case with their place in it: dated ones first, in order of time."""
    order = Window.partitionBy("case_id").orderBy(F.col("year").isNull(), *order_by((("year", "asc"), ("month", "asc"), ("day", "asc"), ("id", "asc"))))
    return case_events.join(events, case_events.event_id == events.id).select("case_id", "id", "year", "month", "day", "precision").withColumn("place", F.row_number().over(order))


def source_counts(case_articles: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles of each case by source."""
    by_source = case_articles.join(articles.select(F.col("id").alias("article_id"), "source_id"), "article_id").groupBy("case_id", "source_id").agg(F.count("*").alias("articles"))
    return by_source.join(sources.select(F.col("id").alias("source_id"), "slug", "name"), "source_id").select("case_id", "slug", "name", "articles")


def mentions(article_entity_cases: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of each case by the number of its articles that mention them."""
    counted = article_entity_cases.groupBy("case_id", "entity_id").agg(F.countDistinct("article_id").alias("mentions"))
    return counted.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").select("case_id", "entity_id", "name", "mentions")


def supporting_articles(article_event_cases: DataFrame) -> DataFrame:
    """How many articles support each event of each case (one join, not one query an event)."""
    return article_event_cases.groupBy("case_id", "event_id").agg(F.countDistinct("article_id").alias("supporting"))


def redirect(cases: DataFrame) -> DataFrame:
    """Merged slugs and the active case each points to; one hop, chains aren't followed."""
    merged = cases.where("status = 'merged'").select(F.col("slug").alias("old_slug"), "merged_into")
    active = cases.where("status = 'active'").select(F.col("id").alias("merged_into"), F.col("slug").alias("new_slug"))
    return merged.join(active, "merged_into").select("old_slug", "new_slug")


def visible_entities(entities: DataFrame, case_entities: DataFrame, article_entities: DataFrame, public: DataFrame) -> DataFrame:
    """Entities with a description, a public case and an article."""
    described = entities.where(F.col("description").isNotNull() & (F.col("description") != ""))
    # distinct ids of one column each: so earlier distincts of pairs drop out of the plan
    shown = case_entities.join(public.select(F.col("id").alias("case_id")).distinct(), "case_id", "left_semi").select("entity_id").distinct()
    mentioned = article_entities.select("entity_id").distinct()
    return described.join(shown, described.id == shown.entity_id, "left_semi").join(mentioned, described.id == mentioned.entity_id, "left_semi")


def entity_articles(articles: DataFrame, sources: DataFrame, article_entity_cases: DataFrame, public: DataFrame) -> DataFrame:
    """Distinct (entity, article, source) through public cases."""
    links = article_entity_cases.join(public.select(F.col("id").alias("case_id")), "case_id", "left_semi").select("entity_id", "article_id").distinct()
    named = articles.select(F.col("id").alias("article_id"), "title", "published_at", "source_id").join(sources.select(F.col("id").alias("source_id"), "slug"), "source_id")
    return links.join(named, "article_id").select("entity_id", "article_id", "title", "slug", "published_at")


def sitemap(public: DataFrame, visible: DataFrame) -> DataFrame:
    """Paths of all public cases and visible entities."""
    cases = public.select(F.concat(F.lit("/cases/"), "slug").alias("path"), F.col("last_updated_at"))
    return cases.unionByName(visible.select(F.concat(F.lit("/entities/"), "slug").alias("path"), F.lit(None).cast("timestamp_ntz").alias("last_updated_at")))


def shared_evidence(links: DataFrame, item: str, label: str, base: Column | None = None) -> DataFrame:
    """Ordered pairs of cases with the number of items both are linked to.

    base restricts the first case before the self-join, so a single page costs its own links only.
    """
    a = links.select(F.col("case_id").alias("base"), F.col(item).alias("item")).distinct()
    if base is not None:
        a = a.where(F.col("base") == base)
    b = links.select(F.col("case_id").alias("other"), F.col(item).alias("item")).distinct()
    return a.join(b, "item").where("base <> other").groupBy("base", "other").agg(F.count("*").alias(label))


def other_cases(cases: DataFrame, case_articles: DataFrame, case_events: DataFrame, case_entities: DataFrame, base: int, limit: int = 10) -> DataFrame:
    """Cases that share evidence with `base`: those sharing more kinds of it first.

    Unlike the feed this asks only for an active case with a summary, blank or not.
    """
    one = F.lit(base)
    parts = [shared_evidence(case_articles, "article_id", "shared_articles", one), shared_evidence(case_events, "event_id", "shared_events", one), shared_evidence(case_entities, "entity_id", "shared_entities", one)]
    labels = ["shared_articles", "shared_events", "shared_entities"]
    joined = cases.where((F.col("status") == "active") & F.col("summary").isNotNull() & (F.col("id") != base))
    for part in parts:
        joined = joined.join(part.drop("base").withColumnRenamed("other", "id"), "id", "left")
    joined = joined.fillna(0, labels)
    kinds = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in labels[1:]), F.when(F.col(labels[0]) > 0, 1).otherwise(0))
    keys = (("kinds", "desc"), *((c, "desc") for c in labels), ("last_updated_at", "desc"), ("id", "asc"))
    return joined.withColumn("kinds", kinds).where("kinds > 0").orderBy(*order_by(keys)).limit(limit)


def duplicate_candidates(links: DataFrame, least_tenths: int = 3) -> DataFrame:
    """Unordered pairs of cases that share at least 30 % of the smaller one's items (integer arithmetic).

    Each case is sent, for each of its items, the larger cases that have the item (of equal ones
    those with the greater id): eight bytes a pair and item. It counts them by itself, so no table
    of pairs is shuffled, and only pairs that reach the share leave it.
    """
    ship(links.sparkSession)
    clean = links.repartition("case_id").distinct()
    sized = clean.withColumn("n", F.count("*").over(Window.partitionBy("case_id"))).where("item is not null and case_id is not null")
    members = sized.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("n", "case_id"))).alias("members"))
    larger = members.where(F.size("members") > 1).select("members", F.transform("members", lambda m: m["case_id"]).alias("ids"))
    sent = larger.select("ids", F.posexplode("members").alias("place", "m")).where(F.col("place") < F.size("ids") - 1)
    held = sent.select("m.case_id", "m.n", F.expr("slice(ids, place + 2, size(ids))").alias("others")).repartition("case_id").sortWithinPartitions("case_id")
    kind = links.schema["case_id"].dataType.simpleString()
    shared = held.mapInArrow(_count_others(least_tenths), f"case_a {kind}, case_b {kind}, shared long, n_a long")
    n_b = clean.groupBy(F.col("case_id").alias("case_b")).agg(F.count("*").alias("n_b"))
    found = shared.join(n_b, "case_b")
    turned = F.col("case_a") > F.col("case_b")
    swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return found.select(swap("case_a", "case_b").alias("case_a"), swap("case_b", "case_a").alias("case_b"), "shared", swap("n_a", "n_b").alias("n_a"), swap("n_b", "n_a").alias("n_b"))


def _count_others(least_tenths: int):
    """Rows (case_id, n, others), sorted by case -> the cases that occur among a case's others often enough."""

    def found(case, n: int, parts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        counted = pa.chunked_array(parts).value_counts()
        kept = counted.filter(pc.greater_equal(pc.multiply(counted.field("counts"), 10), n * least_tenths))
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.repeat(case, len(kept)), kept.field("values"), kept.field("counts"), pa.array(np.full(len(kept), n))], ["case_a", "case_b", "shared", "n_a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, n, parts = None, 0, []
        for batch in batches:
            ids, sizes, others = batch.column("case_id"), batch.column("n"), batch.column("others")
            ends = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1
            for lo, hi in zip(np.r_[0, ends], np.r_[ends, batch.num_rows], strict=True) if batch.num_rows else ():
                if parts and ids[int(lo)] != case:
                    yield from found(case, n, parts)
                    parts = []
                case, n = ids[int(lo)], sizes[int(lo)].as_py()
                parts.append(others.slice(int(lo), int(hi - lo)).flatten())
        if parts:
            yield from found(case, n, parts)

    return run


def case_page(tables, slug: str) -> DataFrame:
    """One row for a public case: its own columns, and its sections as arrays of structs."""
    case = public_cases(tables.cases, tables.case_articles).where(F.col("slug") == slug)
    key = case.select(F.col("id").alias("case_id"))

    def section(rows: DataFrame, label: str, fields: list[str]) -> DataFrame:
        mine = rows.join(key, "case_id", "left_semi")
        return mine.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(label))

    sections = [
        section(source_counts(tables.case_articles, tables.articles, tables.sources).withColumn("order", -F.col("articles")), "sources", ["order", "name", "slug", "articles"]),
        section(mentions(tables.article_entity_cases, tables.entities).withColumn("order", -F.col("mentions")), "entities", ["order", "name", "entity_id", "mentions"]),
        section(timeline(tables.events, tables.case_events.join(key, "case_id", "left_semi")), "timeline", ["place", "id", "year", "month", "day"]),
    ]
    page = case
    for s in sections:
        page = page.join(s, page.id == s.case_id, "left").drop("case_id")
    return page
