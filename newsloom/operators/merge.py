"""Upserts and merges as pure functions from an old snapshot and a delta to a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(delta: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the last in order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return delta.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, the new row wins whole (last writer wins)."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new (one a key) whose key old lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti"))


def non_empty(new: Column, old: Column) -> Column:
    """new unless it is null or '', else old."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def metadata(old: Column, new: Column) -> Column:
    """Shallow union of two string maps; the right one wins."""
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def merge_articles(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Non-destructive article merge on identity_url.

    Incoming text fields replace stored ones only if they aren't empty, metadata is united
    with the incoming side winning, the status is overwritten, every fetch counts as an
    attempt, and a failed fetch is scheduled again: an hour after the first failure, six
    hours while at most one attempt was stored, else a day; success clears the schedule.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.identity_url") == F.col("n.identity_url"), "full_outer")
    has_old, has_new = F.col("o.identity_url").isNotNull(), F.col("n.identity_url").isNotNull()
    stored = F.coalesce(F.col("o.attempts"), F.lit(0))
    wait = F.when(~has_old, F.lit(1)).when(stored <= 1, F.lit(6)).otherwise(F.lit(24))
    later = F.when(F.col("n.fetch_status") == "failed", now + F.make_dt_interval(hours=wait))
    return both.select(
        F.coalesce("n.identity_url", "o.identity_url").alias("identity_url"), non_empty(F.col("n.title"), F.col("o.title")).alias("title"), non_empty(F.col("n.body"), F.col("o.body")).alias("body"),
        F.coalesce("n.published_at", "o.published_at").alias("published_at"), metadata(F.col("o.meta"), F.col("n.meta")).alias("meta"),
        F.when(has_new, F.col("n.fetch_status")).otherwise(F.col("o.fetch_status")).alias("fetch_status"),
        F.when(has_new, stored + 1).otherwise(stored).alias("attempts"), F.when(has_new, later).otherwise(F.col("o.next_fetch_at")).alias("next_fetch_at"),
    )


def merge_aliases(old: Column, new: Column) -> Column:
    """Ordered union without repeats."""
    return F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))))


def merge_entities(old: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply decisions (id, new_name, new_aliases, new_description, new_type, action) to entities.

    Aliases are united; a description is filled in only where there is none; `rename` takes
    the new name and keeps the old one as an alias; `retype` takes the new type.
    """
    joined = old.join(decisions, "id", "left")
    renamed = F.coalesce(F.col("action") == "rename", F.lit(False)) & F.col("new_name").isNotNull()
    aliases = merge_aliases(F.col("aliases"), F.col("new_aliases"))
    return joined.select(
        "id", F.when(renamed, F.col("new_name")).otherwise(F.col("name")).alias("name"), F.when(renamed, merge_aliases(aliases, F.array("name"))).otherwise(aliases).alias("aliases"),
        F.coalesce("description", "new_description").alias("description"), F.when(F.col("action") == "retype", F.col("new_type")).otherwise(F.col("entity_type")).alias("entity_type"),
    )


def replace_links(old: DataFrame, new: DataFrame, owner: str, item: str, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, affected pairs): the links of touched owners are replaced by new; affected are old and new pairs of them."""
    gone = old.join(touched, owner, "left_semi")
    fresh = new.join(touched, owner, "left_semi").dropDuplicates([owner, item])
    return old.join(touched, owner, "left_anti").unionByName(fresh), gone.select(owner, item).union(fresh.select(owner, item)).distinct()


def repair_dates(articles: DataFrame, found: DataFrame) -> DataFrame:
    """published_at is filled in where it was missing, and the row is flagged."""
    joined = articles.join(found.select("id", F.col("published_at").alias("__found")), "id", "left")
    repaired = F.col("published_at").isNull() & F.col("__found").isNotNull()
    return joined.withColumns({"repaired": repaired, "published_at": F.coalesce("published_at", "__found")}).drop("__found")


def group_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions (article_id, identity_id, position, confidence, role, reason) grouped by identity:
    the highest confidence, distinct roles in order, the first reason."""
    roles = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "role"))), lambda x: x["role"]))
    return decisions.groupBy("article_id", "identity_id").agg(F.max("confidence").alias("confidence"), F.array_join(roles, "; ").alias("roles"), F.min_by("reason", "position").alias("reason"))
