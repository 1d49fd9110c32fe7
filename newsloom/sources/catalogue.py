"""The static source catalogue and a deterministic demonstration graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE_SCHEMA = "slug string, name string, base_url string, source_type string, language string, include array<string>, exclude array<string>, crawl_delay double"
KINDS = ("news", "investigative", "regional", "agency", "broadcaster", "official", "fact_check", "other")


def catalogue(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """A table of source configurations; by default 33 invented ones, one row each."""
    if rows is None:
        rows = [(f"source-{k}", f"Source {k}", f"https://source{k}.example", KINDS[k % 8], "uk", ["/news/", "/article/"], ["/tag/", "/video/"], 0.0 if k % 4 else 1.0) for k in range(33)]
    return spark.createDataFrame(rows, CATALOGUE_SCHEMA)


def demo(spark: SparkSession, cases: int = 164, articles: int = 496, events: int = 237, entities: int = 88, sources: int = 12) -> dict[str, DataFrame]:
    """Linked demonstration tables of the given sizes, by modular arithmetic alone."""
    start = F.lit("2026-06-01 00:00:00").cast("timestamp_ntz")
    a = spark.range(articles).select("id", (F.col("id") % sources).alias("source_id"), F.concat(F.lit("Article "), "id").alias("title"), (start - F.make_dt_interval(hours=(F.col("id") * 5).cast("int"))).alias("published_at"), F.when(F.col("id") % 5 < 3, F.concat(F.lit("https://img.example/"), "id")).alias("image_url"))
    c = spark.range(cases).select("id", F.concat(F.lit("case-"), "id").alias("slug"), F.concat(F.lit("Case "), "id").alias("title"), F.lit("active").alias("status"))
    precision = F.element_at(F.array(*map(F.lit, "day month year unknown".split())), (F.col("id") % 4 + 1).cast("int"))
    day = F.date_sub(start.cast("date"), (F.col("id") * 3).cast("int"))
    e = spark.range(events).select("id", F.concat(F.lit("Event "), "id").alias("title"), precision.alias("precision"), F.when(F.col("id") % 4 < 3, F.year(day)).alias("year"), F.when(F.col("id") % 4 < 2, F.month(day)).alias("month"), F.when(F.col("id") % 4 < 1, F.dayofmonth(day)).alias("day"))
    n = spark.range(entities).select("id", F.concat(F.lit("Entity "), "id").alias("name"), (F.col("id") % 8).alias("entity_type"))
    own = a.select((F.col("id") % cases).alias("case_id"), F.col("id").alias("article_id"))
    beside = [own.where(f"article_id % {m} = 0").select(((F.col("case_id") + k) % cases).alias("case_id"), "article_id") for k, m in ((1, 2), (2, 7))]
    links = own.union(beside[0]).union(beside[1]).distinct()
    return {
        "sources": spark.range(sources).select("id", F.concat(F.lit("source-"), "id").alias("slug")), "articles": a, "cases": c, "events": e, "entities": n, "case_articles": links,
        "case_events": e.select((F.col("id") % cases).alias("case_id"), F.col("id").alias("event_id")), "case_entities": links.select("case_id", (F.col("article_id") % entities).alias("entity_id")).distinct(),
    }
