"""Article coverage by source and period, and what is missing from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def periods(column: Column, group_by: str) -> Column:
    """Start of the day or month, as a date."""
    if group_by not in ("day", "month"):
        raise ValueError("group_by is day or month")
    return F.date_trunc(group_by, column).cast("date")


def counts(articles: DataFrame, sources: DataFrame, group_by: str = "month", since: str | None = None, until: str | None = None) -> DataFrame:
    """(slug, period_start, article_count); undated articles have a null period and pass no bound.

    until is a whole day: the bound is the start of the next one.
    """
    rows = articles
    if since:
        rows = rows.where(F.col("published_at") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        rows = rows.where(F.col("published_at") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz"))
    grouped = rows.groupBy("source_id", periods(F.col("published_at"), group_by).alias("period_start")).agg(F.count("*").alias("article_count"))
    return grouped.join(sources.select(F.col("id").alias("source_id"), "slug"), "source_id").select("slug", "period_start", "article_count")


def missing(counted: DataFrame, group_by: str = "month") -> DataFrame:
    """Periods without articles between a source's first and last dated one."""
    step = F.expr("interval 1 month" if group_by == "month" else "interval 1 day")
    dated = counted.where("period_start is not null")
    spans = dated.groupBy("slug").agg(F.min("period_start").alias("lo"), F.max("period_start").alias("hi"))
    axis = spans.select("slug", F.explode(F.sequence("lo", "hi", step)).alias("period_start"))
    return axis.join(dated, ["slug", "period_start"], "left_anti")


def summary(counted: DataFrame, sources: DataFrame) -> DataFrame:
    """Every source of the catalogue with its dated and undated articles, also where there are none."""
    dated = F.sum(F.when(F.col("period_start").isNotNull(), F.col("article_count")).otherwise(0))
    undated = F.sum(F.when(F.col("period_start").isNull(), F.col("article_count")).otherwise(0))
    per = counted.groupBy("slug").agg(dated.alias("dated"), undated.alias("undated"), F.min("period_start").alias("first"), F.max("period_start").alias("last"))
    return sources.select("slug").join(per, "slug", "left").fillna(0, ["dated", "undated"]).withColumn("total", F.col("dated") + F.col("undated"))


def without_articles(counted: DataFrame, sources: DataFrame) -> DataFrame:
    return sources.select("slug", "name").join(counted, "slug", "left_anti")


def markdown(summary_rows: DataFrame, title: str = "Article coverage") -> str:
    """The report as a Markdown table; one row a source of the catalogue reaches the driver."""
    lines = [f"# {title}", "", "| source | dated | undated | first | last |", "|---|--:|--:|---|---|"]
    for r in summary_rows.orderBy("slug").collect():
        lines.append(f"| {r['slug']} | {r['dated']} | {r['undated']} | {r['first'] or '-'} | {r['last'] or '-'} |")
    return "".join(f"{line}\n" for line in lines)
