"""Work discovery: what lacks a stage's result, and what is due again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.feed import order_by

OLDEST = (("published_at", "asc"), ("created_at", "asc"), ("id", "asc"))


def lacking(candidates: DataFrame, results: DataFrame, key: str, limit: int) -> DataFrame:
    """Candidates without a result, the oldest first."""
    return candidates.join(results.select(F.col(key).alias("__key")), candidates.id == F.col("__key"), "left_anti").orderBy(*order_by(OLDEST)).limit(limit)


def due_audit(cases: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Active cases whose evidence moved past the audit, or never audited, or audited before cutoff."""
    due = F.col("audited_revision").isNull() | (F.col("audited_revision") < F.col("revision"))
    if cutoff is not None:
        due = due | (F.col("audited_at") <= cutoff)
    return cases.where((F.col("status") == "active") & due)


def due_refresh(cases: DataFrame) -> DataFrame:
    """Active cases with a blank summary, or whose article count crossed a square since the last refresh."""
    blank = F.col("summary").isNull() | (F.trim("summary") == "")
    crossed = (F.col("article_count") > F.col("refreshed_count")) & (F.col("article_count") > 0) & (F.floor(F.sqrt("article_count")) > F.floor(F.sqrt("refreshed_count")))
    return cases.where((F.col("status") == "active") & (blank | crossed))


def latest(rows: DataFrame, key: str, order: tuple[tuple[str, str], ...]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order_by(order))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def audit_rerun(audits: DataFrame, jobs: DataFrame, limit: int) -> DataFrame:
    """Cases whose latest audit was coherent and whose job succeeded."""
    coherent = latest(audits, "case_id", (("created_at", "desc"), ("id", "desc"))).where("outcome = 'coherent'")
    done = jobs.where("status = 'succeeded'").select(F.col("article_id").alias("case_id")).distinct()
    return coherent.join(done, "case_id", "left_semi").orderBy("case_id").limit(limit)


def stalest_interest(cases: DataFrame, audits: DataFrame, limit: int) -> DataFrame:
    """Active cases by their latest audit, never audited ones first."""
    last = audits.groupBy("case_id").agg(F.max("created_at").alias("audited_at"))
    active = cases.where("status = 'active'")
    return active.join(last, active.id == last.case_id, "left").orderBy(F.col("audited_at").asc_nulls_first(), "id").limit(limit).select("id", "audited_at")


def skippable(urls: DataFrame, articles: DataFrame, max_attempts: int, now: Column) -> DataFrame:
    """URLs already fetched, out of attempts, or not yet due again."""
    done = (F.col("fetch_status") == "succeeded") | (F.col("attempts") >= max_attempts) | (F.col("next_fetch_at") > now)
    return urls.join(articles.where(done).select("identity_url"), "identity_url", "left_semi")


def retry_due(articles: DataFrame, max_attempts: int, now: Column, limit: int) -> DataFrame:
    due = (F.col("fetch_status") == "failed") & (F.col("attempts") < max_attempts) & (F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= now))
    return articles.where(due).orderBy(F.col("next_fetch_at").asc_nulls_first(), "id").limit(limit)


def after_key(rows: DataFrame, created_at: Column, id_: Column, limit: int) -> DataFrame:
    """The next batch of a keyset scan in order of (created_at, id)."""
    past = F.struct(F.col("created_at"), F.col("id")) > F.struct(created_at.alias("created_at"), id_.alias("id"))
    return rows.where(past).orderBy("created_at", "id").limit(limit)
