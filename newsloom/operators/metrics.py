"""Pipeline metrics: queue summaries, ages, recent runs, the connectivity funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_MINUTES = 30


def stale(now: Column) -> Column:
    """A running job whose lease is 30 minutes old or older."""
    return (F.col("status") == "running") & (F.col("locked_at") <= now - F.make_dt_interval(mins=F.lit(STALE_MINUTES)))


def eligible(now: Column) -> Column:
    """A job that may be claimed: attempts left, and queued and due or running on a stale lease."""
    due = (F.col("status") == "queued") & (F.col("run_after").isNull() | (F.col("run_after") <= now))
    return F.coalesce((F.col("attempts") < F.col("max_attempts")) & (due | stale(now)), F.lit(False))


def queue_summary(jobs: DataFrame, now: Column) -> DataFrame:
    """Queued, running, blocked and failed jobs, exhausted running ones, and the next due time."""
    exhausted = F.col("attempts") >= F.col("max_attempts")
    queued, running = F.col("status") == "queued", F.col("status") == "running"
    return jobs.agg(
        F.count_if(queued & ~exhausted).alias("queued_jobs"), F.count_if(running & ~exhausted).alias("running_jobs"), F.count_if(queued & exhausted).alias("blocked_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"), F.count_if(F.coalesce(stale(now), F.lit(False)) & exhausted).alias("blocked_running_jobs"),
        F.min(F.when(queued & ~exhausted, F.col("run_after"))).alias("next_run_after"),
    )


def by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_type", "status").agg(F.count("*").alias("jobs"))


def oldest_queued(jobs: DataFrame, now: Column) -> DataFrame:
    """Age in whole seconds of each type's oldest queued job, never negative."""
    oldest = jobs.where("status = 'queued'").groupBy("job_type").agg(F.min("created_at").alias("oldest"))
    age = F.timestamp_diff("SECOND", F.col("oldest"), now)
    return oldest.select("job_type", "oldest", F.greatest(F.lit(0), age).cast("long").alias("age_seconds"))


def recent_runs(runs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Runs of the last hours by type and status."""
    return runs.where(F.col("created_at") >= now - F.make_dt_interval(hours=F.lit(hours))).groupBy("job_type", "status").agg(F.count("*").alias("runs"))


def active_cooldowns(cooldowns: DataFrame, now: Column) -> DataFrame:
    return cooldowns.select("scope", F.coalesce(F.col("resume_at") > now, F.lit(False)).cast("int").alias("active"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 for an empty whole."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 6))


def funnel(articles: DataFrame, relevant: DataFrame, case_articles: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: articles, candidates, succeeded resolutions, those linked to a case, and the rates."""
    linked = case_articles.select("article_id").distinct().withColumn("linked", F.lit(True))
    candidate = relevant.where("is_relevant").select("article_id").distinct().withColumn("candidate", F.lit(True))
    done = jobs.where("status = 'succeeded'").select("article_id").distinct().withColumn("done", F.lit(True))
    base = articles.select(F.col("id").alias("article_id"))
    for flag in (linked, candidate, done):
        base = base.join(flag, "article_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    counted = base.agg(F.count("*").alias("articles"), F.count_if(yes("candidate")).alias("candidates"), F.count_if(yes("done")).alias("resolved"), F.count_if(yes("done") & yes("linked")).alias("connected"))
    return counted.withColumns({"candidate_rate": rate(F.col("candidates"), F.col("articles")), "connection_rate": rate(F.col("connected"), F.col("resolved"))})


def unconnected(jobs: DataFrame, case_articles: DataFrame, limit: int = 20) -> DataFrame:
    """Succeeded resolutions whose article is in no case, the latest first."""
    done = jobs.where("status = 'succeeded'").groupBy("article_id").agg(F.max("created_at").alias("finished_at"))
    return done.join(case_articles, "article_id", "left_anti").orderBy(F.desc("finished_at"), "article_id").limit(limit)


def exposition(rows: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """Lines of the Prometheus text format, with escaped label values."""
    def label(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("\\", "\\\\"), ("\n", "\\n"), ('"', '\\"')):
            text = F.replace(text, F.lit(a), F.lit(b))
        return F.concat(F.lit(f'{c}="'), text, F.lit('"'))

    return rows.select(F.concat(F.lit(metric + "{"), F.array_join(F.array(*map(label, labels)), ","), F.lit("} "), F.col(value).cast("string")).alias("line"))
