"""Runs, resets and repairs: what maintenance changes, each as a selection and a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates


def start_runs(runs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """runs and new ones, pending since now."""
    fresh = new.withColumns({"status": F.lit("pending"), "started_at": now, "output": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    return runs.unionByName(fresh.select(runs.columns))


def finish_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Pending runs take their result (id, output, error); an error fails them."""
    named = results.select("id", F.col("output").alias("__out"), F.col("error").alias("__err"), F.lit(True).alias("__hit"))
    mine = (F.col("status") == "pending") & F.col("__hit").isNotNull()
    return runs.join(named, "id", "left").withColumns({
        "status": F.when(mine & F.col("__err").isNull(), "succeeded").when(mine, "failed").otherwise(F.col("status")),
        "output": F.when(mine, F.col("__out")).otherwise(F.col("output")), "error": F.when(mine, F.col("__err")).otherwise(F.col("error")),
    }).drop("__out", "__err", "__hit")


def fail_stale(runs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Runs pending for `minutes` or longer fail."""
    stale = (F.col("status") == "pending") & (F.col("started_at") <= now - F.make_dt_interval(mins=F.lit(minutes)))
    return runs.withColumns({"error": F.when(stale, "stale pending run").otherwise(F.col("error")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def reset_jobs(jobs: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """Chosen jobs are queued again with no attempts, lease or error."""
    mine = F.col("__hit").isNotNull()
    return jobs.join(chosen.select("id", F.lit(True).alias("__hit")), "id", "left").withColumns({
        "status": F.when(mine, "queued").otherwise(F.col("status")), "attempts": F.when(mine, 0).otherwise(F.col("attempts")),
        "run_after": F.when(mine, now).otherwise(F.col("run_after")), "locked_at": F.when(~mine, F.col("locked_at")),
    }).drop("__hit")


def unconnected_jobs(jobs: DataFrame, links: DataFrame, runs: DataFrame) -> DataFrame:
    """Succeeded jobs whose article has no link although a run names it in its metadata."""
    named = runs.select(F.get_json_object("metadata", "$.article_id").cast("long").alias("article_id"))
    return jobs.where("status = 'succeeded'").join(links, "article_id", "left_anti").join(named, "article_id", "left_semi")


def exhausted_fetches(articles: DataFrame, max_attempts: int) -> DataFrame:
    return articles.where((F.col("fetch_status") == "failed") & (F.col("attempts") >= max_attempts))


def merge_events(old: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events with what decisions (id, new_description, new_location, stated) add: empty fields
    are filled, unknown date parts too; contradicting parts leave the event and set `conflict`."""
    joined = old.join(decisions, "id", "left")
    clash = F.col("stated").isNotNull() & dates.conflicts(F.col("known"), F.col("stated"))
    merged = F.when(clash | F.col("stated").isNull(), F.col("known")).otherwise(dates.enrich(F.col("known"), F.col("stated")))
    return joined.select("id", F.coalesce("description", "new_description").alias("description"), F.coalesce("location", "new_location").alias("location"), merged.alias("known"), clash.alias("conflict"))


def hide_cases(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cases with a hide verdict on their present revision become hidden; outdated verdicts do nothing."""
    said = verdicts.select("id", F.col("outcome").alias("__outcome"), F.col("revision").alias("__read"))
    hide = (F.col("__outcome") == "hide") & (F.col("__read") == F.col("revision"))
    return cases.join(said, "id", "left").withColumn("status", F.when(F.coalesce(hide, F.lit(False)), "hidden").otherwise(F.col("status"))).drop("__outcome", "__read")


def first_available(candidates: DataFrame, available: DataFrame) -> DataFrame:
    """The first candidate (key, position, url) of each key that is available."""
    return candidates.join(available.select("url").distinct(), "url", "left_semi").groupBy("key").agg(F.min_by("url", "position").alias("url"))


def split_table(rows: DataFrame, card: list[str], gate: list[str]) -> tuple[DataFrame, DataFrame]:
    """One table with two concerns becomes two: rows of the first concern, and all decisions."""
    return rows.where(F.col(card[-1]).isNotNull()).select(card), rows.select(gate)


def validation_report(pages: DataFrame) -> DataFrame:
    """Per source: sampled pages, those without any flag, and whether all passed."""
    counted = pages.groupBy("source").agg(F.count("*").alias("sampled"), F.count_if(F.size("flags") == 0).alias("passed"))
    return counted.withColumn("ok", F.col("sampled") == F.col("passed"))


def connectivity_markdown(funnel: DataFrame, examples: DataFrame) -> str:
    """The funnel (one row) and a few examples as Markdown."""
    f = funnel.first()
    lines = ["# Case resolution connectivity", "", "| stage | articles |", "| --- | ---: |", *(f"| {k} | {f[k]} |" for k in ("articles", "candidates", "resolved", "connected"))]
    lines += ["", f"Connection rate: {100 * f['connection_rate']:.1f} %", "", "| article | finished |", "| --- | --- |"]
    return "\n".join([*lines, *(f"| {r['article_id']} | {r['finished_at']} |" for r in examples.collect())]) + "\n"
