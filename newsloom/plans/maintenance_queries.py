"""Queries of maintenance, lenient JSON and model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import jsonx, texts
from newsloom.operators import maintenance
from newsloom.plans.bindings import JOBS_NOW, Tables, sql, ts
from newsloom.plans.registry import register
from newsloom.sources import html

_NOW = f"TIMESTAMP '{JOBS_NOW}'"
_RUNS = "runs AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'succeeded' ELSE 'failed' END AS status, ts AS started_at, event_type AS output FROM events)"


def _runs(t: Tables):
    key = F.col("event_id")
    return t.raw("events").select(key.alias("id"), F.when(key % 3 == 0, "pending").when(key % 3 == 1, "succeeded").otherwise("failed").alias("status"), F.col("ts").alias("started_at"), F.col("event_type").alias("output"), F.lit(None).cast("string").alias("error"))


@register("runs_started", f"WITH {_RUNS} SELECT id, status, started_at FROM runs UNION ALL SELECT 1000000 + o_orderkey, 'pending', {_NOW} FROM orders WHERE o_orderkey < 10")
def runs_started(spark, sf_dir):
    t = Tables(spark, sf_dir)
    new = t.raw("orders").where("o_orderkey < 10").select((F.lit(1000000) + F.col("o_orderkey")).alias("id"))
    return maintenance.start_runs(_runs(t), new, ts(JOBS_NOW)).select("id", "status", "started_at")


@register("runs_finished", f"WITH {_RUNS} SELECT id, CASE WHEN status = 'pending' AND id % 2 = 0 THEN CASE WHEN id % 10 = 0 THEN 'failed' ELSE 'succeeded' END ELSE status END AS status, CASE WHEN status = 'pending' AND id % 2 = 0 THEN 'out' ELSE output END AS output, CASE WHEN status = 'pending' AND id % 10 = 0 THEN 'bad' END AS error FROM runs")
def runs_finished(spark, sf_dir):
    runs = _runs(Tables(spark, sf_dir))
    results = runs.where("id % 2 = 0").select("id", F.lit("out").alias("output"), F.when(F.col("id") % 10 == 0, "bad").alias("error"))
    return maintenance.finish_runs(runs, results).select("id", "status", "output", "error")


@register("runs_stale", f"WITH {_RUNS} SELECT id, CASE WHEN status = 'pending' AND started_at <= {_NOW} - INTERVAL 30 MINUTE THEN 'failed' ELSE status END AS status FROM runs")
def runs_stale(spark, sf_dir):
    return maintenance.fail_stale(_runs(Tables(spark, sf_dir)), ts(JOBS_NOW)).select("id", "status")


_LINKED = "SELECT article_id FROM case_articles WHERE case_id % 3 = 0"


@register("unconnected_jobs_reset", sql("case_articles jobs", f"SELECT id, CASE WHEN hit THEN 'queued' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE attempts END AS attempts, CASE WHEN hit THEN {_NOW} ELSE run_after END AS run_after FROM (SELECT *, status = 'succeeded' AND id NOT IN ({_LINKED}) AND id IN (SELECT (props->>'$.k')::BIGINT FROM events) AS hit FROM jobs)"))
def unconnected_jobs_reset(spark, sf_dir):
    t = Tables(spark, sf_dir)
    jobs = t.jobs.withColumn("article_id", F.col("id"))
    runs = t.raw("events").select(F.to_json(F.struct(F.get_json_object("props", "$.k").alias("article_id"))).alias("metadata"))
    chosen = maintenance.unconnected_jobs(jobs, t.case_articles.where("case_id % 3 = 0"), runs)
    return maintenance.reset_jobs(jobs, chosen, ts(JOBS_NOW)).select("id", "status", "attempts", "run_after")


@register("exhausted_fetches", sql("articles", "SELECT id FROM articles WHERE fetch_status = 'failed' AND attempts >= 3"))
def exhausted_fetches(spark, sf_dir):
    return maintenance.exhausted_fetches(Tables(spark, sf_dir).articles, 3).select("id")


@register("event_row_merge", sql("news_events", """SELECT id, clash AS conflict, CASE WHEN clash OR s IS NULL THEN year ELSE coalesce(year, s) END AS year FROM (SELECT *, CASE WHEN id % 3 <> 0 THEN 1997 END AS s, coalesce(year <> CASE WHEN id % 3 <> 0 THEN 1997 END, false) AS clash FROM news_events)"""))
def event_row_merge(spark, sf_dir):
    events = Tables(spark, sf_dir).events.select("id", F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("location"), F.struct("year", "month", "day", "precision").alias("known"))
    stated = F.struct(F.lit(1997).alias("year"), F.lit(None).cast("int").alias("month"), F.lit(None).cast("int").alias("day"), F.lit("year").alias("precision"))
    decisions = events.where("id % 3 <> 0").select("id", F.lit("d").alias("new_description"), F.lit("l").alias("new_location"), stated.alias("stated"))
    return maintenance.merge_events(events, decisions).select("id", "conflict", F.col("known.year").alias("year"))


@register("hidden_cases", sql("case_articles articles cases", "SELECT id, CASE WHEN id % 7 = 0 AND revision = 2 THEN 'hidden' ELSE status END AS status FROM cases"))
def hidden_cases(spark, sf_dir):
    cases = Tables(spark, sf_dir).cases
    verdicts = cases.where("id % 7 = 0").select("id", F.lit("hide").alias("outcome"), F.lit(2).alias("revision"))
    return maintenance.hide_cases(cases, verdicts).select("id", "status")


@register("first_available_image", sql("articles case_articles", "SELECT case_id AS key, first(image_url ORDER BY article_id) AS url FROM case_articles JOIN articles ON id = article_id WHERE image_url <> '' AND article_id % 4 <> 1 GROUP BY case_id"))
def first_available_image(spark, sf_dir):
    t = Tables(spark, sf_dir)
    candidates = t.case_articles.join(t.articles.where("image_url <> ''").select(F.col("id").alias("article_id"), F.col("image_url").alias("url")), "article_id").select(F.col("case_id").alias("key"), F.col("article_id").alias("position"), "url")
    return maintenance.first_available(candidates, t.articles.where("id % 4 <> 1").select(F.col("image_url").alias("url")))


@register("json_lenient", "SELECT event_id, '{\"k\":' || (props->>'$.k') || ',\"t\":\"a\\nb\"}' AS json FROM events WHERE event_id % 4 < 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3")
def json_lenient(spark, sf_dir):
    """Fenced answers, raw newlines inside strings, and texts that aren't JSON."""
    body = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "t": "a\nb"}'))
    key = F.col("event_id") % 4
    text = F.when(key == 0, body).when(key == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(key == 2, F.concat(F.lit("  "), body)).otherwise("I can't answer")
    return Tables(spark, sf_dir).raw("events").select("event_id", jsonx.lenient_udf(text).alias("json"))


@register("json_schema_echo", "SELECT event_id, event_id % 2 = 0 AS echo FROM events")
def json_schema_echo(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, '{"properties": {"a": {}}, "type": "object"}').otherwise(F.col("props"))
    return Tables(spark, sf_dir).raw("events").select("event_id", jsonx.schema_echo(text).alias("echo"))


@register("json_keys", "SELECT event_id, true AS has_k, false AS has_x, '{}' AS rest FROM events")
def json_keys(spark, sf_dir):
    props = F.col("props")
    return Tables(spark, sf_dir).raw("events").select("event_id", jsonx.has_key(props, "k").alias("has_k"), jsonx.has_key(props, "x").alias("has_x"), jsonx.without_keys(props, "k").alias("rest"))


@register("evidence_json", sql("case_articles articles cases", """SELECT id, '{"slug":"' || slug || '","summary":' || CASE WHEN summary IS NULL THEN 'null' ELSE '"' || summary || '"' END || '}' AS json FROM cases"""))
def evidence_json(spark, sf_dir):
    return Tables(spark, sf_dir).cases.select("id", jsonx.compact(F.struct("slug", "summary")).alias("json"))


@register("clamped_text", "SELECT doc_id, CASE WHEN length(text) > 80 THEN regexp_replace(substring(text, 1, 80), '[\\s,.;:!?-]+$', '') ELSE text END AS text FROM documents")
def clamped_text(spark, sf_dir):
    return Tables(spark, sf_dir).raw("documents").select("doc_id", texts.clamp(F.col("text"), 80).alias("text"))


@register("source_validation")
def source_validation(spark, sf_dir):
    """Extraction flags of all pages, summed by language."""
    found = html.extract_pages(Tables(spark, sf_dir).raw("pages"))
    return maintenance.validation_report(found.select(F.col("language").alias("source"), texts.quality_flags(F.col("title"), F.col("body")).alias("flags")))
