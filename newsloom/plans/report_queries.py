"""Queries of reports, metrics, planners and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import coverage, metrics, planner, sampling
from newsloom.plans.bindings import JOBS_NOW, Tables, sql, ts
from newsloom.plans.registry import register

_MONTHS = "c AS (SELECT slug, date_trunc('month', published_at)::DATE AS period_start, count(*) AS article_count FROM articles JOIN sources s ON s.id = source_id GROUP BY ALL)"
_NOW = f"TIMESTAMP '{JOBS_NOW}'"


def _months(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t, coverage.counts(t.articles.where("id % 8 <> 3"), t.sources)


_GAPPY = _MONTHS.replace("GROUP BY", "WHERE articles.id % 8 <> 3 GROUP BY")


@register("coverage_by_month", sql("sources articles", "SELECT * FROM c", _MONTHS))
def coverage_by_month(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return coverage.counts(t.articles, t.sources)


@register("coverage_by_day_window", sql("sources articles", "SELECT slug, published_at::DATE AS period_start, count(*) AS article_count FROM articles JOIN sources s ON s.id = source_id WHERE published_at >= TIMESTAMP '1997-03-01' AND published_at < TIMESTAMP '1997-05-16' GROUP BY ALL"))
def coverage_by_day_window(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return coverage.counts(t.articles, t.sources, "day", "1997-03-01", "1997-05-15")


@register(
    "coverage_missing_periods",
    sql("sources articles", "SELECT slug, period_start FROM (SELECT slug, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS period_start FROM (SELECT slug, min(period_start) AS lo, max(period_start) AS hi FROM c GROUP BY slug)) ANTI JOIN c USING (slug, period_start)",
        "c AS (SELECT slug, published_at::DATE AS period_start, count(*) AS article_count FROM articles JOIN sources s ON s.id = source_id WHERE published_at IS NOT NULL GROUP BY ALL)"),
)
def coverage_missing_periods(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return coverage.missing(coverage.counts(t.articles, t.sources, "day"), "day")


@register("coverage_summary", sql("sources articles", "SELECT s.slug, coalesce(sum(article_count) FILTER (period_start IS NOT NULL), 0)::BIGINT AS dated, coalesce(sum(article_count) FILTER (period_start IS NULL), 0)::BIGINT AS undated, min(period_start) AS first, max(period_start) AS last, coalesce(sum(article_count), 0)::BIGINT AS total FROM sources s LEFT JOIN c ON c.slug = s.slug GROUP BY s.slug", _GAPPY))
def coverage_summary(spark, sf_dir):
    t, counted = _months(spark, sf_dir)
    return coverage.summary(counted, t.sources)


@register("coverage_sources_without", sql("sources articles", "SELECT slug, name FROM sources s WHERE NOT EXISTS (SELECT 1 FROM articles WHERE source_id = s.id AND published_at < TIMESTAMP '1995-01-12')"))
def coverage_sources_without(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return coverage.without_articles(coverage.counts(t.articles, t.sources, until="1995-01-11"), t.sources)


_ELIGIBLE = f"(attempts < max_attempts AND ((status = 'queued' AND (run_after IS NULL OR run_after <= {_NOW})) OR (status = 'running' AND locked_at <= {_NOW} - INTERVAL 30 MINUTE)))"


@register("queue_summary", sql("jobs", f"""SELECT count(*) FILTER (status = 'queued' AND attempts < max_attempts) AS queued_jobs, count(*) FILTER (status = 'running' AND attempts < max_attempts) AS running_jobs,
 count(*) FILTER (status = 'queued' AND attempts >= max_attempts) AS blocked_jobs, count(*) FILTER (status = 'failed') AS failed_jobs,
 count(*) FILTER (status = 'running' AND locked_at <= {_NOW} - INTERVAL 30 MINUTE AND attempts >= max_attempts) AS blocked_running_jobs, min(run_after) FILTER (status = 'queued' AND attempts < max_attempts) AS next_run_after FROM jobs"""))
def queue_summary(spark, sf_dir):
    return metrics.queue_summary(Tables(spark, sf_dir).jobs, ts(JOBS_NOW))


@register("jobs_by_status", sql("jobs", "SELECT job_type, status, count(*) AS jobs FROM jobs GROUP BY ALL"))
def jobs_by_status(spark, sf_dir):
    return metrics.by_status(Tables(spark, sf_dir).jobs)


@register("oldest_queued_age", sql("jobs", f"SELECT job_type, min(created_at) AS oldest, greatest(0, date_sub('second', min(created_at), {_NOW}))::BIGINT AS age_seconds FROM jobs WHERE status = 'queued' GROUP BY job_type"))
def oldest_queued_age(spark, sf_dir):
    return metrics.oldest_queued(Tables(spark, sf_dir).jobs, ts(JOBS_NOW))


@register("llm_runs_recent", sql("jobs", f"SELECT job_type, status, count(*) AS runs FROM jobs WHERE created_at >= {_NOW} - INTERVAL 24 HOUR GROUP BY ALL"))
def llm_runs_recent(spark, sf_dir):
    return metrics.recent_runs(Tables(spark, sf_dir).jobs, ts(JOBS_NOW))


@register("metrics_exposition", sql("jobs", """SELECT 'loom_jobs{job_type="' || job_type || '",status="' || status || '"} ' || count(*) AS line FROM jobs GROUP BY job_type, status"""))
def metrics_exposition(spark, sf_dir):
    return metrics.exposition(metrics.by_status(Tables(spark, sf_dir).jobs), "loom_jobs", ["job_type", "status"], "jobs")


_FLAGS = "rel AS (SELECT doc_id AS article_id, quality = 1 AS is_relevant FROM labels), linked AS (SELECT DISTINCT article_id FROM case_articles WHERE case_id % 3 = 0), done AS (SELECT DISTINCT id AS article_id FROM jobs WHERE status = 'succeeded')"


@register("connectivity_funnel", sql("articles case_articles jobs", """SELECT articles, candidates, resolved, connected, CASE WHEN articles = 0 THEN 0.0 ELSE round(candidates::DOUBLE / articles, 6) END AS candidate_rate, CASE WHEN resolved = 0 THEN 0.0 ELSE round(connected::DOUBLE / resolved, 6) END AS connection_rate
FROM (SELECT count(*) AS articles, count(*) FILTER (id IN (SELECT article_id FROM rel WHERE is_relevant)) AS candidates, count(*) FILTER (id IN (FROM done)) AS resolved, count(*) FILTER (id IN (FROM done) AND id IN (FROM linked)) AS connected FROM articles)""", _FLAGS))
def connectivity_funnel(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rel = t.raw("labels").select(F.col("doc_id").alias("article_id"), (F.col("quality") == 1).alias("is_relevant"))
    return metrics.funnel(t.articles, rel, t.case_articles.where("case_id % 3 = 0"), t.jobs.withColumn("article_id", F.col("id")))


@register("unconnected_examples", sql("case_articles jobs", "SELECT id AS article_id, max(created_at) AS finished_at FROM jobs WHERE status = 'succeeded' AND id NOT IN (FROM linked) GROUP BY id ORDER BY finished_at DESC, article_id LIMIT 20", "linked AS (SELECT DISTINCT article_id FROM case_articles WHERE case_id % 3 = 0)"))
def unconnected_examples(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return metrics.unconnected(t.jobs.withColumn("article_id", F.col("id")), t.case_articles.where("case_id % 3 = 0"))


_OLDEST = "ORDER BY published_at NULLS LAST, created_at, id LIMIT 100"


@register("missing_relevance", sql("articles", f"SELECT id, published_at FROM articles WHERE fetch_status = 'succeeded' AND id NOT IN (SELECT doc_id FROM labels) {_OLDEST}"))
def missing_relevance(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return planner.lacking(t.articles.where("fetch_status = 'succeeded'"), t.raw("labels"), "doc_id", 100).select("id", "published_at")


@register("missing_gate", sql("articles", f"SELECT id, published_at FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) {_OLDEST}"))
def missing_gate(spark, sf_dir):
    t = Tables(spark, sf_dir)
    relevant = t.articles.join(t.raw("labels").where("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return planner.lacking(relevant, t.raw("labels").where("toxic = 1"), "doc_id", 100).select("id", "published_at")


@register("missing_card", sql("articles", f"SELECT id, published_at FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND id NOT IN (SELECT conv_id FROM conversations) {_OLDEST}"))
def missing_card(spark, sf_dir):
    t = Tables(spark, sf_dir)
    accepted = t.articles.join(t.raw("labels").where("toxic = 0").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return planner.lacking(accepted, t.raw("conversations"), "conv_id", 100).select("id", "published_at")


_CASES = "case_articles articles cases"


@register("due_audit", sql(_CASES, "SELECT id FROM cases WHERE status = 'active' AND (audited_revision IS NULL OR audited_revision < revision)"))
def due_audit(spark, sf_dir):
    return planner.due_audit(Tables(spark, sf_dir).cases).select("id")


@register("due_refresh", sql(_CASES, "SELECT id, article_count FROM cases WHERE status = 'active' AND (summary IS NULL OR trim(summary) = '' OR (article_count > refreshed_count AND article_count > 0 AND floor(sqrt(article_count)) > floor(sqrt(refreshed_count + 25))))"))
def due_refresh(spark, sf_dir):
    return planner.due_refresh(Tables(spark, sf_dir).cases.withColumn("refreshed_count", F.col("refreshed_count") + 25)).select("id", "article_count")


_AUDITS = "audits AS (SELECT event_id AS id, user_id AS case_id, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN 'split' ELSE 'coherent' END AS outcome FROM events WHERE event_type = 'purchase')"


def _audits(t: Tables):
    return t.raw("events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("case_id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, "split").otherwise("coherent").alias("outcome"))


@register("latest_audit_rerun", sql("jobs", """SELECT id, case_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, id DESC) AS rn FROM audits) WHERE rn = 1 AND outcome = 'coherent'
 AND case_id IN (SELECT article_id FROM jobs WHERE status = 'succeeded') ORDER BY case_id LIMIT 50""", _AUDITS))
def latest_audit_rerun(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return planner.audit_rerun(_audits(t), t.jobs, 50).select("id", "case_id", "outcome")


@register("stalest_interest_audit", sql(_CASES, "SELECT c.id, max(a.created_at) AS audited_at FROM cases c LEFT JOIN audits a ON a.case_id = c.id WHERE status = 'active' AND c.id < 200 GROUP BY c.id ORDER BY audited_at NULLS FIRST, c.id LIMIT 100", _AUDITS))
def stalest_interest_audit(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return planner.stalest_interest(t.cases.where("id < 200"), _audits(t), 100)


@register("retry_due_articles", sql("articles", "SELECT id, attempts FROM articles WHERE fetch_status = 'failed' AND attempts < 3 AND created_at + INTERVAL 6 HOUR <= TIMESTAMP '1998-01-01' ORDER BY created_at + INTERVAL 6 HOUR NULLS FIRST, id LIMIT 100"))
def retry_due_articles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return planner.retry_due(t.articles.withColumn("next_fetch_at", F.expr("created_at + interval 6 hours")), 3, ts("1998-01-01"), 100).select("id", "attempts")


@register("keyset_batch", sql("articles", "SELECT id, created_at FROM articles WHERE (created_at, id) > (TIMESTAMP '1997-05-28', 1) ORDER BY created_at, id LIMIT 50"))
def keyset_batch(spark, sf_dir):
    return planner.after_key(Tables(spark, sf_dir).articles, ts("1997-05-28"), F.lit(1), 50).select("id", "created_at")


_CARDS = "cards AS (SELECT case_id, article_id, published_at, created_at, (row_number() OVER (PARTITION BY case_id ORDER BY published_at NULLS LAST, created_at, article_id) - 1)::INTEGER AS position, count(*) OVER (PARTITION BY case_id) AS n FROM case_articles JOIN articles ON id = article_id)"


def _cards(t: Tables):
    dated = t.articles.select(F.col("id").alias("article_id"), "published_at", "created_at", "title")
    return t.case_articles.join(dated, "article_id"), [F.col(c).asc_nulls_last() for c in ("published_at", "created_at", "article_id")]


@register("representative_titles", sql("articles case_articles", "SELECT case_id, title, position + 1 AS position FROM cards JOIN articles a ON a.id = article_id WHERE position < 8", _CARDS))
def representative_titles(spark, sf_dir):
    rows, order = _cards(Tables(spark, sf_dir))
    return sampling.representative(rows, "case_id", order).select("case_id", "title", "position")


@register("first_latest_sample", sql("articles case_articles", "SELECT case_id, article_id, position FROM cards WHERE n <= 6 OR position < 3 OR position >= n - 3", _CARDS))
def first_latest_sample(spark, sf_dir):
    rows, order = _cards(Tables(spark, sf_dir))
    return sampling.first_latest(sampling.placed(rows, "case_id", order), 6).select("case_id", "article_id", "position")


@register("lifecycle_sample", sql("articles case_articles", "SELECT case_id, article_id, position FROM cards WHERE n <= 6 OR position = 0 OR position = n - 1 OR list_contains(list_transform(range(1, 5), lambda i: round_even(i * (n - 1) / 5.0, 0)::INTEGER), position)", _CARDS))
def lifecycle_sample(spark, sf_dir):
    rows, order = _cards(Tables(spark, sf_dir))
    return sampling.lifecycle(sampling.placed(rows, "case_id", order), 6).select("case_id", "article_id", "position")


@register("card_batches", sql("articles case_articles", "SELECT case_id, (position // 20)::INTEGER AS batch, count(*) AS cards FROM cards GROUP BY ALL", _CARDS))
def card_batches(spark, sf_dir):
    rows, order = _cards(Tables(spark, sf_dir))
    return sampling.batches(sampling.placed(rows, "case_id", order)).groupBy("case_id", "batch").agg(F.count("*").alias("cards"))
