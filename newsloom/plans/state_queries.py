"""Queries of merges, materialised counters, case split and merge, jobs and cooldowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import cooldown, jobs, materialize, merge
from newsloom.plans.bindings import JOBS_NOW, Tables, sql, ts
from newsloom.plans.registry import register

_NOW = f"TIMESTAMP '{JOBS_NOW}'"


def _articles(t: Tables, new: bool):
    key, pre = F.col("o_orderkey"), "new" if new else "old"
    rows = t.raw("orders").where(key % 3 != 0 if new else key % 2 == 0)
    return rows.select(
        F.concat(F.lit("https://news.example/"), key).alias("identity_url"), F.when(key % 5 == 0, "").when(key % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(f"{pre} title "), key)).alias("title"),
        F.when(key % 4 == (0 if new else 2), F.lit(None).cast("string")).otherwise(F.concat(F.lit(f"{pre} body "), key)).alias("body"), F.when(key % (6 if new else 3) != 0, F.col("o_orderdate")).alias("published_at"),
        F.create_map(F.lit("k"), F.concat(F.lit(pre), key), F.lit(f"only_{pre}"), F.lit("1")).alias("meta"), F.when(F.col("o_orderstatus") == ("P" if new else "F"), "failed").otherwise("succeeded").alias("fetch_status"),
        (key % 3).cast("int").alias("attempts"), F.lit(None).cast("timestamp_ntz").alias("next_fetch_at"),
    )


def _article_sql(new: bool) -> str:
    pre = "new" if new else "old"
    return f"""SELECT 'https://news.example/' || o_orderkey AS identity_url, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN NULL ELSE '{pre} title ' || o_orderkey END AS title,
 CASE WHEN o_orderkey % 4 = {0 if new else 2} THEN NULL ELSE '{pre} body ' || o_orderkey END AS body, CASE WHEN o_orderkey % {6 if new else 3} <> 0 THEN o_orderdate END AS published_at, '{pre}' || o_orderkey AS k,
 CASE WHEN o_orderstatus = '{"P" if new else "F"}' THEN 'failed' ELSE 'succeeded' END AS fetch_status, (o_orderkey % 3)::INTEGER AS attempts FROM orders WHERE o_orderkey % {"3 <> 0" if new else "2 = 0"}"""


@register("article_merge", f"""WITH o AS ({_article_sql(False)}), n AS ({_article_sql(True)})
SELECT coalesce(n.identity_url, o.identity_url) AS identity_url, coalesce(nullif(n.title, ''), o.title) AS title, coalesce(nullif(n.body, ''), o.body) AS body, coalesce(n.published_at, o.published_at) AS published_at,
 coalesce(n.k, o.k) AS meta_k, CASE WHEN o.identity_url IS NOT NULL THEN '1' END AS meta_old, CASE WHEN n.identity_url IS NOT NULL THEN n.fetch_status ELSE o.fetch_status END AS fetch_status,
 (coalesce(o.attempts, 0) + CASE WHEN n.identity_url IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS attempts,
 CASE WHEN n.fetch_status = 'failed' THEN {_NOW} + CASE WHEN o.identity_url IS NULL THEN INTERVAL 1 HOUR WHEN o.attempts <= 1 THEN INTERVAL 6 HOUR ELSE INTERVAL 24 HOUR END END AS next_fetch_at
FROM o FULL JOIN n USING (identity_url)""")
def article_merge(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = merge.merge_articles(_articles(t, False), _articles(t, True), ts(JOBS_NOW))
    return out.withColumns({"meta_k": F.col("meta")["k"], "meta_old": F.try_element_at("meta", F.lit("only_old"))}).drop("meta")


@register("source_upsert", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_name || ' (new)' ELSE n_name END AS name FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def source_upsert(spark, sf_dir):
    t = Tables(spark, sf_dir)
    old = t.sources.select("id", "name")
    new = old.where("id % 3 = 0").withColumn("name", F.concat("name", F.lit(" (new)"))).unionByName(t.raw("region").select((F.lit(100) + F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name")))
    return merge.upsert(old, new, "id")


@register("insert_ignore", sql("case_articles", "SELECT case_id, article_id FROM case_articles WHERE case_id % 2 = 0 OR article_id % 3 = 0"))
def insert_ignore(spark, sf_dir):
    links = Tables(spark, sf_dir).case_articles
    return merge.insert_ignore(links.where("case_id % 2 = 0"), links.where("article_id % 3 = 0").unionByName(links.where("article_id % 6 = 0")), ["case_id", "article_id"])


@register("view_upsert", sql("views", "SELECT * FROM views"))
def view_upsert(spark, sf_dir):
    return Tables(spark, sf_dir).views


@register("entity_merge", sql("entities", """SELECT id, CASE WHEN id % 4 = 0 THEN 'Renamed ' || id ELSE name END AS name, lower(name) || '|alias ' || id || CASE WHEN id % 4 = 0 THEN '|extra|' || name WHEN id % 4 < 3 THEN '|extra' ELSE '' END AS aliases,
 coalesce(description, CASE WHEN id % 4 < 3 THEN 'filled' END) AS description, CASE WHEN id % 4 = 1 THEN 9 ELSE entity_type END AS entity_type FROM entities"""))
def entity_merge(spark, sf_dir):
    entities = Tables(spark, sf_dir).entities.drop("slug")
    key = F.col("id")
    decisions = entities.where("id % 4 < 3").select(
        "id", F.concat(F.lit("Renamed "), key).alias("new_name"), F.array(F.lower("name"), F.lit("extra")).alias("new_aliases"), F.lit("filled").alias("new_description"),
        F.lit(9).alias("new_type"), F.when(key % 4 == 0, "rename").when(key % 4 == 1, "retype").otherwise("link").alias("action"),
    )
    return merge.merge_entities(entities, decisions).withColumn("aliases", F.array_join("aliases", "|"))


@register("group_decisions", """WITH l AS (SELECT l_orderkey AS article_id, l_suppkey % 3 AS identity_id, * FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > count(DISTINCT l_linenumber))),
r AS (SELECT article_id, identity_id, string_agg(role, '; ' ORDER BY p) AS roles FROM (SELECT article_id, identity_id, l_returnflag AS role, min(l_linenumber) AS p FROM l GROUP BY ALL) GROUP BY ALL)
SELECT article_id, identity_id, max(l_discount) AS confidence, any_value(roles) AS roles, arg_min(l_linestatus, l_linenumber) AS reason FROM l JOIN r USING (article_id, identity_id) GROUP BY ALL""")
def group_decisions(spark, sf_dir):
    rows = Tables(spark, sf_dir).raw("lineitem")
    plain = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d")).where("n = d").select("l_orderkey")
    decisions = rows.join(plain, "l_orderkey", "left_semi").select(
        F.col("l_orderkey").alias("article_id"), (F.col("l_suppkey") % 3).alias("identity_id"), F.col("l_linenumber").alias("position"), F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("reason"),
    )
    return merge.group_decisions(decisions)


@register("replaced_links", sql("article_entities", "SELECT article_id, entity_id FROM article_entities WHERE article_id % 5 <> 0 UNION SELECT article_id, (entity_id + 1) % 100 FROM article_entities WHERE article_id % 5 = 0"))
def replaced_links(spark, sf_dir):
    t = Tables(spark, sf_dir)
    new = t.article_entities.select("article_id", ((F.col("entity_id") + 1) % 100).alias("entity_id"))
    return merge.replace_links(t.article_entities, new, "article_id", "entity_id", t.articles.where("id % 5 = 0").select(F.col("id").alias("article_id")))[0]


@register("affected_pairs", sql("article_entities", "SELECT article_id, entity_id FROM article_entities WHERE article_id % 5 = 0 UNION SELECT article_id, (entity_id + 1) % 100 FROM article_entities WHERE article_id % 5 = 0"))
def affected_pairs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    new = t.article_entities.select("article_id", ((F.col("entity_id") + 1) % 100).alias("entity_id"))
    return merge.replace_links(t.article_entities, new, "article_id", "entity_id", t.articles.where("id % 5 = 0").select(F.col("id").alias("article_id")))[1]


@register("published_at_repair", sql("articles", "SELECT id, coalesce(published_at, CASE WHEN id % 2 = 0 THEN created_at END) AS published_at, published_at IS NULL AND id % 2 = 0 AS repaired FROM articles"))
def published_at_repair(spark, sf_dir):
    articles = Tables(spark, sf_dir).articles
    found = articles.where("id % 2 = 0").select("id", F.col("created_at").alias("published_at"))
    return merge.repair_dates(articles.select("id", "published_at"), found)


@register("materialize_case_entities", sql("articles article_entity_cases", "SELECT case_id, entity_id, count(DISTINCT article_id) AS mention_count, first(article_id ORDER BY published_at NULLS LAST, created_at, article_id) AS first_article_id FROM article_entity_cases JOIN articles ON id = article_id GROUP BY ALL"))
def materialize_case_entities(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return materialize.case_entities(t.article_entity_cases, t.articles)


@register("materialize_case_events", sql("news_events article_event_cases", "SELECT case_id, event_id, count(DISTINCT article_id) AS supporting_article_count, year, month, day, precision FROM article_event_cases JOIN news_events ON id = event_id GROUP BY ALL"))
def materialize_case_events(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return materialize.case_events(t.article_event_cases, t.events)


@register("event_counts", sql("case_events", "SELECT case_id, count(*) AS event_count FROM case_events GROUP BY case_id"))
def event_counts(spark, sf_dir):
    return materialize.event_counts(Tables(spark, sf_dir).case_events)


@register("case_counts", sql("articles case_articles", "SELECT case_id, count(*) AS article_count, min(published_at) AS first_at, max(published_at) AS last_at FROM case_articles JOIN articles ON id = article_id GROUP BY case_id"))
def case_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return materialize.case_counts(t.case_articles, t.articles)


@register("incremental_case_counts", sql("case_articles articles cases", "SELECT id, article_count + coalesce(d, 0) AS article_count, (revision + coalesce(d, 0))::INTEGER AS revision, greatest(last_updated_at, p) AS last_updated_at FROM cases LEFT JOIN (SELECT case_id, count(*) AS d, max(published_at) AS p FROM fresh JOIN articles ON id = article_id GROUP BY case_id) ON case_id = id",
 "fresh AS (SELECT DISTINCT case_id, (article_id + 1) % (SELECT count(*) FROM orders) AS article_id FROM case_articles WHERE case_id % 10 = 0 EXCEPT SELECT case_id, article_id FROM case_articles)"))
def incremental_case_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    n = t.raw("orders").agg(F.count("*").alias("n"))
    new = t.case_articles.where("case_id % 10 = 0").crossJoin(F.broadcast(n)).select("case_id", ((F.col("article_id") + 1) % F.col("n")).alias("article_id"))  # n: one row
    return materialize.add_links(t.cases, t.case_articles, new, t.articles).select("id", "article_count", "revision", "last_updated_at")


@register("case_split", sql("case_articles", "SELECT * FROM case_articles WHERE case_id <> 22 UNION SELECT CASE WHEN article_id % 2 = 0 THEN 22 ELSE 900022 END, article_id FROM case_articles WHERE case_id = 22 AND article_id % 5 <> 0"))
def case_split(spark, sf_dir):
    links = Tables(spark, sf_dir).case_articles
    stories = links.where("case_id = 22 and article_id % 5 <> 0").select(F.when(F.col("article_id") % 2 == 0, F.lit(22)).otherwise(F.lit(900022)).cast("long").alias("case_id"), "article_id")
    return materialize.split(links, F.lit(22), stories)


_PAIRS = """pairs AS (SELECT a.id AS case_a, b.id AS case_b, CASE WHEN (-a.article_count, a.created_at, a.id::VARCHAR) <= (-b.article_count, b.created_at, b.id::VARCHAR) THEN a.id ELSE b.id END AS survivor,
 CASE WHEN (-a.article_count, a.created_at, a.id::VARCHAR) <= (-b.article_count, b.created_at, b.id::VARCHAR) THEN b.id ELSE a.id END AS absorbed FROM cases a JOIN cases b ON b.id = a.id + 1 WHERE a.id % 50 = 10)"""


def _pairs(t: Tables):
    a = t.cases.where("id % 50 = 10").select(F.col("id").alias("case_a"), F.col("article_count").alias("count_a"), F.col("created_at").alias("created_a"))
    b = t.cases.select(F.col("id").alias("case_b"), F.col("article_count").alias("count_b"), F.col("created_at").alias("created_b"))
    return materialize.survivor(a.join(b, F.col("case_b") == F.col("case_a") + 1))


@register("merge_order", sql("case_articles articles cases", "SELECT * FROM pairs", _PAIRS))
def merge_order(spark, sf_dir):
    return _pairs(Tables(spark, sf_dir)).select("case_a", "case_b", "survivor", "absorbed")


@register("case_merge", sql("case_articles articles cases", "SELECT DISTINCT coalesce(survivor, case_id) AS case_id, article_id FROM case_articles LEFT JOIN pairs ON case_id = absorbed", _PAIRS))
def case_merge(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return materialize.merge_links(t.case_articles, _pairs(t).select("survivor", "absorbed"))


@register("case_merge_status", sql("case_articles articles cases", "SELECT id, CASE WHEN p.survivor IS NOT NULL THEN 'merged' ELSE status END AS status, coalesce(p.survivor, merged_into) AS merged_into, (revision + (id IN (SELECT survivor FROM pairs))::INTEGER)::INTEGER AS revision FROM cases LEFT JOIN pairs p ON p.absorbed = id", _PAIRS))
def case_merge_status(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return materialize.merge_cases(t.cases, _pairs(t).select("survivor", "absorbed")).select("id", "status", "merged_into", "revision")


@register("cases_created", sql("articles cases", f"SELECT id, title, summary, status, article_count, revision, last_updated_at FROM cases UNION ALL SELECT o_orderkey + 500000000, 'Card ' || o_orderkey, NULL, 'active', 1, 1, coalesce(a.published_at, {_NOW}) FROM orders LEFT JOIN articles a ON a.id = o_orderkey WHERE o_orderkey % 9 = 0"))
def cases_created(spark, sf_dir):
    t = Tables(spark, sf_dir)
    key = F.col("o_orderkey")
    cards = t.raw("orders").where(key % 9 == 0).select((key + 500000000).alias("id"), key.alias("article_id"), F.concat(F.lit("Card "), key).alias("title"))
    cards = cards.union(t.cases.where("id % 10 = 0").select("id", F.lit(1).cast("long"), F.lit("taken")))
    return materialize.create_cases(t.cases, cards, t.articles, ts(JOBS_NOW)).select("id", "title", "summary", "status", "article_count", "revision", "last_updated_at")


_JOB = "SELECT id, {0} FROM jobs"
_RUN = "status = 'running'"
_AGAIN = "(status = 'running' AND requested > requested - id % 2)"
_DELAY = "to_minutes(CASE WHEN attempts <= 1 THEN 1 WHEN attempts = 2 THEN 5 ELSE 15 END)"
_FREE = f"CASE WHEN {_RUN} THEN NULL ELSE locked_at END AS locked_at, CASE WHEN {_RUN} THEN NULL ELSE locked_by END AS locked_by"
_LOCK = ["locked_at", "locked_by", "last_error"]


def _processed():
    """The revision that a worker read: every other job was asked for anew meanwhile."""
    return (F.col("requested") - F.col("id") % 2).cast("int")


@register("job_complete", sql("jobs", _JOB.format(f"CASE WHEN {_AGAIN} THEN 'queued' WHEN {_RUN} THEN 'succeeded' ELSE status END AS status, CASE WHEN {_AGAIN} THEN 0 ELSE attempts END AS attempts, CASE WHEN {_AGAIN} THEN {_NOW} ELSE run_after END AS run_after, CASE WHEN {_RUN} THEN (requested - id % 2)::INTEGER ELSE completed END AS completed, {_FREE}, CASE WHEN {_RUN} THEN NULL ELSE last_error END AS last_error")))
def job_complete(spark, sf_dir):
    return jobs.complete(Tables(spark, sf_dir).jobs, _processed(), ts(JOBS_NOW)).select("id", "status", "attempts", "run_after", "completed", *_LOCK)


@register("job_complete_settles", sql("jobs", f"SELECT id, status, completed = requested AS settled FROM (SELECT id, completed, requested, CASE WHEN {_RUN} THEN 'succeeded' ELSE status END AS status FROM (SELECT * REPLACE (CASE WHEN {_RUN} THEN requested ELSE completed END AS completed) FROM jobs))"))
def job_complete_settles(spark, sf_dir):
    """Running jobs completed at the revision asked for, twice in turn: the first run has the older revision."""
    once = jobs.complete(Tables(spark, sf_dir).jobs, F.col("requested") - 1, ts(JOBS_NOW))
    again = once.withColumn("status", F.when((F.col("status") == "queued") & (F.col("completed") == F.col("requested") - 1) & (F.col("run_after") == ts(JOBS_NOW)) & (F.col("id") % 5 == 1), "running").otherwise(F.col("status")))
    return jobs.complete(again, F.col("requested"), ts(JOBS_NOW)).select("id", "status", (F.col("completed") == F.col("requested")).alias("settled"))


@register("job_fail", sql("jobs", _JOB.format(f"""CASE WHEN {_AGAIN} THEN 'queued' WHEN {_RUN} AND attempts >= max_attempts THEN 'failed' WHEN {_RUN} THEN 'queued' ELSE status END AS status,
 CASE WHEN {_RUN} THEN CASE WHEN id % 3 = 0 THEN 'UnknownError' ELSE 'timeout' END ELSE last_error END AS last_error, CASE WHEN {_AGAIN} THEN 0 ELSE attempts END AS attempts, {_FREE},
 CASE WHEN {_AGAIN} THEN {_NOW} WHEN {_RUN} AND attempts < max_attempts THEN {_NOW} + {_DELAY} ELSE run_after END AS run_after""")))
def job_fail(spark, sf_dir):
    error = F.when(F.col("id") % 3 == 0, " ").otherwise("timeout")
    return jobs.fail(Tables(spark, sf_dir).jobs, _processed(), error, ts(JOBS_NOW)).select("id", "status", "attempts", "run_after", *_LOCK)


@register("job_defer", sql("jobs", _JOB.format(f"CASE WHEN {_RUN} THEN 'queued' ELSE status END AS status, CASE WHEN {_RUN} THEN greatest(0, attempts - 1) ELSE attempts END AS attempts, CASE WHEN {_RUN} THEN {_NOW} + INTERVAL 1 HOUR ELSE run_after END AS run_after, {_FREE}, CASE WHEN {_RUN} THEN 'cooldown' ELSE last_error END AS last_error")))
def job_defer(spark, sf_dir):
    return jobs.defer(Tables(spark, sf_dir).jobs, ts(JOBS_NOW) + F.expr("interval 1 hour"), F.lit("cooldown")).select("id", "status", "attempts", "run_after", *_LOCK)


@register("job_revision_request", sql("jobs", _JOB.format(f"CASE WHEN {_RUN} THEN 'running' ELSE 'queued' END AS status, requested + 1 AS requested, CASE WHEN {_RUN} THEN attempts ELSE 0 END AS attempts, {_NOW} AS run_after, CASE WHEN {_RUN} THEN locked_at END AS locked_at, CASE WHEN {_RUN} THEN locked_by END AS locked_by, NULL::VARCHAR AS last_error")))
def job_revision_request(spark, sf_dir):
    return jobs.request_revision(Tables(spark, sf_dir).jobs, ts(JOBS_NOW)).select("id", "status", "requested", "attempts", "run_after", *_LOCK)


_WANTED = "SELECT 1000000000 + o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'view' ELSE 'click' END AS job_type, o_custkey AS article_id FROM orders WHERE o_orderkey % 7 = 0"
_KEPT = "id, job_type, article_id, status, priority, attempts, max_attempts, run_after, requested, locked_at, locked_by, last_error"


def _enqueued_sql(changed: str) -> str:
    """changed: what is selected of jobs that are there and wanted."""
    return sql("jobs", f"""SELECT {_KEPT} FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.job_type = j.job_type AND w.article_id = j.article_id)
 UNION ALL SELECT {changed} FROM jobs j WHERE EXISTS (SELECT 1 FROM w WHERE w.job_type = j.job_type AND w.article_id = j.article_id)
 UNION ALL SELECT min(id), job_type, article_id, 'queued', 5, 0, 4, {_NOW}, 1, NULL, NULL, NULL FROM w WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE w.job_type = j.job_type AND w.article_id = j.article_id) GROUP BY job_type, article_id""", f"w AS ({_WANTED})")


def _requeued(states: str) -> str:
    hit = f"status IN ({states})"
    return f"id, job_type, article_id, CASE WHEN {hit} THEN 'queued' ELSE status END, priority, CASE WHEN {hit} THEN 0 ELSE attempts END, CASE WHEN {hit} THEN 4 ELSE max_attempts END, CASE WHEN {hit} THEN {_NOW} ELSE run_after END, requested, CASE WHEN NOT {hit} THEN locked_at END, CASE WHEN NOT {hit} THEN locked_by END, CASE WHEN NOT {hit} THEN last_error END"


def _enqueue_query(policy: str):
    def query(spark, sf_dir):
        t = Tables(spark, sf_dir)
        key = F.col("o_orderkey")
        wanted = t.raw("orders").where(key % 7 == 0).select((key + 1000000000).alias("id"), F.when(key % 2 == 0, "view").otherwise("click").alias("job_type"), F.col("o_custkey").alias("article_id"))
        return jobs.enqueued(t.jobs, wanted, policy, ts(JOBS_NOW), ts(JOBS_NOW), max_attempts=4, priority=5).select(*_KEPT.split(", "))

    return query


for _policy, _changed in {
    "keep": _KEPT, "failed": _requeued("'failed'"), "finished": _requeued("'failed', 'succeeded'"),
    "revision": f"id, job_type, article_id, CASE WHEN {_RUN} THEN 'running' ELSE 'queued' END, priority, CASE WHEN {_RUN} THEN attempts ELSE 0 END, max_attempts, {_NOW}, requested + 1, CASE WHEN {_RUN} THEN locked_at END, CASE WHEN {_RUN} THEN locked_by END, NULL",
}.items():
    register(f"job_enqueued_{_policy}", _enqueued_sql(_changed))(_enqueue_query(_policy))


_ELIGIBLE = f"attempts < max_attempts AND ((status = 'queued' AND (run_after IS NULL OR run_after <= {_NOW})) OR (status = 'running' AND locked_at <= {_NOW} - INTERVAL 30 MINUTE))"
_CLAIM = "priority DESC, run_after NULLS FIRST, a.published_at NULLS LAST, a.created_at NULLS LAST, j.created_at, j.id"


@register("job_claim_order", sql("articles jobs", f"SELECT j.id, j.job_type, j.priority FROM jobs j LEFT JOIN articles a ON a.id = j.article_id WHERE {_ELIGIBLE.replace('attempts <', 'j.attempts <')} ORDER BY {_CLAIM} LIMIT 50"))
def job_claim_order(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return jobs.claim_order(t.jobs, t.articles, ts(JOBS_NOW), 50).select("id", "job_type", "priority")


@register("job_claim_round_robin", sql("articles jobs", f"""SELECT id, job_type, turn, type_rank FROM (SELECT j.id, j.job_type, (row_number() OVER (PARTITION BY j.job_type ORDER BY {_CLAIM}))::INTEGER AS turn, list_position(['view', 'click', 'purchase'], j.job_type)::INTEGER AS type_rank
 FROM jobs j LEFT JOIN articles a ON a.id = j.article_id WHERE {_ELIGIBLE.replace('attempts <', 'j.attempts <')} AND j.job_type IN ('view', 'click', 'purchase')) ORDER BY turn, type_rank LIMIT 50"""))
def job_claim_round_robin(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return jobs.claim_round_robin(t.jobs, t.articles, ts(JOBS_NOW), ["view", "click", "purchase"], 50).select("id", "job_type", "turn", "type_rank")


@register("job_claimed", sql("articles jobs", f"SELECT id, CASE WHEN m.k IS NOT NULL THEN 'running' ELSE status END AS status, (attempts + (m.k IS NOT NULL)::INTEGER)::INTEGER AS attempts, CASE WHEN m.k IS NOT NULL THEN {_NOW} ELSE locked_at END AS locked_at, CASE WHEN m.k IS NOT NULL THEN 'w9' ELSE locked_by END AS locked_by FROM jobs LEFT JOIN m ON m.k = id",
 f"m AS (SELECT j.id AS k FROM jobs j LEFT JOIN articles a ON a.id = j.article_id WHERE {_ELIGIBLE.replace('attempts <', 'j.attempts <')} ORDER BY {_CLAIM} LIMIT 50)"))
def job_claimed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return jobs.claim(t.jobs, jobs.claim_order(t.jobs, t.articles, ts(JOBS_NOW), 50), "w9", ts(JOBS_NOW)).select("id", "status", "attempts", "locked_at", "locked_by")


@register("job_enqueue", sql("jobs", "SELECT job_type, w.article_id, CASE WHEN j.article_id IS NULL THEN 'inserted' WHEN j.failed THEN 'requeued' ELSE 'existing' END AS outcome FROM (SELECT DISTINCT 'view' AS job_type, o_orderkey AS article_id FROM orders WHERE o_orderkey % 7 = 0) w LEFT JOIN (SELECT job_type, article_id, bool_or(status = 'failed') AS failed FROM jobs GROUP BY ALL) j USING (job_type, article_id)"))
def job_enqueue(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return jobs.enqueue(t.jobs, t.raw("orders").where("o_orderkey % 7 = 0").select(F.lit("view").alias("job_type"), F.col("o_orderkey").alias("article_id")))




def _observations(t: Tables):
    key = F.col("event_id")
    retry = F.when(key % 11 == 0, 120).when(key % 13 == 0, 2400).cast("long")
    return t.raw("events").select(F.col("event_type").alias("scope"), F.timestamp_diff("SECOND", ts("1970-01-01"), F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")).alias("at"), retry.alias("retry_after"))


@register("cooldown_escalations", """WITH obs AS (SELECT event_type AS scope, epoch(date_trunc('second', ts))::BIGINT AS sec, CASE WHEN event_id % 11 = 0 THEN 120 WHEN event_id % 13 = 0 THEN 2400 END AS r FROM events)
SELECT scope, sec AS "at", coalesce(sec - lag(sec) OVER (PARTITION BY scope ORDER BY sec) <= 900, false) AS repeated FROM obs WHERE r IS NULL""")
def cooldown_escalations(spark, sf_dir):
    return cooldown.escalations(_observations(Tables(spark, sf_dir))).select("scope", "at", "repeated")


@register("cooldown_fold", """WITH RECURSIVE obs AS (SELECT event_type AS scope, epoch(date_trunc('second', ts))::BIGINT AS sec, (CASE WHEN event_id % 11 = 0 THEN 120 WHEN event_id % 13 = 0 THEN 2400 END)::BIGINT AS r FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY sec, r NULLS FIRST) AS k, count(*) OVER (PARTITION BY scope) AS n FROM obs),
f AS (SELECT scope, 0::BIGINT AS k, 0::BIGINT AS resume, 0 AS c, NULL::BIGINT AS last, '' AS kind FROM (SELECT DISTINCT scope FROM obs)
UNION ALL SELECT scope, k, greatest(resume, sec + CASE WHEN r IS NOT NULL THEN r WHEN c >= 2 THEN 3600 ELSE 300 END), c, CASE WHEN r IS NULL THEN sec END, CASE WHEN r >= 1800 THEN 'provider_long' WHEN r IS NOT NULL THEN 'provider_short' WHEN c >= 2 THEN 'ambiguous_long' ELSE 'ambiguous_short' END
FROM (SELECT f.scope, o.k, f.resume, o.sec, o.r, CASE WHEN o.r IS NOT NULL THEN 0 WHEN f.last IS NOT NULL AND o.sec - f.last <= 900 THEN f.c + 1 ELSE 1 END AS c FROM f JOIN o ON o.scope = f.scope AND o.k = f.k + 1))
SELECT f.scope, f.resume, f.c AS ambiguous_count, f.kind AS cooldown_kind FROM f JOIN (SELECT DISTINCT scope, n FROM o) m ON m.scope = f.scope AND m.n = f.k""")
def cooldown_fold(spark, sf_dir):
    return cooldown.fold(_observations(Tables(spark, sf_dir)))
