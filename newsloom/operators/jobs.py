"""The job queue's transitions, as column expressions over a table of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.metrics import eligible

RETRY_MINUTES = (1, 5, 15)


def retry_delay(attempts: Column) -> Column:
    """1, 5, then 15 minutes; no jitter."""
    return F.make_dt_interval(mins=F.element_at(F.array(*map(F.lit, RETRY_MINUTES)), F.greatest(F.lit(1), F.least(attempts, F.lit(len(RETRY_MINUTES))))))


def _claim_order() -> list[Column]:
    c = F.col
    return [c("priority").desc(), c("run_after").asc_nulls_first(), c("published_at").asc_nulls_last(), c("article_created_at").asc_nulls_last(), c("created_at").asc(), c("id").asc()]


def with_article_dates(jobs: DataFrame, articles: DataFrame) -> DataFrame:
    return jobs.join(articles.select(F.col("id").alias("article_id"), "published_at", F.col("created_at").alias("article_created_at")), "article_id", "left")


def claim_order(jobs: DataFrame, articles: DataFrame, now: Column, limit: int) -> DataFrame:
    """The next jobs to claim: priority, due time, then the article's age."""
    return with_article_dates(jobs.where(eligible(now)), articles).orderBy(*_claim_order()).limit(limit)


def claim_round_robin(jobs: DataFrame, articles: DataFrame, now: Column, types: list[str], limit: int) -> DataFrame:
    """One job of each type in turn, in the order of types."""
    rank = F.array_position(F.array(*map(F.lit, types)), F.col("job_type"))
    turn = F.row_number().over(Window.partitionBy("job_type").orderBy(*_claim_order()))
    ready = with_article_dates(jobs.where(eligible(now) & F.col("job_type").isin(types)), articles)
    return ready.withColumns({"turn": turn, "type_rank": rank.cast("int")}).orderBy("turn", "type_rank").limit(limit)


def claim(jobs: DataFrame, chosen: DataFrame, worker: str, now: Column) -> DataFrame:
    """Chosen jobs run: locked by worker, one attempt more."""
    mine = F.col("__mine").isNotNull()
    return jobs.join(chosen.select("id", F.lit(True).alias("__mine")), "id", "left").withColumns({
        "status": F.when(mine, "running").otherwise(F.col("status")), "locked_at": F.when(mine, now).otherwise(F.col("locked_at")),
        "locked_by": F.when(mine, worker).otherwise(F.col("locked_by")), "attempts": F.col("attempts") + F.when(mine, 1).otherwise(0),
    }).drop("__mine")


def _released(running: Column) -> dict[str, Column]:
    return {c: F.when(~running, F.col(c)) for c in ("locked_at", "locked_by")}


def complete(jobs: DataFrame, processed: Column, now: Column) -> DataFrame:
    """Running jobs succeed at the revision `processed`; one asked for anew since that revision
    was read is queued again at once, with fresh attempts. Lock and error are cleared."""
    running = F.col("status") == "running"
    again = running & (F.col("requested") > processed)
    return jobs.withColumns({
        "status": F.when(again, "queued").when(running, "succeeded").otherwise(F.col("status")), "attempts": F.when(again, 0).otherwise(F.col("attempts")),
        "run_after": F.when(again, now).otherwise(F.col("run_after")), "completed": F.when(running, processed).otherwise(F.col("completed")),
        "last_error": F.when(~running, F.col("last_error")), **_released(running),
    })


def fail(jobs: DataFrame, processed: Column, error: Column, now: Column) -> DataFrame:
    """Running jobs wait for a retry, or fail for good without attempts left; one asked for anew
    since revision `processed` is queued at once; a blank message becomes UnknownError."""
    running = F.col("status") == "running"
    again = running & (F.col("requested") > processed)
    spent = running & (F.col("attempts") >= F.col("max_attempts"))
    text = F.when(error.isNull() | (F.trim(error) == ""), "UnknownError").otherwise(F.trim(error))
    return jobs.withColumns({
        "status": F.when(again, "queued").when(spent, "failed").when(running, "queued").otherwise(F.col("status")), "last_error": F.when(running, text).otherwise(F.col("last_error")),
        "run_after": F.when(again, now).when(running & ~spent, now + retry_delay(F.col("attempts"))).otherwise(F.col("run_after")),
        "attempts": F.when(again, 0).otherwise(F.col("attempts")), **_released(running),
    })


def defer(jobs: DataFrame, until: Column, reason: Column) -> DataFrame:
    """Running jobs are put off without losing the attempt, the reason noted; others stay."""
    running = F.col("status") == "running"
    return jobs.withColumns({
        "status": F.when(running, "queued").otherwise(F.col("status")), "attempts": F.when(running, F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts")),
        "run_after": F.when(running, until).otherwise(F.col("run_after")), "last_error": F.when(running, reason).otherwise(F.col("last_error")), **_released(running),
    })


def request_revision(jobs: DataFrame, run_after: Column) -> DataFrame:
    """A further revision is asked for, due at run_after: running and queued jobs keep their
    status, others are queued; attempts and lock start again unless the job runs."""
    running = F.col("status") == "running"
    return jobs.withColumns({
        "status": F.when(running, "running").otherwise("queued"), "requested": F.col("requested") + 1,
        "attempts": F.when(running, F.col("attempts")).otherwise(0), "run_after": run_after, "last_error": F.lit(None).cast("string"), **_released(~running),
    })


#: What enqueueing does to a job that is there already: nothing, or queue it anew if it failed,
#: if it failed or succeeded, or ask for a further revision whatever its state.
POLICIES = {"keep": (), "failed": ("failed",), "finished": ("failed", "succeeded"), "revision": None}


def enqueued(jobs: DataFrame, wanted: DataFrame, policy: str, run_after: Column, now: Column, max_attempts: int = 3, priority: int = 0) -> DataFrame:
    """The table of jobs after enqueueing each distinct wanted (id, job_type, article_id).

    A job that isn't there is inserted, queued, with the wanted id; one that is there is treated
    by the policy. Repeated wanted rows count once (the least id).
    """
    states = POLICIES[policy]
    keys = ["job_type", "article_id"]
    asked = wanted.groupBy(*keys).agg(F.min("id").alias("id"))
    there = jobs.join(asked.select(*keys), keys, "left_semi")
    rest = jobs.join(asked.select(*keys), keys, "left_anti")
    if states is None:
        changed = request_revision(there, run_after)
    else:
        hit = F.col("status").isin(*states) if states else F.lit(False)
        fresh = {"status": F.lit("queued"), "attempts": F.lit(0), "run_after": run_after, "locked_at": F.lit(None), "locked_by": F.lit(None), "last_error": F.lit(None), "max_attempts": F.lit(max_attempts)}
        changed = there.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in fresh.items()})
    values = {"status": F.lit("queued"), "priority": F.lit(priority), "attempts": F.lit(0), "max_attempts": F.lit(max_attempts), "run_after": run_after, "requested": F.lit(1), "completed": F.lit(0), "created_at": now}
    new = asked.join(jobs.select(*keys).distinct(), keys, "left_anti")
    inserted = new.select(*[F.col(c) if c in ("id", *keys) else values.get(c, F.lit(None)).cast(t).alias(c) for c, t in jobs.dtypes])
    return rest.unionByName(changed).unionByName(inserted)


def enqueue(jobs: DataFrame, wanted: DataFrame, requeue_failed: bool = True) -> DataFrame:
    """Outcome of a bulk enqueue for each wanted (job_type, article_id): inserted, requeued or existing."""
    there = jobs.groupBy("job_type", "article_id").agg(F.bool_or(F.col("status") == "failed").alias("failed"))
    joined = wanted.distinct().join(there, ["job_type", "article_id"], "left")
    failed = F.col("failed") if requeue_failed else F.lit(False)
    return joined.select("job_type", "article_id", F.when(F.col("failed").isNull(), "inserted").when(failed, "requeued").otherwise("existing").alias("outcome"))


def exhausted(jobs: DataFrame, contains: str | None = None) -> DataFrame:
    """Failed jobs without attempts left, optionally only those whose error holds a text."""
    rows = jobs.where((F.col("status") == "failed") & (F.col("attempts") >= F.col("max_attempts")))
    return rows if contains is None else rows.where(F.contains(F.col("last_error"), F.lit(contains)))
