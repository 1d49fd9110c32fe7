"""The domain tables (sources, articles, cases, entities, events, jobs, ...) bound to the
driver's tables, once as DataFrames and once as common table expressions for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"
JOBS_NOW = "2024-01-20"


def ts(text: str) -> Column:
    """A timestamp literal without time zone."""
    return F.lit(text).cast("timestamp_ntz")


class Tables:
    """Domain frames over one data directory; each is a lazy plan with only its own columns."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sources(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"))

    @cached_property
    def articles(self) -> DataFrame:
        key = F.col("o_orderkey")
        image = F.when(key % 5 < 2, F.lit(None).cast("string")).when(key % 5 == 2, "").otherwise(F.concat(F.lit("https://img.example/"), key, F.lit(".jpg")))
        status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
        return self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
            key.alias("id"), F.col("c_nationkey").alias("source_id"), F.when(key % 17 != 0, F.col("o_orderdate")).alias("published_at"), F.col("o_orderdate").alias("created_at"),
            F.concat(F.lit("Article "), key).alias("title"), image.alias("image_url"), status.alias("fetch_status"), (key % 4).cast("int").alias("attempts"),
        )

    @cached_property
    def case_articles(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_partkey").alias("case_id"), F.col("l_orderkey").alias("article_id")).distinct()

    @cached_property
    def cases(self) -> DataFrame:
        key = F.col("p_partkey")
        status = F.when(key % 20 == 0, "hidden").when(key % 20 == 1, "merged").otherwise("active")
        summary = F.when(key % 13 == 0, F.lit(None).cast("string")).when(key % 13 == 1, "  ").otherwise(F.concat("p_type", F.lit(" "), "p_brand"))
        base = self.raw("part").select(
            key.alias("id"), F.concat(F.lit("case-"), key).alias("slug"), F.col("p_name").alias("title"), summary.alias("summary"), status.alias("status"),
            F.expr("timestamp_ntz'2000-01-01' + make_dt_interval(cast(p_partkey % 1000 as int))").alias("created_at"), F.when(key % 20 == 1, key + 1).alias("merged_into"),
            (key % 9).cast("int").alias("refreshed_count"), (key % 4).cast("int").alias("revision"), F.when(key % 5 != 0, (key % 3).cast("int")).alias("audited_revision"),
        )
        dates = self.articles.select(F.col("id").alias("article_id"), "published_at")
        counts = self.case_articles.join(dates, "article_id").groupBy("case_id").agg(F.count("*").alias("article_count"), F.max("published_at").alias("last_updated_at"))
        return base.join(counts, base.id == counts.case_id, "left").select(*base.columns, F.coalesce("article_count", F.lit(0)).alias("article_count"), "last_updated_at")

    @cached_property
    def entities(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("id"), F.concat(F.lit("entity-"), key).alias("slug"), F.col("s_name").alias("name"), F.when(key % 7 != 0, F.concat(F.lit("Trader number "), key)).alias("description"),
            F.array(F.lower("s_name"), F.concat(F.lit("alias "), key)).alias("aliases"), (F.col("s_nationkey") % 8).alias("entity_type"),
        )

    @cached_property
    def article_entities(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("entity_id")).distinct()

    @cached_property
    def article_entity_cases(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("entity_id"), F.col("l_partkey").alias("case_id")).distinct()

    @cached_property
    def case_entities(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_partkey").alias("case_id"), F.col("l_suppkey").alias("entity_id")).distinct()

    @cached_property
    def events(self) -> DataFrame:
        day = F.col("l_shipdate").cast("date")
        d = self.raw("lineitem").select(day.alias("d")).distinct()
        part = F.dayofmonth("d") % 4
        return d.select(
            F.date_format("d", "yyyyMMdd").cast("int").alias("id"), F.concat(F.lit("Event of "), F.date_format("d", "yyyy-MM-dd")).alias("title"),
            F.when(part < 3, F.year("d")).alias("year"), F.when(part < 2, F.month("d")).alias("month"), F.when(part < 1, F.dayofmonth("d")).alias("day"),
            F.element_at(F.array(*map(F.lit, "day month year unknown".split())), part + 1).alias("precision"),
        )

    @cached_property
    def case_events(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_partkey").alias("case_id"), F.date_format("l_shipdate", "yyyyMMdd").cast("int").alias("event_id")).distinct()

    @cached_property
    def article_event_cases(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("article_id"), F.date_format("l_shipdate", "yyyyMMdd").cast("int").alias("event_id"), F.col("l_partkey").alias("case_id")).distinct()

    @cached_property
    def views(self) -> DataFrame:
        """Daily view counters (SNK6, ST13)."""
        seen = self.raw("events").where("event_type = 'view'")
        return seen.groupBy(F.col("user_id").alias("case_id"), F.col("ts").cast("date").alias("counter_date")).agg(F.count("*").alias("view_count"))

    @cached_property
    def jobs(self) -> DataFrame:
        key = F.col("event_id")
        status = F.element_at(F.array(*map(F.lit, "queued running succeeded failed blocked".split())), (key % 5 + 1).cast("int"))
        return self.raw("events").select(
            key.alias("id"), F.col("event_type").alias("job_type"), F.col("user_id").alias("article_id"), status.alias("status"), (key % 2 * 10).cast("int").alias("priority"),
            (key % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.expr("ts + make_dt_interval(cast(event_id % 3 as int))").alias("run_after"),
            F.when(key % 5 == 1, F.col("ts")).alias("locked_at"), (key % 3).cast("int").alias("requested"), (key % 2).cast("int").alias("completed"), F.col("ts").alias("created_at"),
            F.when(key % 5 == 1, F.concat(F.lit("w"), key % 3)).alias("locked_by"), F.when(key % 5 == 3, F.concat(F.lit("boom "), key % 7)).alias("last_error"),
        )


_DAY = "strftime(l_shipdate, '%Y%m%d')::INTEGER"
CTES = {
    "sources": "SELECT n_nationkey AS id, lower(n_name) AS slug, n_name AS name FROM nation",
    "articles": """SELECT o_orderkey AS id, c_nationkey AS source_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS published_at, o_orderdate AS created_at,
 'Article ' || o_orderkey AS title, CASE WHEN o_orderkey % 5 < 2 THEN NULL WHEN o_orderkey % 5 = 2 THEN '' ELSE 'https://img.example/' || o_orderkey || '.jpg' END AS image_url,
 CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'pending' END AS fetch_status, (o_orderkey % 4)::INTEGER AS attempts
 FROM orders JOIN customer ON o_custkey = c_custkey""",
    "case_articles": "SELECT DISTINCT l_partkey AS case_id, l_orderkey AS article_id FROM lineitem",
    "cases": """SELECT p_partkey AS id, 'case-' || p_partkey AS slug, p_name AS title,
 CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 13 = 1 THEN '  ' ELSE p_type || ' ' || p_brand END AS summary,
 CASE WHEN p_partkey % 20 = 0 THEN 'hidden' WHEN p_partkey % 20 = 1 THEN 'merged' ELSE 'active' END AS status,
 TIMESTAMP '2000-01-01' + to_days((p_partkey % 1000)::INTEGER) AS created_at, CASE WHEN p_partkey % 20 = 1 THEN p_partkey + 1 END AS merged_into,
 (p_partkey % 9)::INTEGER AS refreshed_count, (p_partkey % 4)::INTEGER AS revision, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 3)::INTEGER END AS audited_revision,
 coalesce(n, 0) AS article_count, last_updated_at
 FROM part LEFT JOIN (SELECT case_id, count(*) AS n, max(published_at) AS last_updated_at FROM case_articles JOIN articles ON article_id = id GROUP BY case_id) ON p_partkey = case_id""",
    "entities": """SELECT s_suppkey AS id, 'entity-' || s_suppkey AS slug, s_name AS name, CASE WHEN s_suppkey % 7 <> 0 THEN 'Trader number ' || s_suppkey END AS description,
 [lower(s_name), 'alias ' || s_suppkey] AS aliases, s_nationkey % 8 AS entity_type FROM supplier""",
    "article_entities": "SELECT DISTINCT l_orderkey AS article_id, l_suppkey AS entity_id FROM lineitem",
    "article_entity_cases": "SELECT DISTINCT l_orderkey AS article_id, l_suppkey AS entity_id, l_partkey AS case_id FROM lineitem",
    "case_entities": "SELECT DISTINCT l_partkey AS case_id, l_suppkey AS entity_id FROM lineitem",
    "news_events": f"""SELECT DISTINCT {_DAY} AS id, 'Event of ' || strftime(l_shipdate, '%Y-%m-%d') AS title,
 CASE WHEN day(l_shipdate) % 4 < 3 THEN year(l_shipdate)::INTEGER END AS year, CASE WHEN day(l_shipdate) % 4 < 2 THEN month(l_shipdate)::INTEGER END AS month,
 CASE WHEN day(l_shipdate) % 4 < 1 THEN day(l_shipdate)::INTEGER END AS day, ['day', 'month', 'year', 'unknown'][(day(l_shipdate) % 4 + 1)::INTEGER] AS precision FROM lineitem""",
    "case_events": f"SELECT DISTINCT l_partkey AS case_id, {_DAY} AS event_id FROM lineitem",
    "article_event_cases": f"SELECT DISTINCT l_orderkey AS article_id, {_DAY} AS event_id, l_partkey AS case_id FROM lineitem",
    "views": "SELECT user_id AS case_id, ts::DATE AS counter_date, count(*) AS view_count FROM events WHERE event_type = 'view' GROUP BY ALL",
    "jobs": """SELECT event_id AS id, event_type AS job_type, user_id AS article_id, string_split('queued running succeeded failed blocked', ' ')[(event_id % 5 + 1)::INTEGER] AS status,
 (event_id % 2 * 10)::INTEGER AS priority, (event_id % 4)::INTEGER AS attempts, 3 AS max_attempts, ts + to_days((event_id % 3)::INTEGER) AS run_after,
 CASE WHEN event_id % 5 = 1 THEN ts END AS locked_at, (event_id % 3)::INTEGER AS requested, (event_id % 2)::INTEGER AS completed, ts AS created_at,
 CASE WHEN event_id % 5 = 1 THEN 'w' || (event_id % 3) END AS locked_by, CASE WHEN event_id % 5 = 3 THEN 'boom ' || (event_id % 7) END AS last_error FROM events""",
}
_NEEDS = {"cases": ("case_articles", "articles")}


def sql(tables: str, body: str, extra: str = "") -> str:
    """An oracle statement: the named domain tables as CTEs, further CTEs in `extra`, then body."""
    names: list[str] = []
    for name in tables.split():
        for need in (*_NEEDS.get(name, ()), name):
            if need not in names:
                names.append(need)
    parts = [f"{n} AS ({CTES[n]})" for n in names] + ([extra.strip().rstrip(",")] if extra else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
