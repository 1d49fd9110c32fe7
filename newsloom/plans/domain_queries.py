"""Queries of URLs, pages, dates, JSON, texts, vectors, decisions, constraints and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.functions import dates, texts, urls
from newsloom.operators import constraints, decisions, knn, relevance
from newsloom.plans.bindings import Tables, sql
from newsloom.plans.registry import register
from newsloom.session import drop_stored, scratch_dir
from newsloom.sources import catalogue, feeds, html
from newsloom.streaming import views

_TRACK = "|".join(sorted(urls.TRACKING))
_IDENTITY = rf"""p AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(u, '^https?://([^/?]+)', 1)), '^www[.]', ''), ':(80|443)$', '') AS host,
 regexp_replace(regexp_replace(regexp_extract(u, '^https?://[^/?]+([^?]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
 array_to_string(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: NOT regexp_full_match(x, '(?i:{_TRACK})=.*')), '&') AS query FROM p),
i AS (SELECT page_id, 'https://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS identity_url FROM q WHERE host <> '')"""


@register("url_identity", f"WITH {_IDENTITY} SELECT page_id, identity_url FROM i")
def url_identity(spark, sf_dir):
    pages = Tables(spark, sf_dir).raw("pages")
    return pages.select("page_id", urls.normalize_udf("url").alias("identity_url"))


@register("url_identity_jvm", f"WITH {_IDENTITY} SELECT page_id, identity_url FROM i")
def url_identity_jvm(spark, sf_dir):
    return Tables(spark, sf_dir).raw("pages").select("page_id", urls.normalize_simple(F.col("url")).alias("identity_url"))


@register("url_dedup", f"WITH {_IDENTITY} SELECT identity_url, min(page_id) AS page_id, count(*) AS copies FROM i GROUP BY identity_url")
def url_dedup(spark, sf_dir):
    pages = Tables(spark, sf_dir).raw("pages").select("page_id", urls.normalize_simple(F.col("url")).alias("identity_url"))
    return pages.groupBy("identity_url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@register("url_new_only", f"WITH {_IDENTITY} SELECT page_id, identity_url FROM i WHERE identity_url NOT IN (SELECT identity_url FROM i WHERE page_id % 2 = 0)")
def url_new_only(spark, sf_dir):
    pages = Tables(spark, sf_dir).raw("pages").select("page_id", urls.normalize_simple(F.col("url")).alias("identity_url"))
    return pages.join(pages.where("page_id % 2 = 0").select("identity_url"), "identity_url", "left_anti").select("page_id", "identity_url")


@register("url_year_month", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def url_year_month(spark, sf_dir):
    rows = Tables(spark, sf_dir).raw("orders").select("o_orderkey", F.concat(F.lit("https://n.example/sitemap-"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".xml")).alias("url"))
    return rows.select("o_orderkey", urls.year_month(F.col("url")).alias("month"))


@register("url_month_pruned", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR strftime(o_orderdate, '%Y-%m') BETWEEN '1996-02' AND '1996-05'")
def url_month_pruned(spark, sf_dir):
    month = F.when(F.col("o_orderkey") % 7 == 0, "latest").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    rows = Tables(spark, sf_dir).raw("orders").select("o_orderkey", F.concat(F.lit("https://n.example/sitemap-"), month, F.lit(".xml")).alias("url"))
    return rows.where(urls.may_overlap(F.col("url"), "1996-02-10", "1996-05-20")).select("o_orderkey")


@register("url_allowed", "SELECT page_id FROM pages WHERE (regexp_matches(url, '/en/') OR regexp_matches(url, '/de/')) AND NOT regexp_matches(url, 'spam') AND NOT regexp_matches(url, '[?]page=')")
def url_allowed(spark, sf_dir):
    return Tables(spark, sf_dir).raw("pages").where(urls.allowed(F.col("url"), ["/en/", "/de/"], ["spam", "[?]page="])).select("page_id")


@register("url_safe_remote", "SELECT page_id, true AS safe FROM pages")
def url_safe_remote(spark, sf_dir):
    return Tables(spark, sf_dir).raw("pages").select("page_id", urls.safe_remote_udf("url").alias("safe"))


@register("html_language", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS language FROM pages")
def html_language(spark, sf_dir):
    return html.extract_pages(Tables(spark, sf_dir).raw("pages")).select("page_id", "language")


@register("html_title_matches", "SELECT page_id, true AS same FROM pages")
def html_title_matches(spark, sf_dir):
    """The h1 that extraction takes and the head title agree once entities are resolved (the pages repeat it)."""
    return Tables(spark, sf_dir).raw("pages").select("page_id", F.udf(html.titles_agree, "boolean", useArrow=False)("html").alias("same"))


@register("html_extract")
def html_extract(spark, sf_dir):
    return html.extract_pages(Tables(spark, sf_dir).raw("pages"))


@register("section_links", """SELECT page_id, string_agg(h, ' ' ORDER BY p) AS links FROM (SELECT page_id, h, min(p) AS p FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), 1) AS p FROM pages) GROUP BY ALL) GROUP BY page_id""")
def section_links(spark, sf_dir):
    pages = Tables(spark, sf_dir).raw("pages")
    found = feeds.links(pages.select(F.concat(F.lit("https://site"), "page_id", F.lit(".example/")).alias("url"), F.lit("section").alias("method"), F.col("html").cast("binary").alias("content")))
    path = F.regexp_replace("href", "^https://site[0-9]+[.]example", "")
    held = F.transform(F.array_sort(F.collect_list(F.struct("position", path.alias("path")))), lambda x: x["path"])
    return found.groupBy(F.regexp_extract("page_url", "site([0-9]+)", 1).cast("long").alias("page_id")).agg(F.array_join(held, " ").alias("links"))


@register("sitemap_links", "SELECT o_orderkey, 'https://n.example/' || o_orderkey AS href, o_orderdate AS moment FROM orders")
def sitemap_links(spark, sf_dir):
    entry = F.concat(F.lit("<url><loc>https://n.example/"), "o_orderkey", F.lit("</loc><lastmod>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</lastmod></url>"))
    bodies = Tables(spark, sf_dir).raw("orders").groupBy(F.expr("o_orderkey div 1000").alias("g")).agg(F.array_join(F.collect_list(entry), "").alias("x"))
    pages = bodies.select(F.concat(F.lit("https://n.example/map"), "g").alias("url"), F.lit("sitemap").alias("method"), F.concat(F.lit("<urlset xmlns='urn:any'>"), "x", F.lit("</urlset>")).cast("binary").alias("content"))
    found = feeds.links(pages)
    return found.select(F.regexp_extract("href", "([0-9]+)$", 1).cast("long").alias("o_orderkey"), "href", feeds.stamps(F.col("stamp")).alias("moment"))




@register("dates_iso", "SELECT event_id, date_trunc('second', ts) - INTERVAL 3 HOUR AS moment FROM events")
def dates_iso(spark, sf_dir):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("+03:00"))
    return Tables(spark, sf_dir).raw("events").select("event_id", dates.iso_utc(stamp).alias("moment"))


@register("dates_naive_kyiv", "SELECT event_id, date_trunc('second', ts) - INTERVAL 2 HOUR AS moment FROM events")
def dates_naive_kyiv(spark, sf_dir):
    """January is winter time in Kyiv: two hours before UTC."""
    return Tables(spark, sf_dir).raw("events").select("event_id", dates.iso_utc(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("moment"))


@register("dates_rfc2822", "SELECT event_id, date_trunc('second', ts) AS moment FROM events")
def dates_rfc2822(spark, sf_dir):
    stamp = F.concat(F.date_format("ts", "E, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    return Tables(spark, sf_dir).raw("events").select("event_id", dates.rfc2822_utc(stamp).alias("moment"))


@register("dates_textual", "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN o_orderdate - INTERVAL 2 HOUR END AS moment FROM orders")
def dates_textual(spark, sf_dir):
    names = F.array(*map(F.lit, dates.MONTHS))
    text = F.concat(F.dayofmonth("o_orderdate"), F.lit(" "), F.element_at(names, F.month("o_orderdate")), F.lit(" "), F.year("o_orderdate"), F.lit(" р. 00:00"))
    winter = F.month("o_orderdate").isin(12, 1, 2)
    return Tables(spark, sf_dir).raw("orders").select("o_orderkey", F.when(winter, dates.ukrainian_utc(text)).alias("moment"))


_PART = "news_events"


@register("partial_date_parse", sql(_PART, "SELECT id, year, month, day, precision FROM news_events"))
def partial_date_parse(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    parsed = dates.partial(F.date_format(F.to_date(F.col("id").cast("string"), "yyyyMMdd"), "yyyy-MM-dd"), F.col("precision"))
    return events.select("id", parsed.alias("p")).select("id", "p.year", "p.month", "p.day", "p.precision")


@register("partial_date_text", sql(_PART, "SELECT id, CASE WHEN year IS NOT NULL THEN year::VARCHAR || CASE WHEN month IS NOT NULL THEN '-' || lpad(month::VARCHAR, 2, '0') || CASE WHEN day IS NOT NULL THEN '-' || lpad(day::VARCHAR, 2, '0') ELSE '' END ELSE '' END END AS date_text FROM news_events"))
def partial_date_text(spark, sf_dir):
    return Tables(spark, sf_dir).events.select("id", dates.partial_text(F.struct("year", "month", "day")).alias("date_text"))


_NEXT = "SELECT a.id, b.id AS other, {0} FROM news_events a JOIN news_events b ON b.id = a.id + 1"


def _neighbours(t: Tables):
    fields = ["year", "month", "day", "precision"]
    a = t.events.select("id", F.struct(*fields).alias("a"))
    b = t.events.select(F.col("id").alias("other"), F.struct(*fields).alias("b"))
    return a.join(b, F.col("other") == F.col("id") + 1)


@register("partial_date_conflict", sql(_PART, _NEXT.format("coalesce(a.year <> b.year, false) OR coalesce(a.month <> b.month, false) OR coalesce(a.day <> b.day, false) AS conflict")))
def partial_date_conflict(spark, sf_dir):
    return _neighbours(Tables(spark, sf_dir)).select("id", "other", dates.conflicts(F.col("a"), F.col("b")).alias("conflict"))


@register("partial_date_enrich", sql(_PART, _NEXT.format("coalesce(a.year, b.year) AS year, coalesce(a.month, b.month) AS month, coalesce(a.day, b.day) AS day, CASE WHEN list_position(['unknown', 'year', 'month', 'day'], b.precision) > list_position(['unknown', 'year', 'month', 'day'], a.precision) THEN b.precision ELSE a.precision END AS precision")))
def partial_date_enrich(spark, sf_dir):
    return _neighbours(Tables(spark, sf_dir)).select("id", "other", dates.enrich(F.col("a"), F.col("b")).alias("p")).select("id", "other", "p.*")


@register("json_extract", "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def json_extract(spark, sf_dir):
    return Tables(spark, sf_dir).raw("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@register("json_merge", "SELECT event_id, props->>'$.k' AS k, event_type AS kind, NULL::VARCHAR AS gone FROM events")
def json_merge(spark, sf_dir):
    """Shallow union of two objects (right wins), then a key is removed."""
    from newsloom.operators.merge import metadata

    kind = "map<string,string>"
    left = F.from_json("props", kind)
    right = F.from_json(F.to_json(F.struct(F.col("event_type").alias("kind"), F.lit("x").alias("gone"))), kind)
    merged = F.map_filter(metadata(left, right), lambda k, _: k != "gone")
    return Tables(spark, sf_dir).raw("events").select("event_id", merged.alias("m")).select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("kind")).alias("kind"), F.try_element_at("m", F.lit("gone")).alias("gone"))


@register("json_flag_default", "SELECT event_id, coalesce((props->>'$.k')::INTEGER > 50, false) AS high, coalesce(TRY_CAST(props->>'$.flag' AS BOOLEAN), false) AS flag FROM events")
def json_flag_default(spark, sf_dir):
    k, flag = F.get_json_object("props", "$.k").cast("int"), F.get_json_object("props", "$.flag").try_cast("boolean")
    return Tables(spark, sf_dir).raw("events").select("event_id", F.coalesce(k > 50, F.lit(False)).alias("high"), F.coalesce(flag, F.lit(False)).alias("flag"))


@register("text_budget", "SELECT doc_id, substring(text, 1, 1000) AS text, length(text)::INTEGER AS chars, least(length(text), 1000)::INTEGER AS kept, length(text) > 1000 AS truncated FROM documents")
def text_budget(spark, sf_dir):
    return Tables(spark, sf_dir).raw("documents").select("doc_id", texts.budget(F.col("text"), 1000).alias("b")).select("doc_id", "b.*")


@register("classifier_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim(text) ELSE 'Title ' || doc_id || chr(10) || chr(10) || trim(text) END AS text FROM documents")
def classifier_text(spark, sf_dir):
    title = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit(" Title "), "doc_id", F.lit(" ")))
    return Tables(spark, sf_dir).raw("documents").select("doc_id", texts.classifier_text(title, F.col("text")).alias("text"))


@register("retrieval_text", sql("case_articles articles cases", "SELECT id, concat_ws(chr(10), title, nullif(trim(summary), ''), slug) AS text FROM cases"))
def retrieval_text(spark, sf_dir):
    return Tables(spark, sf_dir).cases.select("id", texts.retrieval_text(F.col("title"), F.col("summary"), F.col("slug")).alias("text"))


@register("query_prefix", "SELECT p_partkey, 'query: ' || p_name AS text FROM part")
def query_prefix(spark, sf_dir):
    return Tables(spark, sf_dir).raw("part").select("p_partkey", texts.prefixed("query", F.col("p_name")).alias("text"))


@register("plural_forms", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 AND o_orderkey % 100 <> 11 THEN 'справа' WHEN o_orderkey % 10 BETWEEN 2 AND 4 AND o_orderkey % 100 NOT BETWEEN 12 AND 14 THEN 'справи' ELSE 'справ' END AS form FROM orders")
def plural_forms(spark, sf_dir):
    return Tables(spark, sf_dir).raw("orders").select("o_orderkey", texts.plural(F.col("o_orderkey"), "справа", "справи", "справ").alias("form"))


@register("enum_aliases", "SELECT event_id, CASE event_type WHEN 'view' THEN 'person' WHEN 'click' THEN 'organization' ELSE 'other' END AS entity_type FROM events")
def enum_aliases(spark, sf_dir):
    raw = F.when(F.col("event_type") == "view", " People ").when(F.col("event_type") == "click", "ORG").otherwise(F.col("event_type"))
    return Tables(spark, sf_dir).raw("events").select("event_id", texts.entity_type(raw).alias("entity_type"))


@register("quality_flags", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 9 = 0 THEN 'title_missing' END, CASE WHEN length(text) < 400 THEN 'text_short' END) AS flags FROM documents")
def quality_flags(spark, sf_dir):
    title = F.when(F.col("doc_id") % 9 == 0, " ").otherwise("t")
    return Tables(spark, sf_dir).raw("documents").select("doc_id", F.array_join(texts.quality_flags(title, F.col("text")), ",").alias("flags"))


_KNN = """n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, n.vec_id AS id, round(list_cosine_similarity(q.v, n.v), 6) AS score FROM n q JOIN n ON q.vec_id % 10 = 0 AND n.vec_id % 10 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS place FROM s{0})"""


def _vectors(t: Tables):
    rows = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows.where("id % 10 <> 0"), rows.where("id % 10 = 0").withColumnRenamed("id", "query_id")


@register("knn_top6", "WITH " + _KNN.format("") + " SELECT query_id, id, place FROM r WHERE place <= 6")
def knn_top6(spark, sf_dir):
    return knn.search(*_vectors(Tables(spark, sf_dir)), limit=6).select("query_id", "id", "place")


@register("knn_threshold", "WITH " + _KNN.format(" WHERE score >= 0.3") + " SELECT query_id, id, place FROM r WHERE place <= 6")
def knn_threshold(spark, sf_dir):
    return knn.search(*_vectors(Tables(spark, sf_dir)), limit=6, threshold=0.3).select("query_id", "id", "place")


@register("knn_hydrated", "WITH " + _KNN.format("") + " SELECT query_id, id, place, label FROM r JOIN embeddings ON vec_id = id WHERE place <= 6 AND label <> 3")
def knn_hydrated(spark, sf_dir):
    t = Tables(spark, sf_dir)
    live = t.raw("embeddings").where("label <> 3").select(F.col("vec_id").alias("id"), "label")
    return knn.hydrate(knn.search(*_vectors(t), limit=6), live).select("query_id", "id", "place", "label")


@register("vectors_normalized", "SELECT vec_id, round(embedding[1]::DOUBLE / n, 6) AS head, round(embedding[len(embedding)]::DOUBLE / n, 6) AS tail FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)")
def vectors_normalized(spark, sf_dir):
    unit = Tables(spark, sf_dir).raw("embeddings").select("vec_id", knn.normalized(F.col("embedding")).alias("unit"))
    return unit.select("vec_id", F.round(F.element_at("unit", 1).cast("double"), 6).alias("head"), F.round(F.element_at("unit", -1).cast("double"), 6).alias("tail"))


_TEXT_FIELDS = "noise nexus core anchor continuation theme story new_core broad case_core shared title reason durable new_name entity_type existing_id rejection evidence conflict new_title date_evidence".split()
_COUNTS = "n_events n_entities n_terms n_links n_new n_matching n_signals n_stories n_detached n_original n_blockers n_cores n_assigned_repeats n_both n_cases n_material".split()
_REPEATS = {"d_events": "n_events", "d_entities": "n_entities", "d_links": "n_links", "d_new": "n_new", "d_stories": "n_stories", "d_detached": "n_detached"}
_FLAGS = "is_candidate role_alias role_description speculative placeholder named_actor concrete".split()
_OUTCOMES = {"resolution": ("resolved", "rejected"), "link_audit": ("connect", "drop", "inconclusive"), "coherence": ("coherent", "split", "inconclusive"), "interest": ("keep", "hide", "inconclusive"), "duplicate": ("merge", "distinct", "inconclusive")}
_ACTIONS = {"refresh": ("keep", "replace"), "entity": ("link_existing", "rename_existing", "retype_existing", "create_new", "reject"), "event": ("link_existing", "create_new", "reject")}


def _made(kind: str) -> str:
    """Columns of synthetic decisions, in SQL that both engines read."""
    out = ["event_id AS id"]
    out += [f"CASE WHEN (event_id * {2 * k + 3}) % {k % 5 + 5} < 2 THEN 't{k}' END AS {c}" for k, c in enumerate(_TEXT_FIELDS)]
    out += [f"CAST((event_id * {2 * k + 5}) % {k % 4 + 3} AS INTEGER) AS {c}" for k, c in enumerate(_COUNTS)]
    out += [f"CAST((event_id * {2 * _COUNTS.index(n) + 5}) % {_COUNTS.index(n) % 4 + 3} - CASE WHEN event_id % 13 = {k} THEN 1 ELSE 0 END AS INTEGER) AS {c}" for k, (c, n) in enumerate(_REPEATS.items())]
    out += [f"event_id % {k + 2} = 0 AS {c}" for k, c in enumerate(_FLAGS)]
    for name, table in (("outcome", _OUTCOMES), ("action", _ACTIONS)):
        values = table.get(kind, ("none",))
        out.append("CASE " + " ".join(f"WHEN event_id % {len(values)} = {k} THEN '{v}'" for k, v in enumerate(values)) + f" END AS {name}")
    out.append("CASE event_id % 6 WHEN 0 THEN '2024-01-05' WHEN 1 THEN '2024-01' WHEN 2 THEN '2024' WHEN 3 THEN 'soon' END AS event_date")
    out.append("CASE event_id % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' ELSE 'unknown' END AS precision")
    return "SELECT " + ", ".join(out) + " FROM events"


for _kind, _rules in decisions.RULES.items():

    @register(f"decision_violations_{_kind}", f"WITH d AS ({_made(_kind)}) SELECT id, {decisions.violation_sql(_rules)} AS violations FROM d")
    def _violations(spark, sf_dir, _kind=_kind, _rules=_rules):
        t = Tables(spark, sf_dir)
        columns = _made(_kind).removeprefix("SELECT ").removesuffix(" FROM events")
        rows = spark.sql(f"SELECT {columns} FROM {{events}}", events=t.raw("events"))
        return rows.select("id", F.array_join(decisions.violations(_rules), ",").alias("violations"))


@register("decision_coverage", """WITH d AS (SELECT l_orderkey AS article, l_linenumber AS ref, count(*) AS times FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY ALL), w AS (SELECT DISTINCT l_orderkey AS article, l_linenumber AS ref FROM lineitem WHERE l_suppkey % 5 <> 0)
SELECT article, count(*) FILTER (d.times IS NULL) AS missing, count(*) FILTER (w.ref IS NULL) AS unknown, count(*) FILTER (d.times > 1) AS repeated FROM d FULL JOIN w USING (article, ref) GROUP BY article""".replace("w.ref IS NULL", "wanted IS NULL").replace("SELECT DISTINCT l_orderkey AS article, l_linenumber AS ref FROM", "SELECT DISTINCT l_orderkey AS article, l_linenumber AS ref, true AS wanted FROM"))
def decision_coverage(spark, sf_dir):
    rows = Tables(spark, sf_dir).raw("lineitem").select(F.col("l_orderkey").alias("article"), F.col("l_linenumber").alias("ref"), "l_suppkey")
    return decisions.coverage(rows.where("l_suppkey % 4 <> 0"), rows.where("l_suppkey % 5 <> 0"), "article", "ref")


@register("decision_stray_links", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey IN (l_orderkey % 100, l_partkey % 100) THEN 'link_existing' ELSE 'reject' END AS action FROM lineitem")
def decision_stray_links(spark, sf_dir):
    rows = Tables(spark, sf_dir).raw("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_suppkey").alias("existing_id"), F.array(F.col("l_orderkey") % 100, F.col("l_partkey") % 100).alias("candidates"), F.lit("link_existing").alias("action"), F.lit(None).cast("string").alias("rejection"))
    return decisions.reject_unknown_links(rows, "candidates").select("l_orderkey", "l_linenumber", "l_suppkey", "action")


@register("decision_recheck", "SELECT article_id, coalesce(kept, 0) AS kept, coalesce(fresh, 0) AS fresh, CASE WHEN coalesce(kept, 0) + coalesce(fresh, 0) > 0 THEN 'resolved' ELSE 'rejected' END AS outcome FROM (SELECT l_orderkey AS article_id, count(*) FILTER (l_returnflag = 'A') AS kept FROM lineitem GROUP BY 1) FULL JOIN (SELECT o_orderkey AS article_id, count(*) AS fresh FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) USING (article_id)")
def decision_recheck(spark, sf_dir):
    t = Tables(spark, sf_dir)
    links = t.raw("lineitem").select(F.col("l_orderkey").alias("article_id"), F.when(F.col("l_returnflag") == "A", "connect").otherwise("drop").alias("outcome"))
    return decisions.recheck(links, t.raw("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("article_id")))


@register("constraint_violations", """SELECT * FROM (SELECT 'order_status' AS rule, o_orderstatus AS value, count(*) AS rows FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY ALL
UNION ALL SELECT 'line_key', l_orderkey || ',' || l_linenumber, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'label_document', conv_id::VARCHAR, count(*) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) GROUP BY conv_id)""")
def constraint_violations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return constraints.together(
        constraints.domain(t.raw("orders"), "order_status", "o_orderstatus", ["F", "O"]), constraints.unique(t.raw("lineitem"), "line_key", ["l_orderkey", "l_linenumber"]),
        constraints.foreign_key(t.raw("conversations"), "label_document", "conv_id", t.raw("labels"), "doc_id"),
    )


@register("partial_date_constraints", sql("news_events", "SELECT id, CASE precision WHEN 'day' THEN day IS NOT NULL WHEN 'month' THEN month IS NOT NULL AND day IS NULL WHEN 'year' THEN year IS NOT NULL AND month IS NULL ELSE year IS NULL END AS parts_fit, true AS in_range FROM news_events"))
def partial_date_constraints(spark, sf_dir):
    return Tables(spark, sf_dir).events.select("id", constraints.partial_date_parts().alias("parts_fit"), constraints.partial_date_range().alias("in_range"))


@register("cascade_delete", sql("case_articles", "SELECT * FROM case_articles WHERE case_id % 20 <> 0"))
def cascade_delete(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return constraints.cascade(t.case_articles, "case_id", t.cases.where("status = 'hidden'"), "id").select("case_id", "article_id")


@register("relevance_funnel", sql("articles", "SELECT 0 AS step, 'fetched' AS stage, count(*) AS articles FROM articles UNION ALL SELECT 1, 'relevant', count(*) FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT 2, 'accepted', count(*) FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)"))
def relevance_funnel(spark, sf_dir):
    t = Tables(spark, sf_dir)
    labelled = lambda where: t.raw("labels").where(where).select(F.col("doc_id").alias("article_id"))
    return relevance.funnel({"fetched": t.articles.select(F.col("id").alias("article_id")), "relevant": labelled("quality = 1"), "accepted": labelled("toxic = 0")})


@register("relevance_scores")
def relevance_scores(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.raw("documents").join(t.raw("labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
    model = relevance.fit(rows.where("doc_id % 5 <> 0").select("text", "label"), vocabulary=20_000)
    return relevance.predict(model, rows.where("doc_id % 5 = 0").select("doc_id", "text"))


@register("source_catalogue", "SELECT 'source-' || i AS slug, (i % 4 = 0)::INTEGER AS delayed FROM range(33) t(i)")
def source_catalogue(spark, sf_dir):
    return catalogue.catalogue(spark).select("slug", (F.col("crawl_delay") > 0).cast("int").alias("delayed"))


@register("demo_feed", """WITH l AS (SELECT DISTINCT * FROM (SELECT i % 164 AS c, i AS a FROM range(496) t(i) UNION ALL SELECT (i % 164 + 1) % 164, i FROM range(496) t(i) WHERE i % 2 = 0 UNION ALL SELECT (i % 164 + 2) % 164, i FROM range(496) t(i) WHERE i % 7 = 0))
SELECT c AS case_id, count(*) AS articles FROM l GROUP BY c""")
def demo_feed(spark, sf_dir):
    return catalogue.demo(spark)["case_articles"].groupBy("case_id").agg(F.count("*").alias("articles"))


def _stream(spark, sf_dir, transform, mode: str = "complete"):
    """The stream over the events table, run to its end."""
    events = Tables(spark, sf_dir).raw("events")
    stream = views.read_stream(spark, f"{sf_dir}/events.parquet*", events.schema, None)
    checkpoint = f"{scratch_dir(spark)}/newsloom/stream-{uuid.uuid4().hex}"
    result = views.drain(transform(stream), f"s{uuid.uuid4().hex}", mode, checkpoint)
    drop_stored(spark, checkpoint)
    return result


@register("stream_views_daily", sql("views", "SELECT * FROM views"))
def stream_views_daily(spark, sf_dir):
    return _stream(spark, sf_dir, views.daily)


@register("stream_views_sliding", "SELECT user_id AS case_id, (ts::DATE - k::INTEGER) AS since, count(*) AS views FROM events, range(7) t(k) WHERE event_type = 'view' GROUP BY ALL")
def stream_views_sliding(spark, sf_dir):
    return _stream(spark, sf_dir, views.sliding)


@register("stream_sessions", "SELECT user_id, min(ts) AS started, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, sf_dir):
    return _stream(spark, sf_dir, views.sessions)
