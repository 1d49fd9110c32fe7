"""Queries of the read path."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.trigram import similarity
from newsloom.operators import dossier, feed
from newsloom.plans.bindings import AS_OF, Tables, sql, ts
from newsloom.plans.registry import register

_PUBLIC = "public AS (SELECT * FROM cases c WHERE status = 'active' AND summary IS NOT NULL AND length(trim(summary)) > 0 AND EXISTS (SELECT 1 FROM case_articles a WHERE a.case_id = c.id))"
_RANKED = f"""{_PUBLIC},
v AS (SELECT case_id, sum(view_count)::BIGINT AS views FROM views GROUP BY case_id),
t AS (SELECT case_id, count(*) AS trending FROM case_articles JOIN articles ON article_id = id WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY case_id),
ranked AS (SELECT p.*, coalesce(views, 0) AS views, coalesce(trending, 0) AS trending FROM public p LEFT JOIN v ON v.case_id = p.id LEFT JOIN t ON t.case_id = p.id)"""
_SHOWN = ["id", "slug", "title", "article_count", "last_updated_at", "created_at", "views", "trending"]
_LAST = "last_updated_at DESC NULLS LAST, id"
_SQL_ORDER = {"latest": _LAST, "newest": f"created_at DESC, {_LAST}", "popular": f"views DESC, {_LAST}", "biggest": f"article_count DESC, {_LAST}", "trending": f"trending DESC, {_LAST}"}
_FEED = "case_articles articles cases views"


def _rows(t: Tables):
    return feed.ranked(t.cases, t.case_articles, t.articles, t.views, ts(AS_OF))


for _name, _order in _SQL_ORDER.items():

    @register(f"feed_{_name}", sql(_FEED, f"SELECT {', '.join(_SHOWN)} FROM ranked ORDER BY {_order} LIMIT 20", _RANKED))
    def _feed(spark, sf_dir, _sort=_name):
        return feed.page(_rows(Tables(spark, sf_dir)), _sort).select(_SHOWN)


@register("feed_trending_page3", sql(_FEED, f"SELECT {', '.join(_SHOWN)} FROM ranked ORDER BY {_SQL_ORDER['trending']} LIMIT 20 OFFSET 40", _RANKED))
def feed_page3(spark, sf_dir):
    return feed.page(_rows(Tables(spark, sf_dir)), "trending", 3).select(_SHOWN)


@register("feed_total_pages", sql("case_articles articles cases", "SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages FROM public", _PUBLIC))
def feed_total_pages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return feed.page_count(feed.public_cases(t.cases, t.case_articles))


@register("public_cases", sql("case_articles articles cases", "SELECT id, slug, summary FROM public", _PUBLIC))
def public_cases(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return feed.public_cases(t.cases, t.case_articles).select("id", "slug", "summary")


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0), lambda w: list_transform(range(1, length(w) + 2), lambda k: substring('  ' || w || ' ', k, 3)))))"


def _sim(a: str, b: str) -> str:
    x, y = _GRAMS.format(a), _GRAMS.format(b)
    return f"(len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct({x} || {y})))"


QUERY = "blue widget"
_FOUND = f"""{_RANKED},
e AS (SELECT id, coalesce(name ILIKE '%{QUERY}%', false) OR coalesce(description ILIKE '%{QUERY}%', false) OR coalesce(to_json(aliases)::VARCHAR ILIKE '%{QUERY}%', false) AS hit,
  greatest({_sim('name', f"'{QUERY}'")}, coalesce({_sim('description', f"'{QUERY}'")}, 0), {_sim('to_json(aliases)::VARCHAR', f"'{QUERY}'")}) AS best FROM entities),
ce AS (SELECT case_id, bool_or(hit) AS hit, max(best) AS best FROM case_entities JOIN e ON e.id = entity_id GROUP BY case_id),
n AS (SELECT id, title ILIKE '%{QUERY}%' AS hit, {_sim('title', f"'{QUERY}'")} AS best FROM news_events),
cn AS (SELECT case_id, bool_or(hit) AS hit, max(best) AS best FROM case_events JOIN n ON n.id = event_id GROUP BY case_id),
found AS (SELECT r.*, round(greatest({_sim('r.title', f"'{QUERY}'")}, {_sim('r.summary', f"'{QUERY}'")}, coalesce(ce.best, 0), coalesce(cn.best, 0)), 6) AS score,
  r.title ILIKE '%{QUERY}%' OR r.summary ILIKE '%{QUERY}%' OR coalesce(ce.hit, false) OR coalesce(cn.hit, false) AS hit
  FROM ranked r LEFT JOIN ce ON ce.case_id = r.id LEFT JOIN cn ON cn.case_id = r.id)"""
_SEARCH = f"{_FEED} entities case_entities news_events case_events"


def _found(t: Tables):
    return feed.searched(_rows(t), feed.Evidence(t.entities, t.case_entities, t.events, t.case_events), QUERY)


@register("feed_search_score", sql(_SEARCH, "SELECT id, score FROM found WHERE hit OR score > 0.15", _FOUND))
def feed_search_score(spark, sf_dir):
    return _found(Tables(spark, sf_dir)).select("id", "score")


@register("feed_search_page", sql(_SEARCH, f"SELECT id, slug, title, score, last_updated_at FROM found WHERE hit OR score > 0.15 ORDER BY score DESC, {_LAST} LIMIT 20", _FOUND))
def feed_search_page(spark, sf_dir):
    return feed.page(_found(Tables(spark, sf_dir)), "search").select("id", "slug", "title", "score", "last_updated_at")


@register("trigram_similarity_pairs", f"SELECT p_partkey, round({_sim('p_name', repr('blue widgets'))}, 6) AS score FROM part")
def trigram_similarity_pairs(spark, sf_dir):
    return Tables(spark, sf_dir).raw("part").select("p_partkey", F.round(similarity(F.col("p_name"), F.lit("blue widgets")), 6).alias("score"))


@register("case_image_candidates", sql("articles case_articles", "SELECT case_id, string_agg(image_url, ' ' ORDER BY created_at, article_id) AS images FROM case_articles JOIN articles ON article_id = id WHERE image_url <> '' GROUP BY case_id"))
def case_image_candidates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return feed.image_candidates(t.case_articles, t.articles).select("case_id", F.array_join("image_urls", " ").alias("images"))


@register("latest_events_top50", sql("case_articles articles cases news_events case_events", "SELECT DISTINCT e.* FROM news_events e JOIN case_events ON event_id = e.id JOIN public p ON p.id = case_id ORDER BY year DESC NULLS LAST, month DESC NULLS LAST, day DESC NULLS LAST, id DESC LIMIT 50", _PUBLIC))
def latest_events_top50(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return dossier.latest_events(t.events, t.case_events, feed.public_cases(t.cases, t.case_articles))


@register("case_timeline", sql("news_events case_events", "SELECT case_id, id, year, month, day, precision, row_number() OVER (PARTITION BY case_id ORDER BY year IS NULL, year NULLS LAST, month NULLS LAST, day NULLS LAST, id)::INTEGER AS place FROM case_events JOIN news_events ON id = event_id"))
def case_timeline(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return dossier.timeline(t.events, t.case_events)


@register("case_sources", sql("sources articles case_articles", "SELECT case_id, slug, name, count(*) AS articles FROM case_articles JOIN articles a ON a.id = article_id JOIN sources s ON s.id = source_id GROUP BY ALL"))
def case_sources(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return dossier.source_counts(t.case_articles, t.articles, t.sources)


@register("case_entities", sql("entities article_entity_cases", "SELECT case_id, entity_id, name, count(DISTINCT article_id) AS mentions FROM article_entity_cases JOIN entities ON id = entity_id GROUP BY ALL"))
def case_entities(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return dossier.mentions(t.article_entity_cases, t.entities)


@register("case_articles", sql("sources articles case_articles", "SELECT case_id, a.id, a.title, s.slug, a.published_at FROM case_articles JOIN articles a ON a.id = article_id JOIN sources s ON s.id = a.source_id"))
def case_articles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    named = t.articles.join(t.sources.select(F.col("id").alias("source_id"), "slug"), "source_id")
    return t.case_articles.join(named, t.case_articles.article_id == named.id).select("case_id", "id", "title", "slug", "published_at")


@register("event_supporting_articles", sql("article_event_cases", "SELECT case_id, event_id, count(DISTINCT article_id) AS supporting FROM article_event_cases GROUP BY ALL"))
def event_supporting_articles(spark, sf_dir):
    return dossier.supporting_articles(Tables(spark, sf_dir).article_event_cases)


@register("merged_redirect", sql("case_articles articles cases", "SELECT m.slug AS old_slug, a.slug AS new_slug FROM cases m JOIN cases a ON a.id = m.merged_into WHERE m.status = 'merged' AND a.status = 'active'"))
def merged_redirect(spark, sf_dir):
    return dossier.redirect(Tables(spark, sf_dir).cases)


_VISIBLE = f"{_PUBLIC}, visible AS (SELECT * FROM entities e WHERE description <> '' AND EXISTS (SELECT 1 FROM case_entities x JOIN public p ON p.id = x.case_id WHERE x.entity_id = e.id) AND EXISTS (SELECT 1 FROM article_entities y WHERE y.entity_id = e.id))"


@register("entity_page_articles", sql("sources case_articles articles cases article_entity_cases", "SELECT DISTINCT entity_id, article_id, a.title, s.slug, a.published_at FROM article_entity_cases x JOIN public p ON p.id = x.case_id JOIN articles a ON a.id = article_id JOIN sources s ON s.id = a.source_id", _PUBLIC))
def entity_page_articles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return dossier.entity_articles(t.articles, t.sources, t.article_entity_cases, feed.public_cases(t.cases, t.case_articles))


@register("sitemap_entries", sql("case_articles articles cases entities case_entities article_entities", "SELECT '/cases/' || slug AS path, last_updated_at FROM public UNION ALL SELECT '/entities/' || slug, NULL FROM visible", _VISIBLE))
def sitemap_entries(spark, sf_dir):
    t = Tables(spark, sf_dir)
    public = feed.public_cases(t.cases, t.case_articles)
    return dossier.sitemap(public, dossier.visible_entities(t.entities, t.case_entities, t.article_entities, public))


def _shared(label: str, links: str, item: str) -> str:
    return f"{label} AS (SELECT b.case_id, count(DISTINCT b.{item}) AS n FROM {links} a JOIN {links} b USING ({item}) WHERE a.case_id = 10 AND b.case_id <> 10 GROUP BY b.case_id)"


@register(
    "other_cases_top10",
    sql(
        "case_articles articles cases case_events case_entities",
        """SELECT id, coalesce(sa.n, 0) AS shared_articles, coalesce(se.n, 0) AS shared_events, coalesce(sn.n, 0) AS shared_entities,
 ((sa.n IS NOT NULL)::INTEGER + (se.n IS NOT NULL)::INTEGER + (sn.n IS NOT NULL)::INTEGER)::INTEGER AS kinds FROM cases c LEFT JOIN sa ON sa.case_id = id LEFT JOIN se ON se.case_id = id LEFT JOIN sn ON sn.case_id = id
 WHERE status = 'active' AND summary IS NOT NULL AND (sa.n IS NOT NULL OR se.n IS NOT NULL OR sn.n IS NOT NULL)
 ORDER BY kinds DESC, shared_articles DESC, shared_events DESC, shared_entities DESC, last_updated_at DESC NULLS LAST, id LIMIT 10""",
        ", ".join([_shared("sa", "case_articles", "article_id"), _shared("se", "case_events", "event_id"), _shared("sn", "case_entities", "entity_id")]),
    ),
)
def other_cases_top10(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return dossier.other_cases(t.cases, t.case_articles, t.case_events, t.case_entities, 10).select("id", "shared_articles", "shared_events", "shared_entities", "kinds")


@register(
    "duplicate_candidates",
    """WITH l AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS i FROM lineitem), n AS (SELECT c, count(*) AS n FROM l GROUP BY c),
s AS (SELECT a.c AS case_a, b.c AS case_b, count(*) AS shared FROM l a JOIN l b ON a.i = b.i AND a.c < b.c GROUP BY ALL)
SELECT case_a, case_b, shared, x.n AS n_a, y.n AS n_b FROM s JOIN n x ON x.c = case_a JOIN n y ON y.c = case_b WHERE shared * 10 >= least(x.n, y.n) * 3""",
)
def duplicate_candidates(spark, sf_dir):
    links = Tables(spark, sf_dir).raw("lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_partkey").alias("item"))
    return dossier.duplicate_candidates(links)


@register(
    "case_page_sections",
    sql(
        "sources articles case_articles cases entities article_entity_cases news_events case_events",
        """SELECT c.id, c.title, (SELECT count(DISTINCT source_id) FROM case_articles JOIN articles a ON a.id = article_id WHERE case_id = 22)::INTEGER AS n_sources,
 (SELECT count(DISTINCT entity_id) FROM article_entity_cases WHERE case_id = 22)::INTEGER AS n_entities, (SELECT count(*) FROM case_events WHERE case_id = 22)::INTEGER AS n_events FROM public c WHERE slug = 'case-22'""",
        _PUBLIC,
    ),
)
def case_page_sections(spark, sf_dir):
    page = dossier.case_page(Tables(spark, sf_dir), "case-22")
    return page.select("id", "title", F.size("sources").alias("n_sources"), F.size("entities").alias("n_entities"), F.size("timeline").alias("n_events"))
