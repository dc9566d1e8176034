"""Queries of lists with their filters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists, ranking
from ..sources import archive as A
from .registry import query


def _article_list(spark, d, **filters):
    a = A.articles(spark, d)
    key = F.col("article_id")
    marks = a.filter("article_id % 4 <> 3").select("article_id", (key % 3 == 0).alias("read"), (key % 5 == 0).alias("starred"))
    return lists.articles(a.select("article_id", "first_discovered_at"), A.members(spark, d), marks, a.select("article_id", "language"), a.filter("article_id % 6 <> 0").select("article_id"), **filters)


_MARKED = """, ml AS (SELECT article_id, first_discovered_at, article_id % 4 <> 3 AND article_id % 3 = 0 AS read, article_id % 4 <> 3 AND article_id % 5 = 0 AS starred, language FROM articles)"""


@query("filtered_articles", _MARKED + """ SELECT article_id, first_discovered_at, read, starred FROM ml WHERE NOT read AND language = '1-URGENT' AND article_id % 6 <> 0 AND first_discovered_at >= TIMESTAMP '1999-03-01' AND first_discovered_at < TIMESTAMP '2001-02-01'""")
def _(spark, d):
    return _article_list(spark, d, unread=True, language="1-URGENT", has_text=True, after="1999-03-01", before="2001-02-01")


@query("read_articles", _MARKED + " SELECT article_id, first_discovered_at, read, starred FROM ml WHERE read AND NOT starred AND article_id % 6 = 0")
def _(spark, d):
    return _article_list(spark, d, unread=False, starred=False, has_text=False)


@query("article_list_page", _MARKED + """ SELECT article_id, first_discovered_at, read, starred FROM ml WHERE starred AND article_id IN (SELECT article_id FROM members WHERE feed_id <= 10 AND feed_id = 5)
    AND (first_discovered_at < TIMESTAMP '2001-05-01' OR (first_discovered_at = TIMESTAMP '2001-05-01' AND article_id < 900)) ORDER BY first_discovered_at DESC, article_id DESC LIMIT 31""")
def _(spark, d):
    return ranking.keyset_page(_article_list(spark, d, starred=True, feed=5), lists.ARTICLE_ORDER, ["2001-05-01 00:00:00", 900], 30)


_EVENTS = """, es AS (SELECT cluster_id % 100 AS event_id, cluster_id, min(effective_at) AS f, max(effective_at) AS l, count(*) AS articles FROM articles GROUP BY 1, 2),
    ev AS (SELECT event_id, min(f) AS started_at, max(l) AS ended_at, count(*) AS stories, sum(articles)::BIGINT AS articles, CASE WHEN event_id % 3 = 0 THEN 'closed' ELSE 'active' END AS status, CASE event_id % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' END AS country FROM es GROUP BY 1),
    et AS (SELECT event_id, c_mktsegment AS title FROM es JOIN customer ON c_custkey = cluster_id), en AS (SELECT DISTINCT cluster_id % 100 AS event_id, entity_id, p_name AS name, entity_id - entity_id % 5 AS root_id FROM links JOIN part ON p_partkey = entity_id)"""


def _event_list(spark, d, **filters):
    stories = A.articles(spark, d).groupBy("cluster_id").agg(F.min("effective_at").alias("f"), F.max("effective_at").alias("l"), F.count("*").alias("articles")).withColumn("event_id", F.col("cluster_id") % 100)
    key = F.col("event_id")
    rows = stories.groupBy("event_id").agg(F.min("f").alias("started_at"), F.max("l").alias("ended_at"), F.count("*").alias("stories"), F.sum("articles").alias("articles"))
    rows = rows.withColumns({"status": F.when(key % 3 == 0, "closed").otherwise("active"), "country": F.when(key % 4 == 0, "DE").when(key % 4 == 1, "FR")})
    titles = A.table(spark, d, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_mktsegment").alias("title")).join(stories.select("cluster_id", "event_id"), "cluster_id")
    e = A.entities(spark, d)
    names = A.links(spark, d).select((F.col("cluster_id") % 100).alias("event_id"), "entity_id").distinct().join(e.select("entity_id", "name"), "entity_id")
    return lists.events(rows, titles, names, e.select("entity_id", (F.col("entity_id") - F.col("entity_id") % 5).alias("root_id")), **filters)


@query("filtered_events", _EVENTS + """ SELECT * FROM ev WHERE status = 'active' AND country = 'FR' AND ended_at >= TIMESTAMP '2000-01-01' AND started_at <= TIMESTAMP '2001-01-01' AND stories >= 1 AND event_id IN (SELECT event_id FROM en WHERE root_id = 15)
    AND (event_id IN (SELECT event_id FROM et WHERE contains(lower(title), 'build')) OR event_id IN (SELECT event_id FROM en WHERE contains(lower(name), 'build')))
    AND (event_id IN (SELECT event_id FROM et WHERE contains(lower(title), 'ring')) OR event_id IN (SELECT event_id FROM en WHERE contains(lower(name), 'ring')))""")
def _(spark, d):
    return _event_list(spark, d, status="active", country="fr", entity=17, start="2000-01-01", end="2001-01-01", words=["Build", "RING"])


@query("biggest_events", _EVENTS + """ SELECT * FROM ev WHERE (articles < 160 OR (articles = 160 AND (ended_at < TIMESTAMP '2001-06-01' OR (ended_at = TIMESTAMP '2001-06-01' AND event_id < 50)))) ORDER BY articles DESC, ended_at DESC, event_id DESC LIMIT 21""")
def _(spark, d):
    return ranking.keyset_page(_event_list(spark, d), lists.EVENT_ORDERS["biggest"], [160, "2001-06-01 00:00:00", 50], 20)


_ENT = """, ent AS (SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 5 IN (3, 4) THEN p_partkey - 2 END AS authority_id, p_name AS name, lower(p_name) AS normalized, CASE p_type WHEN 'SMALL' THEN 'GPE' ELSE p_type END AS kind, p_brand AS language,
        CASE WHEN p_size % 3 = 0 THEN 'confirmed' ELSE 'new' END AS status, p_size % 7 = 0 AS hidden FROM part), use AS (SELECT entity_id, count(DISTINCT article_id) AS n FROM links WHERE entity_id % 3 <> 1 GROUP BY 1)"""


def _entities(spark, d):
    e = A.entities(spark, d)
    key = F.col("entity_id")
    rows = e.select(key, F.when((key % 5).isin(3, 4), key - 2).alias("authority_id"), "name", lists.folded(F.col("name")).alias("normalized"), F.when(F.col("kind") == "SMALL", "GPE").otherwise(F.col("kind")).alias("kind"), F.col("brand").alias("language"), F.when(F.col("size") % 3 == 0, "confirmed").otherwise("new").alias("status"), (F.col("size") % 7 == 0).alias("hidden"))
    return rows, A.links(spark, d).filter("entity_id % 3 <> 1"), e.filter("entity_id % 4 = 0").select("entity_id", F.concat(F.lit("Q"), F.col("entity_id").cast("string")).alias("item"))


@query("filtered_roots", _ENT + """ SELECT r.entity_id, name, kind, lower(name) AS sort_name, CASE WHEN r.entity_id % 4 = 0 THEN 'Q' || r.entity_id END AS item, (SELECT count(*) FROM ent v WHERE v.authority_id = r.entity_id) AS variants, coalesce(n, 0) AS articles FROM ent r LEFT JOIN use USING (entity_id)
    WHERE authority_id IS NULL AND NOT hidden AND status = 'new' AND kind IN ('GPE', 'PROMO', 'ECONOMY') AND r.entity_id % 4 <> 0 AND (contains(lower(name), 'in') OR contains(normalized, 'in') OR EXISTS (SELECT 1 FROM ent v WHERE v.authority_id = r.entity_id AND contains(v.normalized, 'in')))""")
def _(spark, d):
    return lists.roots(*_entities(spark, d), status="new", text=" IN ", linked=False, kinds=["GPE", "PROMO", "ECONOMY"])


@query("roots_by_articles", _ENT + """, r AS (SELECT r.entity_id, name, kind, lower(name) AS sort_name, CASE WHEN r.entity_id % 4 = 0 THEN 'Q' || r.entity_id END AS item, (SELECT count(*) FROM ent v WHERE v.authority_id = r.entity_id) AS variants, coalesce(n, 0) AS articles FROM ent r LEFT JOIN use USING (entity_id) WHERE authority_id IS NULL AND hidden AND r.entity_id % 4 = 0)
    SELECT * FROM r WHERE articles < 31 OR (articles = 31 AND (sort_name > 'p' OR (sort_name = 'p' AND entity_id > 9))) ORDER BY articles DESC, sort_name, entity_id LIMIT 26""")
def _(spark, d):
    return ranking.keyset_page(lists.roots(*_entities(spark, d), hidden=True, linked=True), lists.ROOT_ORDERS["articles"], [31, "p", 9], 25)


@query("entity_picker", _ENT + """ SELECT entity_id, name, normalized, kind, CASE WHEN kind = 'GPE' AND normalized IN ('small ring', 'large bolt') THEN 0 ELSE 1 END AS rank FROM ent r WHERE authority_id IS NULL AND NOT hidden
    AND (entity_id IN (SELECT entity_id FROM use) OR EXISTS (SELECT 1 FROM ent v JOIN use ON use.entity_id = v.entity_id WHERE v.authority_id = r.entity_id))
    AND (starts_with(normalized, 'sm') OR starts_with(normalized, 'l') OR EXISTS (SELECT 1 FROM ent v WHERE v.authority_id = r.entity_id AND (starts_with(v.normalized, 'sm') OR starts_with(v.normalized, 'l'))) OR (kind = 'GPE' AND normalized IN ('small ring', 'large bolt')))""")
def _(spark, d):
    e, links, _ = _entities(spark, d)
    return lists.picker(e, links, ["SM", "l"], ["small ring", "large bolt"])
