"""Queries of what changed for watches and of the pages of stories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import growth
from ..sources import archive as A
from .registry import AS_OF, SINCE, _watch, query

#: Watches looked at on one of two days and evaluated on a third.
_LOOKS = f""", mo AS (SELECT n_nationkey AS monitor_id, CASE WHEN n_nationkey % 4 <> 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '{SINCE}' ELSE TIMESTAMP '2000-06-01' END END AS after, TIMESTAMP '{AS_OF}' AS upto FROM nation),
    mt AS (SELECT c_nationkey AS monitor_id, article_id, cluster_id, effective_at AS enriched_at FROM articles JOIN customer ON cluster_id = c_custkey),"""


def _looks(spark, d):
    matches, _ = _watch(spark, d)
    n = F.col("n_nationkey")
    at = lambda x: F.lit(x).cast("timestamp")
    mon = A.table(spark, d, "nation").select(n.alias("monitor_id"), F.when(n % 4 != 3, F.when(n % 2 == 0, at(SINCE)).otherwise(at("2000-06-01"))).alias("viewed_cursor_at"), at(AS_OF).alias("eval_cursor_at"))
    return matches, mon


@query("watch_story_changes", _LOOKS + """ n AS (SELECT monitor_id, cluster_id, after, upto, count(*) FILTER (enriched_at > after) AS articles, count(*) FILTER (enriched_at <= after) > 0 AS seen FROM mt JOIN mo USING (monitor_id) WHERE enriched_at <= upto AND after < upto GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY monitor_id ORDER BY articles DESC, cluster_id) AS rank, count(*) OVER (PARTITION BY monitor_id) > 10 AS more FROM n WHERE articles > 0),
    g AS (SELECT monitor_id, r.cluster_id, count(DISTINCT CASE WHEN discovered_at <= after THEN feed_id END) AS before, count(DISTINCT CASE WHEN discovered_at <= upto THEN feed_id END) AS now FROM r JOIN members m ON m.cluster_id = r.cluster_id WHERE rank <= 10 GROUP BY 1, 2),
    e AS (SELECT monitor_id, cluster_id, string_agg(article_id, ',' ORDER BY p) AS evidence FROM (SELECT monitor_id, cluster_id, article_id, row_number() OVER (PARTITION BY monitor_id, cluster_id ORDER BY enriched_at DESC, article_id) AS p FROM mt JOIN mo USING (monitor_id) WHERE enriched_at > after AND enriched_at <= upto) WHERE p <= 3 GROUP BY 1, 2)
    SELECT monitor_id, cluster_id, CASE WHEN seen THEN 'grew' ELSE 'new' END AS status, articles, now AS sources, now - before AS sources_added, more, evidence FROM r JOIN g USING (monitor_id, cluster_id) JOIN e USING (monitor_id, cluster_id) WHERE rank <= 10 AND (NOT seen OR now - before >= 2)""")
def _(spark, d):
    out = growth.changed_stories(*_looks(spark, d), A.members(spark, d))
    return out.withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


@query("watch_new_keys", _LOOKS + """ k AS (SELECT monitor_id, 'source' AS kind, feed_id::VARCHAR AS key, feed_id AS id, mt.article_id, enriched_at FROM mt JOIN members m ON m.article_id = mt.article_id UNION ALL SELECT monitor_id, 'entity', entity_id::VARCHAR, entity_id, mt.article_id, enriched_at FROM mt JOIN links l ON l.article_id = mt.article_id),
    n AS (SELECT monitor_id, kind, key, id, count(DISTINCT CASE WHEN enriched_at > after THEN article_id END) AS articles, count(*) FILTER (enriched_at <= after) > 0 AS seen FROM k JOIN mo USING (monitor_id) WHERE enriched_at <= upto AND after < upto GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY monitor_id, kind ORDER BY articles DESC, id) AS rank, count(*) OVER (PARTITION BY monitor_id, kind) > 10 AS more FROM n WHERE articles > 0)
    SELECT monitor_id, kind, key, articles, more FROM r WHERE rank <= 10 AND NOT seen""")
def _(spark, d):
    matches, mon = _looks(spark, d)
    own = matches.select("monitor_id", "article_id", "enriched_at")
    feeds = own.join(A.members(spark, d).select("article_id", "feed_id"), "article_id")
    named = own.join(A.links(spark, d).select("article_id", "entity_id"), "article_id")
    return growth.kinds(("source", growth.new_keys(feeds, mon, "feed_id"), "feed_id"), ("entity", growth.new_keys(named, mon, "entity_id"), "entity_id"))


@query("story_source_growth", _LOOKS + """ w AS (SELECT DISTINCT monitor_id, cluster_id, after, upto FROM mt JOIN mo USING (monitor_id) WHERE after < upto)
    SELECT monitor_id, w.cluster_id, count(DISTINCT CASE WHEN discovered_at <= after THEN feed_id END) AS before, count(DISTINCT CASE WHEN discovered_at <= upto THEN feed_id END) AS now FROM w LEFT JOIN members m ON m.cluster_id = w.cluster_id GROUP BY 1, 2""")
def _(spark, d):
    matches, mon = _looks(spark, d)
    windows = matches.select("monitor_id", "cluster_id").distinct().join(growth._windows(mon), "monitor_id")
    return growth.story_growth(A.members(spark, d), windows)


@query("story_entities", """, n AS (SELECT cluster_id, entity_id, p_name AS name, p_type AS kind, count(DISTINCT article_id) AS articles FROM links JOIN part ON p_partkey = entity_id WHERE p_size % 9 <> 0 GROUP BY 1, 2, 3, 4)
    SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY articles DESC, name, entity_id) AS rank FROM n QUALIFY rank <= 12""")
def _(spark, d):
    names = A.entities(spark, d).select("entity_id", "name", "kind", (F.col("size") % 9 == 0).alias("hidden"))
    return growth.story_entities(A.articles(spark, d), A.links(spark, d), names)


@query("story_titles", """, t AS (SELECT article_id, CASE WHEN article_id % 3 <> 0 THEN language || ' ' || article_id END AS title FROM articles), st AS (SELECT cluster_id, max(article_id) AS representative FROM articles GROUP BY 1),
    f AS (SELECT cluster_id, arg_min(title, (effective_at, article_id)) AS first FROM articles JOIN t USING (article_id) WHERE title IS NOT NULL GROUP BY 1)
    SELECT st.cluster_id, coalesce(t.title, f.first) AS title FROM st LEFT JOIN t ON t.article_id = representative LEFT JOIN f ON f.cluster_id = st.cluster_id""")
def _(spark, d):
    a = A.articles(spark, d)
    titles = a.select("article_id", F.when(F.col("article_id") % 3 != 0, F.concat_ws(" ", "language", F.col("article_id").cast("string"))).alias("title"))
    return growth.story_titles(a.groupBy("cluster_id").agg(F.max("article_id").alias("representative")), a, titles)


@query("story_chart", """, w AS (SELECT (cluster_id * 10000 + year(effective_at)) * 100 + month(effective_at) AS cluster_id, article_id, effective_at FROM articles),
    s AS (SELECT cluster_id, min(effective_at) AS lo, max(effective_at) AS hi, CASE WHEN max(effective_at) - min(effective_at) <= INTERVAL 7 DAY THEN 'hour' ELSE 'day' END AS step FROM w GROUP BY 1),
    b AS (SELECT cluster_id, step, unnest(generate_series(date_trunc(step, lo)::TIMESTAMP, date_trunc(step, hi)::TIMESTAMP, CASE step WHEN 'hour' THEN INTERVAL 1 HOUR ELSE INTERVAL 1 DAY END)) AS bucket FROM s),
    c AS (SELECT cluster_id, date_trunc(step, effective_at)::TIMESTAMP AS bucket, count(*) AS n FROM w JOIN s USING (cluster_id) GROUP BY 1, 2)
    SELECT cluster_id, step, bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (cluster_id, bucket)""")
def _(spark, d):
    """A customer's orders of a month as a story, so that some span days and others weeks."""
    at = F.col("effective_at")
    return growth.story_chart(A.articles(spark, d).select(((F.col("cluster_id") * 10000 + F.year(at)) * 100 + F.month(at)).alias("cluster_id"), "article_id", "effective_at"))
