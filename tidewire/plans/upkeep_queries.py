"""Registered queries of upkeep: selections, completeness, events, eligibility and closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upkeep
from ..sources import archive as A
from .registry import query


@query("reprocessing_selection", "SELECT article_id FROM articles WHERE first_discovered_at >= TIMESTAMP '1999-01-01' AND first_discovered_at < TIMESTAMP '1999-07-01' AND language = '5-LOW'")
def _(spark, d):
    return upkeep.select_articles(A.articles(spark, d), first="1999-01-01", until="1999-07-01", language="5-LOW").select("article_id")


@query("long_texts", "SELECT article_id, length(text) AS chars FROM texts WHERE length(text) > 10000")
def _(spark, d):
    return upkeep.size_guard(A.texts(spark, d), 10_000)[1].select("article_id", F.length("text").cast("long").alias("chars"))


@query("enrichment", """, j AS (SELECT l_orderkey AS article_id, count(*) FILTER (l_linenumber = 7) AS open FROM lineitem GROUP BY 1) SELECT article_id, CASE WHEN article_id % 10 = 0 THEN TIMESTAMP '2002-01-01' WHEN open = 0 THEN TIMESTAMP '2002-02-01' END AS enriched_at FROM articles LEFT JOIN j USING (article_id)""")
def _(spark, d):
    a = A.articles(spark, d).select("article_id", F.when(F.col("article_id") % 10 == 0, F.lit("2002-01-01").cast("timestamp")).alias("enriched_at"))
    jobs = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.when(F.col("l_linenumber") == 7, "running").otherwise("succeeded").alias("status"))
    return upkeep.mark_enriched(a, jobs, "2002-02-01")


@query("orphan_objects", "SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem)")
def _(spark, d):
    l = A.table(spark, d, "lineitem")  # noqa: E741
    objects = A.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lit("2001-01-01").cast("timestamp").alias("stored_at"))
    return upkeep.orphans(objects, [l.filter("l_quantity > 45").select(F.col("l_partkey").alias("key")), l.select(F.col("l_suppkey").alias("key"))], "2002-01-01").select("key")


@query("result_page", "SELECT article_id, cluster_id, CASE article_id WHEN 42 THEN 1 WHEN 7 THEN 2 WHEN 100 THEN 3 ELSE 4 END AS place FROM articles WHERE article_id IN (42, 7, 100, 9)")
def _(spark, d):
    return upkeep.in_order([42, 7, 100, 9], A.articles(spark, d)).select("article_id", "cluster_id", "place")


_PLACED = """, e AS (SELECT c_custkey AS a, c_custkey + 3 AS b FROM customer WHERE c_custkey % 4 = 0), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT a, a FROM both_ways UNION SELECT x.b, r.root FROM r JOIN both_ways x ON x.a = r.node),
    roots AS (SELECT node, min(root) AS root FROM r GROUP BY 1), placed AS (SELECT DISTINCT m.cluster_id, coalesce(root, m.cluster_id) AS event_id FROM members m LEFT JOIN roots ON node = m.cluster_id)"""


def _placed(spark, d):
    pairs = A.table(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("target"), (F.col("c_custkey") + 3).alias("other"), F.lit(0.7).alias("score"))
    return upkeep.associate(pairs, A.members(spark, d).select("cluster_id").distinct())


@query("event_association", _PLACED + " SELECT * FROM placed")
def _(spark, d):
    return _placed(spark, d)


_REFRESHED = _PLACED + """, rw AS (SELECT * FROM members JOIN placed USING (cluster_id)), n AS (SELECT event_id, min(effective_at) AS started_at, max(effective_at) AS ended_at, count(DISTINCT cluster_id) AS stories, count(DISTINCT article_id) AS articles FROM rw GROUP BY 1),
    c AS (SELECT event_id, country FROM (SELECT event_id, country, count(DISTINCT rw.article_id) AS k FROM rw JOIN countries USING (article_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY k DESC, country) = 1)"""


@query("event_refresh", _REFRESHED + " SELECT * FROM n LEFT JOIN c USING (event_id)")
def _(spark, d):
    return upkeep.refresh_events(_placed(spark, d), A.members(spark, d), A.countries(spark, d))


@query("events_by_country", _REFRESHED + " SELECT country, count(*) AS events FROM n JOIN c USING (event_id) WHERE ended_at >= TIMESTAMP '2001-01-01' GROUP BY 1")
def _(spark, d):
    return upkeep.events_by_country(upkeep.refresh_events(_placed(spark, d), A.members(spark, d), A.countries(spark, d)), "2001-01-01")


@query("other_names", """, ent AS (SELECT p_partkey AS entity_id, p_partkey - p_partkey % 5 AS root_id, p_name AS name FROM part)
    SELECT v.root_id, string_agg(DISTINCT v.name, ',' ORDER BY v.name) AS names FROM ent v JOIN ent o ON o.entity_id = v.root_id WHERE v.entity_id <> v.root_id AND v.name <> o.name GROUP BY 1""")
def _(spark, d):
    e = A.entities(spark, d).select("entity_id", F.when(F.col("entity_id") % 5 != 0, F.col("entity_id") - F.col("entity_id") % 5).alias("authority_id"), "name")
    return upkeep.other_names(e).withColumn("names", F.array_join("names", ","))


@query("source_coverage", "SELECT entity_id, count(DISTINCT l.article_id) AS articles FROM links l WHERE article_id IN (SELECT article_id FROM members WHERE feed_id = 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return upkeep.source_coverage(A.members(spark, d), A.links(spark, d), 2)


@query("extraction_states", """SELECT feed_id, count(*) FILTER (article_id % 3 = 0) AS extracted, count(*) FILTER (article_id % 3 = 1 AND article_id % 2 = 0) AS in_progress, count(*) FILTER (article_id % 3 = 1 AND article_id % 2 = 1) AS failed, count(*) FILTER (article_id % 3 = 2) AS not_extracted FROM members GROUP BY 1""")
def _(spark, d):
    a = A.articles(spark, d)
    jobs = a.filter("article_id % 3 = 1").select("article_id", F.when(F.col("article_id") % 2 == 0, "running").otherwise("failed").alias("status"))
    return upkeep.extraction_split(A.members(spark, d), a.filter("article_id % 3 = 0"), jobs)


@query("eligible_roots", """SELECT entity_id, count(DISTINCT article_id) AS articles FROM links JOIN part ON entity_id = p_partkey WHERE p_partkey % 5 = 0 AND p_size <> 50 AND p_type IN ('ECONOMY', 'STANDARD') AND p_partkey % 15 <> 0 GROUP BY 1 HAVING count(DISTINCT article_id) >= 3""")
def _(spark, d):
    e = A.entities(spark, d).select("entity_id", "kind", (F.col("size") == 50).alias("hidden"), F.when(F.col("entity_id") % 5 != 0, F.lit(0)).alias("authority_id"))
    return upkeep.eligible_roots(e, A.links(spark, d), e.filter("entity_id % 15 = 0"), 3, ["ECONOMY", "STANDARD"])


@query("search_names", """, u AS (SELECT entity_id, count(DISTINCT article_id) AS uses FROM links GROUP BY 1), ent AS (SELECT p_partkey AS entity_id, p_partkey - p_partkey % 5 AS root_id, p_brand AS language, p_name AS name FROM part)
    SELECT root_id, language, arg_max(name, (CAST(entity_id = root_id AS INT), coalesce(uses, 0), name)) AS name FROM ent LEFT JOIN u USING (entity_id) GROUP BY 1, 2""")
def _(spark, d):
    e = A.entities(spark, d).select("entity_id", F.col("brand").alias("language"), F.when(F.col("entity_id") % 5 != 0, F.col("entity_id") - F.col("entity_id") % 5).alias("authority_id"), "name")
    return upkeep.search_names(e, A.links(spark, d))


@query("type_closure", """, c AS (SELECT p_partkey AS qid, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), r(qid, ancestor, n) AS (SELECT qid, parent, 1 FROM c UNION SELECT r.qid, c.parent, n + 1 FROM r JOIN c ON c.qid = r.ancestor WHERE n < 4) SELECT DISTINCT qid, ancestor FROM r""")
def _(spark, d):
    return upkeep.type_closure(A.table(spark, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("qid"), F.floor(F.col("p_partkey") / 3).alias("parent")))


@query("dirty_stories", "SELECT c_custkey AS cluster_id FROM customer WHERE c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_acctbal > 5000)")
def _(spark, d):
    c = A.table(spark, d, "customer")
    at = lambda x: F.lit(x).cast("timestamp")
    decided = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("cluster_id"), F.lit(2).alias("version"), F.when(F.col("c_custkey") % 3 == 1, at("2024-01-02")).otherwise(at("2024-02-01")).alias("decided_at"))
    return upkeep.dirty_clusters(c.select(F.col("c_custkey").alias("cluster_id"), F.when(F.col("c_acctbal") > 5000, at("2024-01-03")).otherwise(at("2024-01-01")).alias("updated_at")), decided, 2)


@query("delivery_states", """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT event_type AS status, count(*) AS n, count(*) FILTER (floor(value) < 20 OR event_type = 'failed') AS outstanding FROM r WHERE rn = 1 GROUP BY 1""")
def _(spark, d):
    e = A.table(spark, d, "events")
    return upkeep.delivery_state(e.select(F.col("user_id").alias("article_id"), F.col("event_id").alias("delivery_id"), F.col("event_type").alias("status"), F.floor("value").alias("indexed_revision")), e.select(F.col("user_id").alias("article_id"), F.lit(20).alias("revision")).distinct())
