"""Registered queries of lists, documents, relations and changes between runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue
from ..sources import archive as A
from .registry import query

_FEEDS = """, feeds AS (SELECT s_suppkey AS feed_id, s_name AS name, s_nationkey % 5 <> 0 AS enabled, s_suppkey % 13 = 0 AS retired, ['t' || s_nationkey % 4, 'all'] AS tags FROM supplier),
    lastf AS (SELECT feed_id, arg_max(status, (started_at, fetch_id)) AS last_status, max(started_at) AS last_at FROM fetches GROUP BY 1),
    states AS (SELECT feeds.*, last_status, last_at, CASE WHEN retired THEN 'retired' WHEN NOT enabled THEN 'disabled' WHEN last_status = 'failed' THEN 'failing' ELSE 'active' END AS state FROM feeds LEFT JOIN lastf USING (feed_id))"""


def _feeds(spark, d):
    return A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("feed_id"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 5 != 0).alias("enabled"), (F.col("s_suppkey") % 13 == 0).alias("retired"), F.array(F.concat(F.lit("t"), (F.col("s_nationkey") % 4).cast("string")), F.lit("all")).alias("tags"))


@query("feed_list", _FEEDS + " SELECT feed_id, name, last_status, last_at, state FROM states WHERE list_contains(tags, 't1') AND contains(lower(name), 'supplier')")
def _(spark, d):
    return catalogue.list_feeds(_feeds(spark, d), A.fetches(spark, d), text="Supplier", tag="t1").select("feed_id", "name", "last_status", "last_at", "state")


@query("feed_states", _FEEDS + " SELECT state, count(*) AS n FROM states GROUP BY 1")
def _(spark, d):
    return catalogue.list_feeds(_feeds(spark, d), A.fetches(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


@query("sources_per_tag", _FEEDS + " SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM feeds WHERE NOT retired) GROUP BY 1")
def _(spark, d):
    return _feeds(spark, d).filter("NOT retired").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("unread_articles", """SELECT article_id, effective_at, false AS read, article_id % 5 = 0 AS starred FROM articles a WHERE article_id % 3 <> 0 AND EXISTS (SELECT 1 FROM members m WHERE m.article_id = a.article_id AND feed_id = 4)""")
def _(spark, d):
    a = A.articles(spark, d)
    marks = a.select("article_id", (F.col("article_id") % 3 == 0).alias("read"), (F.col("article_id") % 5 == 0).alias("starred"))
    return catalogue.list_articles(a.select("article_id", "effective_at"), A.members(spark, d), marks, feed=4, unread=True)


_ROOTS = """, ent AS (SELECT p_partkey AS entity_id, p_partkey - p_partkey % 5 AS root_id, p_name AS name FROM part)"""


def _names(spark, d):
    e = A.entities(spark, d)
    return e.select("entity_id", F.when(F.col("entity_id") % 5 != 0, F.col("entity_id") - F.col("entity_id") % 5).alias("authority_id"), "name")


@query("entity_roots", _ROOTS + """, used AS (SELECT root_id, count(DISTINCT article_id) AS articles FROM links JOIN ent USING (entity_id) GROUP BY 1),
    per AS (SELECT root_id, count(*) - 1 AS variants, max(name) FILTER (entity_id = root_id) AS name FROM ent GROUP BY 1 HAVING bool_or(contains(lower(name), 'ring'))) SELECT root_id, variants, name, coalesce(articles, 0) AS articles FROM per LEFT JOIN used USING (root_id)""")
def _(spark, d):
    return catalogue.list_roots(_names(spark, d), A.links(spark, d), "Ring")


@query("entity_lookup", _ROOTS + """, hit AS (SELECT root_id, min(name) AS name FROM ent WHERE starts_with(lower(name), 'small') AND entity_id IN (SELECT entity_id FROM links) GROUP BY 1) SELECT root_id, name FROM hit ORDER BY lower(name) <> 'small', name, root_id LIMIT 10""")
def _(spark, d):
    names = _names(spark, d).select("entity_id", F.coalesce("authority_id", "entity_id").alias("root_id"), "name")
    return catalogue.lookup(names, "small", A.links(spark, d))


@query("event_list", """, st AS (SELECT cluster_id, cluster_id % 100 AS event_id, min(effective_at) AS f, max(effective_at) AS l FROM articles GROUP BY 1), ev AS (SELECT event_id, count(*) AS stories, min(f) AS started_at, max(l) AS ended_at FROM st GROUP BY 1),
    w AS (SELECT c_custkey AS cluster_id, lower(c_mktsegment) AS t FROM customer) SELECT * FROM ev WHERE stories >= 2 AND ended_at >= TIMESTAMP '2000-01-01' AND event_id IN (SELECT event_id FROM st JOIN w USING (cluster_id) WHERE t = 'building') AND event_id IN (SELECT event_id FROM st JOIN w USING (cluster_id) WHERE t = 'machinery')""")
def _(spark, d):
    stories = A.articles(spark, d).groupBy("cluster_id").agg(F.min("effective_at").alias("f"), F.max("effective_at").alias("l")).withColumn("event_id", F.col("cluster_id") % 100)
    events = stories.groupBy("event_id").agg(F.count("*").alias("stories"), F.min("f").alias("started_at"), F.max("l").alias("ended_at"))
    titles = A.table(spark, d, "customer").select(F.col("c_custkey").alias("cluster_id"), F.array(F.lower("c_mktsegment")).alias("tokens"))
    return catalogue.list_events(events, stories, titles, ["Building", "Machinery"], first="2000-01-01", least=2)


@query("article_documents", """, e AS (SELECT article_id, string_agg(entity_id || ':' || occurrence_count, ',' ORDER BY occurrence_count DESC, entity_id) AS entities FROM links GROUP BY 1), s AS (SELECT article_id, string_agg(CAST(feed_id AS VARCHAR), ',' ORDER BY feed_id) AS sources, count(*) AS n FROM members GROUP BY 1)
    SELECT a.article_id, entities, country, sources, CAST(coalesce(n, 0) AS INT) AS distinct_source_count FROM articles a LEFT JOIN e USING (article_id) LEFT JOIN countries USING (article_id) LEFT JOIN s USING (article_id)""")
def _(spark, d):
    doc = catalogue.article_document(A.articles(spark, d), A.links(spark, d), A.entities(spark, d), A.countries(spark, d), A.members(spark, d))
    return doc.select("article_id", F.array_join(F.transform("entities", lambda x: F.concat(x["entity_id"].cast("string"), F.lit(":"), x["count"].cast("string"))), ",").alias("entities"), F.get("countries", F.lit(0)).alias("country"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), "distinct_source_count")


@query("changed_members", "SELECT article_id, cluster_id AS old, cluster_id + 1 AS new FROM articles WHERE article_id % 4 = 0")
def _(spark, d):
    a = A.articles(spark, d)
    return catalogue.changed_members(a, a.withColumn("cluster_id", F.when(F.col("article_id") % 4 == 0, F.col("cluster_id") + 1).otherwise(F.col("cluster_id"))))


@query("changed_members_whole", "SELECT article_id, cluster_id AS old, CAST(CASE WHEN article_id % 9 <> 0 THEN cluster_id + 1 END AS VARCHAR) AS new FROM articles WHERE article_id % 9 = 0 OR article_id % 4 = 0")
def _(spark, d):
    a = A.articles(spark, d)
    return catalogue.changed_members(a, a.filter("article_id % 9 <> 0").withColumn("cluster_id", F.when(F.col("article_id") % 4 == 0, F.col("cluster_id") + 1).otherwise(F.col("cluster_id")))).withColumn("new", F.col("new").cast("string"))


@query("story_sources", """, own AS (SELECT cluster_id, feed_id, min(effective_at) AS seen FROM members GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seen, feed_id) AS rank, min(seen) OVER (PARTITION BY cluster_id) AS start FROM own)
    SELECT cluster_id, feed_id, rank, (epoch(seen) - epoch(start)) / 60.0 AS minutes_behind FROM r WHERE rank <= 100""")
def _(spark, d):
    return catalogue.story_sources(A.members(spark, d))


@query("event_choice", """, s AS (SELECT l_orderkey AS target, l_suppkey AS other, max(l_discount) * 10 AS score, min(l_linenumber) AS gap FROM lineitem GROUP BY 1, 2), c AS (SELECT o_orderkey AS target, o_custkey % 50 AS own FROM orders)
    SELECT target, other FROM s LEFT JOIN c USING (target) WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY target ORDER BY coalesce(other <> own, true), score DESC, gap, other) = 1""")
def _(spark, d):
    scored = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("target"), F.col("l_suppkey").alias("other")).agg((F.max("l_discount") * 10).alias("score"), F.min("l_linenumber").alias("gap"))
    return catalogue.choose_event(scored, A.table(spark, d, "orders").select(F.col("o_orderkey").alias("target"), (F.col("o_custkey") % 50).alias("own")))


@query("entity_relationships", "SELECT entity_id, count(DISTINCT article_id) AS articles FROM links WHERE entity_id <> 7 AND article_id IN (SELECT article_id FROM links WHERE entity_id = 7) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return catalogue.relationships(A.links(spark, d), 7)


@query("relation_problems", """, r AS (SELECT o_orderkey AS relation_id, o_custkey AS a, (o_custkey * 3) % 200 AS b, CASE o_orderkey % 3 WHEN 0 THEN 'related_to' WHEN 1 THEN 'other' ELSE 'part_of' END AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'n' END AS note,
        CASE WHEN o_orderkey % 5 = 0 THEN '2010-13' ELSE '2010' END AS start, CASE WHEN o_orderkey % 7 = 0 THEN '2009-05' ELSE '2011' END AS stop FROM orders),
    f AS (SELECT *, CASE WHEN label = 'related_to' THEN least(a, b) ELSE a END AS x, CASE WHEN label = 'related_to' THEN greatest(a, b) ELSE b END AS y FROM r)
    SELECT relation_id, CASE WHEN a = b THEN 'self' WHEN a >= 1000 OR b >= 1000 THEN 'unknown' WHEN label = 'other' AND note IS NULL THEN 'missing_note' WHEN start = '2010-13' THEN 'bad_date' WHEN left(stop, 4) < left(start, 4) THEN 'out_of_order' WHEN relation_id <> min(relation_id) OVER (PARTITION BY x, y, label) THEN 'duplicate' END AS problem FROM f""")
def _(spark, d):
    o = A.table(spark, d, "orders")
    key = F.col("o_orderkey")
    r = o.select(key.alias("relation_id"), F.col("o_custkey").alias("a"), (F.col("o_custkey") * 3 % 200).alias("b"), F.when(key % 3 == 0, "related_to").when(key % 3 == 1, "other").otherwise("part_of").alias("label"), F.when(key % 2 == 0, "n").alias("note"), F.when(key % 5 == 0, "2010-13").otherwise("2010").alias("start"), F.when(key % 7 == 0, "2009-05").otherwise("2011").alias("end"))
    return catalogue.relation_problems(r, spark.range(1000).select(F.col("id").alias("entity_id")))


@query("relation_problems_whole", """, r AS (SELECT o_orderkey AS relation_id, o_custkey AS a, (o_custkey * 3) % 200 AS b, CASE o_orderkey % 3 WHEN 0 THEN 'related_to' WHEN 1 THEN 'other' ELSE 'part_of' END AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'n' END AS note,
        CASE WHEN o_orderkey % 5 = 0 THEN '2010-13' ELSE '2010' END AS start, CASE WHEN o_orderkey % 7 = 0 THEN '2009-05' ELSE '2011' END AS stop FROM orders),
    f AS (SELECT *, CASE WHEN label = 'related_to' THEN least(a, b) ELSE a END AS x, CASE WHEN label = 'related_to' THEN greatest(a, b) ELSE b END AS y FROM r)
    SELECT relation_id, CASE WHEN a = b THEN 'self' WHEN a >= 1000 OR b >= 1000 THEN 'unknown' WHEN label = 'other' AND note IS NULL THEN 'missing_note' WHEN start = '2010-13' THEN 'bad_date' WHEN left(stop, 4) < left(start, 4) THEN 'out_of_order' WHEN relation_id <> min(relation_id) OVER (PARTITION BY x, y, label) THEN 'duplicate' END AS problem FROM f""")
def _(spark, d):
    o = A.table(spark, d, "orders")
    key = F.col("o_orderkey")
    r = o.select(key.alias("relation_id"), F.col("o_custkey").alias("a"), (F.col("o_custkey") * 3 % 200).alias("b"), F.when(key % 3 == 0, "related_to").when(key % 3 == 1, "other").otherwise("part_of").alias("label"), F.when(key % 2 == 0, "n").alias("note"), F.when(key % 5 == 0, "2010-13").otherwise("2010").alias("start"), F.when(key % 7 == 0, "2009-05").otherwise("2011").alias("end"))
    return catalogue.relation_problems(r, spark.range(1000).select(F.col("id").alias("entity_id")))


@query("split_mentions", """, r AS (SELECT l_orderkey AS article_id, l_partkey - l_partkey % 5 AS root_id, l_linenumber AS place, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS tagged FROM lineitem)
    SELECT article_id, coalesce(tagged, root_id) AS entity_id, count(*) AS occurrence_count, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS places FROM r GROUP BY 1, 2""")
def _(spark, d):
    l = A.table(spark, d, "lineitem")  # noqa: E741
    rows = l.groupBy(F.col("l_orderkey").alias("article_id"), (F.col("l_partkey") - F.col("l_partkey") % 5).alias("root_id")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("place"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("entity_id"))).alias("occurrences"))
    return catalogue.split_rows(rows).withColumn("places", F.array_join(F.transform("places", lambda x: x.cast("string")), ","))


@query("highlight_ranges", """, s AS (SELECT DISTINCT l_orderkey AS article_id, l_linenumber * 4 + l_suppkey % 7 AS start, l_linenumber * 4 + l_suppkey % 7 + 3 + l_partkey % 9 AS stop, CASE WHEN l_partkey % 3 = 0 THEN 'entity' ELSE 'keyword' END AS kind FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY CAST(kind <> 'entity' AS INT), start - stop, start) AS rank FROM s),
    fold AS (SELECT article_id, 1 AS rank, [{'start': start, 'stop': stop, 'kind': kind}] AS kept FROM r WHERE rank = 1
        UNION ALL SELECT r.article_id, r.rank::INT, CASE WHEN len(list_filter(kept, lambda k: k.start < r.stop AND r.start < k.stop)) = 0 THEN list_append(kept, {'start': r.start, 'stop': r.stop, 'kind': r.kind}) ELSE kept END FROM fold JOIN r ON r.article_id = fold.article_id AND r.rank = fold.rank + 1),
    done AS (SELECT article_id, unnest(arg_max(kept, rank)) AS k FROM fold GROUP BY 1) SELECT article_id, k.start AS start, k.stop AS stop, k.kind AS kind FROM done""")
def _(spark, d):
    at = F.col("l_linenumber") * 4 + F.col("l_suppkey") % 7
    spans = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), at.alias("start"), (at + 3 + F.col("l_partkey") % 9).alias("stop"), F.when(F.col("l_partkey") % 3 == 0, "entity").otherwise("keyword").alias("kind")).distinct()
    return catalogue.highlight_ranges(spans)
