"""Queries of lists, search documents and job reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import annotate, listing, search
from ..sources import archive as A
from .registry import AS_OF, STOP_WORDS, query

_PAGE = "SELECT DISTINCT article_id, effective_at FROM {} WHERE {} ORDER BY effective_at DESC NULLS LAST, article_id LIMIT 50"
_STORIES = "SELECT cluster_id, count(DISTINCT article_id) AS articles, max(effective_at) AS last FROM {} WHERE {} GROUP BY 1 ORDER BY last DESC NULLS LAST, cluster_id LIMIT 50"


# ---------------------------------------------------------------- lists


@query("entity_articles", _PAGE.format("links", "entity_id = 7"))
def _(spark, d):
    return listing.articles_of(A.links(spark, d), F.col("entity_id") == 7)


@query("entity_clusters", _STORIES.format("links", "entity_id = 7"))
def _(spark, d):
    return listing.stories_of(A.links(spark, d), F.col("entity_id") == 7)


@query("source_articles", _PAGE.format("members", "feed_id = 5"))
def _(spark, d):
    return listing.articles_of(A.members(spark, d), F.col("feed_id") == 5)


@query("source_clusters", _STORIES.format("members", "feed_id = 5"))
def _(spark, d):
    return listing.stories_of(A.members(spark, d), F.col("feed_id") == 5)


@query("source_fetches", "SELECT fetch_id, started_at, status, new_article_count FROM fetches WHERE feed_id = 5 ORDER BY started_at DESC, fetch_id LIMIT 50")
def _(spark, d):
    rows = A.fetches(spark, d).filter("feed_id = 5").select("fetch_id", "started_at", "status", "new_article_count")
    return listing.newest(rows, "started_at", "fetch_id")


@query("geo_story_articles", _PAGE.format("countries JOIN articles USING (article_id)", "country = (SELECT min(n_name) FROM nation)"))
def _(spark, d):
    first = A.table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return listing.articles_of(A.countries(spark, d).join(A.articles(spark, d).select("article_id", "effective_at"), "article_id"), F.col("country") == first)


@query("geo_source_articles", _PAGE.format("members JOIN supplier ON s_suppkey = feed_id", "s_nationkey = 3"))
def _(spark, d):
    home = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("feed_id"), "s_nationkey")
    return listing.articles_of(A.members(spark, d).join(home, "feed_id"), F.col("s_nationkey") == 3)


@query("story_members", """, m AS (SELECT cluster_id, article_id, max(effective_at) AS effective_at, array_to_string(list_sort(list(DISTINCT feed_id)), ',') AS feeds FROM members GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY effective_at DESC, article_id) AS place FROM m""")
def _(spark, d):
    return listing.story_members(A.members(spark, d)).withColumn("feeds", F.array_join(F.transform("feeds", lambda x: x.cast("string")), ","))


_EVENTS = """, stories AS (SELECT cluster_id, cluster_id % 100 AS event_id, min(effective_at) AS first FROM members GROUP BY 1), scores AS (SELECT c_custkey AS cluster_id, round(c_acctbal / 10000, 4) AS score FROM customer WHERE c_custkey % 3 <> 0)"""


def _event_stories(spark, d):
    """Scores are rounded to four places as SQL does, as a double times 10,000: Spark's `round` goes by the decimals of the shortest text instead."""
    stories = A.members(spark, d).groupBy("cluster_id").agg(F.min("effective_at").alias("first")).withColumn("event_id", F.col("cluster_id") % 100)
    scores = A.table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("cluster_id"), (F.round(F.col("c_acctbal") / 10000 * 10000) / 10000).alias("score"))
    return stories, scores


@query("event_clusters", _EVENTS + " SELECT stories.*, score, row_number() OVER (PARTITION BY event_id ORDER BY score DESC NULLS LAST, first, cluster_id) AS place FROM stories LEFT JOIN scores USING (cluster_id)")
def _(spark, d):
    return listing.event_stories(*_event_stories(spark, d))


@query("event_articles", _PAGE.format("members", "cluster_id % 100 = 7"))
def _(spark, d):
    return listing.articles_of(A.members(spark, d), F.col("cluster_id") % 100 == 7)


@query("source_picker", "SELECT s_suppkey AS feed_id, s_name AS name FROM supplier WHERE contains(lower(s_name), '7') ORDER BY lower(s_name), s_name")
def _(spark, d):
    return listing.pick_by_name(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("feed_id"), F.col("s_name").alias("name")), "name", "7")


# ---------------------------------------------------------------- watches and searches

_WATCH = """, mon AS (SELECT n_nationkey AS monitor_id, n_name AS name, CASE WHEN n_nationkey % 5 <> 0 THEN TIMESTAMP '2001-05-01' END AS cur, CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2001-03-01' END AS seen FROM nation),
    mt AS (SELECT c_nationkey AS monitor_id, article_id, effective_at AS enriched_at FROM articles JOIN customer ON cluster_id = c_custkey)"""


def _watches(spark, d):
    n = F.col("n_nationkey")
    mon = A.table(spark, d, "nation").select(n.alias("monitor_id"), F.col("n_name").alias("name"), F.when(n % 5 != 0, F.lit("2001-05-01").cast("timestamp")).alias("eval_cursor_at"), F.when(n % 2 == 0, F.lit("2001-03-01").cast("timestamp")).alias("viewed_cursor_at"))
    who = A.table(spark, d, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_nationkey").alias("monitor_id"))
    return mon, A.articles(spark, d).join(who, "cluster_id").select("monitor_id", "article_id", F.col("effective_at").alias("enriched_at"))


@query("monitor_results", _WATCH + f""" SELECT monitor_id, article_id, enriched_at, row_number() OVER (PARTITION BY monitor_id ORDER BY enriched_at DESC, article_id) AS place FROM mt JOIN mon USING (monitor_id)
    WHERE enriched_at <= TIMESTAMP '{AS_OF}' AND (coalesce(seen, cur) IS NULL OR enriched_at > coalesce(seen, cur))""")
def _(spark, d):
    mon, matches = _watches(spark, d)
    return listing.results(matches, mon, AS_OF)


@query("investigations", _WATCH + """, l AS (SELECT monitor_id, max(enriched_at) AS latest_match_at FROM mt GROUP BY 1), s AS (SELECT 'search' AS kind, s_suppkey AS id, s_name AS name, NULL::TIMESTAMP AS latest_match_at, CASE WHEN s_suppkey <= 12 THEN s_suppkey END AS monitor_id FROM supplier)
    SELECT kind, id, name, latest_match_at FROM s UNION ALL SELECT 'monitor', monitor_id, name, latest_match_at FROM mon LEFT JOIN l USING (monitor_id) WHERE monitor_id NOT IN (SELECT monitor_id FROM s WHERE monitor_id IS NOT NULL)""")
def _(spark, d):
    mon, matches = _watches(spark, d)
    latest = mon.select("monitor_id", "name").join(matches.groupBy("monitor_id").agg(F.max("enriched_at").alias("latest_match_at")), "monitor_id", "left")
    key = F.col("s_suppkey")
    searches = A.table(spark, d, "supplier").select(key.alias("search_id"), F.col("s_name").alias("name"), F.lit(None).cast("timestamp").alias("latest_match_at"), F.when(key <= 12, key).alias("monitor_id"))
    return listing.investigations(searches, latest)


@query("entity_uses", """, s AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'monitor' ELSE 'search' END AS kind, l_orderkey AS id, l_partkey - l_partkey % 5 AS root_id FROM lineitem)
    SELECT root_id, kind, count(DISTINCT id) AS n FROM s WHERE root_id IN (SELECT p_partkey - p_partkey % 5 FROM part) GROUP BY 1, 2""")
def _(spark, d):
    kind = F.when(F.col("l_linenumber") % 2 == 0, "monitor").otherwise("search")
    states = A.table(spark, d, "lineitem").groupBy(kind.alias("kind"), F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("entity_ids"))
    roots = A.entities(spark, d).select("entity_id", (F.col("entity_id") - F.col("entity_id") % 5).alias("root_id"))
    return listing.uses(roots, states)


@query("watch_report", """, m AS (SELECT c_custkey, c_custkey % 4 <> 0 AS enabled, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2001-07-01' - INTERVAL 1 SECOND * (c_custkey % 900) END AS evaluated_at, CASE c_custkey % 7 WHEN 1 THEN 'query' WHEN 2 THEN 'timeout' END AS error FROM customer),
    due AS (SELECT *, enabled AND (evaluated_at IS NULL OR epoch(TIMESTAMP '2001-07-01') - epoch(evaluated_at) >= 300) AS due FROM m), e AS (SELECT error, count(*) AS n FROM m WHERE error IS NOT NULL GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (enabled) AS enabled, count(*) FILTER (due) AS due, min(evaluated_at) FILTER (due) AS oldest, (SELECT string_agg(error || '=' || n, ',' ORDER BY error) FROM e) AS errors FROM due""")
def _(spark, d):
    key = F.col("c_custkey")
    at = (F.lit(AS_OF).cast("timestamp") - F.make_interval(secs=(key % 900).cast("decimal(18,6)"))).alias("evaluated_at")
    rows = A.table(spark, d, "customer").select((key % 4 != 0).alias("enabled"), F.when(key % 5 != 0, at).alias("evaluated_at"), F.when(key % 7 == 1, "query").when(key % 7 == 2, "timeout").alias("error"))
    return listing.watch_report(rows, AS_OF).withColumn("errors", F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


# ---------------------------------------------------------------- relations and changes of names

_LABELS = {"part_of": ("part of", "has part"), "related_to": ("related to", "related to"), "member_of": ("member of", "has member")}


@query("see_also", """, r AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_linenumber % 4 AS n FROM lineitem)
    SELECT DISTINCT * FROM (SELECT a AS entity_id, b AS other, CASE n WHEN 0 THEN 'part of' WHEN 1 THEN 'related to' ELSE 'member of' END AS label, n AS place FROM r WHERE n < 3 UNION ALL SELECT b, a, CASE n WHEN 0 THEN 'has part' WHEN 1 THEN 'related to' ELSE 'has member' END, n FROM r WHERE n < 3)""")
def _(spark, d):
    n = F.col("l_linenumber") % 4
    label = F.when(n == 0, "part_of").when(n == 1, "related_to").when(n == 2, "member_of").otherwise("unknown")
    return listing.see_also(A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), label.alias("label")).distinct(), _LABELS)


@query("folded_changes", """, c AS (SELECT l_partkey AS entity_id, CASE l_linenumber % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'hidden' ELSE 'status' END AS field, CASE WHEN l_linenumber % 3 = 1 THEN CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END ELSE 'v' || l_suppkey END AS value, l_orderkey * 10 + l_linenumber AS change_id FROM lineitem),
    w AS (SELECT entity_id, field, arg_max(value, (change_id, value)) AS value FROM c GROUP BY 1, 2)
    SELECT p_partkey AS entity_id, coalesce(n.value, p_name) AS name, p_type AS kind, NULL::VARCHAR AS note, h.value AS hidden, NULL::VARCHAR AS ambiguous, s.value AS status FROM part
    LEFT JOIN w n ON n.entity_id = p_partkey AND n.field = 'name' LEFT JOIN w h ON h.entity_id = p_partkey AND h.field = 'hidden' LEFT JOIN w s ON s.entity_id = p_partkey AND s.field = 'status'""")
def _(spark, d):
    n = F.col("l_linenumber") % 3
    value = F.when(n == 1, F.when(F.col("l_quantity") > 25, "true").otherwise("false")).otherwise(F.concat(F.lit("v"), F.col("l_suppkey").cast("string")))
    changes = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.when(n == 0, "name").when(n == 1, "hidden").otherwise("status").alias("field"), value.alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change_id"))
    return listing.fold_changes(A.entities(spark, d).select("entity_id", "name", "kind"), changes)


@query("affected_events", "SELECT DISTINCT cluster_id % 100 AS event_id FROM links WHERE entity_id % 50 = 3")
def _(spark, d):
    touched = A.entities(spark, d).filter("entity_id % 50 = 3")
    stories = A.articles(spark, d).select("cluster_id", (F.col("cluster_id") % 100).alias("event_id")).distinct()
    return listing.affected_events(A.links(spark, d), stories, touched)


_NAMES = """, e AS (SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'el' END AS language, lower(p_name) AS folded FROM part)"""


@query("name_claims", _NAMES + """, c AS (SELECT language, folded, min(entity_id) AS root_id FROM e WHERE entity_id % 3 = 0 GROUP BY 1, 2)
    SELECT entity_id, coalesce(root_id, entity_id) AS root_id FROM e LEFT JOIN c USING (language, folded) WHERE entity_id % 3 <> 0""")
def _(spark, d):
    e = A.entities(spark, d).select("entity_id", F.when(F.col("entity_id") % 2 == 0, "en").otherwise("el").alias("language"), F.lower("name").alias("folded"))
    claims = e.filter("entity_id % 3 = 0").groupBy("language", "folded").agg(F.min("entity_id").alias("root_id"))
    return listing.name_claims(e.filter("entity_id % 3 <> 0"), claims)


@query("country_variants", """, e AS (SELECT c_custkey AS entity_id, 'n' || (c_custkey % 40) AS folded, CASE WHEN c_custkey % 6 = 1 THEN c_custkey - 1 END AS authority_id FROM customer), r AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 99 END AS root_id FROM nation),
    s AS (SELECT n_nationkey AS code, 'n' || (n_nationkey * 2) AS folded FROM nation UNION ALL SELECT n_nationkey, 'n' || (n_nationkey + 1) FROM nation), t AS (SELECT DISTINCT authority_id FROM e WHERE authority_id IS NOT NULL)
    SELECT s.code, s.folded, root_id, CASE WHEN entity_id IS NULL THEN 'created' WHEN entity_id = root_id THEN 'own' WHEN e.authority_id = root_id THEN 'linked_before' WHEN e.authority_id IS NOT NULL THEN 'chosen' WHEN t.authority_id IS NOT NULL THEN 'used' ELSE 'linked' END AS outcome
    FROM s JOIN r USING (code) LEFT JOIN e ON e.folded = s.folded LEFT JOIN t ON t.authority_id = entity_id""")
def _(spark, d):
    key, n = F.col("c_custkey"), F.col("n_nationkey")
    e = A.table(spark, d, "customer").select(key.alias("entity_id"), F.concat(F.lit("n"), (key % 40).cast("string")).alias("folded"), F.when(key % 6 == 1, key - 1).alias("authority_id"))
    nation = A.table(spark, d, "nation")
    roots = nation.select(n.alias("code"), F.when(n % 2 == 0, n).otherwise(99).alias("root_id"))
    spelled = nation.select(n.alias("code"), F.explode(F.array(n * 2, n + 1)).alias("x")).select("code", F.concat(F.lit("n"), F.col("x").cast("string")).alias("folded"))
    return listing.seed_variants(spelled, e, roots)


@query("published_annotations", """, v AS (SELECT l_orderkey AS article_id, l_linenumber // 4 AS generation, l_partkey AS entity_id, 'label' || (l_suppkey % 3) AS label, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
    g AS (SELECT article_id, max(generation) AS generation FROM v GROUP BY 1), r AS (SELECT v.*, CASE WHEN entity_id % 4 = 0 THEN entity_id ELSE entity_id - entity_id % 4 END AS root_id FROM v JOIN g USING (article_id, generation))
    SELECT article_id, root_id, CAST(sum(n) AS BIGINT) AS occurrence_count, arg_min(label, (-n, label)) AS label, least(1.0, sum(n) / 5.0) AS relevance FROM r GROUP BY 1, 2""")
def _(spark, d):
    values = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.floor(F.col("l_linenumber") / 4).alias("generation"), F.col("l_partkey").alias("entity_id"), F.concat(F.lit("label"), (F.col("l_suppkey") % 3).cast("string")).alias("label"), F.col("l_quantity").cast("long").alias("occurrence_count"))
    roots = values.filter("entity_id % 4 <> 0").select("entity_id", (F.col("entity_id") - F.col("entity_id") % 4).alias("root_id")).distinct()
    return listing.publish(values, roots)


# ---------------------------------------------------------------- search documents


def _documents(spark, d):
    """Orders as wide search documents: sources with country and tag, entities with kind, keywords, and their own values."""
    feed = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("feed_id"), F.col("s_nationkey").alias("country"), F.concat(F.lit("t"), (F.col("s_suppkey") % 4).cast("string")).alias("tag"))
    sources = A.members(spark, d).join(feed, "feed_id").groupBy("article_id").agg(F.collect_list(F.struct("feed_id", "country", "tag")).alias("provenance"))
    kinds = A.entities(spark, d).select("entity_id", "kind")
    named = A.links(spark, d).join(kinds, "entity_id").groupBy("article_id").agg(F.collect_list(F.struct("entity_id", "kind", "occurrence_count")).alias("entities"))
    own = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), F.array("o_orderpriority").alias("keywords"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 1000).alias("available"))
    home = A.table(spark, d, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_nationkey").alias("story_country"))
    rows = A.articles(spark, d).withColumn("event_id", F.col("cluster_id") % 100).join(home, "cluster_id", "left").join(own, "article_id").join(sources, "article_id", "left").join(named, "article_id", "left")
    return rows.withColumn("mentioned_countries", F.array_distinct(F.transform("provenance", lambda x: x["country"])))


_DOCS = """, feeds AS (SELECT s_suppkey AS feed_id, s_nationkey AS country, 't' || (s_suppkey % 4) AS tag FROM supplier), prov AS (SELECT * FROM members JOIN feeds USING (feed_id)), named AS (SELECT * FROM links JOIN (SELECT p_partkey AS entity_id, p_type AS kind FROM part) USING (entity_id)),
    docs AS (SELECT a.*, a.cluster_id % 100 AS event_id, c_nationkey AS story_country, o_orderpriority AS keyword, o_orderstatus AS status, o_totalprice > 1000 AS available FROM articles a JOIN orders ON o_orderkey = article_id LEFT JOIN customer ON c_custkey = a.cluster_id)"""


@query("search_filter", _DOCS + """ SELECT article_id FROM docs x WHERE EXISTS (SELECT 1 FROM prov p WHERE p.article_id = x.article_id AND country IN (1, 2, 3, 4, 5, 6, 7, 8) AND tag IN ('t1', 't2'))
    AND EXISTS (SELECT 1 FROM named n WHERE n.article_id = x.article_id AND kind LIKE 'E%') AND effective_at >= TIMESTAMP '1996-01-01' AND effective_at < TIMESTAMP '2000-01-01' AND story_country < 20 AND available
    AND keyword IN ('1-URGENT', '2-HIGH', '5-LOW') AND EXISTS (SELECT 1 FROM prov p WHERE p.article_id = x.article_id AND country IN (3, 9))""")
def _(spark, d):
    kinds = [r[0] for r in A.entities(spark, d).select("kind").distinct().filter("kind LIKE 'E%'").collect()]  # kinds of names are few
    found = listing.search_filter(_documents(spark, d), source_countries=[*range(1, 9)], tags=["t1", "t2"], kinds=kinds, since="1996-01-01", until="2000-01-01", story_countries=[*range(20)], available=True, keywords=["1-URGENT", "2-HIGH", "5-LOW"], mentioned_countries=[3, 9])
    return found.select("article_id")


@query("search_most_sources", _DOCS + """, n AS (SELECT article_id, count(DISTINCT feed_id) AS n FROM prov GROUP BY 1) SELECT article_id FROM docs LEFT JOIN n USING (article_id) WHERE event_id = 7 ORDER BY n DESC, effective_at DESC, article_id LIMIT 30""")
def _(spark, d):
    return listing.ordered(listing.search_filter(_documents(spark, d), events=[7]), "most_sources", 30).select("article_id")


@query("search_oldest", _DOCS + " SELECT article_id FROM docs WHERE event_id = 7 AND status = 'O' ORDER BY effective_at NULLS LAST, article_id LIMIT 30")
def _(spark, d):
    return listing.ordered(listing.search_filter(_documents(spark, d), events=[7], statuses=["O"]), "oldest", 30).select("article_id")


@query("result_projection", _DOCS + """, s AS (SELECT article_id, array_to_string(list_sort(list(DISTINCT feed_id)), ',') AS sources FROM prov GROUP BY 1), e AS (SELECT article_id, string_agg(entity_id, ',' ORDER BY occurrence_count DESC, entity_id) AS entities FROM (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY occurrence_count DESC, entity_id) <= 3) GROUP BY 1)
    SELECT article_id, entities, sources, cluster_id FROM docs LEFT JOIN s USING (article_id) LEFT JOIN e USING (article_id)""")
def _(spark, d):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return listing.projection(_documents(spark, d)).withColumn("entities", join("entities")).withColumn("sources", join("sources"))


@query("search_nine_facets", _DOCS + """, v AS (SELECT article_id, 'source' AS facet, CAST(feed_id AS VARCHAR) AS value FROM prov UNION ALL SELECT article_id, 'source_country', CAST(country AS VARCHAR) FROM prov UNION ALL SELECT article_id, 'story_country', CAST(story_country AS VARCHAR) FROM docs
    UNION ALL SELECT article_id, 'mentioned_country', CAST(country AS VARCHAR) FROM prov UNION ALL SELECT article_id, 'language', language FROM docs UNION ALL SELECT article_id, 'entity', CAST(entity_id AS VARCHAR) FROM named UNION ALL SELECT article_id, 'entity_type', kind FROM named
    UNION ALL SELECT article_id, 'keyword', keyword FROM docs UNION ALL SELECT article_id, 'story', CAST(cluster_id AS VARCHAR) FROM docs),
    n AS (SELECT facet, value, count(DISTINCT article_id) AS articles FROM v GROUP BY 1, 2), t AS (SELECT facet, count(*) AS total FROM n GROUP BY 1)
    SELECT facet, value, articles, total, total > 10 AS truncated FROM n JOIN t USING (facet) QUALIFY row_number() OVER (PARTITION BY facet ORDER BY articles DESC, value) <= 10""")
def _(spark, d):
    each = lambda array, field: F.transform(array, lambda x: x[field])
    groups = {
        "source": each("provenance", "feed_id"), "source_country": each("provenance", "country"), "story_country": F.array("story_country"), "mentioned_country": F.col("mentioned_countries"), "language": F.array("language"),
        "entity": each("entities", "entity_id"), "entity_type": each("entities", "kind"), "keyword": F.col("keywords"), "story": F.array("cluster_id"),
    }
    return search.facets(_documents(spark, d), groups, 10)


@query("resolved_criteria", """, cat AS (SELECT 'entity' AS kind, p_partkey AS id, p_name AS name, p_partkey - p_partkey % 5 AS root_id FROM part UNION ALL SELECT 'source', s_suppkey, s_name, NULL FROM supplier),
    want AS (SELECT kind, lower(trim(name)) AS folded FROM cat WHERE id % 17 = 2), hit AS (SELECT cat.* FROM cat JOIN (SELECT DISTINCT * FROM want) w ON w.kind = cat.kind AND w.folded = lower(trim(name)))
    SELECT kind, id FROM hit UNION SELECT cat.kind, cat.id FROM cat JOIN hit ON hit.root_id = cat.root_id AND hit.kind = cat.kind""")
def _(spark, d):
    e = A.entities(spark, d).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), "name", (F.col("entity_id") - F.col("entity_id") % 5).alias("root_id"))
    s = A.table(spark, d, "supplier").select(F.lit("source").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("long").alias("root_id"))
    known = e.unionByName(s)
    return listing.resolve_names(known.filter("id % 17 = 2").select("kind", F.upper("name").alias("name")), known)


@query("title_overlap", r""", t AS (SELECT article_id, list_filter(list_distinct(regexp_extract_all(lower(title), '([0-9a-z]+)')), lambda x: x NOT IN ('the', 'and', 'of', 'to', 'in', 'a', 'is', 'that', 'for', 'it')) AS a FROM texts), n AS (SELECT article_id + 1 AS article_id, a AS b FROM t)
    SELECT article_id, CASE WHEN len(list_intersect(a, b)) < 4 THEN 0 ELSE least(1.0, 2.0 * len(list_intersect(a, b)) / greatest(12, least(25, len(a), len(b)))) END AS overlap FROM t JOIN n USING (article_id)""")
def _(spark, d):
    t = A.texts(spark, d).select("article_id", C.title_tokens(F.col("title"), STOP_WORDS).alias("a"))
    both = t.join(t.select((F.col("article_id") + 1).alias("article_id"), F.col("a").alias("b")), "article_id")
    weight = F.map_from_entries(F.transform(F.array_union("a", "b"), lambda x: F.struct(x, F.lit(2.0))))
    return both.select("article_id", C.term_overlap(F.col("a"), F.col("b"), weight).alias("overlap"))


# ---------------------------------------------------------------- jobs


@query("clustering_status", """, j AS (SELECT CASE event_id % 4 WHEN 0 THEN 'waiting' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS state FROM events)
    SELECT (SELECT count(*) FROM articles) AS clustered, (SELECT count(DISTINCT cluster_id) FROM articles) AS stories, count(*) FILTER (state = 'waiting') AS waiting, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed FROM j""")
def _(spark, d):
    n = F.col("event_id") % 4
    jobs = A.table(spark, d, "events").select(F.when(n == 0, "waiting").when(n == 1, "running").when(n == 2, "done").otherwise("failed").alias("state"))
    return listing.story_job_status(A.articles(spark, d), jobs)


@query("association_run", """, b AS (SELECT c_custkey AS cluster_id, c_custkey % 100 AS old FROM customer WHERE c_custkey % 11 <> 0), a AS (SELECT c_custkey AS cluster_id, (c_custkey % 100) + CASE WHEN c_custkey % 3 = 0 THEN 50 ELSE 0 END AS new FROM customer), ev AS (SELECT event_id, max(o) AS o, max(n) AS n FROM (SELECT old AS event_id, 1 AS o, 0 AS n FROM b UNION ALL SELECT new, 0, 1 FROM a) GROUP BY 1)
    SELECT count(new) AS evaluated, count(*) FILTER (old <> new) AS moved, (SELECT count(*) FROM ev WHERE o = 0) AS created, (SELECT count(*) FROM ev WHERE n = 0) AS deleted FROM b FULL JOIN a USING (cluster_id)""")
def _(spark, d):
    key = F.col("c_custkey")
    c = A.table(spark, d, "customer")
    before = c.filter("c_custkey % 11 <> 0").select(key.alias("cluster_id"), (key % 100).alias("event_id"))
    return listing.run_statistics(before, c.select(key.alias("cluster_id"), (key % 100 + F.when(key % 3 == 0, 50).otherwise(0)).alias("event_id")))


@query("link_statistics", "SELECT date_trunc('day', started_at)::TIMESTAMP AS day, coalesce(error_category, 'search') AS kind, status AS outcome, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms FROM fetches GROUP BY 1, 2, 3")
def _(spark, d):
    rows = A.fetches(spark, d).select(F.col("started_at").alias("at"), F.coalesce("error_category", F.lit("search")).alias("kind"), F.col("status").alias("outcome"), "duration_ms")
    return listing.link_statistics(rows)


_HISTORY = """, h AS (SELECT 'fetch' AS process, fetch_id AS run_id, started_at AS "at", status, coalesce(error_category, '') AS detail FROM fetches UNION ALL SELECT 'annotate', o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'running' END, o_orderpriority FROM orders)"""


def _history(spark, d):
    f = A.fetches(spark, d).select(F.lit("fetch").alias("process"), F.col("fetch_id").alias("run_id"), F.col("started_at").alias("at"), "status", F.coalesce("error_category", F.lit("")).alias("detail"))
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    o = A.table(spark, d, "orders").select(F.lit("annotate").alias("process"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("at"), status.alias("status"), F.col("o_orderpriority").alias("detail"))
    return f.unionByName(o)


@query("activity_page", _HISTORY + ''' SELECT * FROM h WHERE status = 'failed' AND contains(lower(detail), 't') ORDER BY "at" DESC, process, run_id LIMIT 50''')
def _(spark, d):
    return listing.activity(_history(spark, d), status="failed", text="T")[0]


@query("activity_counts", _HISTORY + " SELECT status, count(*) AS n FROM h WHERE process = 'annotate' GROUP BY 1")
def _(spark, d):
    return listing.activity(_history(spark, d), process="annotate", status="failed")[1]


@query("process_cards", _HISTORY + f""", c AS (SELECT process, count(*) AS runs, count(*) FILTER (status = 'failed') AS failures, max("at") AS last_at, arg_max(status, ("at", run_id)) AS last_status FROM h GROUP BY 1)
    SELECT *, CASE WHEN last_status = 'failed' THEN 'failing' WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(last_at) > 86400 THEN 'idle' ELSE 'ok' END AS state FROM c""")
def _(spark, d):
    return listing.process_cards(_history(spark, d), AS_OF)


@query("feed_profiles", """, e AS (SELECT source AS feed_id, doc_id AS entry_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id AS published_at, lang FROM documents), s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC, entry_id) <= 50),
    n AS (SELECT feed_id, lang, count(*) AS n FROM s WHERE lang IS NOT NULL GROUP BY 1, 2), l AS (SELECT feed_id, arg_min(lang, (-n, lang)) AS language FROM n GROUP BY 1) SELECT feed_id, count(*) AS entries, max(published_at) AS latest, any_value(language) AS language FROM e LEFT JOIN l USING (feed_id) GROUP BY 1""")
def _(spark, d):
    e = A.table(spark, d, "documents").select(F.col("source").alias("feed_id"), F.col("doc_id").alias("entry_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("doc_id").cast("int"))).alias("published_at"), "lang")
    return listing.feed_profile(e, F.col("lang"))


@query("approximate_stories", "SELECT feed_id, true AS close FROM members GROUP BY 1")
def _(spark, d):
    about = listing.approximate_distinct(A.members(spark, d), ["feed_id"], "cluster_id")
    exact = A.members(spark, d).groupBy("feed_id").agg(F.count_distinct("cluster_id").alias("n"))
    return about.join(exact, "feed_id").select("feed_id", (F.abs(F.col("about") - F.col("n")) <= 1 + 0.1 * F.col("n")).alias("close"))


@query("short_names", """, p AS (SELECT l_orderkey AS article_id, CASE WHEN l_linenumber % 3 = 0 THEN 'first' || (l_suppkey % 3) || ' last' || (l_partkey % 4) ELSE 'last' || (l_partkey % 4) END AS name, count(*) AS n FROM lineitem GROUP BY 1, 2),
    l AS (SELECT article_id, name AS long, n AS long_n, split_part(name, ' ', 1) AS head, split_part(name, ' ', 2) AS name FROM p WHERE contains(name, ' '))
    SELECT article_id, p.name, arg_max(long, (long_n, long)) AS target FROM p JOIN l USING (article_id, name) GROUP BY 1, 2 HAVING count(DISTINCT head) = 1""")
def _(spark, d):
    last = F.concat(F.lit("last"), (F.col("l_partkey") % 4).cast("string"))
    name = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("first"), (F.col("l_suppkey") % 3).cast("string"), F.lit(" "), last)).otherwise(last)
    people = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("article_id"), name.alias("name")).agg(F.count("*").alias("n"))
    return annotate.merge_short_names(people)
