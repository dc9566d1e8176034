"""The queries over the driver's tables and the SQL that they are held against.

A query is declared with `query(name, sql)`; `sql` starts after the archive's common tables (`archive.SQL`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import authority, clustering, compare, dossiers, events, graph, ingest, monitors, ranking, search, timelines
from ..operators.graph import _kept
from ..sources import archive as A
from ..sources import feeds
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "source_timing"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Words left out of titles and ledes.
STOP_WORDS = ["the", "and", "of", "to", "in", "a", "is", "that", "for", "it"]
AS_OF = "2001-07-01"
SINCE = "2001-06-02"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH RECURSIVE {A.SQL}\n{sql}" if not sql.lstrip().startswith(",") else f"WITH RECURSIVE {A.SQL}{sql}"
        return f

    return add


# ---------------------------------------------------------------- rankings and counts


@query("top_sources", "SELECT feed_id, count(DISTINCT article_id) AS articles FROM members GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return ranking.distinct_rank(A.members(spark, d), ["feed_id"])


@query("top_entities_window", f"SELECT entity_id, count(DISTINCT article_id) AS articles FROM links WHERE effective_at >= TIMESTAMP '{SINCE}' AND effective_at < TIMESTAMP '{AS_OF}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return ranking.distinct_rank(A.links(spark, d).filter((F.col("effective_at") >= SINCE) & (F.col("effective_at") < AS_OF)), ["entity_id"])


@query("top_countries", "SELECT country, count(DISTINCT article_id) AS articles FROM countries GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return ranking.distinct_rank(A.countries(spark, d), ["country"])


@query("entities_per_story", """, n AS (SELECT cluster_id, entity_id, count(DISTINCT article_id) AS articles FROM links GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY articles DESC, entity_id) AS rank FROM n QUALIFY rank <= 5""")
def _(spark, d):
    n = A.links(spark, d).groupBy("cluster_id", "entity_id").agg(F.count_distinct("article_id").alias("articles"))
    return ranking.top_per_group(n, ["cluster_id"], [F.desc("articles"), F.col("entity_id")], 5)


@query("first_of_story", "SELECT cluster_id, arg_min(article_id, (effective_at, article_id)) AS article_id, min(effective_at) AS effective_at FROM articles GROUP BY 1")
def _(spark, d):
    return ranking.first_per_group(A.articles(spark, d).select("cluster_id", "article_id", "effective_at"), ["cluster_id"], [F.col("effective_at"), F.col("article_id")])


@query("fetch_counts", "SELECT feed_id, count(*) FILTER (status = 'success') AS good, count(*) FILTER (status = 'failed') AS bad, count(*) FILTER (new_article_count >= 50) AS busy FROM fetches GROUP BY 1")
def _(spark, d):
    return ranking.conditional_counts(A.fetches(spark, d), ["feed_id"], good=F.col("status") == "success", bad=F.col("status") == "failed", busy=F.col("new_article_count") >= 50)


@query("modal_country", """, n AS (SELECT feed_id, country, count(DISTINCT article_id) AS n FROM members JOIN countries USING (article_id) GROUP BY 1, 2)
    SELECT feed_id, country FROM n QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY n DESC, country) = 1""")
def _(spark, d):
    return ranking.modal_value(A.members(spark, d).join(A.countries(spark, d), "article_id"), ["feed_id"], "country")


@query("article_page", "SELECT article_id, published_at FROM articles WHERE published_at < TIMESTAMP '2000-01-01' OR (published_at = TIMESTAMP '2000-01-01' AND article_id > 100) OR published_at IS NULL ORDER BY published_at DESC NULLS LAST, article_id LIMIT 51")
def _(spark, d):
    import datetime

    rows = A.articles(spark, d).select("article_id", "published_at")
    return ranking.keyset_page(rows, [("published_at", True), ("article_id", False)], [datetime.datetime(2000, 1, 1), 100], 50)


@query("top_terms", """, n AS (SELECT value, count(DISTINCT article_id) AS articles FROM (SELECT article_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)')) AS value FROM texts) GROUP BY 1),
    t AS (SELECT *, count(*) OVER () > 25 AS truncated FROM n) SELECT * FROM t ORDER BY articles DESC, value LIMIT 25""")
def _(spark, d):
    return ranking.terms(A.texts(spark, d), F.array_distinct(search.tokens(F.col("text"))), 25)


@query("fetch_percentiles", "SELECT feed_id, quantile_cont(duration_ms, 0.5) FILTER (status = 'success') AS median, quantile_cont(duration_ms, 0.9) FILTER (status = 'success') AS p90 FROM fetches GROUP BY 1")
def _(spark, d):
    return ranking.percentiles(A.fetches(spark, d), ["feed_id"], "duration_ms", F.col("status") == "success")


# ---------------------------------------------------------------- timelines


@query("ingestion_timeline", """, n AS (SELECT date_trunc('day', started_at)::TIMESTAMP AS bucket, count(*) AS n FROM fetches GROUP BY 1),
    s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM n), (SELECT max(bucket) FROM n), INTERVAL 1 DAY)) AS bucket),
    z AS (SELECT bucket, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (bucket)),
    m AS (SELECT *, avg(n) OVER w AS mean_before, count(*) OVER w = 7 AS whole FROM z WINDOW w AS (ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT bucket, n, mean_before, whole AND n > 0 AND n >= 2 * mean_before AS spike FROM m""")
def _(spark, d):
    return timelines.with_spikes(timelines.histogram(A.fetches(spark, d), "started_at", "day"))


@query("ingestion_timeline_whole", """, n AS (SELECT date_trunc('day', started_at)::TIMESTAMP AS bucket, count(*) AS n FROM fetches GROUP BY 1),
    s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM n), (SELECT max(bucket) FROM n), INTERVAL 1 DAY)) AS bucket),
    z AS (SELECT bucket, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (bucket)),
    m AS (SELECT *, avg(n) OVER w AS mean_before, count(*) OVER w = 7 AS whole FROM z WINDOW w AS (ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT bucket, n, mean_before, whole AND n > 0 AND n >= 2 * mean_before AS spike FROM m""")
def _(spark, d):
    return timelines.with_spikes(timelines.histogram(A.fetches(spark, d), "started_at", "day"))


@query("story_timeline", """, n AS (SELECT cluster_id, date_trunc('month', effective_at)::TIMESTAMP AS bucket, count(*) AS n FROM articles GROUP BY 1, 2),
    s AS (SELECT cluster_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 MONTH)) AS bucket FROM n GROUP BY 1)
    SELECT cluster_id, bucket, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (cluster_id, bucket)""")
def _(spark, d):
    return timelines.histogram(A.articles(spark, d), "effective_at", "month", ["cluster_id"])


@query("archive_timeline", """, n AS (SELECT date_trunc('month', effective_at)::TIMESTAMP AS bucket, count(*) AS n FROM articles GROUP BY 1),
    s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM n), (SELECT max(bucket) FROM n), INTERVAL 1 MONTH)) AS bucket) SELECT bucket, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (bucket)""")
def _(spark, d):
    rows = A.articles(spark, d)
    return timelines.histogram(rows, "effective_at", timelines.choose_interval(rows, "effective_at"))


@query("rising_sources", f""", r AS (SELECT DISTINCT feed_id, article_id, effective_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 MONTH AS recent FROM members WHERE effective_at > TIMESTAMP '{AS_OF}' - INTERVAL 8 MONTH AND effective_at <= TIMESTAMP '{AS_OF}'),
    n AS (SELECT feed_id, count(*) FILTER (recent) AS today, count(*) FILTER (NOT recent) AS "before" FROM r GROUP BY 1),
    t AS (SELECT * FROM n WHERE today >= 3 ORDER BY today DESC, feed_id LIMIT 50)
    SELECT *, "before" / 7 AS mean_before, today / ("before" / 7 + 1) AS ratio FROM t WHERE today >= 1.2 * "before" / 7 ORDER BY ratio DESC, feed_id LIMIT 10""")
def _(spark, d):
    return timelines.rising(A.members(spark, d), ["feed_id"], "effective_at", AS_OF, factor=1.2, unit="month")


# ---------------------------------------------------------------- comparison


@query("compare_articles", """, s AS (SELECT article_id, bool_or(feed_id = 3) AS in_a, bool_or(feed_id = 7) AS in_b FROM members WHERE feed_id IN (3, 7) GROUP BY 1),
    n AS (SELECT count(*) FILTER (in_a AND NOT in_b) AS only_a, count(*) FILTER (in_a AND in_b) AS "both", count(*) FILTER (in_b AND NOT in_a) AS only_b, count(*) AS "union" FROM s)
    SELECT *, CASE WHEN "union" > 0 THEN round("both" / "union", 4) END AS jaccard FROM n""")
def _(spark, d):
    return compare.overlap(A.members(spark, d), "feed_id", 3, 7, "article_id")


@query("compare_stories", """, s AS (SELECT cluster_id, bool_or(feed_id = 3) AS in_a, bool_or(feed_id = 7) AS in_b FROM members WHERE feed_id IN (3, 7) GROUP BY 1),
    n AS (SELECT count(*) FILTER (in_a AND NOT in_b) AS only_a, count(*) FILTER (in_a AND in_b) AS "both", count(*) FILTER (in_b AND NOT in_a) AS only_b, count(*) AS "union" FROM s)
    SELECT *, CASE WHEN "union" > 0 THEN round("both" / "union", 4) END AS jaccard FROM n""")
def _(spark, d):
    return compare.overlap(A.members(spark, d), "feed_id", 3, 7, "cluster_id")


@query("compare_only_a", "SELECT DISTINCT cluster_id FROM members WHERE feed_id = 3 AND cluster_id NOT IN (SELECT cluster_id FROM members WHERE feed_id = 7)")
def _(spark, d):
    return compare.part(A.members(spark, d), "feed_id", 3, 7, "cluster_id", "only_a")


@query("compare_related", """, s AS (SELECT article_id, bool_or(feed_id = 3) AS in_a, bool_or(feed_id = 7) AS in_b FROM members WHERE feed_id IN (3, 7) GROUP BY 1)
    SELECT entity_id, count(*) FILTER (in_a) AS a, count(*) FILTER (in_b) AS b FROM links JOIN s USING (article_id) GROUP BY 1 ORDER BY a + b DESC, entity_id LIMIT 10""")
def _(spark, d):
    return compare.related(A.members(spark, d), A.links(spark, d), "feed_id", 3, 7, "entity_id")


@query("compare_timelines", """, days AS (SELECT unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2000-03-31', INTERVAL 1 DAY)) AS day),
    r AS (SELECT DISTINCT feed_id, article_id, date_trunc('day', effective_at)::TIMESTAMP AS day FROM members WHERE feed_id IN (3, 7)),
    n AS (SELECT day, count(*) FILTER (feed_id = 3) AS a, count(*) FILTER (feed_id = 7) AS b FROM r GROUP BY 1) SELECT day, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM days LEFT JOIN n USING (day)""")
def _(spark, d):
    return compare.timelines(A.members(spark, d), "feed_id", 3, 7, "effective_at", "2000-01-01", "2000-03-31")


# ---------------------------------------------------------------- graph

_NODES = """, nodes AS (SELECT feed_id, count(DISTINCT article_id) AS articles FROM members GROUP BY 1 ORDER BY feed_id = 5 DESC, articles DESC, feed_id LIMIT 50)"""


@query("graph_nodes", _NODES + " SELECT * FROM nodes")
def _(spark, d):
    return graph.nodes(A.members(spark, d), "feed_id", 50, focus=5)


@query("graph_edges", _NODES + f""", r AS (SELECT DISTINCT article_id, feed_id, effective_at FROM members JOIN nodes USING (feed_id)),
    p AS (SELECT x.feed_id AS a, y.feed_id AS b, count(*) AS weight, count(*) FILTER (x.effective_at >= TIMESTAMP '{SINCE}') AS recent FROM r x JOIN r y ON x.article_id = y.article_id AND x.feed_id < y.feed_id GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT a, b, weight, recent, round(weight / (m.articles + n.articles - weight), 4) AS score, recent = weight AS is_new FROM p JOIN nodes m ON m.feed_id = a JOIN nodes n ON n.feed_id = b ORDER BY a = 5 OR b = 5 DESC, score DESC, weight DESC, a, b LIMIT 150""")
def _(spark, d):
    rows = A.members(spark, d)
    return graph.edges(rows, graph.nodes(rows, "feed_id", 50, focus=5), "feed_id", pinned=5, at="effective_at", recent_since=SINCE)


@query("graph_expand", """, s AS (SELECT DISTINCT article_id, feed_id AS start FROM members WHERE feed_id IN (1, 2)),
    n AS (SELECT start, feed_id, count(*) AS weight FROM s JOIN (SELECT DISTINCT article_id, feed_id FROM members) USING (article_id) WHERE feed_id NOT IN (1, 2, 3) GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY start ORDER BY weight DESC, feed_id) AS rank FROM n QUALIFY rank <= 8""")
def _(spark, d):
    return graph.expand(A.members(spark, d), "feed_id", [1, 2], [3])


@query("graph_evidence", """, b AS (SELECT article_id, max(effective_at) AS seen, max(cluster_id) AS c FROM members WHERE feed_id IN (1, 2) GROUP BY 1 HAVING count(DISTINCT feed_id) = 2)
    SELECT count(*) AS total, min(seen) AS first, max(seen) AS last, count(DISTINCT c) AS stories FROM b""")
def _(spark, d):
    return graph.evidence(A.members(spark, d), "feed_id", 1, 2, "effective_at", "cluster_id")


def _rounds(n: int) -> str:
    """The SQL of `n` rounds of label propagation, one table a round."""
    out = """, e AS (SELECT a, b, weight AS vote FROM edges UNION ALL SELECT b, a, weight FROM edges),
        l0 AS MATERIALIZED (SELECT node, number, number AS label FROM (SELECT a AS node, row_number() OVER (ORDER BY sum(vote) DESC, a) AS number FROM e GROUP BY a))"""
    for i in range(n):
        out += f""", v{i} AS (SELECT e.a, l.label, sum(vote) AS w FROM e JOIN l{i} l ON l.node = e.b GROUP BY 1, 2), b{i} AS (SELECT a, arg_min(label, (-w, label)) AS next FROM v{i} GROUP BY 1),
        l{i + 1} AS MATERIALIZED (SELECT node, number, CASE WHEN number % 2 = {i % 2} THEN next ELSE label END AS label FROM l{i} JOIN b{i} ON a = node)"""
    return out + f" SELECT x.node, y.node AS label FROM l{n} x JOIN l0 y ON y.number = x.label"


_DRAWN = """, nodes AS (SELECT feed_id, count(DISTINCT article_id) AS articles FROM members GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50), r AS (SELECT DISTINCT article_id, feed_id FROM members JOIN nodes USING (feed_id)),
    p AS (SELECT x.feed_id AS a, y.feed_id AS b, count(*) AS weight FROM r x JOIN r y ON x.article_id = y.article_id AND x.feed_id < y.feed_id GROUP BY 1, 2 HAVING count(*) >= 2),
    edges AS (SELECT a, b, weight, round(weight / (m.articles + n.articles - weight), 4) AS score FROM p JOIN nodes m ON m.feed_id = a JOIN nodes n ON n.feed_id = b ORDER BY score DESC, weight DESC, a, b LIMIT 150)"""


@query("graph_communities", _DRAWN + _rounds(20))
def _(spark, d):
    rows = A.members(spark, d)
    return graph.communities(graph.edges(rows, graph.nodes(rows, "feed_id", 50), "feed_id"))


# ---------------------------------------------------------------- stories and events


@query("story_statistics", """SELECT cluster_id, count(DISTINCT article_id) AS articles, count(DISTINCT feed_id) AS sources, min(effective_at) AS first, max(effective_at) AS last, arg_min(article_id, (effective_at, article_id)) AS representative
    FROM members GROUP BY 1 HAVING count(DISTINCT article_id) >= 2""")
def _(spark, d):
    return clustering.statistics(A.members(spark, d))


_PAIRS = """, met AS (SELECT x.article_id AS target, y.article_id AS other, count(DISTINCT x.entity_id) AS n, any_value(abs(epoch(x.effective_at) - epoch(y.effective_at))) AS apart
        FROM links x JOIN links y ON x.entity_id = y.entity_id AND x.article_id <> y.article_id AND abs(epoch(x.effective_at) - epoch(y.effective_at)) <= 172800 GROUP BY 1, 2),
    titled AS (SELECT x.article_id AS target, y.article_id AS other, abs(epoch(x.effective_at) - epoch(y.effective_at)) AS apart FROM articles x JOIN articles y ON x.cluster_id = y.cluster_id AND x.article_id <> y.article_id AND abs(epoch(x.effective_at) - epoch(y.effective_at)) <= 172800),
    pairs AS (SELECT target, other FROM (SELECT target, other, apart FROM met WHERE n >= 2 UNION SELECT target, other, apart FROM titled) QUALIFY row_number() OVER (PARTITION BY target ORDER BY apart, other) <= 200)"""


def _candidates(spark, d):
    titles = A.articles(spark, d).withColumn("title_hash", C.title_hash(F.col("cluster_id").cast("string")))
    return clustering.candidates_by_rule(A.links(spark, d), titles)


@query("story_candidates", _PAIRS + " SELECT * FROM pairs")
def _(spark, d):
    return _candidates(spark, d)


def _features(spark, d):
    sets = A.links(spark, d).groupBy("article_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
    rows = A.articles(spark, d).select("article_id", "effective_at", C.title_tokens(F.concat_ws(" ", "language", F.col("cluster_id").cast("string")), STOP_WORDS).alias("tokens"))
    return rows.join(sets, "article_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<long>")))


@query("story_matches", _PAIRS + """, f AS (SELECT a.article_id, effective_at, list_distinct(regexp_extract_all(lower(language || ' ' || cluster_id), '[0-9a-z]+')) AS tokens, coalesce(e, []) AS ents FROM articles a LEFT JOIN (SELECT article_id, list(DISTINCT entity_id) AS e FROM links GROUP BY 1) l USING (article_id)),
    g AS (SELECT article_id, effective_at, list_filter(tokens, lambda x: x NOT IN ('the', 'and', 'of', 'to', 'in', 'a', 'is', 'that', 'for', 'it')) AS tokens, ents FROM f),
    s AS (SELECT target, other, 0.5 * CASE WHEN len(x.tokens) > 0 AND len(y.tokens) > 0 THEN len(list_intersect(x.tokens, y.tokens)) / (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens))) ELSE 0 END
        + 0.35 * CASE WHEN len(x.ents) > 0 AND len(y.ents) > 0 THEN len(list_intersect(x.ents, y.ents)) / (len(x.ents) + len(y.ents) - len(list_intersect(x.ents, y.ents))) ELSE 0 END
        + 0.15 * greatest(0, 1 - abs(epoch(x.effective_at) - epoch(y.effective_at)) / 172800.0) AS score, abs(epoch(x.effective_at) - epoch(y.effective_at)) AS apart FROM pairs JOIN g x ON x.article_id = target JOIN g y ON y.article_id = other)
    SELECT target, other, round(score, 9) AS score FROM s WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, apart, other) = 1""")
def _(spark, d):
    scored = clustering.score(_candidates(spark, d), _features(spark, d))
    return clustering.best_match(scored.withColumn("score", F.round("score", 9)))


@query("story_components", """, e AS (SELECT x.article_id AS a, y.article_id AS b FROM articles x JOIN articles y ON x.cluster_id = y.cluster_id AND x.article_id <> y.article_id AND abs(epoch(x.effective_at) - epoch(y.effective_at)) <= 172800),
    r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY 1""")
def _(spark, d):
    titles = A.articles(spark, d).withColumn("title_hash", C.title_hash(F.col("cluster_id").cast("string")))
    return clustering.components(clustering.band_join(titles, titles, ["title_hash"]).select("target", "other"))


@query("document_frequency", """, f AS (SELECT x.article_id AS target, x.entity_id AS term, count(DISTINCT y.article_id) AS df FROM links x JOIN links y ON x.entity_id = y.entity_id AND x.article_id <> y.article_id AND abs(epoch(x.effective_at) - epoch(y.effective_at)) <= 172800 GROUP BY 1, 2)
    SELECT l.article_id AS target, l.entity_id AS term, coalesce(df, 0) + 1 AS df FROM (SELECT DISTINCT article_id, entity_id FROM links) l LEFT JOIN f ON target = article_id AND term = entity_id""")
def _(spark, d):
    rows = A.links(spark, d).withColumnRenamed("entity_id", "term")
    return clustering.document_frequency(rows, rows)


_FACTS = """, span AS (SELECT cluster_id, min(effective_at) AS first, max(effective_at) AS last, count(DISTINCT article_id) AS articles FROM members GROUP BY 1),
    own AS (SELECT DISTINCT cluster_id, article_id FROM members),
    sets AS (SELECT o.cluster_id, list_sort(list(DISTINCT feed_id)) AS entities FROM own o JOIN (SELECT article_id, feed_id FROM members) USING (article_id) GROUP BY 1),
    home AS (SELECT cluster_id, country FROM (SELECT o.cluster_id, country, count(DISTINCT article_id) AS n FROM own o JOIN countries USING (article_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, country) = 1),
    facts AS (SELECT span.*, entities, country FROM span LEFT JOIN sets USING (cluster_id) LEFT JOIN home USING (cluster_id)),
    fe AS (SELECT cluster_id, first, last, country, unnest(entities) AS entity_id FROM facts),
    cand AS (SELECT x.cluster_id AS target, y.cluster_id AS other, count(DISTINCT x.entity_id) AS shared, any_value(y.last) AS o_last FROM fe x JOIN fe y ON x.entity_id = y.entity_id AND x.cluster_id <> y.cluster_id
        AND epoch(y.first) - epoch(x.last) <= 259200 AND epoch(x.first) - epoch(y.last) <= 259200 GROUP BY 1, 2 HAVING count(DISTINCT x.entity_id) >= 2)"""


def _carriers(spark, d):
    """Feeds as the entities that stories share: the tables have no entity that two customers' orders name in the same days."""
    return A.members(spark, d).select("article_id", F.col("feed_id").alias("entity_id"))


def _facts(spark, d):
    members = _kept(A.members(spark, d).drop("discovered_at"))  # read four times
    return events.cluster_facts(members, members.select("article_id", F.col("feed_id").alias("entity_id")), A.countries(spark, d))


@query("event_story_facts", _FACTS + " SELECT cluster_id, first, last, articles, array_to_string(entities, ',') AS entities, country FROM facts")
def _(spark, d):
    return _facts(spark, d).withColumn("entities", F.array_join(F.transform("entities", lambda x: x.cast("string")), ","))


@query("entity_weights", "SELECT entity_id, count(DISTINCT article_id) AS articles, 1 / ln(exp(1) + count(DISTINCT article_id)) AS weight FROM links GROUP BY 1")
def _(spark, d):
    return events.entity_weights(A.links(spark, d))


@query("event_candidates", _FACTS + " SELECT target, other, shared FROM cand QUALIFY row_number() OVER (PARTITION BY target ORDER BY o_last DESC, other) <= 50")
def _(spark, d):
    return events.candidates(_facts(spark, d))


@query("event_scores", _FACTS + """, w AS (SELECT feed_id AS entity_id, 1 / ln(exp(1) + count(DISTINCT article_id)) AS weight FROM members GROUP BY 1), lw AS (SELECT cluster_id, entity_id, weight FROM fe JOIN w USING (entity_id)), mass AS (SELECT cluster_id, sum(weight) AS mass FROM lw GROUP BY 1),
    c50 AS (SELECT target, other FROM cand QUALIFY row_number() OVER (PARTITION BY target ORDER BY o_last DESC, other) <= 50),
    b AS (SELECT target, other, sum(x.weight) AS shared FROM c50 JOIN lw x ON x.cluster_id = target JOIN lw y ON y.cluster_id = other AND x.entity_id = y.entity_id GROUP BY 1, 2)
    SELECT target, other, round(0.25 * greatest(0, 1 - greatest(epoch(q.first) - epoch(p.last), epoch(p.first) - epoch(q.last), 0) / 259200.0) + 0.4 * shared / (m.mass + n.mass - shared) + 0.15 * CASE WHEN p.country = q.country THEN 1 ELSE 0 END, 6) AS score
    FROM b JOIN facts p ON p.cluster_id = target JOIN facts q ON q.cluster_id = other JOIN mass m ON m.cluster_id = target JOIN mass n ON n.cluster_id = other""")
def _(spark, d):
    facts = _kept(_facts(spark, d))
    return events.score(events.candidates(facts), facts, events.entity_weights(_carriers(spark, d)))


@query("event_days", """, m AS (SELECT *, cluster_id % 100 AS event_id, date_trunc('day', effective_at)::TIMESTAMP AS day FROM members),
    st AS (SELECT event_id, day, count(*) AS started FROM (SELECT event_id, cluster_id, min(day) AS day FROM m GROUP BY 1, 2) GROUP BY 1, 2)
    SELECT event_id, day, articles, sources, coalesce(started, 0) AS started FROM (SELECT event_id, day, count(DISTINCT article_id) AS articles, count(DISTINCT feed_id) AS sources FROM m GROUP BY 1, 2) LEFT JOIN st USING (event_id, day)""")
def _(spark, d):
    return events.day_by_day(A.members(spark, d).withColumn("event_id", F.col("cluster_id") % 100))[0]


@query("event_evidence", """, m AS (SELECT DISTINCT cluster_id % 100 AS event_id, date_trunc('day', effective_at)::TIMESTAMP AS day, article_id, effective_at FROM members)
    SELECT *, row_number() OVER (PARTITION BY event_id, day ORDER BY effective_at, article_id) AS rank FROM m QUALIFY rank <= 3""")
def _(spark, d):
    return events.day_by_day(A.members(spark, d).withColumn("event_id", F.col("cluster_id") % 100))[1]


_STORIES = """, stories AS (SELECT cluster_id, cluster_id % 100 AS event_id, count(DISTINCT article_id) AS articles, min(effective_at) AS first, max(effective_at) AS last FROM members GROUP BY 1)"""


def _event_summary(spark, d):
    m = A.members(spark, d)
    stories = clustering.statistics(m).withColumn("event_id", F.col("cluster_id") % 100)
    return events.summaries(stories, m, A.links(spark, d))


@query("event_summaries", _STORIES + """ SELECT event_id, count(*) AS stories, CAST(sum(articles) AS BIGINT) AS articles, min(first) AS started_at, max(last) AS ended_at, arg_min(cluster_id, (-articles, first, cluster_id)) AS headline FROM stories WHERE articles >= 2 GROUP BY 1""")
def _(spark, d):
    return _event_summary(spark, d)[0]


@query("event_entities", _STORIES + """, n AS (SELECT event_id, entity_id, count(DISTINCT l.article_id) AS articles FROM stories s JOIN links l USING (cluster_id) WHERE articles >= 2 GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY articles DESC, entity_id) AS rank FROM n QUALIFY rank <= 5""")
def _(spark, d):
    return _event_summary(spark, d)[1]


@query("event_status", _STORIES + f" SELECT event_id, max(last) AS ended_at, CASE WHEN max(last) < TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR THEN 'closed' ELSE 'active' END AS status FROM stories GROUP BY 1")
def _(spark, d):
    rows = A.members(spark, d).groupBy((F.col("cluster_id") % 100).alias("event_id")).agg(F.max("effective_at").alias("ended_at"))
    return events.close_idle(rows, AS_OF)


# ---------------------------------------------------------------- search

_TOK = "regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}]+)')"


@query("search_bm25", f""", t AS (SELECT article_id, {_TOK.format('title')} AS a, {_TOK.format('text')} AS b FROM texts),
    r AS (SELECT article_id, len(a) + len(b) AS len, 3.0 * len(list_filter(a, lambda x: x = 'the')) + len(list_filter(b, lambda x: x = 'the')) AS tf0, 3.0 * len(list_filter(a, lambda x: x = 'with')) + len(list_filter(b, lambda x: x = 'with')) AS tf1 FROM t),
    s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM r)
    SELECT article_id, round(ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * len / mean)) + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score FROM r, s WHERE tf0 > 0 AND tf1 > 0""")
def _(spark, d):
    return search.bm25(A.texts(spark, d), ["the", "with"], {"title": 3.0, "text": 1.0})


@query("search_phrase", f"SELECT article_id FROM texts WHERE contains(' ' || array_to_string({_TOK.format('text')}, ' ') || ' ', ' of the ')")
def _(spark, d):
    return A.texts(spark, d).filter(search.phrase(F.col("text"), ["of", "the"])).select("article_id")


@query("search_facets", f""", v AS (SELECT article_id, 'language' AS facet, language AS value FROM texts UNION ALL SELECT article_id, 'source', source FROM texts UNION ALL SELECT article_id, 'word', unnest(list_distinct({_TOK.format('title')})) FROM texts),
    n AS (SELECT facet, value, count(DISTINCT article_id) AS articles FROM v GROUP BY 1, 2), t AS (SELECT facet, count(*) AS total FROM n GROUP BY 1)
    SELECT facet, value, articles, total, total > 25 AS truncated FROM n JOIN t USING (facet) QUALIFY row_number() OVER (PARTITION BY facet ORDER BY articles DESC, value) <= 25""")
def _(spark, d):
    return search.facets(A.texts(spark, d), {"language": F.array("language"), "source": F.array("source"), "word": search.tokens(F.col("title"))})


_STOP_SQL = "('" + "', '".join(STOP_WORDS) + "')"
_RELATED = f""", p AS (SELECT article_id, term, count(*)::DOUBLE AS tf FROM (SELECT article_id, unnest({_TOK.format('text')}) AS term FROM texts) WHERE term NOT IN {_STOP_SQL} GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY 1 HAVING count(*) >= 2), w AS (SELECT article_id, term, tf * ln((SELECT count(*) FROM texts) / df) AS weight FROM p JOIN df USING (term) WHERE length(term) >= 3),
    top AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY weight DESC, term) <= 25),
    met AS (SELECT t.article_id AS target, p.article_id AS other, count(*) AS shared, round(sum(t.weight), 6) AS score FROM top t JOIN p ON p.term = t.term AND p.article_id <> t.article_id WHERE t.article_id % 100 = 0 AND t.article_id // 10 <> p.article_id // 10 GROUP BY 1, 2 HAVING count(*) >= 5)"""


@query("related_articles", _RELATED + " SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, other) <= 10")
def _(spark, d):
    docs = A.texts(spark, d)
    stories = docs.select("article_id", F.floor(F.col("article_id") / 10).alias("cluster_id"))
    return search.related(search.postings(docs, {"text": 1.0}), docs.count(), docs.filter(F.col("article_id") % 100 == 0), stop_words=STOP_WORDS, stories=stories, shown=10)


@query("same_element_filter", "SELECT DISTINCT article_id FROM members JOIN supplier ON feed_id = s_suppkey WHERE s_nationkey IN (3, 4) AND feed_id % 2 = 0")
def _(spark, d):
    feed = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("feed_id"), "s_nationkey")
    docs = A.members(spark, d).join(feed, "feed_id").groupBy("article_id").agg(F.collect_list(F.struct((F.col("feed_id") % 2).alias("parity"), "s_nationkey")).alias("provenance"))
    return docs.filter(search.same_element("provenance", parity=[0], s_nationkey=[3, 4])).select("article_id")


# ---------------------------------------------------------------- dossiers and reports


@query("entity_dossiers", "SELECT entity_id, CAST(sum(occurrence_count) AS BIGINT) AS mentions, count(DISTINCT article_id) AS articles, count(DISTINCT cluster_id) AS stories, min(effective_at) AS first_seen, max(effective_at) AS last_seen FROM links GROUP BY 1")
def _(spark, d):
    return dossiers.entity_dossier(A.links(spark, d).drop("cluster_id"), A.articles(spark, d))


_POS = """, own AS (SELECT cluster_id, feed_id, arg_min(article_id, (effective_at, article_id)) AS article_id, min(effective_at) AS effective_at FROM members GROUP BY 1, 2),
    best AS (SELECT cluster_id, min(effective_at) AS seen, arg_min(article_id, (effective_at, article_id)) AS first_id FROM own GROUP BY 1 HAVING count(*) >= 2),
    pos AS (SELECT cluster_id, feed_id, article_id, article_id = first_id AS is_first, (epoch(effective_at) - epoch(seen)) / 60.0 AS minutes FROM own JOIN best USING (cluster_id))"""


@query("source_positions", _POS + " SELECT * FROM pos")
def _(spark, d):
    return dossiers.source_positions(A.members(spark, d))


@query("source_timing", _POS + " SELECT feed_id, count(*) AS stories, count(*) FILTER (is_first) AS first, quantile_cont(minutes, 0.5) FILTER (NOT is_first) AS median, quantile_cont(minutes, 0.9) FILTER (NOT is_first) AS p90 FROM pos GROUP BY 1")
def _(spark, d):
    return dossiers.source_timing(dossiers.source_positions(A.members(spark, d)))


_STREAK = """, r AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY started_at DESC, fetch_id DESC) AS rn FROM fetches QUALIFY rn <= 20),
    streak AS (SELECT feed_id, CAST(coalesce(min(rn) FILTER (status = 'success') - 1, count(*)) AS BIGINT) AS streak, min(rn) FILTER (status = 'success') IS NULL AS capped FROM r GROUP BY 1)"""


@query("failure_streaks", _STREAK + " SELECT * FROM streak")
def _(spark, d):
    return dossiers.failure_streaks(A.fetches(spark, d))


@query("failures_since_success", """, g AS (SELECT feed_id, max(started_at) FILTER (status = 'success') AS good FROM fetches GROUP BY 1)
    SELECT feed_id, count(*) FILTER (status = 'failed' AND (good IS NULL OR started_at > good)) AS failures FROM fetches JOIN g USING (feed_id) GROUP BY 1""")
def _(spark, d):
    return dossiers.failures_since_success(A.fetches(spark, d))


@query("feed_health", _STREAK + """, n AS (SELECT feed_id, count(*) AS fetches, count(*) FILTER (status = 'failed') AS failed, CAST(sum(new_article_count) AS BIGINT) AS new_articles, max(started_at) AS last_at FROM fetches GROUP BY 1),
    o AS (SELECT n.*, streak, capped, CAST(greatest(0, CAST(floor(epoch(TIMESTAMP '2024-01-31')) AS BIGINT) - CAST(floor(epoch(last_at)) AS BIGINT) - 3600) AS BIGINT) AS overdue_s FROM n JOIN streak USING (feed_id))
    SELECT *, CASE WHEN streak >= 3 THEN 'failing' WHEN overdue_s > 0 THEN 'overdue' ELSE 'ok' END AS state FROM o""")
def _(spark, d):
    return dossiers.feed_health(A.fetches(spark, d), "2024-01-31")


@query("failure_report", """, b AS (SELECT *, row_number() OVER (PARTITION BY error_category ORDER BY started_at DESC, fetch_id DESC) AS rank, count(*) OVER (PARTITION BY error_category) AS n FROM fetches WHERE status = 'failed')
    SELECT error_category, n, rank, fetch_id, started_at FROM b WHERE rank <= 5""")
def _(spark, d):
    return dossiers.failures(A.fetches(spark, d))


# ---------------------------------------------------------------- ingestion and text


_URLS = rf""", un AS (SELECT page_id AS seq, html, trim(url) AS u FROM pages),
    up AS (SELECT seq, html, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(u, '^[^:]+://([^/?#:]*)', 1)) AS host, regexp_extract(u, '^[^:]+://[^/?#]*:(\d+)(?:[/?#]|$)', 1) AS port, regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ({", ".join(f"'{t}'" for t in C.TRACKING)}))), '&') AS query FROM un),
    nu AS (SELECT seq, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS normalized_url
        FROM up WHERE scheme IN ('http', 'https') AND host <> '')"""


@query("article_dedup", _URLS + " SELECT normalized_url, min(seq) AS article_id, TIMESTAMP '2024-01-01' + to_hours(min(seq)) AS published_at, arg_max(title, seq) AS title, count(*) AS entries FROM nu GROUP BY 1")
def _(spark, d):
    rows = A.entries(spark, d).withColumn("normalized_url", C.normalize_url(F.col("url")))
    return ingest.dedup_articles(rows.filter("normalized_url IS NOT NULL"))


@query("title_hashes", "SELECT article_id, sha256(lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))) AS title_hash FROM texts")
def _(spark, d):
    return A.texts(spark, d).select("article_id", C.title_hash(F.col("title")).alias("title_hash"))


@query("page_links", """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def _(spark, d):
    return feeds.page_links(A.table(spark, d, "pages"))


@query("content_changes", """, o AS (SELECT doc_id AS article_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 2 = 0)
    SELECT t.article_id, sha256(CASE WHEN t.article_id % 4 = 0 THEN text || '!' ELSE text END) AS content_hash, CASE WHEN t.article_id % 4 = 0 THEN h END AS previous_content_hash, CASE WHEN t.article_id % 4 = 0 THEN 1 ELSE 0 END AS change_count FROM texts t LEFT JOIN o USING (article_id)""")
def _(spark, d):
    t = A.texts(spark, d)
    at = F.lit("2024-02-01").cast("timestamp")
    new = t.select("article_id", F.when(F.col("article_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), at.alias("extracted_at"))
    old = t.filter(F.col("article_id") % 2 == 0).select("article_id", F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("string").alias("previous_content_hash"), F.lit(0).alias("change_count"), at.alias("last_content_change_at"))
    return ingest.track_content(new, old).drop("last_content_change_at")


@query("newest_revisions", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def _(spark, d):
    return ingest.newest_revision(A.table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], F.struct("ts", "event_id"))


@query("title_tokens", "SELECT article_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(title), '([0-9a-z]+)')), lambda x: x NOT IN ('the', 'and', 'of', 'to', 'in', 'a', 'is', 'that', 'for', 'it'))), ' ') AS tokens FROM texts")
def _(spark, d):
    return A.texts(spark, d).select("article_id", F.array_join(C.title_tokens(F.col("title"), STOP_WORDS), " ").alias("tokens"))


def _stem_sql(w: str) -> str:
    """The three steps of `columns.stem` on the column `w`, as nested selects give it (a: without a plural, b: without a suffix)."""
    bare = lambda x: f"CASE WHEN right({x}, 1) = left(right({x}, 2), 1) AND length({x}) > 1 AND right({x}, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN left({x}, -1) ELSE {x} END"
    plural = f"CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, -3) || 'y' WHEN {w} LIKE '%sses' THEN left({w}, -2) WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us|is)$') AND length({w}) > 3 THEN left({w}, -1) ELSE {w} END"
    suffix = f"CASE WHEN a LIKE '%ing' AND length(a) > 5 THEN {bare('left(a, -3)')} WHEN a LIKE '%ed' AND length(a) > 4 THEN {bare('left(a, -2)')} ELSE a END"
    return f"SELECT article_id, CASE WHEN b LIKE '%e' AND length(b) > 3 THEN left(b, -1) ELSE b END AS term FROM (SELECT article_id, {suffix} AS b FROM (SELECT article_id, {plural} AS a FROM lw))"


@query("lede_terms", rf""", lw AS (SELECT article_id, unnest(list_filter(regexp_extract_all(lower(text), '(\p{{L}}+)')[1:80], lambda w: length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS w FROM texts), st AS ({_stem_sql("w")})
    SELECT article_id, coalesce(terms, '') AS terms FROM texts LEFT JOIN (SELECT article_id, array_to_string(list_sort(list(DISTINCT left(term, 64))), ' ') AS terms FROM st GROUP BY 1) USING (article_id)""")
def _(spark, d):
    return A.texts(spark, d).select("article_id", F.array_join(C.lede_terms(F.col("text"), STOP_WORDS), " ").alias("terms"))


@query("stale_annotations", "SELECT article_id, processor FROM texts, (VALUES ('language'), ('keywords')) p(processor) WHERE NOT (processor = 'language' AND article_id % 3 = 0)")
def _(spark, d):
    docs = A.texts(spark, d).select("article_id", F.sha2("text", 256).alias("fingerprint"))
    ran = docs.filter(F.col("article_id") % 3 == 0).select("article_id", F.lit("language").alias("processor"), "fingerprint", F.lit("1").alias("version"))
    return ingest.stale(docs, ran, spark.createDataFrame([("language", "1"), ("keywords", "1")], "processor string, version string"))


# ---------------------------------------------------------------- watches, authority and streams

_MATCH = """, mon AS (SELECT n_nationkey AS monitor_id, CASE WHEN n_nationkey % 5 <> 0 THEN TIMESTAMP '2001-05-01' END AS cur, CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2001-03-01' END AS seen FROM nation),
    mt AS (SELECT c_nationkey AS monitor_id, article_id, cluster_id, effective_at AS enriched_at FROM articles JOIN customer ON cluster_id = c_custkey)"""


def _watch(spark, d):
    matches = A.articles(spark, d).join(A.table(spark, d, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_nationkey").alias("monitor_id")), "cluster_id").select("monitor_id", "article_id", "cluster_id", F.col("effective_at").alias("enriched_at"))
    n = F.col("n_nationkey")
    mon = A.table(spark, d, "nation").select(n.alias("monitor_id"), F.when(n % 5 != 0, F.lit("2001-05-01").cast("timestamp")).alias("eval_cursor_at"), F.when(n % 2 == 0, F.lit("2001-03-01").cast("timestamp")).alias("viewed_cursor_at"))
    return matches, mon


@query("watch_evaluation", _MATCH + f""" SELECT monitor_id, count(DISTINCT article_id) FILTER (cur IS NOT NULL AND enriched_at > coalesce(seen, cur)) AS unseen_articles, count(DISTINCT cluster_id) FILTER (cur IS NOT NULL AND enriched_at > coalesce(seen, cur)) AS unseen_stories,
    count(DISTINCT article_id) FILTER (cur IS NOT NULL AND enriched_at > cur) AS new_articles, max(enriched_at) AS latest_match_at, TIMESTAMP '{AS_OF}' AS eval_cursor_at FROM mon LEFT JOIN (SELECT * FROM mt WHERE enriched_at <= TIMESTAMP '{AS_OF}') USING (monitor_id) GROUP BY 1""")
def _(spark, d):
    return monitors.evaluate(*_watch(spark, d), AS_OF)


@query("watch_changes", _MATCH + f""", n AS (SELECT monitor_id, cluster_id, count(*) FILTER (enriched_at > TIMESTAMP '{SINCE}') AS articles, count(*) FILTER (enriched_at <= TIMESTAMP '{SINCE}') = 0 AS is_new FROM mt WHERE enriched_at <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY monitor_id ORDER BY articles DESC, cluster_id) AS rank FROM n WHERE articles > 0 QUALIFY rank <= 10""")
def _(spark, d):
    return monitors.changes(_watch(spark, d)[0], SINCE, AS_OF, "cluster_id").drop("evidence")


@query("combined_mentions", """, r AS (SELECT article_id, entity_id - entity_id % 5 AS root_id, entity_id, sum(occurrence_count) AS n FROM links GROUP BY ALL)
    SELECT article_id, root_id, CAST(sum(n) AS BIGINT) AS occurrence_count, arg_min(entity_id, (-n, entity_id <> root_id, entity_id)) AS observed_entity_id, least(1.0, sum(n) / 5.0) AS relevance FROM r GROUP BY 1, 2""")
def _(spark, d):
    e = A.entities(spark, d).select("entity_id", F.when(F.col("entity_id") % 5 != 0, F.col("entity_id") - F.col("entity_id") % 5).alias("authority_id"))
    return authority.combine_rows(A.links(spark, d), authority.roots(e))


@query("merge_problems", """, q AS (SELECT p_partkey AS source, (p_partkey * 7) % 200 AS target FROM part), e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey - p_partkey % 5 END AS root FROM part)
    SELECT source, target, CASE WHEN source = target THEN 'self' WHEN s.root IS NOT NULL THEN 'already_variant' WHEN t.root IS NOT NULL THEN 'target_is_variant' WHEN least(source, target) % 10 = 0 AND greatest(source, target) = least(source, target) + 30 THEN 'distinct' END AS problem FROM q LEFT JOIN e s ON s.id = source LEFT JOIN e t ON t.id = target""")
def _(spark, d):
    p = A.entities(spark, d).select("entity_id", F.when(F.col("entity_id") % 5 != 0, F.col("entity_id") - F.col("entity_id") % 5).alias("authority_id"))
    wanted = p.select(F.col("entity_id").alias("source"), (F.col("entity_id") * 7 % 200).alias("target"))
    return authority.merge_problems(wanted, p, p.filter(F.col("entity_id") % 10 == 0).select(F.col("entity_id").alias("a"), (F.col("entity_id") + 30).alias("b")))


@query("similar_names", r""", nm AS (SELECT p_type AS kind, p_name || ' ' || p_brand AS name, min(p_partkey) AS entity_id FROM part GROUP BY 1, 2), ws AS (SELECT entity_id, kind, '  ' || w || ' ' AS w FROM (SELECT entity_id, kind, unnest(string_split_regex(lower(name), '[^\p{L}\p{N}]+')) AS w FROM nm) WHERE w <> ''),
    gm AS MATERIALIZED (SELECT DISTINCT entity_id, kind, w[i:i + 2] AS gram FROM (SELECT entity_id, kind, w, unnest(generate_series(1, length(w) - 2)) AS i FROM ws)), n AS (SELECT entity_id, count(*) AS n FROM gm GROUP BY 1),
    bo AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS c FROM gm x JOIN gm y ON x.kind = y.kind AND x.gram = y.gram AND x.entity_id < y.entity_id GROUP BY 1, 2)
    SELECT a, b, round(c / (p.n + q.n - c), 6) AS similarity FROM bo JOIN n p ON p.entity_id = a JOIN n q ON q.entity_id = b WHERE c / (p.n + q.n - c) >= 0.8""")
def _(spark, d):
    named = A.entities(spark, d).groupBy("kind", F.concat_ws(" ", "name", "brand").alias("name")).agg(F.min("entity_id").alias("entity_id"))
    return authority.similar_names(named, 0.8)


@query("stream_daily_counts", "SELECT date_trunc('day', started_at)::TIMESTAMP AS day, status, count(*) AS n FROM fetches GROUP BY 1, 2")
def _(spark, d):
    rows = streams.read(spark, f"{d}/events.parque[t]", A.table(spark, d, "events").schema)  # a pattern reads one file and a folder of files alike
    days = streams.daily_counts(rows.withColumn("status", F.when(F.col("event_type") == "error", "failed").otherwise("success")), "ts", ["status"])
    return streams.newest_version(spark, streams.run_to_table(days, "complete"))

from . import annotation_queries, association_queries, catalogue_queries, fulltext_queries, growth_queries, list_queries, listing_queries, page_queries, relation_queries, story_queries, upkeep_queries  # noqa: E402, F401  add their queries
