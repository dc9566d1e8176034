"""Upkeep of the archive: selections for work, completeness, orphans, refreshes of events, and what is eligible for linking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clustering import components
from .graph import _kept
from .ranking import modal_value


def select_articles(articles: DataFrame, ids: list | None = None, first: str | None = None, until: str | None = None, language: str | None = None) -> DataFrame:
    """Articles by ids, discovery in [first, until) and language; only given conditions count."""
    rows = articles
    if ids is not None:
        rows = rows.filter(F.col("article_id").isin(ids))
    if first:
        rows = rows.filter(F.col("first_discovered_at") >= F.lit(first).cast("timestamp"))
    if until:
        rows = rows.filter(F.col("first_discovered_at") < F.lit(until).cast("timestamp"))
    return rows.filter(F.col("language") == language) if language else rows


def size_guard(docs: DataFrame, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected): texts over the limit fail visibly and are never cut."""
    long = F.coalesce(F.length("text") > most, F.lit(False))
    return docs.filter(~long), docs.filter(long)


def mark_enriched(articles: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """(article_id, enriched_at): complete when a step was asked for and none is queued, running or retrying; written once. A failure is an end."""
    n = jobs.groupBy("article_id").agg(F.count_if(F.col("status").isin("queued", "running", "retrying")).alias("open"))
    rows = articles.join(n, "article_id", "left")
    done = F.coalesce(F.col("open") == 0, F.lit(False))
    return rows.select("article_id", F.coalesce("enriched_at", F.when(done, F.lit(as_of).cast("timestamp"))).alias("enriched_at"))


def orphans(objects: DataFrame, used: list[DataFrame], as_of: str, days: int = 7) -> DataFrame:
    """Stored keys older than the limit that no table names. One anti-join a table: their union need not be made distinct."""
    rows = objects.filter(F.col("stored_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))
    for u in used:
        rows = rows.join(u.select("key"), "key", "left_anti")
    return rows


def latest_stop_words(revisions: DataFrame) -> DataFrame:
    """(language, word) of the newest revision of each language."""
    newest = revisions.groupBy("language").agg(F.max_by("words", "revision").alias("words"))
    return newest.select("language", F.explode("words").alias("word")).distinct()


def in_order(ids: list, rows: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows of a page's ids in the page's order."""
    place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(key))
    return rows.filter(F.col(key).isin(ids)).withColumn("place", place.cast("int")).orderBy("place")


def associate(scored: DataFrame, stories: DataFrame, least: float = 0.5) -> DataFrame:
    """(cluster_id, event_id): stories joined by scores of `least` or more form one event, named by its smallest story; others are alone.

    All stories are placed together, where the order of arrival would need one machine.
    """
    roots = components(scored.filter(F.col("score") >= least).select("target", "other"))
    return stories.select("cluster_id").join(roots.withColumnRenamed("node", "cluster_id"), "cluster_id", "left").select("cluster_id", F.coalesce("root", "cluster_id").alias("event_id"))


def refresh_events(placed: DataFrame, members: DataFrame, countries: DataFrame) -> DataFrame:
    """Span, stories, articles and the most frequent country of each event."""
    rows = members.join(placed, "cluster_id")
    n = rows.groupBy("event_id").agg(F.min("effective_at").alias("started_at"), F.max("effective_at").alias("ended_at"), F.count_distinct("cluster_id").alias("stories"), F.count_distinct("article_id").alias("articles"))
    return n.join(modal_value(rows.select("event_id", "article_id").distinct().join(countries, "article_id"), ["event_id"], "country"), "event_id", "left")


def events_by_country(events: DataFrame, first: str) -> DataFrame:
    """Events per country whose span reaches the window."""
    return events.filter((F.col("ended_at") >= F.lit(first).cast("timestamp")) & F.col("country").isNotNull()).groupBy("country").agg(F.count("*").alias("events"))


def other_names(entities: DataFrame) -> DataFrame:
    """Per root its variants' names without repeats and without its own."""
    named = entities.select(F.coalesce("authority_id", "entity_id").alias("root_id"), "entity_id", "name")
    own = named.filter("entity_id = root_id").select("root_id", F.col("name").alias("own"))
    return named.filter("entity_id <> root_id").join(own, "root_id").filter("name <> own").groupBy("root_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def stated_edges(relations: DataFrame, drawn: DataFrame) -> DataFrame:
    """Stated links with both ends drawn, one a label."""
    return relations.join(drawn.select(F.col("entity_id").alias("a")), "a", "left_semi").join(drawn.select(F.col("entity_id").alias("b")), "b", "left_semi").select("a", "b", "label").distinct()


def source_coverage(members: DataFrame, links: DataFrame, feed, k: int = 10) -> DataFrame:
    """The entities most often in a source's articles."""
    own = members.filter(F.col("feed_id") == feed).select("article_id").distinct()
    return links.join(own, "article_id", "left_semi").groupBy("entity_id").agg(F.count_distinct("article_id").alias("articles")).orderBy(F.desc("articles"), "entity_id").limit(k)


def extraction_split(articles: DataFrame, contents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Articles a feed as extracted, in progress, failed, or not extracted. `jobs`: article_id, status of the newest extraction."""
    rows = articles.join(contents.select("article_id", F.lit(True).alias("has")).distinct(), "article_id", "left").join(jobs, "article_id", "left")
    state = F.when(F.col("has"), "extracted").when(F.col("status").isin("queued", "running", "retrying"), "in_progress").when(F.col("status") == "failed", "failed").otherwise("not_extracted")
    return rows.groupBy("feed_id").agg(*[F.count_if(state == s).alias(s) for s in ("extracted", "in_progress", "failed", "not_extracted")])


def eligible_roots(entities: DataFrame, links: DataFrame, linked: DataFrame, least: int = 3, kinds: list[str] | None = None) -> DataFrame:
    """Visible roots of known kinds without a link that are in `least` articles."""
    rows = entities.filter(F.col("authority_id").isNull() & ~F.col("hidden") & (F.col("kind").isin(kinds) if kinds else F.lit(True))).join(linked.select("entity_id"), "entity_id", "left_anti")
    n = links.groupBy("entity_id").agg(F.count_distinct("article_id").alias("articles")).filter(F.col("articles") >= least)
    return rows.select("entity_id").join(n, "entity_id")


def search_names(entities: DataFrame, links: DataFrame) -> DataFrame:
    """One name a root and language: the root's own, else its most used variant's, the later in the alphabet on ties."""
    used = links.groupBy("entity_id").agg(F.count_distinct("article_id").alias("uses"))
    rows = entities.select(F.coalesce("authority_id", "entity_id").alias("root_id"), "entity_id", "language", "name").join(used, "entity_id", "left")
    best = F.struct((F.col("entity_id") == F.col("root_id")).alias("own"), F.coalesce("uses", F.lit(0)).alias("uses"), F.col("name"))
    return rows.groupBy("root_id", "language").agg(F.max_by("name", best).alias("name"))


def type_closure(classes: DataFrame, levels: int = 4) -> DataFrame:
    """(qid, ancestor): each class with its superclasses up to `levels` steps. `classes`: qid, parent."""
    seen = _kept(classes.select("qid", F.col("parent").alias("ancestor")).distinct())
    front = seen
    for _ in range(levels - 1):
        front = _kept(front.join(classes.select(F.col("qid").alias("ancestor"), "parent"), "ancestor").select("qid", F.col("parent").alias("ancestor")).distinct().join(seen, ["qid", "ancestor"], "left_anti"))
        if front.isEmpty():
            break
        seen = _kept(seen.unionByName(front))
    return seen


def dirty_clusters(clusters: DataFrame, decisions: DataFrame, version: int) -> DataFrame:
    """Stories never decided under a version, or changed since."""
    d = decisions.filter(F.col("version") == version).select("cluster_id", "decided_at")
    rows = clusters.join(d, "cluster_id", "left")
    return rows.filter(F.col("decided_at").isNull() | (F.col("updated_at") > F.col("decided_at"))).select("cluster_id")


def fetch_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("fetch_id").agg(F.count("*").alias("entries"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if("is_new").alias("new"))


def delivery_state(deliveries: DataFrame, documents: DataFrame) -> DataFrame:
    """Per status of the newest delivery of each document its number, and how many are outstanding (indexed revision behind, or failed)."""
    w = Window.partitionBy("article_id").orderBy(F.desc("delivery_id"))
    last = deliveries.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn").join(documents.select("article_id", "revision"), "article_id")
    return last.groupBy("status").agg(F.count("*").alias("n"), F.count_if((F.col("indexed_revision") < F.col("revision")) | (F.col("status") == "failed")).alias("outstanding"))
