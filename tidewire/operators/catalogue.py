"""Lists and documents: feeds, articles, events, roots, the wide search document, story summaries and what changed between two runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_per_group


def list_feeds(feeds: DataFrame, fetches: DataFrame, text: str | None = None, tag: str | None = None, status: str | None = None) -> DataFrame:
    """Feeds with their newest finished fetch; by a part of the name, a tag, or status active, failing, disabled, retired."""
    last = fetches.groupBy("feed_id").agg(F.max_by(F.struct("status", "started_at"), F.struct("started_at", "fetch_id")).alias("l")).select("feed_id", F.col("l.status").alias("last_status"), F.col("l.started_at").alias("last_at"))
    state = F.when(F.col("retired"), "retired").when(~F.col("enabled"), "disabled").when(F.col("last_status") == "failed", "failing").otherwise("active")
    rows = feeds
    if text:
        rows = rows.filter(F.lower("name").contains(text.lower()))
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    out = rows.join(last, "feed_id", "left").withColumn("state", state)
    return out.filter(F.col("state") == status) if status else out


def list_articles(articles: DataFrame, provenance: DataFrame, marks: DataFrame, feed=None, unread: bool = False, starred: bool = False) -> DataFrame:
    """Articles with read and starred marks; of one feed, unread or starred only."""
    rows = articles
    if feed is not None:
        rows = rows.join(provenance.filter(F.col("feed_id") == feed).select("article_id"), "article_id", "left_semi")
    if unread:
        rows = rows.join(marks.filter("read").select("article_id"), "article_id", "left_anti")
    if starred:
        rows = rows.join(marks.filter("starred").select("article_id"), "article_id", "left_semi")
    m = marks.select("article_id", "read", "starred")
    return rows.join(m, "article_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("read", "starred")})


def list_roots(entities: DataFrame, links: DataFrame, text: str | None = None) -> DataFrame:
    """Roots with variants, names and different articles of all their names; a text is looked for in any name."""
    named = entities.select("entity_id", F.coalesce("authority_id", "entity_id").alias("root_id"), "name")
    per = named.groupBy("root_id").agg((F.count("*") - 1).alias("variants"), F.max_by("name", F.col("entity_id") == F.col("root_id")).alias("name"), *([F.bool_or(F.lower("name").contains(text.lower())).alias("hit")] if text else []))
    used = links.select("article_id", "entity_id").join(named.select("entity_id", "root_id"), "entity_id").groupBy("root_id").agg(F.count_distinct("article_id").alias("articles"))
    rows = per.filter("hit").drop("hit") if text else per
    return rows.join(used, "root_id", "left").fillna(0, ["articles"])


def lookup(names: DataFrame, prefix: str, links: DataFrame, k: int = 10) -> DataFrame:
    """Names in use that begin with a prefix, case aside; exact ones first, then by name. `names`: entity_id, root_id, name."""
    folded = prefix.lower()
    hit = names.filter(F.lower("name").startswith(folded)).join(links.select("entity_id").distinct(), "entity_id", "left_semi")
    best = hit.groupBy("root_id").agg(F.min(F.struct((F.lower("name") != folded).alias("other"), "name")).alias("n"))
    return best.select("root_id", "n.name").orderBy(F.lower("name") != folded, "name", "root_id").limit(k)


def list_events(events: DataFrame, stories: DataFrame, titles: DataFrame, words: list[str], first: str | None = None, last: str | None = None, least: int = 1) -> DataFrame:
    """Events whose span meets [first, last], with `least` stories, and every word in the title of some story.

    `titles`: cluster_id, tokens. All words are looked for in one pass: a flag a word, combined before the shuffle.
    """
    rows = events.filter(F.col("stories") >= least)
    if first:
        rows = rows.filter(F.col("ended_at") >= F.lit(first).cast("timestamp"))
    if last:
        rows = rows.filter(F.col("started_at") <= F.lit(last).cast("timestamp"))
    if words:
        has = stories.select("event_id", "cluster_id").join(titles, "cluster_id").groupBy("event_id").agg(*[F.bool_or(F.array_contains("tokens", w.lower())).alias(f"w{i}") for i, w in enumerate(words)])
        for i in range(len(words)):
            has = has.filter(F.col(f"w{i}"))
        rows = rows.join(has.select("event_id"), "event_id", "left_semi")
    return rows


def article_document(articles: DataFrame, links: DataFrame, names: DataFrame, countries: DataFrame, provenance: DataFrame) -> DataFrame:
    """The wide document: entities most relevant first, countries, sources and their number. Each side is aggregated before it is joined."""
    e = links.join(names.select("entity_id", "name"), "entity_id").groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("occurrence_count")).alias("o"), "entity_id", "name"))), lambda x: F.struct(x["entity_id"].alias("entity_id"), x["name"].alias("name"), (-x["o"]).alias("count"))).alias("entities"))
    c = countries.groupBy("article_id").agg(F.array_sort(F.collect_set("country")).alias("countries"))
    s = provenance.groupBy("article_id").agg(F.array_sort(F.collect_set("feed_id")).alias("sources"))
    out = articles.join(e, "article_id", "left").join(c, "article_id", "left").join(s, "article_id", "left")
    return out.withColumn("distinct_source_count", F.coalesce(F.size("sources"), F.lit(0)))


def changed_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """Articles whose cluster is another one, or none, in the second of two runs."""
    o, n = old.select("article_id", F.col("cluster_id").alias("old")), new.select("article_id", F.col("cluster_id").alias("new"))
    return o.join(n, "article_id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


def story_sources(members: DataFrame, shown: int = 100) -> DataFrame:
    """Per story its sources by first report, with minutes behind the first, `shown` a story (the page's own limit)."""
    own = first_per_group(members.select("cluster_id", "feed_id", "effective_at", "article_id"), ["cluster_id", "feed_id"], [F.col("effective_at"), F.col("article_id")])
    start = own.groupBy("cluster_id").agg(F.min("effective_at").alias("start"))
    w = Window.partitionBy("cluster_id").orderBy("effective_at", "feed_id")
    return own.join(start, "cluster_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= shown).select("cluster_id", "feed_id", "rank", ((F.unix_seconds("effective_at") - F.unix_seconds("start")) / 60.0).alias("minutes_behind"))


def choose_event(scored: DataFrame, current: DataFrame, stay: float = 0.5) -> DataFrame:
    """(target, other): a story stays where its own event still scores `stay`, else goes to the best of `stay` or more, else nowhere.

    `scored`: target, other, score, gap. `current`: target, own.
    """
    rows = scored.filter(F.col("score") >= stay).join(current, "target", "left")
    key = F.struct((F.coalesce(F.col("other") != F.col("own"), F.lit(True))).alias("leaves"), (-F.col("score")).alias("s"), F.col("gap"), F.col("other"))
    return rows.groupBy("target").agg(F.min_by("other", key).alias("other"))


def relationships(links: DataFrame, entity, k: int = 10) -> DataFrame:
    """The entities most often in the same articles as one."""
    mine = links.filter(F.col("entity_id") == entity).select("article_id").distinct()
    rows = links.filter(F.col("entity_id") != entity).join(mine, "article_id", "left_semi")
    return rows.groupBy("entity_id").agg(F.count_distinct("article_id").alias("articles")).orderBy(F.desc("articles"), "entity_id").limit(k)


def relation_problems(relations: DataFrame, kinds: DataFrame, symmetric: tuple[str, ...] = ("related_to",)) -> DataFrame:
    """The first reason against each stated relation: self, unknown end, missing note, period out of order, duplicate; or null."""
    from ..functions.columns import partial_date_valid, period_ordered

    known = kinds.select("entity_id")
    flip = F.col("label").isin(*symmetric) & (F.col("a") > F.col("b"))
    rows = relations.withColumn("x", F.when(flip, F.col("b")).otherwise(F.col("a"))).withColumn("y", F.when(flip, F.col("a")).otherwise(F.col("b")))
    first = rows.groupBy("x", "y", "label").agg(F.min("relation_id").alias("kept"))
    rows = rows.join(first, ["x", "y", "label"])
    rows = rows.join(known.select(F.col("entity_id").alias("a"), F.lit(True).alias("has_a")), "a", "left").join(known.select(F.col("entity_id").alias("b"), F.lit(True).alias("has_b")), "b", "left")
    dates = lambda c: F.col(c).isNull() | partial_date_valid(F.col(c))
    why = F.when(F.col("a") == F.col("b"), "self").when(F.col("has_a").isNull() | F.col("has_b").isNull(), "unknown").when((F.col("label") == "other") & F.col("note").isNull(), "missing_note").when(~dates("start") | ~dates("end"), "bad_date").when(~period_ordered(F.col("start"), F.col("end")), "out_of_order").when(F.col("relation_id") != F.col("kept"), "duplicate")
    return rows.select("relation_id", why.alias("problem"))


def split_rows(rows: DataFrame) -> DataFrame:
    """Mentions given back to the names they were tagged with; untagged ones stay with the root. `rows`: article_id, root_id, occurrences (place, entity_id)."""
    each = rows.select("article_id", "root_id", F.explode("occurrences").alias("o"))
    return each.groupBy("article_id", F.coalesce("o.entity_id", "root_id").alias("entity_id")).agg(F.count("*").alias("occurrence_count"), F.array_sort(F.collect_list("o.place")).alias("places"))


def history(changes: DataFrame, entities: DataFrame, root) -> DataFrame:
    """Changes of a root and of its variants, oldest first."""
    ids = entities.filter((F.col("entity_id") == root) | (F.col("authority_id") == root)).select("entity_id")
    return changes.join(ids, "entity_id", "left_semi").orderBy("at", "change_id")


def without_overlaps(spans: DataFrame, key: list[str], order: Callable[[Column], Column]) -> DataFrame:
    """Per key the spans (start, stop, …) that overlap none taken before them, taken in `order` (least first).

    A key's spans are bounded by its text; they are folded over in one array, as each choice depends on those before.
    """
    rest = [c for c in spans.columns if c not in key]
    one = F.struct(*rest)
    listed = spans.select(*key, one.alias("s")).select(*key, F.struct(order(F.col("s")).alias("o"), "s").alias("s")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["s"]).alias("all"))
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["stop"]) & (x["start"] < k["stop"]))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return listed.select(*key, F.explode(kept).alias("s")).select(*key, "s.*")


def highlight_ranges(spans: DataFrame) -> DataFrame:
    """Spans to mark: entities before keywords, then the longer, then the first; a span stays when it overlaps none that stays before it.

    `spans`: article_id, start, stop, kind.
    """
    return without_overlaps(spans.select("article_id", "start", "stop", "kind"), ["article_id"], lambda s: F.struct((s["kind"] != "entity").cast("int").alias("a"), (s["start"] - s["stop"]).alias("b"), s["start"].alias("c")))
