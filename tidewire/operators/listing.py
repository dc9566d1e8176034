"""Lists and reports over the archive: members of stories and events, evidence of maps and watches, uses of entities, search documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import place_numbers
from .search import same_element


# ---------------------------------------------------------------- lists


def newest(rows: DataFrame, at: str = "effective_at", key: str = "article_id", k: int = 50) -> DataFrame:
    """The first `k` rows by time, newest first; ties by key."""
    return rows.orderBy(F.col(at).desc_nulls_last(), key).limit(k)


def articles_of(links: DataFrame, condition: Column, k: int = 50) -> DataFrame:
    """A page of the different articles for which a link holds, newest first: those of an entity, a source, a country, an event."""
    return newest(links.filter(condition).select("article_id", "effective_at").distinct(), k=k)


def stories_of(links: DataFrame, condition: Column, k: int = 50) -> DataFrame:
    """A page of the stories of the same: their articles that count, most recent story first."""
    rows = links.filter(condition).groupBy("cluster_id").agg(F.count_distinct("article_id").alias("articles"), F.max("effective_at").alias("last"))
    return newest(rows, "last", "cluster_id", k)


def story_members(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Per story its articles with their feeds and their place, newest first."""
    rows = members.groupBy(cluster, "article_id").agg(F.max("effective_at").alias("effective_at"), F.array_sort(F.collect_set("feed_id")).alias("feeds"))
    return place_numbers(rows, [cluster], [F.desc("effective_at"), F.col("article_id")])


def event_stories(stories: DataFrame, scores: DataFrame) -> DataFrame:
    """Stories of events with the score and the signals that brought them there, largest score first; without one, last."""
    rows = stories.join(scores, "cluster_id", "left")
    return place_numbers(rows, ["event_id"], [F.col("score").desc_nulls_last(), F.col("first"), F.col("cluster_id")])


def pick_by_name(rows: DataFrame, name: str, part: str) -> DataFrame:
    """Rows whose name holds the letters, whatever their case, in name order."""
    return rows.filter(F.lower(name).contains(part.lower())).orderBy(F.lower(name), name)


# ---------------------------------------------------------------- watches and searches


def results(matches: DataFrame, monitors: DataFrame, horizon: str) -> DataFrame:
    """The matches of each watch after it was last looked at, up to the horizon, with their place, newest discovered first."""
    since = F.coalesce("viewed_cursor_at", "eval_cursor_at")
    rows = matches.join(monitors.select("monitor_id", since.alias("since")), "monitor_id")
    rows = rows.filter((F.col("enriched_at") <= F.lit(horizon).cast("timestamp")) & (F.col("since").isNull() | (F.col("enriched_at") > F.col("since"))))
    return place_numbers(rows.drop("since"), ["monitor_id"], [F.desc("enriched_at"), F.col("article_id")])


def investigations(searches: DataFrame, monitors: DataFrame, by: str = "latest") -> DataFrame:
    """Saved searches and the watches that belong to none, in one list, by name or by latest match (without one last). Both: name, latest_match_at, their id."""
    attached = searches.filter(F.col("monitor_id").isNotNull()).select("monitor_id")
    alone = monitors.join(attached, "monitor_id", "left_anti")
    rows = searches.select(F.lit("search").alias("kind"), F.col("search_id").alias("id"), "name", "latest_match_at").unionByName(alone.select(F.lit("monitor").alias("kind"), F.col("monitor_id").alias("id"), "name", "latest_match_at"))
    return rows.orderBy(*([F.lower("name")] if by == "name" else [F.col("latest_match_at").desc_nulls_last(), F.lower("name")]), "kind", "id")


def uses(roots: DataFrame, states: DataFrame) -> DataFrame:
    """(root_id, kind, n): saved searches and watches whose state names any id of a root. `roots`: entity_id, root_id; `states`: kind, id, entity_ids."""
    named = states.select("kind", "id", F.explode(F.array_distinct("entity_ids")).alias("entity_id"))
    return named.join(roots, "entity_id").select("root_id", "kind", "id").distinct().groupBy("root_id", "kind").agg(F.count("*").alias("n"))


def watch_report(monitors: DataFrame, now: str, every_seconds: int = 300) -> DataFrame:
    """One row: all watches, those enabled, those due, the oldest overdue time, and how many ended in which error."""
    due = F.col("enabled") & (F.col("evaluated_at").isNull() | (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("evaluated_at") >= every_seconds))
    errors = monitors.filter(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error", "n")))).alias("errors"))
    counts = monitors.agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(due).alias("due"), F.min(F.when(due, F.col("evaluated_at"))).alias("oldest"))
    return counts.join(F.broadcast(errors))


# ---------------------------------------------------------------- relations and changes of names


def see_also(relations: DataFrame, labels: dict[str, tuple[str, str]]) -> DataFrame:
    """(entity_id, other, label, place): stated relations from both sides, each side with its own label, in the order of `labels`."""
    names = [F.struct(F.lit(k).alias("label"), F.lit(a).alias("there"), F.lit(b).alias("back"), F.lit(i).alias("place")) for i, (k, (a, b)) in enumerate(labels.items())]
    known = relations.withColumn("l", F.try_element_at(F.filter(F.array(*names), lambda x: x["label"] == F.col("label")), F.lit(1))).filter(F.col("l").isNotNull())
    there = known.select(F.col("a").alias("entity_id"), F.col("b").alias("other"), F.col("l.there").alias("label"), F.col("l.place").alias("place"))
    back = known.select(F.col("b").alias("entity_id"), F.col("a").alias("other"), F.col("l.back").alias("label"), F.col("l.place").alias("place"))
    return there.unionByName(back).distinct()


def fold_changes(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities after a table of changes (entity_id, field, value, change_id): of each field the last change counts, of equal ones the greater value. Fields: name, kind, note, hidden, ambiguous, status."""
    last = changes.groupBy("entity_id", "field").agg(F.max_by("value", F.struct("change_id", "value")).alias("value"))
    fields = ["name", "kind", "note", "hidden", "ambiguous", "status"]
    wide = last.groupBy("entity_id").agg(*[F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"new_{f}") for f in fields])
    rows = entities.join(wide, "entity_id", "left")
    return rows.select("entity_id", *[F.when(F.col(f"new_{f}").isNotNull(), F.col(f"new_{f}.value")).otherwise(F.col(f).cast("string") if f in entities.columns else F.lit(None)).alias(f) for f in fields])


def affected_events(links: DataFrame, stories: DataFrame, entities: DataFrame) -> DataFrame:
    """Events with an article that names one of the touched entities."""
    touched = links.join(entities.select("entity_id"), "entity_id", "left_semi").select("article_id", "cluster_id").distinct()
    return stories.join(touched.select("cluster_id"), "cluster_id", "left_semi").select("event_id").distinct()


def name_claims(new: DataFrame, claims: DataFrame) -> DataFrame:
    """New entities whose (language, name) a root has claimed join that root; the others are roots of their own."""
    return new.join(claims.select("language", "folded", F.col("root_id").alias("claimed")), ["language", "folded"], "left").select("entity_id", F.coalesce("claimed", "entity_id").alias("root_id"))


def seed_variants(spellings: DataFrame, entities: DataFrame, roots: DataFrame) -> DataFrame:
    """What becomes of each spelling of a country: created, linked, or skipped as used (it is a root with variants), chosen (under another root) or own (the root itself).

    `spellings`: code, folded; `entities`: entity_id, folded, authority_id; `roots`: code, root_id.
    """
    taken = entities.filter(F.col("authority_id").isNotNull()).select(F.col("authority_id").alias("entity_id"), F.lit(True).alias("has_variants")).distinct()
    rows = spellings.join(roots, "code").join(entities.join(taken, "entity_id", "left"), "folded", "left")
    what = F.when(F.col("entity_id").isNull(), "created").when(F.col("entity_id") == F.col("root_id"), "own").when(F.col("authority_id") == F.col("root_id"), "linked_before").when(F.col("authority_id").isNotNull(), "chosen").when(F.col("has_variants"), "used").otherwise("linked")
    return rows.select("code", "folded", "root_id", what.alias("outcome"))


def publish(values: DataFrame, roots: DataFrame) -> DataFrame:
    """Annotations of the newest generation of each article, combined under roots. `values`: article_id, generation, entity_id, label, occurrence_count."""
    newest_only = values.join(values.groupBy("article_id").agg(F.max("generation").alias("generation")), ["article_id", "generation"], "left_semi")
    rooted = newest_only.join(roots, "entity_id", "left").withColumn("root_id", F.coalesce("root_id", "entity_id"))
    out = rooted.groupBy("article_id", "root_id").agg(F.sum("occurrence_count").alias("occurrence_count"), F.min_by("label", F.struct(-F.col("occurrence_count"), F.col("label"))).alias("label"))
    return out.withColumn("relevance", F.least(F.lit(1.0), F.col("occurrence_count") / 5.0))


# ---------------------------------------------------------------- search documents


def search_filter(docs: DataFrame, **criteria) -> DataFrame:
    """Documents that meet all given criteria; None sets none, an empty list matches nothing.

    sources, source_countries, tags: on the same element of provenance (feed_id, country, tag). entities, kinds: on the same element of entities
    (entity_id, kind). since, until: effective time [since, until). languages, stories, events, story_countries, statuses: the row's own value.
    keywords, mentioned_countries: any in the array. available: whether there is content.
    """
    given = {k: v for k, v in criteria.items() if v is not None}
    tests: list[Column] = []
    for array, fields in (("provenance", {"sources": "feed_id", "source_countries": "country", "tags": "tag"}), ("entities", {"entities": "entity_id", "kinds": "kind"})):
        wanted = {f: list(given[c]) for c, f in fields.items() if c in given}
        if wanted:
            tests.append(same_element(array, **wanted) if all(wanted.values()) else F.lit(False))
    for c, column in {"languages": "language", "stories": "cluster_id", "events": "event_id", "story_countries": "story_country", "statuses": "status"}.items():
        if c in given:
            tests.append(F.col(column).isin(*given[c]))
    for c in ("keywords", "mentioned_countries"):
        if c in given:
            tests.append(F.coalesce(F.arrays_overlap(F.col(c), F.array(*map(F.lit, given[c])).cast(docs.schema[c].dataType)), F.lit(False)))
    if "since" in given:
        tests.append(F.col("effective_at") >= F.lit(given["since"]).cast("timestamp"))
    if "until" in given:
        tests.append(F.col("effective_at") < F.lit(given["until"]).cast("timestamp"))
    if "available" in given:
        tests.append(F.col("available") == given["available"])
    return docs.filter(reduce(lambda a, b: a & b, tests)) if tests else docs


def ordered(docs: DataFrame, order: str, k: int, score: str | None = None) -> DataFrame:
    """The first `k` by relevance (score, then newest), newest, oldest or most_sources; the id breaks ties."""
    keys = {
        "relevance": [F.desc(score or "effective_at"), F.desc("effective_at")], "newest": [F.col("effective_at").desc_nulls_last()], "oldest": [F.col("effective_at").asc_nulls_last()],
        "most_sources": [F.desc(F.size(F.array_distinct(F.transform("provenance", lambda x: x["feed_id"])))), F.desc("effective_at")],
    }
    return docs.orderBy(*keys[order], "article_id").limit(k)


def projection(docs: DataFrame, shown: int = 3) -> DataFrame:
    """What a result shows: its first entities by mentions, its different sources in order, its story."""
    first = F.slice(F.array_sort(F.transform("entities", lambda x: F.struct((-x["occurrence_count"]).alias("a"), x["entity_id"].alias("b")))), 1, shown)
    return docs.select("article_id", F.transform(first, lambda x: x["b"]).alias("entities"), F.array_sort(F.array_distinct(F.transform("provenance", lambda x: x["feed_id"]))).alias("sources"), "cluster_id")


def resolve_names(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(kind, id) that names stand for: `wanted` and `catalogue` hold kind and name (compared in lower case); an entity brings its root and all variants of it. `catalogue` has id and root_id (null where it is no entity)."""
    hit = catalogue.withColumn("folded", F.lower(F.trim("name"))).join(wanted.select("kind", F.lower(F.trim("name")).alias("folded")).distinct(), ["kind", "folded"]).select("kind", "id", "root_id")
    family = hit.filter("root_id IS NOT NULL").select("kind", "root_id").distinct().join(catalogue.select("kind", "root_id", "id"), ["kind", "root_id"]).select("kind", "id")
    return hit.select("kind", "id").unionByName(family).distinct()


# ---------------------------------------------------------------- jobs


def story_job_status(articles: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: articles in stories, stories, and jobs by state."""
    counts = articles.agg(F.count("cluster_id").alias("clustered"), F.count_distinct("cluster_id").alias("stories"))
    states = jobs.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("waiting", "running", "done", "failed")])
    return counts.join(F.broadcast(states))


def run_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row on a run that gave stories their events (cluster_id, event_id): evaluated, moved, and events that began and ended."""
    rows = before.withColumnRenamed("event_id", "old").join(after.withColumnRenamed("event_id", "new"), "cluster_id", "full")
    moved = rows.agg(F.count("new").alias("evaluated"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))).alias("moved"))
    seen = before.select("event_id", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(after.select("event_id", F.lit(0).alias("o"), F.lit(1).alias("n"))).groupBy("event_id").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return moved.join(F.broadcast(seen.agg(F.count_if(F.col("o") == 0).alias("created"), F.count_if(F.col("n") == 0).alias("deleted"))))


def link_statistics(requests: DataFrame) -> DataFrame:
    """Requests by day, kind and outcome, with their mean duration."""
    return requests.groupBy(F.date_trunc("day", "at").alias("day"), "kind", "outcome").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


def activity(history: DataFrame, process: str | None = None, status: str | None = None, text: str | None = None, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of the history of processes, newest first, and the counts by status of what the other filters leave."""
    rows = history
    if process:
        rows = rows.filter(F.col("process") == process)
    if text:
        rows = rows.filter(F.lower("detail").contains(text.lower()))
    page = rows.filter(F.col("status") == status) if status else rows
    return page.orderBy(F.desc("at"), "process", "run_id").limit(k), rows.groupBy("status").agg(F.count("*").alias("n"))


def process_cards(history: DataFrame, now: str, idle_seconds: int = 86_400) -> DataFrame:
    """Per process its runs, failures, newest run and state: failing (the newest run failed), idle (none for a day), else ok."""
    rows = history.groupBy("process").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"), F.max("at").alias("last_at"), F.max_by("status", F.struct("at", "run_id")).alias("last_status"))
    late = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("last_at") > idle_seconds
    return rows.withColumn("state", F.when(F.col("last_status") == "failed", "failing").when(late, "idle").otherwise("ok"))


def feed_profile(entries: DataFrame, language: Column, first: int = 50) -> DataFrame:
    """Per feed: entries, the latest, and the language of most of its newest `first` entries (the earlier in the alphabet on ties)."""
    w = Window.partitionBy("feed_id").orderBy(F.desc("published_at"), "entry_id")
    some = entries.withColumn("language", language).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= first)
    n = some.filter("language IS NOT NULL").groupBy("feed_id", "language").agg(F.count("*").alias("n"))
    return entries.groupBy("feed_id").agg(F.count("*").alias("entries"), F.max("published_at").alias("latest")).join(n.groupBy("feed_id").agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language")), "feed_id", "left")


def approximate_distinct(rows: DataFrame, group: list[str], subject: str, error: float = 0.02) -> DataFrame:
    """Distinct subjects by a cardinality sketch, for groups too large to count exactly."""
    return rows.groupBy(*group).agg(F.approx_count_distinct(subject, error).alias("about"))
