"""How things stood at a moment: running counts looked up as of a time, growth of stories between two looks, and what changed for a watch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import place_numbers
from .ranking import top_per_group
from .skew import split_join

#: Keys that a watch shows of each kind, articles shown with one, and how many more sources make a story's growth worth telling.
TOP, EVIDENCE, GROWTH = 10, 3, 2


def valid_intervals(reports: DataFrame, key: str, item: str, at: str) -> DataFrame:
    """(key, item, since): from when on each item counts for its key; once it does, it stays."""
    return reports.filter(F.col(at).isNotNull()).groupBy(key, item).agg(F.min(at).alias("since"))


def counts_as_of(intervals: DataFrame, looks: DataFrame, key: str, item: str, at: str = "at", name: str = "n") -> DataFrame:
    """`looks` (key, time `at`, any other columns, together different) with the number of items of their key that count by then, the moment itself included.

    An interval as-of join without a window a key: starts and looks are numbered together by time, looks alone are numbered too, and the
    difference of a look's two places is how many starts lie before it. A key of any size is numbered over many tasks.
    """
    rest = [c for c in looks.columns if c not in {key, at}]
    starts = intervals.select(key, F.col("since").alias(at), F.lit(0).alias("__look"), *[F.lit(None).cast(looks.schema[c].dataType).alias(c) for c in rest], F.col(item).cast("string").alias("__item"))
    asked = looks.select(key, at, F.lit(1).alias("__look"), *rest, F.lit(None).cast("string").alias("__item"))
    order: list[Column] = [F.col(at), F.col("__look"), *[F.col(c) for c in rest], F.col("__item")]
    both = place_numbers(starts.unionByName(asked), [key], order, "__both").filter("__look = 1")
    return place_numbers(both, [key], order, "__own").withColumn(name, F.col("__both") - F.col("__own")).select(key, at, *rest, name)


def story_growth(reports: DataFrame, windows: DataFrame) -> DataFrame:
    """(monitor_id, cluster_id, before, now): different sources that had reported a story by a window's start and by its end.

    `reports`: cluster_id, feed_id, discovered_at; `windows`: monitor_id, cluster_id, after, upto.
    """
    ends = windows.select("cluster_id", "monitor_id", F.explode(F.array(F.struct(F.col("after").alias("at"), F.lit("before").alias("end")), F.struct(F.col("upto").alias("at"), F.lit("now").alias("end")))).alias("e"))
    counted = counts_as_of(valid_intervals(reports, "cluster_id", "feed_id", "discovered_at"), ends.select("cluster_id", "e.at", "monitor_id", "e.end"), "cluster_id", "feed_id")
    side = lambda end: F.max(F.when(F.col("end") == end, F.col("n"))).alias(end)
    return counted.groupBy("monitor_id", "cluster_id").agg(side("before"), side("now"))


def _windows(monitors: DataFrame) -> DataFrame:
    """(monitor_id, after, upto) of the watches that were looked at before their last evaluation; the others show no change."""
    rows = monitors.select("monitor_id", F.col("viewed_cursor_at").alias("after"), F.col("eval_cursor_at").alias("upto"))
    return rows.filter(F.col("after") < F.col("upto"))


def found_keys(matches: DataFrame, monitors: DataFrame, key: str, k: int = TOP) -> DataFrame:
    """(monitor_id, key, articles, seen, rank, more): the `k` keys of most articles matched in each watch's window, whether a match before it had the
    key, and whether there are more keys. `matches`: monitor_id, article_id, enriched_at and the key, one row a key of an article."""
    rows = split_join(matches.filter(F.col(key).isNotNull()).select("monitor_id", key, "article_id", "enriched_at").distinct(), _windows(monitors), ["monitor_id"]).filter(F.col("enriched_at") <= F.col("upto"))
    inside = F.col("enriched_at") > F.col("after")
    n = rows.groupBy("monitor_id", key).agg(F.count_if(inside).alias("articles"), (F.count_if(~inside) > 0).alias("seen")).filter(F.col("articles") > 0)
    top = top_per_group(n, ["monitor_id"], [F.desc("articles"), F.col(key)], k + 1)
    more = top.filter(F.col("rank") > k).select("monitor_id", F.lit(True).alias("more"))
    return top.filter(F.col("rank") <= k).join(more, "monitor_id", "left").fillna(False, ["more"])


def evidence(matches: DataFrame, found: DataFrame, monitors: DataFrame, key: str, shown: int = EVIDENCE) -> DataFrame:
    """(monitor_id, key, evidence): the newest `shown` articles of each found key in its watch's window; rows beyond are dropped before the shuffle."""
    rows = matches.select("monitor_id", key, "article_id", "enriched_at").distinct().join(found.select("monitor_id", key), ["monitor_id", key]).join(_windows(monitors), "monitor_id")
    rows = rows.filter((F.col("enriched_at") > F.col("after")) & (F.col("enriched_at") <= F.col("upto")))
    newest = top_per_group(rows, ["monitor_id", key], [F.desc("enriched_at"), F.col("article_id")], shown)
    held = newest.groupBy("monitor_id", key).agg(F.array_sort(F.collect_list(F.struct("rank", "article_id"))).alias("e"))  # `shown` at most
    return held.select("monitor_id", key, F.col("e.article_id").alias("evidence"))


def new_keys(matches: DataFrame, monitors: DataFrame, key: str, k: int = TOP) -> DataFrame:
    """(monitor_id, key, articles, more, evidence): of the most matched sources or entities of each watch's window those that it never matched before."""
    found = found_keys(matches, monitors, key, k)
    fresh = found.filter("NOT seen").select("monitor_id", key, "articles", "more")
    return fresh.join(evidence(matches, fresh, monitors, key), ["monitor_id", key])


def changed_stories(matches: DataFrame, monitors: DataFrame, reports: DataFrame, k: int = TOP) -> DataFrame:
    """(monitor_id, cluster_id, status, articles, sources, sources_added, more, evidence): of the most matched stories of each watch's window the new ones, and those
    that grew by GROWTH sources or more."""
    found = found_keys(matches, monitors, "cluster_id", k)
    asked = found.select("monitor_id", "cluster_id").join(_windows(monitors), "monitor_id")
    grown = found.join(story_growth(reports, asked), ["monitor_id", "cluster_id"])
    told = grown.filter(~F.col("seen") | (F.col("now") - F.col("before") >= GROWTH))
    rows = told.select("monitor_id", "cluster_id", F.when(F.col("seen"), "grew").otherwise("new").alias("status"), "articles", F.col("now").alias("sources"), (F.col("now") - F.col("before")).alias("sources_added"), "more")
    return rows.join(evidence(matches, rows, monitors, "cluster_id"), ["monitor_id", "cluster_id"])


# ---------------------------------------------------------------- one story's page, for all stories

#: Entities and sources of a story's page; the longest span, in days, that is charted by the hour.
STORY_ENTITIES, STORY_SOURCES, HOURLY_DAYS = 12, 100, 7


def story_titles(stories: DataFrame, members: DataFrame, titles: DataFrame) -> DataFrame:
    """(cluster_id, title): the representative's title, else that of the story's earliest article that has one. `stories`: cluster_id, representative."""
    own = stories.join(titles.select(F.col("article_id").alias("representative"), F.col("title").alias("own")), "representative", "left")
    first = members.select("cluster_id", "article_id", "effective_at").distinct().join(titles.filter(F.col("title").isNotNull()), "article_id").groupBy("cluster_id").agg(F.min_by("title", F.struct("effective_at", "article_id")).alias("first"))
    return own.join(first, "cluster_id", "left").select("cluster_id", F.coalesce("own", "first").alias("title"))


def story_entities(members: DataFrame, links: DataFrame, names: DataFrame, k: int = STORY_ENTITIES) -> DataFrame:
    """(cluster_id, entity_id, name, kind, articles, rank): the visible entities of most articles of each story, then by name. `names`: entity_id, name, kind, hidden."""
    own = members.select("cluster_id", "article_id").distinct()
    n = own.join(links.select("article_id", "entity_id").distinct(), "article_id").groupBy("cluster_id", "entity_id").agg(F.count("*").alias("articles"))
    rows = split_join(n, names.filter(~F.coalesce("hidden", F.lit(False))).select("entity_id", "name", "kind"), ["entity_id"])
    return top_per_group(rows, ["cluster_id"], [F.desc("articles"), F.col("name"), F.col("entity_id")], k)


def kinds(*parts: tuple[str, DataFrame, str]) -> DataFrame:
    """New keys of several kinds in one list: (monitor_id, kind, key, articles, more)."""
    rows = [df.select("monitor_id", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "articles", "more") for kind, df, key in parts]
    return reduce(DataFrame.unionByName, rows)


def story_chart(members: DataFrame) -> DataFrame:
    """(cluster_id, step, bucket, n): articles of each story by the hour where it spans up to a week, else by the day, quiet buckets included."""
    dates = members.select("cluster_id", "article_id", "effective_at").distinct().filter(F.col("effective_at").isNotNull())
    span = dates.groupBy("cluster_id").agg(F.min("effective_at").alias("lo"), F.max("effective_at").alias("hi"))
    step = F.when(F.unix_micros("hi") - F.unix_micros("lo") <= HOURLY_DAYS * 86_400_000_000, "hour").otherwise("day")
    span = span.withColumn("step", step)
    floor = lambda c: F.when(F.col("step") == "hour", F.date_trunc("hour", c)).otherwise(F.date_trunc("day", c))
    width = F.when(F.col("step") == "hour", F.expr("interval 1 hour")).otherwise(F.expr("interval 24 hours"))
    spine = span.select("cluster_id", "step", F.explode(F.sequence(floor("lo"), floor("hi"), width)).alias("bucket"))
    counts = split_join(dates, span.select("cluster_id", "step"), ["cluster_id"]).groupBy("cluster_id", floor("effective_at").alias("bucket")).agg(F.count("*").alias("n"))
    return spine.join(counts, ["cluster_id", "bucket"], "left").fillna(0, ["n"])
