"""Dossiers of entities and sources, and reports over the history of fetches and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_per_group


def entity_dossier(links: DataFrame, members: DataFrame) -> DataFrame:
    """Per entity: mentions, different articles and stories, first and last seen. An article is in one story at most, so sums do not fan out."""
    rows = links.join(members.select("article_id", "cluster_id").distinct(), "article_id", "left")
    return rows.groupBy("entity_id").agg(F.sum("occurrence_count").alias("mentions"), F.count_distinct("article_id").alias("articles"), F.count_distinct("cluster_id").alias("stories"), F.min("effective_at").alias("first_seen"), F.max("effective_at").alias("last_seen"))


def source_positions(members: DataFrame) -> DataFrame:
    """Per source and story of two sources or more: the source's earliest article, whether it came first, and minutes behind."""
    own = first_per_group(members.select("cluster_id", "feed_id", "article_id", "effective_at"), ["cluster_id", "feed_id"], [F.col("effective_at"), F.col("article_id")])
    best = own.groupBy("cluster_id").agg(F.min(F.struct("effective_at", "article_id")).alias("f"), F.count("*").alias("sources")).filter("sources >= 2")
    return own.join(best, "cluster_id").select("cluster_id", "feed_id", "article_id", (F.col("article_id") == F.col("f.article_id")).alias("is_first"), ((F.unix_seconds("effective_at") - F.unix_seconds("f.effective_at")) / 60.0).alias("minutes"))


def source_timing(positions: DataFrame) -> DataFrame:
    late = F.when(~F.col("is_first"), F.col("minutes"))
    return positions.groupBy("feed_id").agg(F.count("*").alias("stories"), F.count_if("is_first").alias("first"), F.percentile(late, F.lit(0.5)).alias("median"), F.percentile(late, F.lit(0.9)).alias("p90"))


def failure_streaks(fetches: DataFrame, newest: int = 20) -> DataFrame:
    """Per feed: failures in a row at the newest end of its last `newest` finished fetches, and whether all of these failed."""
    w = Window.partitionBy("feed_id").orderBy(F.desc("started_at"), F.desc("fetch_id"))
    last = fetches.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= newest)
    s = last.groupBy("feed_id").agg(F.count("*").alias("seen"), F.min(F.when(F.col("status") == "success", F.col("rn"))).alias("good"))
    return s.select("feed_id", F.coalesce(F.col("good") - 1, F.col("seen")).cast("long").alias("streak"), F.col("good").isNull().alias("capped"))


def failures_since_success(fetches: DataFrame) -> DataFrame:
    """Per feed, failed fetches after the last good one. Both are aggregates over (feed, day) first, so one busy feed is split."""
    last = fetches.filter("status = 'success'").groupBy("feed_id").agg(F.max("started_at").alias("good_at"))
    rows = fetches.join(last, "feed_id", "left").filter((F.col("status") == "failed") & (F.col("good_at").isNull() | (F.col("started_at") > F.col("good_at"))))
    n = rows.groupBy("feed_id").agg(F.count("*").alias("failures"))
    return fetches.select("feed_id").distinct().join(n, "feed_id", "left").fillna(0, ["failures"])


def feed_health(fetches: DataFrame, as_of: str, overdue_minutes: int = 60) -> DataFrame:
    """Per feed: state (failing at three in a row, overdue, ok), seconds overdue, totals."""
    streak = failure_streaks(fetches)
    n = fetches.groupBy("feed_id").agg(F.count("*").alias("fetches"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("new_article_count").alias("new_articles"), F.max("started_at").alias("last_at"))
    late = F.greatest(F.lit(0), F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("last_at") - overdue_minutes * 60)
    state = F.when(F.col("streak") >= 3, "failing").when(F.col("overdue_s") > 0, "overdue").otherwise("ok")
    return n.join(streak, "feed_id").withColumn("overdue_s", late).withColumn("state", state)


def failures(fetches: DataFrame, newest: int = 5) -> DataFrame:
    """Failures by category with the newest ones' times."""
    w = Window.partitionBy("error_category").orderBy(F.desc("started_at"), F.desc("fetch_id"))
    bad = fetches.filter("status = 'failed'")
    n = bad.groupBy("error_category").agg(F.count("*").alias("n"))
    top = bad.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= newest)
    return top.join(n, "error_category").select("error_category", "n", "rank", "fetch_id", "started_at")
