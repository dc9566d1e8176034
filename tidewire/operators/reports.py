"""Countries on a map, and reports over the queues of jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def countries(links: DataFrame, members: DataFrame, with_sources: bool = True) -> DataFrame:
    """Per country: different articles and stories, and sources. `links`: article_id, country."""
    rows = links.select("article_id", "country").distinct().join(members.select("article_id", "cluster_id", "feed_id"), "article_id")
    n = [F.count_distinct("article_id").alias("articles"), F.count_distinct("cluster_id").alias("stories")]
    return rows.groupBy("country").agg(*n, *([F.count_distinct("feed_id").alias("sources")] if with_sources else []))


def coverage(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Articles in all and those that have a country."""
    located = links.filter(F.col("country").isNotNull()).select("article_id", F.lit(True).alias("located")).distinct()
    return articles.select("article_id").join(located, "article_id", "left").agg(F.count("*").alias("total"), F.count_if("located").alias("located"))


def job_pipeline(jobs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Per pipeline, in one pass: jobs by state, expired leases, the longest wait, and what ended in the window (its edge included)."""
    now = F.lit(as_of).cast("timestamp")
    start = now - F.expr(f"interval {hours} hours")
    due = F.col("status").isin("queued", "retrying") & (F.col("next_attempt_at") <= now)
    return jobs.groupBy("pipeline").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", "retrying", "failed")], F.count_if((F.col("status") == "running") & (F.col("claim_expires_at") < now)).alias("lease_expired"),
        (F.unix_seconds(now) - F.unix_seconds(F.min(F.when(due, F.col("next_attempt_at"))))).alias("oldest_wait_s"),
        F.count_if((F.col("status") == "succeeded") & (F.col("completed_at") >= start)).alias("done_in_window"), F.count_if((F.col("status") == "failed") & (F.col("completed_at") >= start)).alias("failed_in_window"),
    )


def activity(histories: dict[str, DataFrame]) -> DataFrame:
    """Histories of several processes as one table: process, ref_id, status, at."""
    return reduce(DataFrame.unionByName, [h.select(F.lit(name).alias("process"), F.col("ref_id").cast("string").alias("ref_id"), "status", "at") for name, h in histories.items()])


def prunable(history: DataFrame, as_of: str, days: int = 30, key: tuple[str, ...] = ("ref_id", "process")) -> DataFrame:
    """Succeeded rows older than the limit that a newer row of the same subject replaces. The newest time is an aggregate joined back, so
    that a subject with a third of all rows is combined before the shuffle."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    newest = history.groupBy(*key).agg(F.max("at").alias("newest"))
    return history.filter((F.col("status") == "succeeded") & (F.col("at") < limit)).join(newest, list(key)).filter(F.col("at") < F.col("newest")).drop("newest")
