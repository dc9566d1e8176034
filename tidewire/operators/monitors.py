"""Watches over the archive, evaluated for many windows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(matches: DataFrame, monitors: DataFrame, horizon: str) -> DataFrame:
    """Per watch: unseen articles and stories in (viewed, horizon], new ones in (cursor, horizon], latest match. A first run (null cursor)
    is a baseline of zero. `matches`: monitor_id, article_id, cluster_id, enriched_at; running it again gives the same. Where watches have a
    `notified_through`, what lies before it was announced and is not new again though a view took the cursor back; a cursor never goes back here."""
    h = F.lit(horizon).cast("timestamp")
    rows = monitors.join(matches.filter(F.col("enriched_at") <= h), "monitor_id", "left")
    started = F.col("eval_cursor_at").isNotNull()
    unseen = started & (F.col("enriched_at") > F.coalesce("viewed_cursor_at", "eval_cursor_at"))
    told = F.greatest("eval_cursor_at", "notified_through") if "notified_through" in monitors.columns else F.col("eval_cursor_at")
    fresh = started & (F.col("enriched_at") > told)
    n = rows.groupBy("monitor_id").agg(
        F.count_distinct(F.when(unseen, F.col("article_id"))).alias("unseen_articles"), F.count_distinct(F.when(unseen, F.col("cluster_id"))).alias("unseen_stories"),
        F.count_distinct(F.when(fresh, F.col("article_id"))).alias("new_articles"), F.max("enriched_at").alias("latest_match_at"), F.max("eval_cursor_at").alias("cursor"),
    )
    return n.withColumn("eval_cursor_at", F.greatest("cursor", h)).drop("cursor")


def changes(matches: DataFrame, after: str, until: str, key: str, k: int = 10, shown: int = 3) -> DataFrame:
    """Keys matched in (after, until]: articles, whether the key never matched before, and the newest articles as evidence."""
    lo, hi = F.lit(after).cast("timestamp"), F.lit(until).cast("timestamp")
    rows = matches.filter(F.col("enriched_at") <= hi).select("monitor_id", key, "article_id", "enriched_at").distinct()
    now = F.col("enriched_at") > lo
    newest = F.transform(F.slice(F.sort_array(F.collect_list(F.when(now, F.struct("enriched_at", "article_id"))), False), 1, shown), lambda x: x["article_id"])
    n = rows.groupBy("monitor_id", key).agg(F.count_if(now).alias("articles"), (F.count_if(~now) == 0).alias("is_new"), newest.alias("evidence")).filter(F.col("articles") > 0)
    from .ranking import top_per_group

    return top_per_group(n, ["monitor_id"], [F.desc("articles"), F.col(key)], k)


def apply_views(monitors: DataFrame, views: DataFrame) -> DataFrame:
    """Later view times move the viewed cursor on and zero the counts; earlier ones change nothing. An evaluation cursor beyond the view, where watches have one, goes back to it, so that what came since is counted."""
    seen = views.groupBy("monitor_id").agg(F.max("viewed_at").alias("viewed_at"))
    rows = monitors.join(seen, "monitor_id", "left")
    on = F.col("viewed_at").isNotNull() & (F.col("viewed_cursor_at").isNull() | (F.col("viewed_at") > F.col("viewed_cursor_at")))
    if "eval_cursor_at" in monitors.columns:
        rows = rows.withColumn("eval_cursor_at", F.when(on & (F.col("eval_cursor_at") > F.col("viewed_at")), F.col("viewed_at")).otherwise(F.col("eval_cursor_at")))
    return rows.withColumn("unseen", F.when(on, 0).otherwise(F.col("unseen"))).withColumn("viewed_cursor_at", F.when(on, F.col("viewed_at")).otherwise(F.col("viewed_cursor_at"))).drop("viewed_at")


def digest(monitors: DataFrame, separate: int = 3) -> DataFrame:
    """Messages owed: a row a watch up to `separate` of a user's, one combined row beyond. The watches of one user are summed in groups."""
    owed = monitors.filter((F.col("state") == "enabled") & F.col("notify") & (F.col("pending") > 0))
    n = owed.groupBy("user_id").agg(F.count("*").alias("watches"), F.sum("pending").alias("total"))
    rows = owed.join(n, "user_id")
    single = rows.filter(F.col("watches") <= separate).select("user_id", F.col("monitor_id").cast("string").alias("subject"), F.col("pending").cast("long").alias("articles"))
    many = n.filter(F.col("watches") > separate).select("user_id", F.concat(F.col("watches").cast("string"), F.lit(" watches")).alias("subject"), F.col("total").alias("articles"))
    return single.unionByName(many)
