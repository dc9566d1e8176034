"""Counts as of a moment and what changed for watches, against plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from tidewire.operators import growth

at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)


def test_growth_equals_plain_counts_also_for_a_story_with_most_reports(spark):
    rng = random.Random(4)
    reports = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(40), at(rng.randrange(100)) if rng.random() < 0.95 else None) for _ in range(600)]
    windows = [(m, c, at(rng.randrange(60)), at(60 + rng.randrange(60))) for m in range(12) for c in (1, 2, 3, 4)]
    df = spark.createDataFrame(reports, "cluster_id long, feed_id long, discovered_at timestamp")
    got = growth.story_growth(df, spark.createDataFrame(windows, "monitor_id long, cluster_id long, after timestamp, upto timestamp"))
    n = lambda c, t: len({f for k, f, d in reports if k == c and d is not None and d <= t})
    assert sorted((r["monitor_id"], r["cluster_id"], r["before"], r["now"]) for r in got.collect()) == sorted((m, c, n(c, a), n(c, u)) for m, c, a, u in windows)


def test_changes_of_watches(spark):
    monitors = spark.createDataFrame([(1, at(10), at(20)), (2, None, at(20)), (3, at(20), at(20))], "monitor_id long, viewed_cursor_at timestamp, eval_cursor_at timestamp")
    matches = [(m, a, c, at(h)) for m in (1, 2, 3) for a, c, h in [(1, 100, 5), (2, 100, 11), (3, 100, 12), (4, 200, 13), (5, 300, 9), (6, 300, 14), (7, 400, 25), (8, 100, 15), (9, 100, 16)]]
    df = spark.createDataFrame(matches, "monitor_id long, article_id long, cluster_id long, enriched_at timestamp")
    reports = spark.createDataFrame([(100, 1, at(5)), (100, 2, at(11)), (100, 3, at(12)), (100, 1, at(13)), (200, 1, at(13)), (300, 1, at(1)), (300, 2, at(14))], "cluster_id long, feed_id long, discovered_at timestamp")
    got = {r["cluster_id"]: (r["status"], r["articles"], r["sources"], r["sources_added"], r["evidence"]) for r in growth.changed_stories(df, monitors, reports).collect()}
    # 300 grew by one source only, 400 lies beyond the evaluation
    assert got == {100: ("grew", 4, 3, 2, [9, 8, 3]), 200: ("new", 1, 1, 1, [4])}
    feeds = df.join(spark.createDataFrame([(a, a % 4) for a in range(10)], "article_id long, feed_id long"), "article_id").drop("cluster_id")
    assert {(r["monitor_id"], r["feed_id"], r["articles"]) for r in growth.new_keys(feeds, monitors, "feed_id").collect()} == {(1, 0, 2), (1, 2, 2), (1, 3, 1)}
    few = growth.found_keys(df, monitors, "cluster_id", 2).orderBy("rank").collect()
    assert [(r["cluster_id"], r["more"]) for r in few] == [(100, True), (200, True)]


def test_charts_go_by_hour_up_to_a_week(spark):
    rows = spark.createDataFrame([(1, 1, at(0)), (1, 2, at(7 * 24)), (2, 3, at(0)), (2, 4, at(7 * 24 + 1)), (3, 5, None), (4, 6, at(5)), (4, 6, at(5))], "cluster_id long, article_id long, effective_at timestamp")
    n = {r["cluster_id"]: (r["step"], r["buckets"], r["articles"]) for r in growth.story_chart(rows).groupBy("cluster_id", "step").agg(F.count("*").alias("buckets"), F.sum("n").alias("articles")).collect()}
    assert n == {1: ("hour", 169, 2), 2: ("day", 8, 2), 4: ("hour", 1, 1)}
