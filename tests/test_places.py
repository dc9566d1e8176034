"""Place numbers against plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import listing, places


def held(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("down", [True, False])
def test_large_groups_and_null_groups_are_numbered_as_by_a_window(spark, down):
    group = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 90)
    rows = spark.range(5000).select(group.alias("g"), F.xxhash64("id").alias("x"), F.col("id"))
    order = [F.desc("x") if down else F.asc("x"), F.col("id")]
    got = places.place_numbers(rows, ["g"], order, parts=6)
    want = rows.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert held(got.select(*want.columns)) == held(want)
    plan = places.place_numbers(rows.filter("g = 7"), ["g"], order, parts=6)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" in plan and places.place_numbers(rows.filter("g = 7"), ["g"], order, parts=6).agg(F.max("place")).first()[0] == rows.filter("g = 7").count()


def test_rows_of_a_large_group_are_dealt_to_many_ranges(spark):
    rows = spark.range(6000).select(F.lit(1).alias("g"), F.lit(None).cast("string").alias("h"), F.col("id"))
    got = places.place_numbers(rows, ["g", "h"], [F.desc("id")], parts=6)
    assert [r["place"] for r in got.orderBy(F.desc("id")).collect()] == list(range(1, 6001))
    assert places.place_numbers(rows.limit(0), ["g"], [F.col("id")]).count() == 0


def test_lists_keep_their_places_when_one_story_has_most_articles(spark):
    members = spark.range(3000).select(F.when(F.col("id") % 4 > 0, 5).otherwise(F.col("id") % 40).alias("cluster_id"), F.col("id").alias("article_id"), (F.col("id") % 6).alias("feed_id"), F.timestamp_seconds(F.col("id") % 500).alias("effective_at"))
    got = listing.story_members(members).select("cluster_id", "article_id", "place")
    w = Window.partitionBy("cluster_id").orderBy(F.desc("effective_at"), "article_id")
    assert held(got) == held(members.select("cluster_id", "article_id", F.row_number().over(w).alias("place")))
