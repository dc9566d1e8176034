"""Exact quantiles by brackets against Spark's own."""

import math

import pytest
from pyspark.sql import functions as F

from tidewire.operators import quantiles, ranking


def held(df):
    out = {}
    for r in df.collect():
        *g, a, b = r
        out[tuple(g)] = tuple(None if x is None else "nan" if math.isnan(x) else round(x, 9) for x in (a, b))
    return out


def table(spark, n=30_000):
    g = F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 30 == 0, F.lit(None)).when(F.col("id") < 30, 100 + F.col("id")).otherwise(2 + F.col("id") % 4)
    v = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 5 == 0, 3.5).otherwise((F.xxhash64("id") % 100_000) / 7.0)
    return spark.range(n).select(g.alias("g"), (F.col("id") % 2).alias("h"), v.cast("double").alias("v"), "id")


@pytest.mark.parametrize("slack", [0.02, 0.0])
def test_same_as_percentile_also_where_the_sketch_misses(spark, slack):
    rows = table(spark)
    want = rows.filter("v IS NOT NULL").groupBy("g", "h").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.9)).alias("p"))
    got = quantiles.exact_quantiles(rows, ["g", "h"], "v", {"m": 0.5, "p": 0.9}, slack=slack)
    assert held(got) == held(want)
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()


def test_ends_nan_and_one_group(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, 2.0), (2, float("nan")), (3, 5.0), (4, None), (5, -0.0), (5, 1e300), (5, -1e300)], "g long, v double")
    want = rows.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.lit(0.0)).alias("a"), F.percentile("v", F.lit(1.0)).alias("z"))
    assert held(quantiles.exact_quantiles(rows, ["g"], "v", {"a": 0.0, "z": 1.0})) == held(want)
    alone = quantiles.exact_quantiles(rows.filter("g = 3"), [], "v", {"a": 0.5, "z": 0.9})
    assert [tuple(r) for r in alone.collect()] == [(5.0, 5.0)]
    assert quantiles.exact_quantiles(rows.limit(0), ["g"], "v", {"a": 0.5, "z": 0.9}).count() == 0


def test_percentiles_of_large_groups_keep_groups_without_values(spark):
    rows = table(spark, 6000)
    cond = F.col("g").isNull() | (F.col("g") != 3)
    small, large = (ranking.percentiles(rows, ["g"], "v", cond, largest=n) for n in (10**6, 100))
    assert held(small.select("g", "median", "p90")) == held(large.select("g", "median", "p90")) and (3,) in held(large.select("g", "median", "p90"))
