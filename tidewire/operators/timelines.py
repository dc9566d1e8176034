"""Series over days and other buckets, dense with zeros, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Finest first; a series has at most LIMIT buckets.
INTERVALS = ("hour", "day", "week", "month", "year")
LIMIT = 200


def extent(rows: DataFrame, at: str) -> DataFrame:
    return rows.agg(F.min(at).alias("first"), F.max(at).alias("last"))


def bucket_count(first: Column, last: Column, interval: str) -> Column:
    a, b = F.date_trunc(interval, first), F.date_trunc(interval, last)
    if interval == "month":
        return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) + 1
    if interval == "year":
        return F.year(b) - F.year(a) + 1
    seconds = {"hour": 3600, "day": 86400, "week": 7 * 86400}[interval]
    return ((F.unix_seconds(b) - F.unix_seconds(a)) / seconds).cast("int") + 1


def choose_interval(rows: DataFrame, at: str, interval: str | None = None) -> str:
    """The finest interval of at most LIMIT buckets over the rows' extent; an explicit one that passes it is an error."""
    n = extent(rows, at).select(*[bucket_count(F.col("first"), F.col("last"), i).alias(i) for i in INTERVALS]).first()
    if interval:
        if (n[interval] or 0) > LIMIT:
            raise ValueError(f"more than {LIMIT} buckets of one {interval}")
        return interval
    return next((i for i in INTERVALS if (n[i] or 0) <= LIMIT), INTERVALS[-1])


def histogram(rows: DataFrame, at: str, interval: str, group: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Counts by bucket from the first to the last (of the rows, or as given), zeros included."""
    group = group or []
    counts = rows.filter(F.col(at).isNotNull()).groupBy(*group, F.date_trunc(interval, at).alias("bucket")).agg(F.count("*").alias("n"))
    lo = F.lit(first).cast("timestamp") if first else F.min("bucket")
    hi = F.lit(last).cast("timestamp") if last else F.max("bucket")
    ends = counts.groupBy(*group).agg(lo.alias("lo"), hi.alias("hi")) if not (first and last) or group else counts.sparkSession.range(1).select(lo.alias("lo"), hi.alias("hi"))
    spine = ends.select(*group, F.explode(F.sequence(F.date_trunc(interval, "lo"), F.date_trunc(interval, "hi"), F.expr(f"interval 1 {interval}"))).alias("bucket"))
    return spine.join(counts, [*group, "bucket"], "left").fillna(0, ["n"])


def with_spikes(days: DataFrame, group: list[str] | None = None, look_back: int = 7, factor: float = 2.0) -> DataFrame:
    """A day is a spike when it has rows and at least `factor` times the mean of the `look_back` days before, all of which must exist."""
    w = Window.partitionBy(*(group or [])).orderBy("bucket")
    past = w.rowsBetween(-look_back, -1)
    mean = F.avg("n").over(past)
    full = F.count("n").over(past) == look_back
    return days.withColumn("mean_before", mean).withColumn("spike", full & (F.col("n") > 0) & (F.col("n") >= factor * F.col("mean_before")))


def rising(links: DataFrame, key: list[str], at: str, as_of: str, subject: str = "article_id", least: int = 3, factor: float = 2.0, busiest: int = 50, k: int = 10, unit: str = "day", past: int = 7) -> DataFrame:
    """Keys of the last unit that have `least` subjects and `factor` times their mean of the `past` units before."""
    now = F.lit(as_of).cast("timestamp")
    day, week = now - F.expr(f"interval 1 {unit}"), now - F.expr(f"interval {past + 1} {unit}")
    rows = links.filter((F.col(at) > week) & (F.col(at) <= now)).select(*key, subject, (F.col(at) > day).alias("recent")).distinct()
    n = rows.groupBy(*key).agg(F.count_if("recent").alias("today"), F.count_if(~F.col("recent")).alias("before"))
    top = n.filter(F.col("today") >= least).orderBy(F.desc("today"), *key).limit(busiest)
    out = top.withColumn("mean_before", F.col("before") / past).filter(F.col("today") >= factor * F.col("mean_before"))
    return out.withColumn("ratio", F.col("today") / (F.col("mean_before") + 1)).orderBy(F.desc("ratio"), *key).limit(k)
