"""Two subjects side by side: what only one has, what both have, and how they moved over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sides(links: DataFrame, subject: str, a, b, item: str) -> DataFrame:
    """Per item whether subject `a` and subject `b` have it. One pass: an item's rows are combined before the shuffle."""
    rows = links.filter(F.col(subject).isin(a, b) & F.col(item).isNotNull())
    return rows.groupBy(item).agg(F.max(F.col(subject) == F.lit(a)).alias("in_a"), F.max(F.col(subject) == F.lit(b)).alias("in_b"))


def overlap(links: DataFrame, subject: str, a, b, item: str) -> DataFrame:
    """only_a, both, only_b, union and jaccard (null where neither has an item)."""
    s = sides(links, subject, a, b, item)
    n = s.agg(F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"), F.count_if(F.col("in_a") & F.col("in_b")).alias("both"), F.count_if(~F.col("in_a") & F.col("in_b")).alias("only_b"), F.count("*").alias("union"))
    return n.withColumn("jaccard", F.when(F.col("union") > 0, F.round(F.col("both") / F.col("union"), 4)))


def part(links: DataFrame, subject: str, a, b, item: str, which: str) -> DataFrame:
    """Items of a part: only_a, both or only_b."""
    test = {"only_a": F.col("in_a") & ~F.col("in_b"), "both": F.col("in_a") & F.col("in_b"), "only_b": ~F.col("in_a") & F.col("in_b")}[which]
    return sides(links, subject, a, b, item).filter(test).select(item)


def related(links: DataFrame, others: DataFrame, subject: str, a, b, other: str, k: int = 10, item: str = "article_id") -> DataFrame:
    """Other keys of the items of either side by how many items of each they have; the subjects themselves are left out."""
    s = sides(links, subject, a, b, item)
    rows = others.select(item, other).distinct().join(s, item)
    if other == subject:
        rows = rows.filter(~F.col(other).isin(a, b))
    n = rows.groupBy(other).agg(F.count_if("in_a").alias("a"), F.count_if("in_b").alias("b"))
    return n.orderBy((F.col("a") + F.col("b")).desc(), other).limit(k)


def timelines(links: DataFrame, subject: str, a, b, at: str, first: str, last: str, item: str = "article_id") -> DataFrame:
    """Items a day on each side, zeros included."""
    days = links.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"), F.expr("interval 1 day"))).alias("day"))
    rows = links.filter(F.col(subject).isin(a, b)).select(subject, item, F.date_trunc("day", at).alias("day")).distinct()
    n = rows.groupBy("day").agg(F.count_if(F.col(subject) == F.lit(a)).alias("a"), F.count_if(F.col(subject) == F.lit(b)).alias("b"))
    return days.join(n, "day", "left").fillna(0, ["a", "b"])
