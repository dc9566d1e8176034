"""Rankings, top rows of groups, counts under conditions, and pages. Ties always go by a stated key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_rank(links: DataFrame, by: list[str], subject: str = "article_id", k: int | None = 10, name: str = "articles") -> DataFrame:
    """Values of `by` by the number of different subjects, most first, ties by value; the first `k`."""
    out = links.select(*by, subject).distinct().groupBy(*by).agg(F.count("*").alias(name))
    return out.orderBy(F.desc(name), *by).limit(k) if k else out


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows of each group with their rank. Spark drops rows beyond `n` before the shuffle (window group limit)."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


def first_per_group(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """One row a group: the least by `order`. An aggregate, so it is combined before the shuffle and a hot group is no burden."""
    rest = [c for c in rows.columns if c not in group]
    key = F.struct(*order).alias("o")
    picked = rows.groupBy(*group).agg(F.min_by(F.struct(*rest), key).alias("r"))
    return picked.select(*group, "r.*")


def conditional_counts(rows: DataFrame, group: list[str], **conditions: Column) -> DataFrame:
    """Several counts in one pass, each under its own condition."""
    return rows.groupBy(*group).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def modal_value(rows: DataFrame, group: list[str], value: str, subject: str = "article_id") -> DataFrame:
    """Per group the value of most different subjects; alphabetical on ties."""
    n = rows.filter(F.col(value).isNotNull()).select(*group, value, subject).distinct().groupBy(*group, value).agg(F.count("*").alias("n"))
    return n.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def with_truncation(ranked: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first `k` rows, each telling whether there were more. Only k + 1 rows are ever sorted together."""
    head = ranked.orderBy(*order).limit(k + 1)
    flagged = head.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return flagged.withColumn("truncated", F.max("place").over(Window.partitionBy()) > k).filter(F.col("place") <= k).drop("place")


def keyset_page(rows: DataFrame, keys: list[tuple[str, bool]], after: list | None, limit: int) -> DataFrame:
    """The next rows past `after` in the order of `keys` (column, descending); one more than `limit` shows that there is another page."""
    if after is not None:
        steps = []
        for i, (name, down) in enumerate(keys):
            same = [F.col(c).eqNullSafe(F.lit(v)) for (c, _), v in zip(keys[:i], after[:i], strict=True)]
            further = F.col(name) < F.lit(after[i]) if down else F.col(name) > F.lit(after[i])
            if down:
                further = further | (F.col(name).isNull() & F.lit(after[i]).isNotNull())
            steps.append(reduce(lambda a, b: a & b, [*same, further]))
        rows = rows.filter(reduce(lambda a, b: a | b, steps))
    return rows.orderBy(*[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in keys]).limit(limit + 1)


def terms(docs: DataFrame, path: Column, k: int, subject: str = "article_id", within: Column | None = None) -> DataFrame:
    """Most frequent values of an array (or of records in it that pass `within`), counted by subject, with a truncation flag.

    `docs` has one row a subject, so an array without repeats needs no distinct: only partial counts of values are shuffled.
    """
    rows = docs.select(F.explode(F.array_distinct(path)).alias("value"))
    if within is not None:
        rows = rows.filter(within)
    return with_truncation(rows.groupBy("value").agg(F.count("*").alias("articles")), [F.desc("articles"), F.col("value")], k)


#: Rows of a group that one task's aggregate may hold.
LARGEST = 1_000_000


def percentiles(rows: DataFrame, group: list[str], value: str, when: Column, largest: int = LARGEST) -> DataFrame:
    """Continuous median and 90th percentile of the values under a condition. Where a group has more than `largest` values none is held whole (`exact_quantiles`)."""
    v = F.when(when, F.col(value))
    shares = {"median": 0.5, "p90": 0.9}
    sizes = rows.groupBy(*group).agg(F.count(v).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= largest:
        return rows.groupBy(*group).agg(*[F.percentile(v, F.lit(p)).alias(name) for name, p in shares.items()])
    from .quantiles import exact_quantiles

    found = exact_quantiles(rows, group, v, shares)
    names = [f"__{g}" for g in group]
    same = F.lit(True)
    for g, name in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(name))
    return sizes.drop("n").join(found.withColumnsRenamed(dict(zip(group, names, strict=True))), same, "left").drop(*names)


def map_totals(rows: DataFrame, column: str) -> DataFrame:
    """Sum over a map of counts, by key."""
    return rows.select(F.explode(column).alias("category", "n")).groupBy("category").agg(F.sum("n").alias("n"))
