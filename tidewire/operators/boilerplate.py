"""What the pages of a host have in common: lines that most of them repeat are not an article's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import main_text
from .graph import _kept
from .skew import split_join


def host(url: Column) -> Column:
    """The host of an address, without www; without one, empty."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:www\.)?([^/:?#]+)", 1), F.lit(""))


def page_lines(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, host, lines): the lines of each page's main text."""
    text = main_text(F.coalesce(html, F.lit("")))
    return pages.select(key, host(F.col(url)).alias("host"), F.filter(F.split(text, "\n"), lambda x: x != "").alias("lines"))


def repeated_lines(lines: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(host, line, pages, of): lines on more than `share` of the pages of a host that has `least` pages or more. Counts are combined before the shuffle."""
    each = lines.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    n = lines.groupBy("host").agg(F.count("*").alias("of")).filter(F.col("of") >= least)
    # a line of few pages cannot be one of most pages of a large host; one count a host and line remains
    counts = each.groupBy("host", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") > least * share)
    return split_join(counts, n, ["host"]).filter(F.col("pages") > share * F.col("of")).select("host", "line", "pages", "of")


def without_boilerplate(pages: DataFrame, least: int = 3, share: float = 0.5, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, text, dropped): each page's main text without its host's repeated lines, and how many lines that took.

    A host's repeated lines are fewer than its lines a page over `share`, so they fit beside each page whatever the number of pages; pages of one very
    large host are spread by `split_join`. Pages without a host are their own.
    """
    lines = _kept(page_lines(pages, url, html, key))  # parsed once, read for the counts and the texts
    known = lines.filter("host <> ''")
    sets = repeated_lines(known, least, share).groupBy("host").agg(F.collect_set("line").alias("common"))
    every = known.select("host").distinct().join(sets, "host", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
    rows = split_join(known, every, ["host"]).unionByName(lines.filter("host = ''").withColumn("common", F.array().cast("array<string>")))
    kept = F.filter("lines", lambda x: ~F.array_contains("common", x))
    return rows.select(key, F.array_join(kept, "\n").alias("text"), (F.size("lines") - F.size(kept)).alias("dropped"))
