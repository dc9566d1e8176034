"""The archive's lists with all their filters, in their own orders; a page of one is `ranking.keyset_page` over the named keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotate import greek_fold

#: Keys of the lists' orders (column, descending), for `ranking.keyset_page`.
ARTICLE_ORDER = [("first_discovered_at", True), ("article_id", True)]
EVENT_ORDERS = {"latest": [("ended_at", True), ("event_id", True)], "biggest": [("articles", True), ("ended_at", True), ("event_id", True)]}
ROOT_ORDERS = {"name": [("sort_name", False), ("entity_id", False)], "articles": [("articles", True), ("sort_name", False), ("entity_id", False)]}
PICKER_ORDER = [("rank", False), ("normalized", False), ("entity_id", False)]


def _there(rows: DataFrame, ids: DataFrame, key: str, wanted: bool) -> DataFrame:
    """The rows whose key is among `ids`, or those whose key is not."""
    return rows.join(ids.select(key).distinct(), key, "left_semi" if wanted else "left_anti")


def articles(rows: DataFrame, provenance: DataFrame, marks: DataFrame, languages: DataFrame, texts: DataFrame, *, feed=None, unread: bool | None = None, starred: bool | None = None, language: str | None = None, has_text: bool | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """Articles with their read and starred marks: of a feed, read or unread, starred or not, in a language, with or without text, discovered on the
    UTC days from `after` on and before `before`.

    `provenance`: article_id, feed_id; `marks`: article_id, read, starred; `languages`: article_id, language (the current one); `texts`: article_id.
    """
    day = lambda d: F.lit(d).cast("timestamp")  # noqa: E731  a day begins at its midnight
    if after:
        rows = rows.filter(F.col("first_discovered_at") >= day(after))
    if before:
        rows = rows.filter(F.col("first_discovered_at") < day(before))
    if feed is not None:
        rows = _there(rows, provenance.filter(F.col("feed_id") == feed), "article_id", True)
    if language:
        rows = _there(rows, languages.filter(F.col("language") == language), "article_id", True)
    if has_text is not None:
        rows = _there(rows, texts, "article_id", has_text)
    one = marks.groupBy("article_id").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in ("read", "starred")])
    out = rows.join(one, "article_id", "left").fillna(False, ["read", "starred"])
    if unread is not None:
        out = out.filter(F.col("read") != unread)
    return out if starred is None else out.filter(F.col("starred") == starred)


def events(rows: DataFrame, titles: DataFrame, names: DataFrame, roots: DataFrame, *, status: str | None = None, country: str | None = None, entity=None, start: str | None = None, end: str | None = None, words: list[str] | None = None, least: int = 1) -> DataFrame:
    """Events of a status, a country, with any name of an entity's root, whose span meets [start, end], of `least` stories, and of which every word is in
    some story's title or some entity's name, whatever its case.

    `rows`: event_id, started_at, ended_at, stories, articles, status, country (events without an end are never listed); `titles`: event_id, title (of the
    stories' representatives); `names`: event_id, entity_id, name; `roots`: entity_id, root_id.
    """
    out = rows.filter(F.col("ended_at").isNotNull())
    if status:
        out = out.filter(F.col("status") == status)
    if country:
        out = out.filter(F.col("country") == country.upper())
    if start:
        out = out.filter(F.col("ended_at") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.filter(F.col("started_at") <= F.lit(end).cast("timestamp"))
    if least > 1:
        out = out.filter(F.col("stories") >= least)
    if entity is not None:
        mine = roots.filter(F.col("entity_id") == entity).select("root_id")
        alike = roots.join(mine, "root_id", "left_semi").select("entity_id")
        out = _there(out, _there(names, alike, "entity_id", True), "event_id", True)
    if words:
        text = titles.select("event_id", F.lower("title").alias("text")).unionByName(names.select("event_id", F.lower("name").alias("text")))
        flags = [F.bool_or(F.coalesce(F.col("text").contains(w.lower()), F.lit(False))).alias(f"w{i}") for i, w in enumerate(words)]
        hit = text.groupBy("event_id").agg(*flags).filter(reduce(lambda a, b: a & b, [F.col(f"w{i}") for i in range(len(words))]))
        out = _there(out, hit, "event_id", True)
    return out


def roots(entities: DataFrame, links: DataFrame, items: DataFrame, *, language: str | None = None, status: str | None = None, text: str | None = None, linked: bool | None = None, hidden: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """(entity_id, name, kind, sort_name, variants, item, articles) of roots: in a language, of a status, with or without an item, of some kinds, visible or hidden,
    and with a text in any of their names.

    `entities`: entity_id, authority_id, name, normalized, kind, language, status, hidden; `links`: article_id, entity_id (a root's own, as its variants' articles
    are moved to it); `items`: entity_id, item.
    """
    own = entities.filter(F.col("authority_id").isNull() & (F.coalesce("hidden", F.lit(False)) == hidden))
    if kinds:
        own = own.filter(F.col("kind").isin(*kinds))
    if language is not None:
        own = own.filter(F.col("language") == language)
    if status is not None:
        own = own.filter(F.col("status") == status)
    if text and text.strip():
        part = text.strip().lower()
        held = lambda c: F.coalesce(F.col(c).contains(part), F.lit(False))
        root = F.coalesce("authority_id", "entity_id").alias("root_id")
        hit = entities.select(root, "authority_id", F.lower("name").alias("low"), "normalized").filter((F.col("authority_id").isNull() & held("low")) | held("normalized"))
        own = own.join(hit.select(F.col("root_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    one = items.groupBy("entity_id").agg(F.min("item").alias("item"))
    out = own.select("entity_id", "name", "kind", F.lower("name").alias("sort_name")).join(one, "entity_id", "left")
    if linked is not None:
        out = out.filter(F.col("item").isNotNull() == linked)
    variants = entities.filter("authority_id IS NOT NULL").groupBy(F.col("authority_id").alias("entity_id")).agg(F.count("*").alias("variants"))
    used = links.groupBy("entity_id").agg(F.count_distinct("article_id").alias("articles"))
    return out.join(variants, "entity_id", "left").join(used, "entity_id", "left").fillna(0, ["variants", "articles"])


def picker(entities: DataFrame, links: DataFrame, prefixes: list[str], countries: list[str] | None = None) -> DataFrame:
    """(entity_id, name, normalized, kind, rank) of visible roots in use of which a name begins with one of the folded prefixes: countries that the text
    names in another spelling first (rank 0), all others after (rank 1). `entities`: as in `roots`."""
    root = F.coalesce("authority_id", "entity_id").alias("root_id")
    keys = [greek_fold(F.lit(p)) for p in prefixes] or [F.lit("")]
    begins = reduce(lambda a, b: a | b, [F.col("normalized").startswith(k) for k in keys])
    used = links.select("entity_id").distinct().join(entities.select("entity_id", root), "entity_id").select(F.col("root_id").alias("entity_id")).distinct()
    own = entities.filter(F.col("authority_id").isNull() & ~F.coalesce("hidden", F.lit(False))).select("entity_id", "name", "normalized", "kind").join(used, "entity_id", "left_semi")
    hit = entities.filter(begins).select(root).distinct().withColumn("hit", F.lit(True)).withColumnRenamed("root_id", "entity_id")
    named = F.lit(False)
    if countries:
        named = (F.col("kind") == "GPE") & F.col("normalized").isin(*countries)
    rows = own.join(hit, "entity_id", "left").filter(F.col("hit") | named)
    return rows.select("entity_id", "name", "normalized", "kind", F.when(named, 0).otherwise(1).alias("rank"))


def keyword_picker(keywords: DataFrame, links: DataFrame, prefix: str) -> DataFrame:
    """(keyword_id, text, normalized) of keywords in use that begin with the folded prefix. `keywords`: keyword_id, text, normalized; `links`: article_id, keyword_id."""
    fit = keywords.filter(F.col("normalized").startswith(greek_fold(F.lit(prefix.strip()))))
    return fit.join(links.select("keyword_id").distinct(), "keyword_id", "left_semi").select("keyword_id", "text", "normalized")


def folded(name: Column) -> Column:
    """The form in which names are looked up: lower case without Greek accents, white space as one space."""
    return F.trim(F.regexp_replace(greek_fold(name), r"\s+", " "))
