"""Readers and writers: feed files, pages, exports and versioned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import plain_text
from ..operators.ingest import newest_revision

#: The elements of RSS items and Atom entries that are read.
ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("guid", "title", "link", "description", "pubDate")])
ENTRY = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", T.StringType())]))), T.StructField("summary", T.StringType()), T.StructField("updated", T.StringType())])


def feed_date(text: Column) -> Column:
    """RFC 2822 with or without the weekday and seconds, or ISO 8601."""
    t = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(t, r"\b(GMT|UT|UTC|Z)$", "+0000")
    forms = [F.try_to_timestamp(t, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")]
    return F.coalesce(*forms, F.try_to_timestamp(text))


def absolute(link: Column, base: Column) -> Column:
    """A link as it stands, or joined to its feed's scheme and host."""
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    return F.when(link.rlike("^https?://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))


def read_feed(spark: SparkSession, path: str, base: str, atom: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, invalid): guid, title, url, description without tags, published_at; entries without a title or link are invalid."""
    raw = spark.read.format("xml").option("rowTag", "entry" if atom else "item").schema(ENTRY if atom else ITEM).load(path)
    if atom:
        raw = raw.select(F.col("id").alias("guid"), "title", F.element_at("link", 1)["_href"].alias("link"), F.col("summary").alias("description"), F.col("updated").alias("pubDate"))
    rows = raw.select(F.coalesce("guid", "link").alias("guid"), F.nullif(F.trim("title"), F.lit("")).alias("title"), absolute(F.trim("link"), F.lit(base)).alias("url"), plain_text(F.coalesce("description", F.lit(""))).alias("description"), feed_date(F.col("pubDate")).alias("published_at"))
    good = F.col("title").isNotNull() & F.col("url").isNotNull()
    return rows.filter(good), rows.filter(~good)


def feed_links(pages: DataFrame) -> DataFrame:
    """(page_id, place, href): alternate links to feeds in page order, absolute, each once."""
    found = F.regexp_extract_all("html", F.lit(r'(?i)(<link\b[^>]*type="application/(?:rss|atom)\+xml"[^>]*>)'), 1)
    rows = pages.select("page_id", "url", F.posexplode(found).alias("place", "tag")).withColumn("href", absolute(F.regexp_extract("tag", r'(?i)href="([^"]*)"', 1), F.col("url")))
    return rows.groupBy("page_id", "href").agg(F.min("place").alias("place"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, href, n): links of each page."""
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count("*").alias("n"))


def export_articles(articles: DataFrame, sources: DataFrame, entities: DataFrame, top: int = 5, csv: bool = True) -> DataFrame:
    """Rows to write: id, sorted sources and top entities; for CSV lists are joined and a leading = + - @ is made harmless."""
    names = sources.groupBy("article_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    ranked = entities.groupBy("article_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("occurrence_count")).alias("n"), "name", "entity_id"))), lambda e: e["name"]), 1, top).alias("entities"))
    out = articles.join(names, "article_id", "left").join(ranked, "article_id", "left")
    if not csv:
        return out

    def safe(c: Column) -> Column:
        return F.when(F.left(c, F.lit(1)).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)).otherwise(c)

    for c in ("sources", "entities"):
        out = out.withColumn(c, safe(F.array_join(c, "; ")))
    return out


def write_documents(documents: DataFrame, path: str, stored: DataFrame | None = None, key: str = "article_id") -> None:
    """The newest revision of each document; a write older than the stored one changes nothing. Each version is a folder of its own."""
    rows = documents if stored is None else stored.unionByName(documents)
    newest_revision(rows, [key], F.col("revision")).write.parquet(path)
