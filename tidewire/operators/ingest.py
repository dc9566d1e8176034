"""Ingestion: first writers, latest titles, content changes and incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_articles(entries: DataFrame, key: str = "normalized_url", order: str = "seq") -> DataFrame:
    """One article a key: the first entry keeps id and date, the latest gives the title. Both in one aggregation."""
    return entries.groupBy(key).agg(F.min_by("entry_id", order).alias("article_id"), F.min_by("published_at", order).alias("published_at"), F.max_by("title", order).alias("title"), F.count("*").alias("entries"))


def dedup_discoveries(entries: DataFrame, order: str = "seq") -> DataFrame:
    """One row a feed and article, then one a feed and guid; the first stays, with the latest title."""
    one = entries.groupBy("feed_id", "article_id").agg(F.min_by(F.struct("guid", order), order).alias("f"), F.max_by("title", order).alias("title"))
    return one.select("feed_id", "article_id", "title", "f.guid", F.col(f"f.{order}").alias(order)).groupBy("feed_id", "guid").agg(F.min_by(F.struct("article_id", "title"), order).alias("r")).select("feed_id", "guid", "r.*")


def changed(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of rows that are new or differ in a column, nulls being values."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    rows = new.alias("n").join(old.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "left")
    return rows.filter(F.col(f"o.{key}").isNull() | ~same).select(F.col(f"n.{key}").alias(key))


def track_content(extracted: DataFrame, contents: DataFrame) -> DataFrame:
    """A new hash shifts the stored one to previous and counts a change; the same hash only moves the extraction time."""
    rows = extracted.alias("e").join(contents.alias("c"), "article_id", "left")
    new = F.sha2(F.col("e.text"), 256)
    moved = F.col("c.content_hash").isNotNull() & (F.col("c.content_hash") != new)
    return rows.select(
        "article_id", new.alias("content_hash"), F.when(moved, F.col("c.content_hash")).otherwise(F.col("c.previous_content_hash")).alias("previous_content_hash"),
        (F.coalesce("c.change_count", F.lit(0)) + moved.cast("int")).alias("change_count"), F.when(moved | F.col("c.content_hash").isNull(), F.col("e.extracted_at")).otherwise(F.col("c.last_content_change_at")).alias("last_content_change_at"),
    )


def input_document(articles: DataFrame, discoveries: DataFrame) -> DataFrame:
    """Title and body, or title and different descriptions where there is no body; sections with their offsets, and a fingerprint."""
    first = discoveries.filter(F.col("description") != "").groupBy("article_id", F.lower("description").alias("folded")).agg(F.min(F.struct("discovered_at", "feed_id", "description")).alias("d"))
    found = first.groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["description"]).alias("descriptions"))
    rows = articles.join(found, "article_id", "left")
    rest = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.array("text")).otherwise(F.coalesce("descriptions", F.array().cast("array<string>")))
    parts = rows.withColumn("sections", F.concat(F.array("title"), rest))
    ends = F.aggregate("sections", F.array().cast("array<int>"), lambda a, s: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + 2, F.lit(0)) + F.length(s))))
    return parts.withColumn("text", F.array_join("sections", "\n\n")).withColumn("ends", ends).select("article_id", "text", "ends", F.sha2("text", 256).alias("fingerprint"))


def stale(documents: DataFrame, states: DataFrame, processors: DataFrame, force: bool = False) -> DataFrame:
    """(article, processor) that never ran or ran on another input, version or configuration. All processors come as one row, so each document is widened where it is read."""
    all_of_them = processors.agg(F.collect_list(F.struct("processor", "version")).alias("p"))
    wanted = documents.select("article_id", "fingerprint").join(F.broadcast(all_of_them)).select("article_id", "fingerprint", F.inline("p"))
    held = states.select("article_id", "processor", F.col("fingerprint").alias("old_fingerprint"), F.col("version").alias("old_version"))
    rows = wanted.join(held, ["article_id", "processor"], "left")
    if not force:
        rows = rows.filter(F.col("old_fingerprint").isNull() | (F.col("old_fingerprint") != F.col("fingerprint")) | (F.col("old_version") != F.col("version")))
    return rows.select("article_id", "processor")


def newest_revision(rows: DataFrame, key: list[str], revision: Column) -> DataFrame:
    """Of each key the row of the highest revision; stale writes are those that do not come through."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), revision).alias("r")).select(*key, "r.*")


def import_new(new: DataFrame, held: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not an active one's; retired keys may come back."""
    return new.dropDuplicates([key]).join(held.filter(F.col("retired_at").isNull()).select(key), key, "left_anti")
